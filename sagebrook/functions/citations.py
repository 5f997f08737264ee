"""Citation marks `[^n]` and what they cover, as column expressions.

Numbers may have any number of digits: they are kept as text without leading zeros and compared by
length first, so that none is lost or cut.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, trimmed

MARK = "\\[\\^(\\d+)\\]"
_INT_DIGITS = 9  # longer numbers are beyond any count of sources


def cited_numbers(x: Column) -> Column:
    """All numbers in order, repeats included."""
    return F.transform(F.regexp_extract_all(x, F.lit(MARK), 1), lambda s: F.regexp_replace(s, "^0+(?=\\d)", ""))


def distinct_numbers(x: Column) -> Column:
    ordered = F.array_sort(F.transform(F.array_distinct(cited_numbers(x)), lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))
    return F.transform(ordered, lambda p: p["s"])


def in_range(number: Column, sources: Column) -> Column:
    """Whether a number names one of so many sources."""
    return (F.length(number) <= _INT_DIGITS) & F.coalesce(F.try_to_number(F.substring(number, 1, _INT_DIGITS), F.lit("9" * _INT_DIGITS)).between(1, sources), F.lit(False))


def has_citation(x: Column) -> Column:
    return x.rlike(MARK)


def is_heading(x: Column) -> Column:
    """A markdown heading or a line that is bold as a whole."""
    return x.rlike(f"^#{{1,6}}{WS}+") | x.rlike("^\\*\\*[^*]+\\*\\*:?\\z")


def claim_sentences(x: Column) -> Column:
    """Pieces between white space after . ! ? or line breaks that say something; headings and lone marks are none."""
    parts = F.transform(F.split(x, f"(?<=[.!?]){WS}+|\\n+"), trimmed)
    return F.filter(parts, lambda s: (F.length(s) > 0) & F.regexp_replace(s, MARK, "").rlike("[\\p{L}\\p{N}]") & ~is_heading(s))


def validation(answer: Column, sources: Column, threshold: float) -> Column:
    """A struct: cited, valid, invalid (numbers as text), total, uncited, coverage (2 decimals) and ok.

    ok: no number is out of range, at least one is in it, and the unrounded share of claim
    sentences with a mark reaches the threshold.
    """
    numbers, claims = distinct_numbers(answer), claim_sentences(answer)
    covered = F.size(F.filter(claims, has_citation))
    total = F.size(claims)
    share = F.when(total == 0, 0.0).otherwise(covered / total)
    valid = F.filter(numbers, lambda n: in_range(n, sources))
    invalid = F.filter(numbers, lambda n: ~in_range(n, sources))
    return F.struct(
        numbers.alias("cited"), valid.alias("valid"), invalid.alias("invalid"), total.alias("total"), (total - covered).alias("uncited"),
        F.round(share, 2).alias("coverage"), ((F.size(invalid) == 0) & (F.size(valid) > 0) & (share >= threshold)).alias("ok"),
    )


def text_parts(x: Column) -> Column:
    """The text cut around its marks: an array of strings, marks included, empty ones left out."""
    head = "^\\[\\^\\d+\\]"
    pieces = F.transform(F.split(x, "(?=\\[\\^\\d+\\])"), lambda p: F.array(F.regexp_extract(p, head, 0), F.regexp_replace(p, head, "")))
    return F.filter(F.flatten(pieces), lambda s: F.length(s) > 0)
