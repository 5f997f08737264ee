"""Reading the replies of models, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formats import NOT_STATED, UNKNOWN_STUDY
from .text import WS, prefix, trimmed


def reordered(reply: Column, n: Column) -> Column:
    """Places 0 to n-1: those the reply names, in its order, then the rest in theirs."""
    named = F.filter(F.transform(F.regexp_extract_all(reply, F.lit("(\\d+)"), 1), lambda s: F.when(F.length(s) <= 9, s.cast("int"))), lambda i: i.isNotNull() & (i < n))
    rest = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(named, rest))


def judged(reply: Column) -> Column:
    """The first number of a reply within 0 and 1; 0 without any."""
    number = F.nullif(F.regexp_extract(reply, "(\\d*\\.?\\d+)", 1), F.lit(""))
    return F.when(number.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number.cast("double"))))  # least and greatest skip nulls


def json_object(reply: Column) -> Column:
    """From the first { to the last }, fences left out; null where there is none."""
    return F.nullif(F.regexp_extract(F.regexp_replace(reply, "```(?:json)?", ""), "(?s)\\{.*\\}", 0), F.lit(""))


def field(reply: Column, name: str, default: str) -> Column:
    """A trimmed text field of the reply's object, or the default."""
    return F.coalesce(F.nullif(trimmed(F.get_json_object(json_object(reply), f"$.{name}")), F.lit("")), F.lit(default))


# Fields of the object that a model is asked for, and the names they have here.
EVIDENCE_FIELDS = {"studyType": "study_type", "population": "population", "intervention": "intervention", "comparison": "comparison", "outcome": "outcome", "sampleSize": "sample_size", "keyFinding": "key_finding", "evidenceSnippet": "evidence_snippet"}


def evidence(reply: Column, abstract: Column) -> Column:
    """A struct of the evidence in a model's reply: trimmed fields or defaults from the abstract, and flags without blank ones.

    A null reply or one without a readable object gives the defaults and no flags.
    """
    default = {name: F.lit(NOT_STATED) for name in EVIDENCE_FIELDS.values()} | {"study_type": F.lit(UNKNOWN_STUDY), "key_finding": prefix(abstract, 200), "evidence_snippet": prefix(abstract, 160)}
    found = json_object(reply)
    texts = [F.coalesce(F.nullif(trimmed(F.get_json_object(found, f"$.{given}")), F.lit("")), default[name]).alias(name) for given, name in EVIDENCE_FIELDS.items()]
    flags = F.filter(F.transform(F.coalesce(F.from_json(F.get_json_object(found, "$.qualityFlags"), "array<string>"), F.array().cast("array<string>")), trimmed), lambda x: F.length(x) > 0)
    return F.struct(*texts, flags.alias("flags"))


def blank(x: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(x, f"{WS}+", "")), F.lit(0)) == 0
