"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of JavaScript, which is more than \s here.
WS = "[\\s\\x0b\\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
TURKISH_LETTERS = "[çğıöşüÇĞİÖŞÜ]"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}+|{WS}+\\z", "")


def collapsed(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return trimmed(F.regexp_replace(x, f"{WS}+", " "))


def without_tags(x: Column) -> Column:
    return collapsed(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]+>", ""))


def normal_title(x: Column) -> Column:
    """Lower case; all but a-z and 0-9 are separators."""
    return F.btrim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def without_pdf_suffix(x: Column) -> Column:
    return F.regexp_replace(x, "(?i)\\.pdf\\z", "")


def safe_filename(x: Column) -> Column:
    return F.regexp_replace(x, "[^a-zA-Z0-9._-]", "_")


def prefix(x: Column, n: int) -> Column:
    return F.substring(x, 1, n)


def turkish_share(x: Column) -> Column:
    return F.coalesce(F.try_divide(F.regexp_count(x, F.lit(TURKISH_LETTERS)).cast("double"), F.length(x)), F.lit(0.0))


def document_language(x: Column) -> Column:
    """tr where more than 0.5 % of the first 5,000 characters are Turkish letters, else en."""
    return F.when(turkish_share(F.substring(F.coalesce(x, F.lit("")), 1, 5000)) > 0.005, "tr").otherwise("en")


def query_language(x: Column) -> Column:
    """tr where more than 1 % are Turkish letters or any of ş ğ ü ö ç occurs, else en."""
    return F.when((turkish_share(x) > 0.01) | x.rlike("[şğüöçŞĞÜÖÇ]"), "tr").otherwise("en")


def estimated_tokens(text: Column, language: Column) -> Column:
    return F.ceil(F.length(text) / F.when(language == "tr", 3).otherwise(4)).cast("long")


def packing_sentences(x: Column) -> Column:
    """Cut at white space between . ! ? and a Latin or Turkish capital; blank pieces dropped."""
    return F.filter(F.split(x, f"(?<=[.!?]){WS}+(?=[A-ZÇĞİÖŞÜ])"), lambda s: F.length(trimmed(s)) > 0)


def is_section_heading(x: Column) -> Column:
    """Short, and either numbered with a capital or a capital followed by at most sixty characters without . ! ?"""
    numbered = x.rlike(f"^[\\d.]+{WS}+[A-Z]")
    titled = x.rlike("^[A-ZÇĞİÖŞÜ][^.!?]{0,60}\\z")
    return (F.length(x) < 80) & (numbered | titled)


def blocks(x: Column) -> Column:
    """Trimmed blocks between blank lines, newlines within them as blanks, empty ones dropped."""
    return F.filter(F.transform(F.split(x, f"\\n{WS}*\\n"), lambda b: trimmed(F.translate(b, "\n", " "))), lambda b: F.length(b) > 0)


def with_section(section: Column, text: Column) -> Column:
    return F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("["), section, F.lit("] "), text)).otherwise(text)


def embedding_text(header: Column, content: Column) -> Column:
    return F.when(F.coalesce(header, F.lit("")) != "", F.concat(header, F.lit("\n\n"), content)).otherwise(content)


def form_encoded(x: Column) -> Column:
    return F.url_encode(x)


def component_encoded(x: Column) -> Column:
    return F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))


def redacted(x: Column) -> Column:
    """A connection string without its password."""
    return F.regexp_replace(x, "://([^:/@]+):[^@]*@", "://$1:***@")


def listed_bytes(n: Column) -> Column:
    """0 B for null and 0; one decimal below 10 beyond bytes; GB at most."""
    out = F.lit("0 B")
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        v = n / F.lit(float(1024**k))
        text = F.when((v < 10) & F.lit(k > 0), F.format_string(f"%.1f {unit}", F.round(v, 1))).otherwise(F.concat(F.round(v, 0).cast("long").cast("string"), F.lit(f" {unit}")))
        low = 1 if k == 0 else 1024**k
        out = F.when((n >= low) & F.lit(k == 3), text).when((n >= low) & (n < 1024 ** (k + 1)), text).otherwise(out)
    return F.when(n.isNull() | (n <= 0), "0 B").otherwise(out)


# How gone-by time is shown.
JUST_NOW, MINUTES, HOURS, DAYS = "az önce", " dk önce", " sa önce", " gün önce"


def elapsed(now: Column, then: Column) -> Column:
    """Time gone by as minutes, hours or days, rounded down."""
    minutes = F.floor((F.unix_millis(now) - F.unix_millis(then)) / 60_000)
    return (
        F.when(minutes < 1, JUST_NOW)
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(MINUTES)))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit(HOURS)))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit(DAYS)))
    )
