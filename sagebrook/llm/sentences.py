"""Sentence units of texts in any script, as SQL expressions.

Points that end nothing (decimals, URLs, initials, abbreviations, list numbers, quotations) are
masked with private-use characters of the same length, so that positions stay those of the text.
Script-specific terminator patterns then put a separator after each unit and the text is split
there. Masks are undone by `translate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CHARS, is_blank

# Abbreviations after which a sentence goes on.
ABBREVIATIONS = (
    "Prof Dr Dra Mr Mrs Ms Jr Sr St vs approx ext cf ff al incl resp Inc Ltd Corp Co Gov Sen Gen Capt Rev Hon dept est "
    "örn bkz dah Uzm Ecz Doç Op Av Sn Pzt Sal Çar Per Cum Cmt Paz "
    "ca bzw Abschn evtl ggf inkl Mo Fr env ex sect apdo ej Sra Sto pág Mme Mlle Mon Tue Wed Thu Fri Sat Sun "
    "проф напр см рис тел гр стр доц"
).split()
TITLES = "Prof Dr Dra Mr Mrs Ms Uzm Ecz Doç".split()
# Abbreviations that count only before a number.
BEFORE_NUMBER = "No Nr no nr Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec sec rev fig Fig Figs Abb Tab Şek Sek pp Vol vol Art art Ch ch Sec Sect Kap cap núm п с гл табл Рис Табл n".split()
# Abbreviations that may close a sentence; they do before a capital or a number.
CLOSERS = "etc usw vb vd др".split()
# Words that go on after a quotation which ends in a point.
AFTER_QUOTE = "and or but ve veya ama und oder aber et ou mais y o pero и или но diye dedi asked said wrote sagte fragte dit demande dijo".split()

SEP, SPAN_ON, SPAN_OFF = "\ue0ff", "\ue0f0", "\ue0f1"
POINT = "\ue000"  # a point that ends nothing
OTHER_ENDS = "।॥։።፧។៕။۔"  # of Devanagari, Armenian, Ethiopic, Khmer, Burmese and Urdu
OTHER_TO = "".join(chr(0xE01E + i) for i in range(len(OTHER_ENDS)))  # they are handled as one range: long classes are slow
QUOTED_FROM = "。！？.!?…؟" + OTHER_TO
QUOTED_TO = "".join(chr(0xE00D + i) for i in range(len(QUOTED_FROM)))  # terminators within a quotation
PRIVATE = "[\ue000-\ue0ff]"

_EMOJI = "\\x{1F1E6}-\\x{1FAFF}\u2600-\u27bf\ufe0f\u200d"
_GAP = "[ \\t\u00a0]*\\n?[ \\t\u00a0]*"
_TAIL = f"(?:{_GAP}\\[\\^\\d+\\]|{_GAP}[{_EMOJI}]+)*"
_END = "[.!?…؟\ue01e-\ue026]"
_CLOSE = "(?:[ \u00a0]?»|[\"”“’'」』）)\\]])"
_BLANK = "[\\s\u00a0\u200b\u202f\u3000]"
_LOWER = f"(?!{_BLANK}+\\p{{Ll}}(?!\\p{{Lu}}))"

SPANS = (
    "(“[^“”]*+”|„[^„“”]*+[“”]|«[^«»]*+»|「[^「」]*+」|『[^『』]*+』"
    '|"[^"\\n]*+(?:\\n[^"\\n]++)*+"'
    "|(?:https?://|www\\.)[^\\s\"”»<>]*[^\\s\"”»<>.,;:!?…)\\]]"
    "|[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+)"
)
_HAS_SPAN = '["”“»」』]|://|www\\.|@'


def _word(words: list[str]) -> str:
    """The words as given and in capitals, titles in small letters too."""
    return "(?:" + "|".join(dict.fromkeys([*words, *(w.upper() for w in words if len(w) > 1), *(w.lower() for w in words if w in TITLES)])) + ")"


MASKED_POINT = (
    "\\.(?:"
    "(?=[\\p{Ll}\\p{N}])(?<![\\p{Ll})]{3}\\.)"  # decimals, URLs, file names, e.g.
    "|(?=\\p{Ll})"
    f"|(?<=(?<![\\p{{L}}\\p{{M}}\\p{{N}}]){_word(ABBREVIATIONS)}\\.)"
    f"|(?<=(?<![\\p{{L}}\\p{{M}}\\p{{N}}]){_word(BEFORE_NUMBER)}\\.)(?=[\\s\u00a0]*[\\p{{N}}№])"
    f"|(?<=(?<![\\p{{L}}\\p{{M}}\\p{{N}}]){_word(CLOSERS)}\\.)(?=[\\s\u00a0]*[\\p{{Ll}},;:)\\]](?!\\p{{Lu}}))"
    "|(?<=(?<![\\p{L}\\p{M}\\p{N}/])(?<!\\d[ \u00a0])\\p{L}\\.)(?=[\\s\u00a0]|[-,;)\\p{L}])"  # initials
    "|(?<=\\d\\.)(?=\\s+\\p{Ll}(?!\\p{Lu}))"  # ordinals
    "|(?<=(?:^|\\n)[ \\t]{0,12}\\d{1,3}\\.)(?=\\s)"  # list numbers
    ")"
)

_LISTED = "\\n(?=[ \\t\u00a0]*(?:[-•*‣▪]|\\d{1,3}[.)\ue000])[ \\t\u00a0])"
_PARAGRAPH = "\\n(?=[ \\t\\r\u00a0\u200b]*\\n)"
_SPACED = (
    # plain terminators; before a small letter too
    f"{_END}++(?<!…|\\.\\.){_TAIL}(?:{_END}++{_TAIL})?(?={_BLANK}|$)"
    # an ellipsis goes on before a small letter
    f"|{_END}++(?<=…|\\.\\.){_TAIL}(?:{_END}++{_TAIL})?(?={_BLANK}|$){_LOWER}"
    # a quotation that ends in a point
    f"|[.\ue010](?:[ \u00a0]?»|[\"”“]){_TAIL}(?={_BLANK}|$)(?!{_BLANK}+{_word(AFTER_QUOTE)}\\b)"
    # other closing marks
    f"|[.!?…؟\ue010-\ue026]++{_CLOSE}++{_TAIL}(?={_BLANK}|$){_LOWER}"
    # a missing space before the next sentence
    f"|{_END}++(?<=(?:[\\p{{Ll}}\\p{{N}})%/][\\p{{L}}\\p{{N}})%]|\\d\\])[.!?…؟\ue01e-\ue026]{{1,3}})(?=\\p{{Lu}}(?:[\\p{{Ll}}\\s’']|\\p{{Lu}}{{2}}|\\p{{Lu}}\\s)|[¿¡“«„])"
    f"|{_END}++(?<=\\p{{L}}{{3}}[.!?…؟\ue01e-\ue026]{{1,3}})(?=\\p{{Lu}}\\p{{Ll}})"
    f"|{_END}++(?<=\\p{{Ll}}{{3}}[.!?…؟\ue01e-\ue026]{{1,3}})(?=\\p{{N}})"
    f"|{_END}++(?<=\\p{{IsArabic}}{{2}}[.!?…؟\ue01e-\ue026]{{1,3}})(?=\\p{{IsArabic}})"
    f"|[.!?…؟\ue010-\ue026]++{_CLOSE}*+(?:{_GAP}\\[\\^\\d+\\])++(?=\\p{{L}})"
    f"|[.!?…\ue010-\ue013]++[\"”»](?=\\p{{Lu}}\\p{{Ll}})"
)
_UNSPACED = (
    f"[。！？]++{_TAIL}(?![」』”’）)》。！？])"
    f"|[。！？\ue00d-\ue00f]++[」』”’）)》]++{_TAIL}(?![と，、；：])"
)
_THAI = (
    "(?<=[\u0e00-\u0e7f][”\"»)\\]%]{0,2})[ \\t\\n\u00a0]+(?![\\s(\\[" + _EMOJI + "])"
    "|(?<=\\S)(?<!(?:^|\\n)[ \\t\u00a0]{0,12}[-•*‣▪\\d.)\ue000]{1,12})[ \\t\\n\u00a0]+(?=[\u0e00-\u0e7f])"
)
BOUNDARY = f"{_PARAGRAPH}|{_LISTED}|{_UNSPACED}|{_SPACED}"
BOUNDARY_THAI = f"{BOUNDARY}|{_THAI}"

_BLOCK = 64


def masked(text: Column) -> Column:
    """The text with every point that ends nothing replaced, at unchanged length."""
    spans = F.split(F.regexp_replace(text, SPANS, f"{SPAN_ON}$1{SPAN_OFF}"), f"[{SPAN_ON}{SPAN_OFF}]")
    quoted = F.array_join(F.transform(spans, lambda s, i: F.when(i % 2 == 1, F.translate(s, QUOTED_FROM, QUOTED_TO)).otherwise(s)), "")
    return F.regexp_replace(F.when(text.rlike(_HAS_SPAN), quoted).otherwise(text), MASKED_POINT, POINT)


def unmasked(text: Column) -> Column:
    return F.translate(text, POINT + QUOTED_TO + OTHER_TO, "." + QUOTED_FROM.replace(OTHER_TO, OTHER_ENDS) + OTHER_ENDS)


def with_pieces(df: DataFrame, text: str) -> DataFrame:
    """Adds `_pieces`: the masked text cut after each unit, with nothing lost."""
    whole = F.when(F.col(text).rlike(PRIVATE), F.regexp_replace(text, PRIVATE, "\ufffd")).otherwise(F.col(text))
    given = F.when(F.col(text).rlike("[\u0589\u06d4\u0964-\u17d5]"), F.translate(whole, OTHER_ENDS, OTHER_TO)).otherwise(whole)
    marked = F.when(F.col("_m").rlike("[\u0e00-\u0e7f]"), F.regexp_replace("_m", BOUNDARY_THAI, f"$0{SEP}")).otherwise(F.regexp_replace("_m", BOUNDARY, f"$0{SEP}"))
    return df.withColumn("_m", masked(given)).withColumn("_pieces", F.split(marked, SEP)).drop("_m")


def sentence_units(df: DataFrame, text: str = "content", keep: list[str] | None = None) -> DataFrame:
    """One row for each sentence unit of each row: `keep`, unit_no (from 1), start_char, end_char, unit.

    Null, empty and blank texts give no rows. Rows are taken as they come: repeated rows give
    repeated units. Columns named like the outputs, or like the columns used in between, are left out.
    Characters of the private-use block used for masks come out as U+FFFD in `unit`; positions
    are right all the same. Positions count code points from 0; end_char follows the last
    character that is not blank.
    """
    taken = (text, "unit_no", "start_char", "end_char", "unit", "_text", "_m", "_pieces", "_lens", "_sums", "_starts", "_i", "_u")
    keep = keep if keep is not None else [c for c in df.columns if c not in taken]
    base = with_pieces(df.where(~is_blank(F.col(text))).select(*keep, F.col(text).alias("_text")), "_text").drop("_text")
    lens = F.transform("_pieces", F.length)
    blocks = F.sequence(F.lit(0), F.floor((F.size("_lens") - 1) / _BLOCK).cast("int"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    block = lambda b: F.slice("_lens", b * _BLOCK + 1, F.lit(_BLOCK))
    within = lambda own, before: F.transform(own, lambda _, i: before + total(F.slice(own, F.lit(1), i)))
    starts = F.flatten(F.transform(blocks, lambda b: F.transform(F.array(block(b)), lambda own: within(own, total(F.slice("_sums", F.lit(1), b))))[0]))
    cut = (
        base.withColumn("_lens", lens)
        .withColumn("_sums", F.transform(blocks, lambda b: total(block(b))))
        .withColumn("_starts", starts)
        .select(*keep, F.posexplode(F.arrays_zip("_pieces", "_starts")).alias("_i", "_u"))
    )
    bare = F.rtrim(F.col("_u._pieces"), F.lit(BLANK_CHARS))
    lead = F.length(bare) - F.length(F.ltrim(bare, F.lit(BLANK_CHARS)))
    return cut.where(F.length(bare) > lead).select(
        *keep,
        (F.col("_i") + 1).alias("unit_no"),
        (F.col("_u._starts") + lead).alias("start_char"),
        (F.col("_u._starts") + F.length(bare)).cast("int").alias("end_char"),
        unmasked(F.ltrim(bare, F.lit(BLANK_CHARS))).alias("unit"),
    )
