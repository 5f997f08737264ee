"""Per-document text statistics, and the kind of text they show."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of the languages at hand.
COMMON_WORDS = frozenset(
    "the of and to in is for with a an that be not are by on as at or it from this which "
    "ve bir bu ile için da de olarak sonra veya ya göre daha en çok olan gibi kadar "
    "der die das und von mit für ist ein eine den im zu nicht bei auf nach oder wie "
    "el la los las de en que y con por para un una se del no es al como "
    "le les des et du une est dans pour par sur pas au avec qui ne "
    "и в на с по не от до для как что при или из о к за "
    "في من على إلى عن مع أو لا ما هذا قبل بعد حتى".split()
)
# Frequent function words of languages that don't space words.
UNSPACED_WORDS = "の に は を が で と も した して です ます これ この 的 了 是 在 和 不 有 与 或 请 可以 以及 之后 之前 ที่ และ ใน ของ เป็น การ ให้ ได้ ไม่ กับ หรือ จาก".split()
# Words of page navigation.
NAVIGATION_WORDS = frozenset("menu home print share login logout search sitemap cookies rss top next previous back contact copyright subscribe privacy terms giriş ara anasayfa yazdır paylaş menü iletişim startseite drucken suche anmelden accueil imprimer recherche inicio buscar imprimir".split())

LIST_LINE = re.compile(r"\s*(?:[-•*–‣▪◦·]\s|\(?\d{1,3}[.)]\s|[a-zA-Z][.)]\s)")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TERMINAL = re.compile(r"[.!?…؟。！？:]['\"”’»“」)\]]*(?:\s*\[\^\d+\])*\s*$")
_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-’“”„«»…。，、；：！？「」（）؟،؛%/\[\]^°|•*–̀-ͯ฀-๿ؐ-ًؚ-ٟ]")
_CODE = re.compile(r"(?=.*\d)(?=.*[A-Za-z])|[a-z][A-Z][a-zA-Z]*[a-z][A-Z]")
_DELIMITERS = ("\t", "|", ";", ",")
_GAPS = re.compile(r" {2,}")
_NUMBER = re.compile(r"[<>≤≥±~(]?\s*[-+]?\d[\d.,]*\s*(?:[^\W\d]{1,6}|%)?(?:/\S{1,8})?\)?$")

LEXICAL = ("n_chars", "n_lines", "n_words", "mean_word_length", "letter_ratio", "punctuation_end_share", "common_word_share")  # by expressions
COLUMNS = {
    "symbol_ratio": "double", "distinct_word_share": "double", "repeated_line_share": "double", "compressed_share": "double",
    "delimiter_alignment": "double", "indent_periodicity": "double", "line_length_autocorrelation": "double", "list_share": "double", "table_share": "double", "junk_share": "double", "text_kind": "string",
}


def autocorrelation(x: np.ndarray, most: int = 4) -> float:
    """The largest autocorrelation at lags 1 to `most`; 0 where there are too few values, 1 where all are equal."""
    if len(x) < 4:
        return 0.0
    y = x - x.mean()
    var = float(y @ y)
    if var < 1e-9:
        return 1.0
    return float(max((y[:-k] @ y[k:]) / var * len(x) / (len(x) - k) for k in range(1, min(most, len(x) - 2) + 1)))


def indent_periodicity(indents: np.ndarray, most: int = 4) -> float:
    """Largest share of lines whose indentation comes again after 1 to `most` lines, if any line is indented."""
    if len(indents) < 4 or not indents.any():
        return 0.0
    return float(max((indents[:-k] == indents[k:]).mean() for k in range(1, min(most, len(indents) - 2) + 1)))


def _two_columns(lines: list[str], mark: str | re.Pattern) -> bool:
    """Whether lines with one delimiter each are rows of a table and not a sentence's commas or items of a list."""
    if any(LIST_LINE.match(s) for s in lines):
        return False
    pairs = [[c.strip() for c in (s.split(mark) if isinstance(mark, str) else mark.split(s.strip()))] for s in lines]
    both = sum(len(p) == 2 and all(p) for p in pairs)  # else the delimiter indents or ends the lines
    if any(len(p) != 2 for p in pairs) or both < 3 or 2 * both <= len(lines):
        return False
    if isinstance(mark, str) and mark in ",;":
        if any(mark + " " in s for s in lines):
            return False
    elif isinstance(mark, str):
        return True
    at = {s.index(mark) if isinstance(mark, str) else len(s.rstrip()) - len(b) for s, (_, b) in zip(lines, pairs)}
    numbers = [all(_NUMBER.match(p[c]) for p in pairs[1:]) for c in (0, 1)]
    return len(at) == 1 or any(numbers)


def table_rows(lines: list[str]) -> np.ndarray:
    """Which lines stand in a table: at least three together, cut by one delimiter into as many cells.

    Cells are short, except between tabs and bars. One delimiter a line is enough where it stands
    in one column, where a cell is a number in all lines after the first, or where it is a tab or bar.
    """
    rows = np.zeros(len(lines), bool)
    if len(lines) < 3:
        return rows
    for mark in (*_DELIMITERS, _GAPS):
        if isinstance(mark, str):
            counts = np.array([s.count(mark) for s in lines])
        else:
            counts = np.array([len(mark.findall(s.strip("\r\n").lstrip())) for s in lines])
        if (counts >= 1).sum() < 3:
            continue
        i = 0
        while i < len(lines):
            j = i + 1
            while j < len(lines) and counts[j] == counts[i]:
                j += 1
            if counts[i] >= 1 and j - i >= 3 and (counts[i] >= 2 or _two_columns(lines[i:j], mark)):
                cells = [c for s in lines[i:j] for c in (s.split(mark) if isinstance(mark, str) else mark.split(s.strip()))]
                ended = sum(bool(_TERMINAL.search(s)) for s in lines[i:j]) / (j - i)
                filled = 2 * sum(bool(c.strip()) for c in cells) > len(cells)
                if (mark in ("\t", "|") and filled or sum(map(len, cells)) / max(1, len(cells)) < 30) and ended < 0.5:
                    rows[i:j] = True
            i = j
    return rows


def _variety(words: list[str], window: int = 200) -> float:
    """Share of distinct words, averaged over windows, so that it doesn't fall with a text's length."""
    shares = [len(set(words[i : i + window])) / len(words[i : i + window]) for i in range(0, len(words), window)]
    return sum(shares) / len(shares)


def _coded(token: str) -> bool:
    """Whether a token is machine code such as base64 or a key, not a word of any script."""
    return len(token) >= 24 and token.isascii() and bool(_CODE.search(token)) and "://" not in token


def _junk(text: str, words: list[str], lines: list[str], symbol_ratio: float, letter_ratio: float, packed: float) -> bool:
    """Whether a whole text is unreadable, boilerplate or repeated."""
    if symbol_ratio > 0.12 or "�" in text and text.count("�") > 0.05 * len(text):
        return True
    if len(text) > 120 and packed < 0.12:
        return True
    if len(words) >= 12 and _variety(words) < 0.12:
        return True
    if len(words) >= 4 and sum(w in NAVIGATION_WORDS for w in words) > 0.4 * len(words):
        return True
    if sum(len(t) for t in text.split() if _coded(t)) > 0.5 * len(text):
        return True
    parts = [p.strip() for s in lines for p in re.split(r"\s+\|\s+|\s{2,}|\t", s) if p.strip()]
    short = [p for p in parts if len(p) <= 24 and len(p.split()) <= 3]
    if len(parts) >= 4 and len(short) > 0.7 * len(parts):
        seen = sum(bool(NAVIGATION_WORDS & set(_WORD.findall(p.lower()))) or p[0] in "©»›" for p in short)
        if seen > 0.4 * len(short) or len(short) >= 12 and len(set(short)) < 0.4 * len(short):
            return True
    return False


def statistics(text: str | None) -> tuple:
    """The values of COLUMNS for one text. Null counts as empty; an empty or blank text is junk."""
    text = text or ""
    lines = [s for s in text.split("\n") if s.strip(" \t\r\x0b\x0c ​﻿　")]
    if not lines:
        return (*[0.0] * (len(COLUMNS) - 2), 1.0, "junk")
    solid = len(text) - sum(map(str.isspace, text)) or 1
    words = _WORD.findall(text.lower())
    symbol_ratio = len(_SYMBOL.findall(text)) / solid
    letters = sum(map(len, words))
    raw = text.encode("utf-8", "replace")
    packed = len(zlib.compress(raw, 1)) / len(raw)
    lens = np.array([len(s.strip()) for s in lines], float)
    total = lens.sum()
    indents = np.array([len(s) - len(s.lstrip(" \t")) for s in lines])
    ended = np.array([bool(_TERMINAL.search(s)) for s in lines])
    listed = np.array([LIST_LINE.match(s) is not None for s in lines])
    tabled = table_rows(lines)
    periodic, correlated = indent_periodicity(indents), autocorrelation(lens)
    # items without marks: many short lines that end in no full stop, alike in length or indentation
    plain = ~listed & ~tabled
    short = plain & (lens < 60) & ~ended
    if short.sum() >= 5 and short.sum() > 0.6 * plain.sum() and (lens[plain].mean() < 45 or periodic > 0.8 or correlated > 0.5) and not listed.any():
        starts_small = np.mean([lines[i].strip()[0].islower() for i in np.flatnonzero(short)])
        if lens[short].mean() < 45 or starts_small < 0.3:
            listed = listed | short
    list_share, table_share = float(lens[listed & ~tabled].sum() / total), float(lens[tabled].sum() / total)
    counts = Counter(lines)
    if _junk(text, words, lines, symbol_ratio, letters / solid, packed):
        junk_share, kind = 1.0, "junk"
    else:
        bad = np.array([len(_SYMBOL.findall(s)) > 0.15 * len(s) or counts[s] > 3 for s in lines]) & ~listed & ~tabled
        junk_share = float(lens[bad].sum() / total)
        shares = {"table": table_share, "list": list_share, "junk": junk_share}
        kind = max(shares, key=shares.get) if sum(shares.values()) > 0.5 else "prose"
    return (
        symbol_ratio, len(set(words)) / max(1, len(words)), 1 - len(counts) / len(lines), packed,
        float(tabled.mean()), periodic, correlated, list_share, table_share, junk_share, kind,
    )


# Letters of scripts that don't space words, for a set of characters; names of scripts begin with Is in one of the two dialects.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}ー"
_SPACED = rf"[^\P{{L}}{_UNSPACED}]"
MARKS = r"[̀-ͯؐ-ًؚ-ٟ]"  # taken out before words are cut
WORD = (
    "(?:" + "|".join(UNSPACED_WORDS) + r")|\p{IsHan}{1,2}|\p{IsHiragana}{1,3}|[\p{IsKatakana}ー]{1,8}|\p{IsThai}{1,4}"
    + rf"|{_SPACED}+(?:['’-]{_SPACED}+){{0,9}}"  # an unbounded group would nest too deep in long runs
)
ENDED = r"[.!?…؟。！？:।][\]'\"”’»“」)]*(?:[ \t]*\[\^[0-9]+\])*[ \t\r]*$"
BLANKS = r"[ \t\r\n\x{b}\x{c}\x{a0}\x{200b}\x{3000}\x{feff}]"


def lexical(text: Column) -> list[Column]:
    """The columns of LEXICAL: counts and ratios of characters, lines and words.

    Words of scripts without spaces are function words and else pieces of two Chinese characters,
    three hiragana, eight katakana or four Thai letters, about as long as words there are.
    """
    given = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(given, "\n"), lambda s: F.length(F.regexp_replace(s, BLANKS, "")) > 0)
    words = F.regexp_extract_all(F.regexp_replace(F.lower(given), MARKS, ""), F.lit(WORD), 0)
    letters, count, n_lines = F.length(F.array_join(words, "")), F.size(words), F.size(lines)
    share = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))
    return [
        F.length(given).cast("long").alias("n_chars"), n_lines.alias("n_lines"), count.cast("long").alias("n_words"), share(letters, count).alias("mean_word_length"),
        share(letters, F.length(F.regexp_replace(given, BLANKS, ""))).alias("letter_ratio"), share(F.size(F.filter(lines, lambda s: s.rlike(ENDED))), n_lines).alias("punctuation_end_share"),
        share(F.size(F.filter(words, lambda w: w.isin(*COMMON_WORDS, *UNSPACED_WORDS))), count).alias("common_word_share"),
    ]


def word_statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key` and the columns of LEXICAL for each row; null texts count as empty, whose counts and shares are 0."""
    return df.select(key, *lexical(F.col(text)))


def _structures(df: DataFrame, key: str, text: str, keep: list[str]) -> DataFrame:
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (key, *keep))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = pd.DataFrame([statistics(t) for t in b[text]], columns=list(COLUMNS), index=b.index)
            yield pd.concat([b[[key, *keep]], found], axis=1)

    return df.select(key, *keep, text).mapInPandas(run, f"{kinds}, " + ", ".join(f"{k} {v}" for k, v in COLUMNS.items()))


def text_statistics(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `df`: `key` and the values of LEXICAL and COLUMNS. Other columns are not kept, so none can clash.

    Null, empty and blank texts have statistics of 0 and the kind junk. Repeated rows give
    repeated results. Each text is read whole, by itself: nothing is shuffled.
    """
    return _structures(df.select(key, *lexical(F.col(text)), F.col(text).alias("_text")), key, "_text", list(LEXICAL))


def kinds_apart_from_prose(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return _structures(df.select(key, F.col(text).alias("_text")), key, "_text", []).where(F.col("text_kind") != "prose").select(key, "text_kind")
