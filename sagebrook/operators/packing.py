"""Packing paragraphs and sentences into chunks: one Arrow pass over each document, linear in its length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blocks, estimated_tokens, is_section_heading, packing_sentences

TARGET, MOST, LEAST = 384, 480, 80
CHUNK = "chunk_no int, content string, page_number int, paragraph_index int, char_offset_start long, char_offset_end long, section_path string, language string"
PARAGRAPH = "page_number int, paragraph_index int, text string, char_offset_start long, char_offset_end long, section_path string"


def joined_sentences(sentences: list[str], tokens: list[int]) -> list[str]:
    """Sentences joined by a blank while they fit into TARGET tokens. A longer sentence stays whole."""
    out: list[str] = []
    held: list[str] = []
    n = 0
    for s, t in zip(sentences, tokens):
        if held and n + t > TARGET:
            out.append(" ".join(held))
            held, n = [], 0
        held.append(s)
        n += t
    return out + ([" ".join(held)] if held else [])


def packed(sizes: list[int]) -> list[tuple[int, int, int, bool]]:
    """(first, last, tokens, long) of the chunks of a document's paragraphs.

    A paragraph beyond MOST tokens stands alone and is long. Else what is held is closed when the
    paragraph would take it beyond TARGET and it has LEAST tokens already, and after adding when
    it has MOST.
    """
    out, held = [], None
    for i, t in enumerate(sizes):
        if t > MOST:
            out += [held] if held else []
            out.append((i, i, t, True))
            held = None
            continue
        if held and held[2] + t > TARGET and held[2] >= LEAST:
            out.append(held)
            held = None
        held = (held[0], i, held[2] + t, False) if held else (i, i, t, False)
        if held[2] >= MOST:
            out.append(held)
            held = None
    return out + ([held] if held else [])


def pack_chunks(rows: DataFrame, key: str, paragraphs: str, language: str) -> DataFrame:
    """key, chunk_no (from 0), first, last, tokens, long, for an array column of paragraphs. Only sizes leave the JVM. Null arrays give no rows."""
    kind = rows.schema[key].dataType.simpleString()
    sizes = rows.where(F.size(paragraphs) > 0).select(key, F.transform(paragraphs, lambda p: estimated_tokens(p, F.col(language))).alias("sizes"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(k, n, *c) for k, s in zip(b[key], b["sizes"]) for n, c in enumerate(packed(s.tolist()))]
            if made:
                yield pd.DataFrame(made, columns=[key, "chunk_no", "first", "last", "tokens", "long"])

    return sizes.mapInPandas(run, f"`{key}` {kind}, chunk_no int, first int, last int, tokens long, long boolean")


def pack_sentences(rows: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """key and pieces: an array of each text's packed sentences. Null texts give no rows."""
    kind = rows.schema[key].dataType.simpleString()
    cut = rows.where(F.col(text).isNotNull()).select(key, packing_sentences(F.col(text)).alias("s"), F.col(language).alias("l"))
    sized = cut.select(key, "s", F.transform("s", lambda x: estimated_tokens(x, F.col("l"))).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({key: b[key], "pieces": [joined_sentences(list(s), t.tolist()) for s, t in zip(b["s"], b["t"])]})

    return sized.mapInPandas(run, f"`{key}` {kind}, pieces array<string>")


def _paged(rows: DataFrame, key: str, pages: str, language: Column) -> DataFrame:
    """Pages cut into blocks, with which of them are headings, their tokens and sentences, all by expressions."""
    cut = rows.where(F.col(pages).isNotNull()).select(key, language.alias("language"), F.transform(pages, F.length).alias("lengths"), F.transform(pages, lambda p: blocks(p)).alias("blocks"))
    each = lambda f: F.transform("blocks", lambda page: F.transform(page, f))
    return cut.select("*", each(is_section_heading).alias("headings"), each(lambda b: estimated_tokens(b, F.col("language"))).alias("sizes"))


def _paragraphs(lengths: list, blocks_: list, headings: list) -> list[tuple]:
    """(page, index, text, start, end, section): blocks two characters apart, pages one; a heading holds to the end of its page."""
    out, begin = [], 0
    for page, (length, texts, flags) in enumerate(zip(lengths, blocks_, headings), 1):
        at, section = begin, None
        for index, (text, heading) in enumerate(zip(texts, flags)):
            section = text if heading else section
            out.append((page, index, text, at, at + len(text), section))
            at += len(text) + 2
        begin += int(length) + 1
    return out


def paged_paragraphs(rows: DataFrame, key: str, pages: str) -> DataFrame:
    """key and the paragraphs of its pages (an array of texts) with offsets and sections. Null pages give no rows; nothing is shuffled."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [(k, *p) for k, *parts in zip(b[key], b["lengths"], b["blocks"], b["headings"]) for p in _paragraphs(*parts)]
            if made:
                yield pd.DataFrame(made, columns=[key, "page_number", "paragraph_index", "text", "char_offset_start", "char_offset_end", "section_path"])

    return _paged(rows, key, pages, F.lit("")).select(key, "lengths", "blocks", "headings").mapInPandas(run, f"`{key}` {kind}, {PARAGRAPH}")


def chunk_rows(rows: DataFrame, key: str, pages: str, language: str) -> DataFrame:
    """The chunks of each document: key and the columns of CHUNK.

    `pages` is an array of texts. Paragraphs go together, with their sections before them, as
    `packed` says; the place of a chunk is that of its first paragraph, its end that of its last,
    its section the first there is. Long paragraphs are cut between sentences; their pieces'
    offsets count the pieces before and one character between, not the section. Null and blank
    pages give nothing. Nothing is shuffled and each document is gone through once.
    """
    kind = rows.schema[key].dataType.simpleString()
    cut = _paged(rows, key, pages, F.coalesce(F.col(language), F.lit("")))
    long = F.transform(F.flatten("blocks"), lambda b: F.when(estimated_tokens(b, F.col("language")) > MOST, packing_sentences(b)))
    cut = cut.withColumn("sentences", long).withColumn("tokens", F.transform("sentences", lambda s: F.transform(s, lambda x: estimated_tokens(x, F.col("language")))))
    with_section = lambda section, text: f"[{section}] {text}" if section else text

    def chunks(lengths: list, blocks_: list, headings: list, sizes: list, sentences: list, tokens: list, lang: str) -> Iterator[tuple]:
        paragraphs = _paragraphs(lengths, blocks_, headings)
        for first, last, _, is_long in packed([int(t) for page in sizes for t in page]):
            held = paragraphs[first : last + 1]
            page, index, _, start, _, section = held[0]
            if not is_long:
                yield "\n\n".join(with_section(p[5], p[2]) for p in held), page, index, start, held[-1][4], next((p[5] for p in held if p[5]), None), lang
                continue
            for piece in joined_sentences(list(sentences[first]), [int(t) for t in tokens[first]]):
                yield with_section(section, piece), page, index, start, start + len(piece), section, lang
                start += len(piece) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = zip(b[key], b["lengths"], b["blocks"], b["headings"], b["sizes"], b["sentences"], b["tokens"], b["language"])
            made = [(k, n, *c) for k, *p in parts for n, c in enumerate(chunks(*p))]
            if made:
                yield pd.DataFrame(made, columns=[key, *(c.split()[0] for c in CHUNK.split(", "))])

    return cut.select(key, "lengths", "blocks", "headings", "sizes", "sentences", "tokens", "language").mapInPandas(run, f"`{key}` {kind}, {CHUNK}")
