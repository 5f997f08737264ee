"""Cutting oversized texts at natural boundaries."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: sentence marks that end a stretch.
_BOUNDS = ".!?…。！？"
_SENTENCE = re.compile(r"(?:[.!?…؟]+[\"”’»)\]]*(?:\s*\[\^\d+\])*\s+|[。！？]+[」』”’）)]*\s*|\n+[ \t]*)")
_MARK = re.compile(r"(?:[-•*–‣▪]|\d{1,3}[.)])[ \t]")
_CLAUSE = re.compile(r"[,;:،؛，、；：]\s*")
_SPACE = re.compile(r"\s+")
# Strength of the boundary that a cut would fall on.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, INSIDE = 5, 4, 3, 2, 1, 0


def _atoms(text: str, most: int) -> tuple[list[int], list[int]]:
    """Ends of atomic segments of at most `most` characters, and the strength of the boundary at each end."""
    ends: list[int] = []
    strengths: list[int] = []

    def close(end: int, strength: int) -> None:
        if ends and end <= ends[-1]:
            strengths[-1] = max(strengths[-1], strength)
        elif end > 0:
            ends.append(end)
            strengths.append(strength)

    def finer(start: int, end: int, strength: int, marks: tuple) -> None:
        if end - start <= most:
            close(end, strength)
            return
        if not marks:
            for at in range(start + most, end, most):
                close(at, INSIDE)
            close(end, strength)
            return
        (pattern, value), at = marks[0], start
        for m in pattern.finditer(text, start, end):
            if m.end() < end:
                finer(at, m.end(), value, marks[1:])
                at = m.end()
        finer(at, end, strength, marks[1:])

    at = 0
    for m in _SENTENCE.finditer(text):
        breaks = m.group().count("\n")
        if breaks == 1 and m.group()[0] == "\n" and not _MARK.match(text, m.end()):
            continue  # a wrapped line
        finer(at, m.end(), PARAGRAPH if breaks > 1 else LINE if breaks and _MARK.match(text, m.end()) else SENTENCE, ((_CLAUSE, CLAUSE), (_SPACE, WORD)))
        at = m.end()
    finer(at, len(text), PARAGRAPH, ((_CLAUSE, CLAUSE), (_SPACE, WORD)))
    return ends, strengths


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at the end) of the pieces of a text.

    Segments are merged across their weakest boundary first, the smallest pair first among
    equals, as long as both and the overlap fit into the limit. Every piece but the first
    then begins `overlap` characters before the end of the one before it.
    """
    room = limit - overlap
    ends, strengths = _atoms(text, room)
    n = len(ends)
    if not n:
        return []
    starts = [0, *ends[:-1]]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(strengths[i], ends[i + 1] - starts[i], i, ends[i], ends[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, size, i, mid, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if size > room or j >= n or ends[i] != mid or ends[j] != end or end - starts[i] != size:
            continue
        ends[i], strengths[i], alive[j], after[i] = ends[j], strengths[j], False, after[j]
        if after[i] < n:
            before[after[i]] = i
            heapq.heappush(heap, (strengths[i], ends[after[i]] - starts[i], i, ends[i], ends[after[i]]))
        if before[i] >= 0:
            k = before[i]
            heapq.heappush(heap, (strengths[k], ends[i] - starts[k], k, ends[k], ends[i]))
    left = [i for i in range(n) if alive[i]]
    while len(left) > 1 and ends[left[0]] <= overlap:  # the first piece must hold the overlap; nothing stands before it, so both fit
        starts[left[1]] = 0
        left.pop(0)
    return [(max(0, starts[i] - overlap), ends[i], strengths[i]) for i in left]


def forced(text: str, pieces: list[tuple[int, int, int]], limit: int) -> bool:
    """Whether a cut between the pieces lies in a stretch longer than the limit without white space and sentence marks.

    Such a stretch can't be spared a cut, as pieces are within the limit.
    """
    bound = lambda c: c.isspace() or c in _BOUNDS
    for _, end, _ in pieces[:-1]:
        low = high = end
        while low > 0 and high - low <= limit and not bound(text[low - 1]):
            low -= 1
        while high < len(text) and high - low <= limit and not bound(text[high]):
            high += 1
        if high - low > limit:
            return True
    return False


_NAMES = ("paragraph", "line", "sentence", "clause", "word", "inside")
SCHEMA = "chunk_id string, piece_no int, content string, char_offset_start int, char_offset_end int, section_path string, boundary string, cut_kind string"


def split_oversized(chunks: DataFrame, limit: int, overlap: int) -> DataFrame:
    """The pieces of every chunk whose content is longer than `limit` code points.

    A chunk delivered twice counts once, as delivered last. Pieces have at most `limit`
    characters; each after the first repeats the last `overlap` characters of the one before.
    Offsets are those of the chunk plus the place in it, null where the chunk has none.
    cut_kind is forced where a cut had to fall into a stretch longer than the limit that holds
    neither white space nor a sentence mark, else natural. Null ids, null and short contents give no rows; other columns
    are not kept. Only oversized texts are shuffled.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and below limit")
    long = F.length("content") > limit
    last = F.max(F.struct(F.col("ingested_at").alias("o"), F.coalesce(F.length("content"), F.lit(0)).alias("n"), F.when(long, F.col("content")).alias("content"), "char_offset_start", "section_path")).alias("r")
    rows = chunks.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("chunk_id")).agg(last).where(F.col("r.n") > limit).select("chunk_id", "r.content", "r.char_offset_start", "r.section_path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, text, offset, section in zip(b["chunk_id"], b["content"], b["char_offset_start"], b["section_path"]):
                pieces = split_text(text, limit, overlap)
                kind = "forced" if forced(text, pieces, limit) else "natural"
                offset = None if pd.isna(offset) else int(offset)
                for k, (start, end, strength) in enumerate(pieces):
                    out.append((key, k + 1, text[start:end], None if offset is None else offset + start, None if offset is None else offset + end, section, _NAMES[PARAGRAPH - strength], kind))
            if not out:
                continue
            done = pd.DataFrame(out, columns=["chunk_id", "piece_no", "content", "char_offset_start", "char_offset_end", "section_path", "boundary", "cut_kind"])
            yield done.astype({"char_offset_start": "Int32", "char_offset_end": "Int32"})

    return rows.mapInPandas(run, SCHEMA)


def soundness(pieces: DataFrame, chunks: DataFrame, limit: int, overlap: int) -> DataFrame:
    """For each chunk cut: whether its pieces give back its text, keep the limit, and overlap exactly. Groups are the pieces of one chunk."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct("piece_no", F.col("content").alias("piece")))), lambda p: p["piece"])
    each = pieces.groupBy("chunk_id").agg(texts.alias("t"))
    last = chunks.where(F.col("id").isNotNull()).groupBy(F.col("id").alias("chunk_id")).agg(F.max_by("content", "ingested_at").alias("whole")).where(F.length("whole") > limit)
    joined = F.array_join(F.transform("t", lambda p, i: F.when(i == 0, p).otherwise(F.substring(p, F.lit(overlap + 1), F.length(p)))), "")
    pairs = F.zip_with(F.slice("t", F.lit(1), F.size("t") - 1), F.slice("t", F.lit(2), F.size("t") - 1), lambda a, b: F.right(a, F.lit(overlap)) == F.left(b, F.lit(overlap)))
    return last.join(each, "chunk_id", "left").select(
        "chunk_id",
        F.coalesce(joined == F.col("whole"), F.lit(False)).alias("gives_back"),
        F.coalesce(F.forall("t", lambda p: F.length(p) <= limit), F.lit(False)).alias("within_limit"),
        F.coalesce(F.forall(pairs, lambda x: x), F.lit(False)).alias("overlaps"),
    )
