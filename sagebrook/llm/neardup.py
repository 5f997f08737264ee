"""Near-duplicate texts: all pairs whose character pieces overlap beyond a threshold.

A text is the set of its pieces, a long row of bits of which as many are set as it has different
pieces (its population). Two texts at the threshold differ in no more bits than the radius, and so
do their populations; the row is sampled by 256 minima of hashed pieces, one bit each. Runs of the
minima (bands) name blocks; texts that are similar enough share a block with a probability beyond
0.999. Within blocks the samples are compared exactly, tile by tile in order of population, with
exclusive-or and bit counts; tiles whose populations differ beyond the radius are skipped. Pairs
within the radius are held against the threshold with their whole texts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .conversations import connected_components

WORDS = 4  # of 64 bits in a fingerprint
MINIMA = 64 * WORDS
TILE = 1024
BLOCK = 8192  # texts that one task compares with each other at once, about
SAMPLED = 16  # one text in so many is counted to find large blocks; no block is left out by that
EQUAL = 2048  # equal texts that one task pairs with each other at once, about
PARTNERS = 2048  # candidates of one text that one task measures, about
BATCH_CHARS = 600_000
_SPACES = re.compile(r"\s+")


@dataclass(frozen=True)
class Measure:
    """What counts as similar, and how blocks are made for it."""

    piece: int  # code points a piece
    threshold: float
    shortest: int = 0  # code points that the text as given needs
    bands: int = 30
    rows: int = 3
    short: bool = False  # texts of a few dozen pieces: a hash function for each minimum, not for 64

    @property
    def radius(self) -> int:
        """Differing sampled bits that a pair at the threshold passes with odds of 4.5 standard deviations."""
        p = (1 - self.threshold) / 2
        return math.ceil(MINIMA * p + 4.5 * math.sqrt(MINIMA * p * (1 - p)))


def normal(text: str) -> str:
    return _SPACES.sub(" ", text.lower()).strip()


def pieces(text: str, size: int) -> set[str]:
    return {text[i : i + size] for i in range(len(text) - size + 1)}


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; wraps around."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def minima(texts: list[str], m: Measure) -> tuple[np.ndarray, np.ndarray]:
    """(texts, MINIMA) minima of hashed pieces, and each text's population. Texts are normal already."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    count = np.maximum(lens - m.piece + 1, 0)
    raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    out = np.full((len(texts), MINIMA), np.iinfo(np.uint32).max, np.uint32)
    if not count.sum():
        return out, count
    size = np.zeros(len(texts), np.int64)
    h = np.zeros(len(raw) - m.piece + 1, np.uint64)
    for k in range(m.piece):
        h = h * np.uint64(0x100000001B3) + raw[k : len(raw) - m.piece + 1 + k]
    begins = np.concatenate(([0], np.cumsum(lens)[:-1]))
    own = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + begins[own]
    h = _mix(h[at])
    seen = np.sort((own.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    size += np.bincount((seen[np.diff(seen, prepend=~seen[0]) != 0] >> np.uint64(44)).astype(np.int64), minlength=len(texts))
    if m.short:
        first = np.flatnonzero(np.diff(own, prepend=-1))
        for j in range(MINIMA):
            out[own[first], j] = np.minimum.reduceat((_mix(h + np.uint64(j * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(32)).astype(np.uint32), first)
        return out, size
    flat = out.reshape(-1)
    for j in range(WORDS):
        g = _mix(h + np.uint64(j * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)) if j else h
        np.minimum.at(flat, own * MINIMA + j * 64 + (g >> np.uint64(58)).astype(np.int64), (g & np.uint64(0xFFFFFFFE)).astype(np.uint32))
    # an empty bin takes the value of the next filled one of its sixty-four
    bins = out.reshape(-1, 64)
    empty = bins == np.iinfo(np.uint32).max
    rows = np.flatnonzero(empty.any(axis=1) & ~empty.all(axis=1))
    for r in rows:
        filled = np.flatnonzero(~empty[r])
        holes = np.flatnonzero(empty[r])
        source = filled[np.searchsorted(filled, holes) % len(filled)]
        bins[r, holes] = (bins[r, source].astype(np.uint64) * np.uint64(0x9E3779B1) + ((holes - source) % 64).astype(np.uint64)).astype(np.uint32) & np.uint32(0xFFFFFFFE)
    return out, size


def signatures(texts: list[str], m: Measure) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sampled bits (texts, WORDS), band keys (texts, bands) and populations."""
    low, count = minima(texts, m)
    bits = (_mix(low.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    prints = np.packbits(bits, axis=1).view(np.uint64).reshape(len(texts), WORDS)
    keys = np.zeros((len(texts), m.bands), np.uint64)
    for r in range(m.rows):
        keys = _mix(keys * np.uint64(0x100000001B3) + low[:, r * m.bands : (r + 1) * m.bands].astype(np.uint64) + np.uint64(r + 1))
    return prints, _mix(keys + np.arange(m.bands, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)), count


def close_pairs(prints: np.ndarray, pops: np.ndarray, m: Measure) -> tuple[np.ndarray, np.ndarray, int]:
    """Index pairs within the radius of each other, tile by tile in order of population, and the tiles skipped.

    Sets of x and y > x pieces that share the threshold's part of their union differ in
    (1 - threshold) of it, which y - x exceeds where x < threshold * y. So a tile that begins
    beyond that, and all after it, hold no partner of the tile at hand. Populations are counted by
    hashes of 44 bits, so one piece is allowed for.
    """
    order = np.argsort(pops, kind="stable")
    prints, pops = prints[order], pops[order]
    left, right, skipped = [], [], 0
    for i in range(0, len(prints), TILE):
        a, most = prints[i : i + TILE], pops[i : i + TILE][-1]
        for j in range(i, len(prints), TILE):
            if m.threshold * pops[j] > most + 1:
                skipped += -(-(len(prints) - j) // TILE)
                break
            b = prints[j : j + TILE]
            far = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]).astype(np.uint16)
            for w in range(1, WORDS):
                far += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
            x, y = np.nonzero(far <= m.radius)
            keep = ((x + i) < (y + j)) & (pops[x + i] + 1 >= m.threshold * pops[y + j])
            left.append(order[x[keep] + i])
            right.append(order[y[keep] + j])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none), skipped


def _in_blocks(key: np.ndarray, side: np.ndarray, prints: np.ndarray, pops: np.ndarray, m: Measure) -> tuple[np.ndarray, np.ndarray]:
    """Close index pairs within runs of equal keys that ascend by population. `side` 0: all pairs of the block; 1 and 2: only across.

    Runs smaller than a tile go together: all their rows are held against the next row, then the
    one after, and so on; a row whose next is beyond its radius is done.
    """
    first = np.flatnonzero(np.diff(key, prepend=key[0] - 1 if len(key) else 0))
    size = np.diff(np.append(first, len(key)))
    left, right = [], []
    for f, n in zip(first[size > 48], size[size > 48]):
        x, y, _ = close_pairs(prints[f : f + n], pops[f : f + n], m)
        left.append(x + f)
        right.append(y + f)
    small = np.repeat(size <= 48, size)
    at, gap = np.flatnonzero(small), 1
    last = np.repeat(first + size, size)
    while len(at):
        at = at[at + gap < last[at]]
        at = at[pops[at] + 1 >= m.threshold * pops[at + gap]]
        near = np.bitwise_count(prints[at] ^ prints[at + gap]).sum(axis=1) <= m.radius
        left.append(at[near])
        right.append(at[near] + gap)
        gap += 1
    x, y = np.concatenate(left or [np.zeros(0, int)]), np.concatenate(right or [np.zeros(0, int)])
    across = (side[x] == 0) | (side[x] != side[y])
    return x[across], y[across]


def _signed(rows: DataFrame, m: Measure) -> DataFrame:
    """id, twin (a hash of the normal text), population, sampled words and band keys of every text that has pieces."""
    schema = "id string, twin binary, pop int, " + ", ".join(f"f{w} long" for w in range(WORDS)) + ", bands array<long>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for b in batches:
            ids, texts = b["id"].to_numpy(), [normal(t) for t in b["text"]]
            start, size = 0, 0
            for end in range(1, len(texts) + 1):
                size += len(texts[end - 1])
                if size < BATCH_CHARS and end < len(texts):
                    continue
                part = texts[start:end]
                prints, keys, count = signatures(part, m)
                ok = np.flatnonzero(count > 0)
                if not len(ok):
                    start, size = end, 0
                    continue
                words = {f"f{w}": prints[ok, w].view(np.int64) for w in range(WORDS)}
                yield pd.DataFrame({"id": ids[start:end][ok], "twin": [hashlib.blake2b(part[i].encode("utf-8", "replace"), digest_size=16).digest() for i in ok], "pop": count[ok].astype(np.int32), **words, "bands": list(keys[ok].view(np.int64))})
                start, size = end, 0

    return rows.mapInPandas(run, schema)


def _candidates(heads: DataFrame, m: Measure) -> DataFrame:
    """Distinct pairs (a < b) of hashed ids that are close in some block.

    Blocks of more than about BLOCK texts are split: their texts get a group by hash, and every pair of
    groups is a block of its own, so that no task holds an unbounded block and no pair is lost.
    """
    words = [f"f{w}" for w in range(WORDS)]
    spread = heads.select("rid", "pop", *words, F.explode("bands").alias("key"))
    some = spread.where(F.pmod(F.xxhash64("rid"), F.lit(SAMPLED)) == 0).groupBy("key").agg((F.count(F.lit(1)) * SAMPLED).alias("n"))
    large = some.where(F.col("n") > BLOCK // 2).select("key", F.ceil(F.col("n") / (BLOCK // 2)).cast("int").alias("groups"))
    # at most bands * texts / BLOCK blocks are large
    own = F.pmod(F.xxhash64("rid"), F.col("groups")).cast("int")
    others = F.sequence(F.lit(0), F.col("groups") - 1)
    shares = F.transform(others, lambda o: F.struct(F.xxhash64("key", F.least(own, o), F.greatest(own, o)).alias("key"), F.when(o == own, 0).when(own < o, 1).otherwise(2).alias("side")))
    plain = F.array(F.struct(F.col("key").alias("key"), F.lit(0).alias("side")))
    split = spread.join(large, "key", "left").select("rid", "pop", *words, F.explode(F.when(F.col("groups").isNull(), plain).otherwise(shares)).alias("s")).select("s.key", "s.side", "rid", "pop", *words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            key = b["key"].to_numpy()
            whole = int(np.searchsorted(key, key[-1])) if len(key) else 0
            held = b.iloc[whole:]
            if whole:
                yield found(b.iloc[:whole])
        if held is not None and len(held):
            yield found(held)

    def found(b: pd.DataFrame) -> pd.DataFrame:
        prints = np.ascontiguousarray(b[words].to_numpy(np.int64)).view(np.uint64)
        rid = b["rid"].to_numpy()
        x, y = _in_blocks(b["key"].to_numpy(), b["side"].to_numpy(), prints, b["pop"].to_numpy(), m)
        x, y = np.minimum(rid[x], rid[y]), np.maximum(rid[x], rid[y])
        return pd.DataFrame({"a": x, "b": y})[x != y].drop_duplicates()

    return split.repartition("key").sortWithinPartitions("key", "pop").mapInPandas(run, "a long, b long").distinct()


def near_duplicates(rows: DataFrame, m: Measure, number_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """Links between different texts and the members of groups of equal texts.

    `rows` has id and text. The first result is (id_a, id_b, similarity), one row for each pair
    of class representatives at or above the threshold; the second (class_id, id, n), a row for
    each text that has pieces, class_id being the smallest id with the same normal text and n the
    number of such texts. Null ids and texts, texts shorter than `shortest` and those without a
    whole piece belong to none. ids must be unique; ids are compared as numbers where
    `number_ids`. Repeated rows count once. Other columns are not kept.
    """
    texts = rows.where(F.col("id").isNotNull() & F.col("text").isNotNull() & (F.length("text") >= m.shortest)).select("id", "text")
    signed = checkpoint(_signed(texts, m))
    rank = F.col("id").cast("long") if number_ids else F.col("id")
    words = [f"f{w}" for w in range(WORDS)]
    classes = signed.groupBy("twin").agg(F.min(F.struct(rank.alias("k"), "id", "pop", *words, "bands")).alias("h"), F.countDistinct("id").alias("n"))
    heads = classes.select(F.xxhash64("h.id").alias("rid"), F.col("h.id").alias("id"), "h.pop", *[F.col(f"h.{w}") for w in words], "h.bands")
    pairs = checkpoint(_candidates(heads, m))
    named = heads.select("rid", "id")
    # a text of many partners is measured in groups of them, each with its own copy of the text
    ends = pairs.select(F.col("a").alias("rid")).unionAll(pairs.select(F.col("b").alias("rid"))).groupBy("rid").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).cast("int").alias("groups"))
    wanted = checkpoint(ends.join(named, "rid").join(texts.dropDuplicates(["id"]), "id").select("rid", "groups", "id", "text"))
    heavy = wanted.where("groups > 1").select("rid", "groups")
    parts = wanted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    left, right = (parts.select(*[F.col(c).alias(c + s) for c in ("rid", "part", "id", "text")]) for s in ("_a", "_b"))
    dealt = pairs
    for own, other in (("a", "b"), ("b", "a")):
        dealt = dealt.join(heavy.select(F.col("rid").alias(own), F.col("groups").alias("_g")), own, "left").withColumn(f"part_of_{own}", F.coalesce(F.pmod(F.xxhash64(other), F.col("_g")).cast("int"), F.lit(0))).drop("_g")
    with_a = dealt.join(left, (F.col("a") == F.col("rid_a")) & (F.col("part_of_a") == F.col("part_a"))).select("b", "part_of_b", "id_a", "text_a")
    both = with_a.join(right, (F.col("b") == F.col("rid_b")) & (F.col("part_of_b") == F.col("part_b"))).select("id_a", "id_b", "text_a", "text_b")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ia, ib, ta, tb in zip(b["id_a"], b["id_b"], b["text_a"], b["text_b"]):
                x, y = pieces(normal(ta), m.piece), pieces(normal(tb), m.piece)
                common = len(x & y)
                total = len(x) + len(y) - common
                if total and common >= m.threshold * total - 1e-9:
                    out.append((*((ia, ib) if (int(ia) < int(ib) if number_ids else ia < ib) else (ib, ia)), common / total))
            if out:
                yield pd.DataFrame(out, columns=["id_a", "id_b", "similarity"])

    links = both.mapInPandas(measure, "id_a string, id_b string, similarity double")
    members = signed.select("twin", "id").distinct().join(classes.select("twin", F.col("h.id").alias("class_id"), "n"), "twin").select("class_id", "id", "n")
    return links, members


def all_pairs(links: DataFrame, members: DataFrame, number_ids: bool = False) -> DataFrame:
    """(id_a, id_b) of all pairs, each once: of the members of linked classes, and of equal texts.

    Large classes are dealt to groups of about EQUAL texts, and every pair of groups is paired by
    itself, so that no task holds an unbounded class. The result has as many rows as there are
    pairs; links and members say the same at the size of the texts.
    """
    share = F.ceil(F.col("n") / EQUAL).cast("int")
    dealt = members.select("class_id", "id", "n", share.alias("g"), F.pmod(F.xxhash64("id"), share).cast("int").alias("part"))
    a, b = (dealt.select(F.col("class_id").alias(f"class_{s}"), F.col("part").alias(f"part_{s}"), F.col("id").alias(s)) for s in ("x", "y"))
    sizes = members.where(F.col("id") == F.col("class_id")).select("class_id", share.alias("g"))
    spread = links.select(F.col("id_a").alias("class_x"), F.col("id_b").alias("class_y"))
    for s in ("x", "y"):
        spread = spread.join(sizes.select(F.col("class_id").alias(f"class_{s}"), "g"), f"class_{s}").withColumn(f"part_{s}", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).drop("g")
    cross = spread.join(a, ["class_x", "part_x"]).join(b, ["class_y", "part_y"]).select("x", "y")
    other = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    rows = dealt.where("n > 1")
    x = rows.select("class_id", F.col("id").alias("x"), F.col("part").alias("part_x"), other.alias("part_y"))
    y = rows.select("class_id", F.col("id").alias("y"), F.col("part").alias("part_y"), other.alias("part_x"))
    before = (lambda p, q: F.col(p).cast("long") < F.col(q).cast("long")) if number_ids else (lambda p, q: F.col(p) < F.col(q))
    within = x.join(y, ["class_id", "part_x", "part_y"]).where(before("x", "y")).select("x", "y")
    first = before("x", "y")
    return cross.unionByName(within).select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("id_a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("id_b"))


def groups(links: DataFrame, members: DataFrame, number_ids: bool = False) -> DataFrame:
    """(id, class_id, group_id, n_links): a row for each text that has pieces.

    group_id is the smallest id among all texts that links of similar ones lead to, n_links the
    number of other classes that the text's class is linked to.
    """
    rank = F.col("id").cast("long") if number_ids else F.col("id")
    own = members.where(F.col("id") == F.col("class_id")).select("class_id", F.xxhash64("class_id").alias("node"))
    edges = links.select(F.xxhash64("id_a").alias("a"), F.xxhash64("id_b").alias("b"))
    parts = connected_components(edges.unionAll(own.select(F.col("node"), F.col("node"))))
    named = parts.join(own, "node").select("class_id", "component", F.col("class_id").alias("id"))
    least = named.groupBy("component").agg(F.min_by("id", rank).alias("group_id"))
    degree = links.select(F.explode(F.array("id_a", "id_b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    of_class = named.select("class_id", "component").join(least, "component").join(degree, "class_id", "left").select("class_id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return members.select("class_id", "id").join(of_class, "class_id").select("id", "class_id", "group_id", "n_links")


CONTENT = Measure(piece=5, threshold=0.6, shortest=200, bands=30, rows=3)
TITLE = Measure(piece=3, threshold=0.7, bands=28, rows=4, short=True)
