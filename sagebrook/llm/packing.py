"""Filling containers of a fixed number of tokens with documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .tokens import TOKENIZER, token_counts

LINEAR, QUADRATIC = 1.0, 1.0  # cost of a document: LINEAR * n + QUADRATIC * n * n / capacity
SHARD_CONTAINERS = 2000  # containers that one task fills, about
SHARD_ROWS = 200_000
SMALL = 0.3  # documents up to this part of a container close gaps


def assign(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each item, all of 1 to `capacity` tokens; containers are numbered from 0.

    Items go, in descending order, to the container of the lowest cost that has room, costs being
    linear in tokens plus quadratic for attention. Small items go where they leave least room,
    which the balance of costs hardly feels. A container is added where none has room.
    """
    order = np.argsort(-sizes, kind="stable")
    n = max(1, -(-int(sizes.sum()) // capacity)) if len(sizes) else 0
    most = n + len(sizes)
    cost, room = np.zeros(n), np.full(n, capacity, np.int64)
    out = np.zeros(len(sizes), np.int64)
    for i in order:
        size = int(sizes[i])
        fits = room >= size
        if not fits.any():
            cost, room = np.append(cost, 0.0), np.append(room, capacity)
            at = len(room) - 1
        elif size <= SMALL * capacity:
            at = int(np.where(fits, room, most * capacity + capacity).argmin())
        else:
            at = int(np.where(fits, cost, np.inf).argmin())
        out[i] = at
        cost[at] += LINEAR * size + QUADRATIC * size * size / capacity
        room[at] -= size
    return out


def pack_documents(docs: DataFrame, capacity: int, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """Every document in containers of at most `capacity` tokens.

    One row for each document, or part of one: key, part_no (from 0), token_start, token_end,
    n_tokens, container_id. Only documents beyond the capacity are split, into full containers and
    a rest that is packed like a document. Documents without tokens (null or empty texts) take no
    room and go into the first container of their shard. Documents are dealt to shards by a hash
    of the key; a shard fills about SHARD_CONTAINERS containers, so that no task grows with the
    data. Null keys are dropped; repeated rows are packed as often as they come.
    """
    kind = docs.schema[key].dataType.simpleString()
    sized = checkpoint(token_counts(docs.where(F.col(key).isNotNull()), [key], text, tokenizer))
    rest = F.col("n_tokens") % capacity
    total, rows = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count(F.lit(1))).first()
    shards = max(1, round(total / (capacity * SHARD_CONTAINERS)), -(-rows // SHARD_ROWS))
    full = (F.col("n_tokens") / capacity).cast("int")
    parts = sized.select(key, "n_tokens", F.monotonically_increasing_id().alias("_row"), F.explode(F.sequence(F.lit(0), F.when((full > 0) & (rest == 0), full - 1).otherwise(full))).alias("part_no"))
    parts = parts.withColumn("token_start", F.col("part_no").cast("long") * capacity).withColumn("token_end", F.least(F.col("n_tokens"), F.col("token_start") + capacity))
    parts = parts.select(key, "_row", "part_no", "token_start", "token_end", (F.col("token_end") - F.col("token_start")).alias("n_tokens"))
    columns = [key, "part_no", "token_start", "token_end", "n_tokens", "container_id"]
    alone = parts.where(F.col("n_tokens") == capacity).select(*columns[:-1], F.concat(F.lit("full-"), F.col("_row").cast("string"), F.lit("-"), F.col("part_no").cast("string")).alias("container_id"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", key, "part_no"], ascending=[False, True, True]).reset_index(drop=True)
        sizes = pdf["n_tokens"].to_numpy()
        bins = np.zeros(len(pdf), np.int64)
        bins[sizes > 0] = assign(sizes[sizes > 0], capacity)
        pdf["container_id"] = [f"{s}-{b}" for s, b in zip(pdf["_shard"], bins)]
        return pdf[columns]

    shared = parts.where(F.col("n_tokens") < capacity).withColumn("_shard", F.pmod(F.xxhash64(key, "_row"), F.lit(shards)))
    schema = f"`{key}` {kind}, part_no int, token_start long, token_end long, n_tokens long, container_id string"
    return alone.unionByName(shared.groupBy("_shard").applyInPandas(run, schema))


def container_use(packed: DataFrame, capacity: int) -> DataFrame:
    """How full the containers are: one row."""
    each = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("squares"))
    return each.agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("share_used"), (F.stddev_pop("squares") / F.avg("squares")).alias("attention_spread"))


def packing_soundness(packed: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """One row: documents, and what should all be 0: overfull containers, documents cut that would fit, tokens missing or packed twice."""
    over = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where(F.col("n") > capacity).agg(F.count(F.lit(1)).alias("overfull"))
    each = packed.groupBy(key).agg(F.count(F.lit(1)).alias("parts"), F.sum("n_tokens").alias("n"), F.max("token_end").alias("end"))
    counts = each.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("n") <= capacity)).alias("needless"), F.count_if(F.col("n") != F.col("end")).alias("uneven"))
    return counts.crossJoin(over)  # one row each
