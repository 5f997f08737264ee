"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint
from .tokens import TOKENIZER, token_counts

BUCKETS = 4096


def plain_source(source: Column) -> Column:
    """The name of a source without differences of case, blanks and hyphens."""
    return F.regexp_replace(F.lower(F.trim(source)), "[\\s-]+", "_")


def water_fill(weights: dict[str, float], room: dict[str, float], total: float) -> dict[str, float]:
    """Amounts in proportion to the weights, none beyond its room, `total` together where the room allows.

    Sources whose share exceeds their room are clamped to it; what they leave is given to the
    others in proportion to their weights, again and again until all fit.
    """
    out, open_ = {}, {s for s, w in weights.items() if w > 0 and room.get(s, 0) > 0}
    out = {s: 0.0 for s in weights}
    left = float(total)
    while open_:
        scale = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * scale >= room[s]}
        if not over:
            for s in open_:
                out[s] = weights[s] * scale
            break
        for s in over:
            out[s] = float(room[s])
            left -= room[s]
        open_ -= over
    return out


def mix_sources(docs: DataFrame, targets: DataFrame, seed: int = 0, key: str = "doc_id", tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """A mixture and its report.

    docs: key, source, text; targets: source, target_share, max_repeats (some dozens of rows, they
    are gathered). The mixture, (key, source, n_tokens, repeats), holds as many tokens as all
    documents together, or fewer where every cap binds. A source's amount over its tokens gives
    whole repetitions of all its documents and a fraction for some, chosen in seeded hash order
    until the fraction's tokens are reached. Documents without tokens or of a source without a
    target are left out; their tokens count towards the size. Spellings of a source's name are
    made alike; null sources have no target. A target without documents gets nothing and its
    share goes to the others; a null share or cap counts as 0, a null target source is left out. The report has a row for each target, with the shares reached.
    """
    sized = checkpoint(token_counts(docs.where(F.col(key).isNotNull()).select(key, plain_source(F.col("source")).alias("source"), "text"), [key, "source"], "text", tokenizer))
    wanted = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.where(F.col("source").isNotNull()).select(plain_source(F.col("source")).alias("source"), "target_share", "max_repeats").collect()}
    have = {r["source"]: int(r["n"]) for r in sized.where(F.col("source").isin(*wanted)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()} if wanted else {}
    total = sized.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    amount = water_fill({s: w for s, (w, _) in wanted.items()}, {s: have.get(s, 0) * cap for s, (_, cap) in wanted.items()}, total)
    spark = docs.sparkSession
    plan = []
    for s, (_, cap) in wanted.items():
        ratio = amount[s] / have[s] if have.get(s) else 0.0
        whole = min(int(ratio + 1e-12), cap)
        plan.append((s, whole, 0.0 if whole == cap else (ratio - whole) * have.get(s, 0)))
    plans = F.broadcast(spark.createDataFrame(plan, "source string, whole int, extra double"))  # a row for each target
    rows = sized.where(F.col("n_tokens") > 0).join(plans, "source")
    place = F.xxhash64(F.lit(seed), F.col(key))
    rows = rows.withColumn("_place", place).withColumn("_bucket", F.pmod(place, F.lit(BUCKETS)))
    buckets = rows.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_held"), F.first("extra").alias("_extra"))
    along = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    reached = buckets.withColumn("_before", F.coalesce(F.sum("_held").over(along), F.lit(0)))
    reached = reached.select("source", "_bucket", "_before", F.when(F.col("_before") + F.col("_held") <= F.col("_extra"), "all").when(F.col("_before") < F.col("_extra"), "some").otherwise("none").alias("_take"))
    rows = rows.join(F.broadcast(reached), ["source", "_bucket"])  # BUCKETS rows for each target at most
    within = Window.partitionBy("source", "_bucket").orderBy("_place", key).rowsBetween(Window.unboundedPreceding, 0)
    edge = rows.where(F.col("_take") == "some").withColumn("_sum", F.sum("n_tokens").over(within))
    edge = edge.withColumn("_more", (F.col("_before") + F.col("_sum") <= F.col("extra")).cast("int")).drop("_sum")
    rest = rows.where(F.col("_take") != "some").withColumn("_more", (F.col("_take") == "all").cast("int"))
    mixture = rest.unionByName(edge).withColumn("repeats", F.col("whole") + F.col("_more")).where(F.col("repeats") > 0).select(key, "source", "n_tokens", "repeats")
    made = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("repeats").alias("most_repeats"))
    named = spark.createDataFrame([(s, w, cap, have.get(s, 0), amount[s]) for s, (w, cap) in wanted.items()], "source string, target_share double, max_repeats int, available_tokens long, planned_tokens double")
    report = named.join(F.broadcast(made), "source", "left").na.fill(0, ["tokens", "documents", "most_repeats"])
    everything = Window.partitionBy()
    return mixture, report.withColumn("reached_share", F.col("tokens") / F.sum("tokens").over(everything))
