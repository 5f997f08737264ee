"""Order-dependent work within groups, one of which may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 20_000  # groups up to this size are never split
HOT_GROUPS = 2_000  # a group is hot if it holds more than this part of all rows: so many can be hot at most
PARTS = 64
SAMPLED = 2048  # values of a hot group from which cuts of texts are taken, about


def with_parts(df: DataFrame, group: str, at: str | Column) -> DataFrame:
    """Adds `_part`: 0 for ordinary groups; hot groups are cut along `at` into up to PARTS parts.

    `at` is a number, or the name of a timestamp or text column. Parts ascend with it, equal values
    share one and nulls come first. Cut points are quantiles of each hot group, of texts those
    of about SAMPLED values with the right hashes, both found with partial aggregation; at most
    HOT_GROUPS groups can be hot, so the table that is broadcast has at most HOT_GROUPS * PARTS cuts.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total"))
    hot = sizes.join(F.broadcast(total), F.col("_n") > F.greatest(F.lit(HOT_ROWS), F.col("_total") / HOT_GROUPS)).select(group, "_n")
    texts = isinstance(at, str) and df.schema[at].dataType.typeName() == "string"
    place = at if not isinstance(at, str) else F.col(at) if texts else F.unix_micros(F.col(at).cast("timestamp"))
    own = df.join(F.broadcast(hot), group)
    if texts:
        held = own.where(F.pmod(F.xxhash64(at), F.ceil(F.col("_n") / SAMPLED).cast("long")) == 0).groupBy(group).agg(F.array_sort(F.collect_set(at)).alias("_s"))
        cuts = held.select(group, F.transform(F.sequence(F.lit(1), F.lit(PARTS - 1)), lambda k: F.get("_s", F.floor(k * F.size("_s") / PARTS).cast("int"))).alias("_cuts"))
    else:
        cuts = own.groupBy(group).agg(F.percentile_approx(place, [k / PARTS for k in range(1, PARTS)], 1000).alias("_cuts"))
    part = F.coalesce(F.size(F.filter("_cuts", lambda c: c < place)), F.lit(0))
    return df.join(F.broadcast(cuts), group, "left").withColumn("_part", F.when(F.col("_cuts").isNull(), 0).otherwise(part)).drop("_cuts")


def sequence_within(df: DataFrame, group: str, order: list[Column], last: str, counted: str = "_no") -> DataFrame:
    """For a result of with_parts: `_no`, the place in the group from 1, and `_before`, the value of `last` in the row before.

    Parts are numbered by themselves and then shifted by what lies before them; only one row
    for each part takes part in the second step.
    """
    own = Window.partitionBy(group, "_part").orderBy(*order)
    rows = df.withColumn("_at", F.row_number().over(own)).withColumn("_prev", F.lag(last).over(own))
    ends = rows.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_size"), F.max_by(last, "_at").alias("_end"))
    along = Window.partitionBy(group).orderBy("_part")
    shifts = ends.select(
        group,
        "_part",
        F.coalesce(F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"),
        F.lag("_end").over(along).alias("_carried"),
        (F.lead("_size").over(along).isNull()).alias("_final"),
        "_size",
    )
    return (
        rows.join(shifts, [group, "_part"])
        .withColumn(counted, (F.col("_at") + F.col("_shift")).cast("int"))
        .withColumn("_before", F.when(F.col("_at") == 1, F.col("_carried")).otherwise(F.col("_prev")))
        .withColumn("_last", F.col("_final") & (F.col("_at") == F.col("_size")))
        .drop("_at", "_prev", "_shift", "_carried", "_final", "_size")
    )


def running_sum(df: DataFrame, group: str, order: list[Column], value: str, name: str) -> DataFrame:
    """For a result of with_parts: adds the sum of `value` over the group up to and with each row, parts summed by themselves first."""
    own = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.groupBy(group, "_part").agg(F.sum(value).alias("_held"))
    along = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(group, "_part", F.coalesce(F.sum("_held").over(along), F.lit(0)).alias("_passed"))
    return df.withColumn("_own", F.sum(value).over(own)).join(before, [group, "_part"]).withColumn(name, F.col("_own") + F.col("_passed")).drop("_own", "_passed")
