"""Shared helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Every character that counts as blank (white space, no-break and zero-width spaces).
BLANK_CHARS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u200b\u2060\ufeff"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def limits(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """The rows of size_limits (three, fixed) as a dict."""
    return {r["limit_name"]: int(r["amount"]) for r in table(spark, sf_dir, "size_limits").collect()}


def latest(df: DataFrame, key: str, order: str, cols: list[str]) -> DataFrame:
    """One row for each non-null key: the one delivered last.

    A partial max runs before the shuffle, so a key that holds many rows costs no more than
    one row a task. Equal `order` is settled by the largest remaining values, so reruns agree.
    """
    best = F.max(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in cols])).alias("_r")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def is_blank(col: Column) -> Column:
    return F.coalesce(F.length(F.btrim(col, F.lit(BLANK_CHARS))), F.lit(0)) == 0


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for cut lineage: the one the cluster names; a local one only where none is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir is not set")
            import tempfile

            named = tempfile.mkdtemp(prefix="checkpoint-")
        sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
