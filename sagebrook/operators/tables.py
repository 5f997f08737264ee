"""Changes to tables without a table format: each returns the new state, to be written beside the old."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_a_key(new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """One row for each non-null key: the last by `order`, of equals the one with the largest values. Aggregated before the shuffle."""
    rest = [c for c in new.columns if c != key]
    if not rest:
        return new.where(F.col(key).isNotNull()).distinct()
    first = [F.col(order).alias("_o")] if order else []
    best = F.max(F.struct(*first, *rest)).alias("_r")
    return new.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(*[F.col(c) if c == key else F.col(f"_r.{c}") for c in new.columns])


def upsert(old: DataFrame, new: DataFrame, key: str, changed: list[str], order: str | None = None, stamp: str | None = None, now: Column | None = None) -> DataFrame:
    """Old rows with `changed` columns from new rows of the same key, and the new rows of other keys.

    Of several new rows of a key the last by `order` holds. Rows that new ones touch get `now`
    (the current time by default) in the column `stamp`. New rows without a key are left out;
    columns that only one side has are not allowed.
    """
    once = one_a_key(new.select(*dict.fromkeys([*old.columns, *([order] if order else [])])), key, order)
    o, n = old.select(*[F.col(c).alias(f"o_{c}") for c in old.columns]), once.select(F.lit(True).alias("n_hit"), *[F.col(c).alias(f"n_{c}") for c in old.columns])
    hit, known = F.col("n_hit").isNotNull(), F.col("o_hit").isNotNull()

    def pick(c: str) -> Column:
        if c == stamp:
            return F.when(hit, now if now is not None else F.current_timestamp()).otherwise(F.col(f"o_{c}"))
        if c in changed:
            return F.when(hit, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}"))
        return F.when(known, F.col(f"o_{c}")).otherwise(F.col(f"n_{c}"))

    return o.withColumn("o_hit", F.lit(True)).join(n, F.col(f"o_{key}") == F.col(f"n_{key}"), "full_outer").select(*[pick(c).alias(c) for c in old.columns])


def insert_if_absent(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Old rows and the new rows of keys that the old ones lack: one for each key, the first by `order`, else that with the smallest values."""
    rest = [c for c in old.columns if c != key]
    first = [F.col(order).alias("_o")] if order else []
    absent = new.where(F.col(key).isNotNull()).join(old.select(key).distinct(), key, "left_anti")
    if not rest:
        return old.unionByName(absent.select(key).distinct())
    least = absent.groupBy(key).agg(F.min(F.struct(*first, *rest)).alias("_r")).select(*[F.col(c) if c == key else F.col(f"_r.{c}") for c in old.columns])
    return old.unionByName(least)


def inserted(new: DataFrame, tenant: str, key: str = "id", tenant_key: str = "tenant_id", status: str | None = None, now: Column | None = None) -> DataFrame:
    """New rows as they are stored: with a generated key where they have none, the tenant's id, and the time of creation.

    Keys are name-based: the same row gets the same key when a lost task runs again.
    """
    name = F.md5(F.to_json(F.struct(F.lit(tenant), *[F.col(c) for c in new.columns if c != key]), {"ignoreNullFields": "false"}))
    made = F.concat_ws("-", *[F.substring(name, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    out = new.withColumn(key, F.coalesce(F.col(key), made) if key in new.columns else made).withColumn(tenant_key, F.lit(tenant))
    out = out.withColumn("created_at", now if now is not None else F.current_timestamp())
    return out.withColumn("status", F.lit(status)) if status else out


def bulk_insert(old: DataFrame, new: DataFrame, path: str) -> int:
    """Writes new rows beside the old and returns how many; none are no write."""
    count = new.count()
    if count:
        new.select(*old.columns).write.mode("append").parquet(path)
    return count


def patched(rows: DataFrame, changes: DataFrame, key: str, at: str, patch: str = "patch", metadata: str = "metadata") -> DataFrame:
    """Rows after status changes: (key, at, status, patch as a JSON object of text values).

    The last change by time gives the status; patches are merged in order of time into the
    metadata, later values winning, as maps whose entries are reduced before the shuffle.
    processed_at is stamped with the time of the last change where its status is ready. Rows
    without changes stay as they are, changes of unknown keys do nothing.
    """
    as_map = lambda c: F.coalesce(F.from_json(F.col(c), "map<string,string>"), F.create_map().cast("map<string,string>"))
    last = changes.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(F.col(at).alias("t"), F.col("status").alias("s"))).alias("_c"))
    entries = changes.where(F.col(key).isNotNull()).select(key, at, F.explode(as_map(patch)).alias("_k", "_v"))
    latest = entries.groupBy(key, "_k").agg(F.max(F.struct(F.col(at).alias("t"), F.col("_v").alias("v"))).alias("_e"))
    merged = latest.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_k", F.col("_e.v").alias("_v")))).alias("_p"))  # an entry for each field
    joined = rows.join(last, key, "left").join(merged, key, "left")
    own = as_map(metadata)
    kept = F.map_filter(own, lambda k, v: ~F.coalesce(F.array_contains(F.map_keys("_p"), k), F.lit(False)))
    entries_ = F.array_sort(F.map_entries(F.map_concat(kept, F.coalesce("_p", F.create_map().cast("map<string,string>")))))
    done = joined.withColumn(metadata, F.when(F.col("_p").isNotNull(), F.to_json(F.map_from_entries(entries_))).otherwise(F.col(metadata)))
    stamp = F.when(F.col("_c.s") == "ready", F.col("_c.t")).otherwise(F.col("processed_at"))
    return done.withColumn("processed_at", stamp).withColumn("status", F.coalesce("_c.s", "status")).select(*rows.columns)


def delete_with_children(parents: DataFrame, children: DataFrame, key: str, child_key: str, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Parents and children without the parents for which `gone` holds, and their children."""
    dropped = parents.where(gone).select(F.col(key).alias("_gone")).distinct()
    return (
        parents.join(dropped, F.col(key) == F.col("_gone"), "left_anti"),
        children.join(dropped, F.col(child_key) == F.col("_gone"), "left_anti"),
    )


def latest_state(log: DataFrame, key: str, at: str, tie: str, columns: list[str]) -> DataFrame:
    """The last row of each key, found by a partial maximum before the shuffle."""
    best = F.max(F.struct(at, tie, *[c for c in columns if c not in (at, tie)])).alias("s")
    return log.groupBy(key).agg(best).select(key, *[F.col(f"s.{c}").alias(c) for c in columns])


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def missing_parents(children: DataFrame, child_key: str, parents: DataFrame, key: str) -> DataFrame:
    return children.where(F.col(child_key).isNotNull()).join(parents.select(F.col(key).alias("_k")), F.col(child_key) == F.col("_k"), "left_anti")


def child_counts(parents: DataFrame, children: DataFrame, key: str, child_key: str) -> DataFrame:
    """Parents with `n_children`; counts are made before the join."""
    counts = children.groupBy(F.col(child_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return parents.join(counts, F.col(key) == F.col("_k"), "left").withColumn("n_children", F.coalesce("_n", F.lit(0))).drop("_k", "_n")
