from pyspark.sql import functions as F

from sagebrook.operators import ordering


def test_hot_groups_are_cut_and_joined_again(spark, monkeypatch):
    monkeypatch.setattr(ordering, "HOT_ROWS", 50)
    rows = [("hot", i, f"v{i}") for i in range(500)] + [("cold", i, f"v{i}") for i in range(5)] + [("hot", 7, "tie")]
    df = spark.createDataFrame(rows, "g string, t long, v string").withColumn("at", F.timestamp_seconds("t"))
    parts = ordering.with_parts(df, "g", "at")
    by = {r["g"]: r["n"] for r in parts.groupBy("g").agg(F.countDistinct("_part").alias("n")).collect()}
    assert by["cold"] == 1 and by["hot"] > 10
    got = ordering.sequence_within(parts, "g", [F.col("at"), F.col("v")], "v").orderBy("g", "_no").collect()
    for g in ("hot", "cold"):
        mine = [r for r in got if r["g"] == g]
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        assert [r["v"] for r in mine] == [r[2] for r in want]
        assert [r["_no"] for r in mine] == list(range(1, len(want) + 1))
        assert [r["_before"] for r in mine] == [None, *[r[2] for r in want[:-1]]]
        assert [r["_last"] for r in mine] == [False] * (len(want) - 1) + [True]


def test_text_order_and_running_sums(spark, monkeypatch):
    monkeypatch.setattr(ordering, "HOT_ROWS", 20)
    rows = [("g", f"chunk-00000-{i * 7919 % 1000:03}é", i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, id string, v long")
    parts = ordering.with_parts(df, "g", "id")
    assert parts.select("_part").distinct().count() > 5
    got = ordering.running_sum(parts, "g", [F.col("id")], "v", "s").orderBy("id").collect()
    total = 0
    for r, (_, i, v) in zip(got, sorted(rows, key=lambda r: r[1])):
        total += v
        assert (r["id"], r["s"]) == (i, total)
