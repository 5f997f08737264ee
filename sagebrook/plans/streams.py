"""Queries over streams, files and model slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.citations import validation
from ..functions.providers import called, embedded, first_that_works, md5_provider
from ..operators.tables import latest_state
from ..session import scratch, table
from ..sources import readers
from ..streaming import streams as S
from .registry import query

_M = "(SELECT id, arg_max(content, ingested_at) AS content FROM messages WHERE content <> '' GROUP BY id)"


def _said(spark: SparkSession, d: str) -> DataFrame:
    """Messages that say something, once each, as delivered last."""
    rows = table(spark, d, "messages").where("content <> ''")
    return latest_state(rows, "id", "ingested_at", "content", ["ingested_at", "content"]).select("id", "content")


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    """A stream of message texts in pieces of forty characters, written first to a folder."""
    rows = _said(spark, d)
    n = F.ceil(F.length("content") / 40).cast("int")
    pieces = rows.select(F.col("id").alias("message_id"), "content", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    out = pieces.select("message_id", "seq", F.expr("substring(content, seq * 40 + 1, 40)").alias("delta"), (F.col("seq") == F.col("n") - 1).alias("last"))
    folder = scratch(spark, "deltas")
    out.write.parquet(folder)
    return spark.readStream.schema(S.DELTAS).option("maxFilesPerTrigger", 4).parquet(folder)


@query(f"SELECT id AS message_id, content AS text FROM {_M}")
def delta_reassembly(spark: SparkSession, d: str) -> DataFrame:
    return S.drained(S.reassembled(_deltas(spark, d)), "messages")


_CITED = r"list_transform(list_sort(list_transform(list_distinct(list_transform(regexp_extract_all(content, '\\[\\^(\\d+)\\]', 1), lambda x: regexp_replace(x, '^0+([0-9])', '\\1'))), lambda x: {'n': length(x), 's': x})), lambda p: p.s)".replace("\\\\", "\\")


@query(rf"""WITH m AS (SELECT *, greatest(1, (length(content) + 999) // 1000) AS n FROM {_M})
SELECT id AS message_id, 0::INT AS event_no, 'start' AS event, length(content)::VARCHAR AS payload FROM m UNION ALL SELECT id, 1, 'text-start', NULL FROM m
UNION ALL SELECT id, (i + 2)::INT, 'text-delta', substring(content, i * 1000 + 1, 1000) FROM (SELECT id, content, unnest(range(0, n)) AS i FROM m) UNION ALL SELECT id, (n + 2)::INT, 'text-end', NULL FROM m
UNION ALL SELECT id, (n + 3)::INT, 'finish', array_to_string({_CITED}, ',') FROM m""")
def stream_protocol(spark: SparkSession, d: str) -> DataFrame:
    """What is known comes first, then the text in pieces, the validation once it is whole."""
    known = _said(spark, d).select(F.col("id").alias("message_id"), F.length("content").cast("string").alias("metadata"))
    cited = F.array_join(validation(F.col("text"), F.lit(3), 0.6)["cited"], ",")
    return S.as_events(delta_reassembly(spark, d), known, lambda f: f.select("message_id", cited.alias("payload")))


@query("SELECT event_id, coalesce(CASE a WHEN 0 THEN b = 1 OR b = 3 WHEN 1 THEN b = 2 OR b = 3 WHEN 2 THEN b = 1 WHEN 3 THEN b = 1 ELSE b = 0 END, false) AS allowed FROM (SELECT event_id, event_id % 5 AS a, event_id % 4 AS b FROM events)")
def status_changes(spark: SparkSession, d: str) -> DataFrame:
    """Which changes of a document's state are allowed; an old state of none is a new document."""
    states = F.array(*map(F.lit, ("pending", "processing", "ready", "failed")))
    old, new = F.get(states, (F.col("event_id") % 5).cast("int")), F.get(states, (F.col("event_id") % 4).cast("int"))
    return table(spark, d, "events").select("event_id", S.allowed_change(old, new).alias("allowed"))


def _events(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    folder = scratch(spark, "events")
    rows.repartitionByRange(4, "ts").write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 6) AS total FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts of a stream, of the hours that the watermark has passed. An extension."""
    return S.drained(S.windowed_counts(_events(spark, d)), "windows").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT user_id, max(event_id) AS last_event FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY user_id")
def stream_status(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each user, kept by a stream."""
    latest = _events(spark, d).groupBy("user_id").agg(F.max(F.struct("ts", "event_id"))["event_id"].alias("last_event"))
    return S.drained(latest, "status", "complete")


@query("SELECT doc_id, upper(coalesce(title, '')) AS title, length(coalesce(text, ''))::BIGINT AS n FROM documents")
def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Documents that arrive as JSON files, taken in by a stream."""
    base = scratch(spark, "ingest")
    table(spark, d, "documents").select("doc_id", "title", "text").write.json(f"{base}/in")
    S.ingest(spark, f"{base}/in", "doc_id long, title string, text string", lambda s: s.select("doc_id", F.upper(F.coalesce("title", F.lit(""))).alias("title"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n")), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out")


@query("SELECT doc_id, title, source FROM documents")
def overwrite_corpus(spark: SparkSession, d: str) -> DataFrame:
    """A corpus replaced as a whole and read again."""
    folder = scratch(spark, "corpus")
    rows = table(spark, d, "documents").select("doc_id", "title", "source")
    rows.limit(0).write.parquet(folder)
    rows.write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


@query("SELECT doc_id::VARCHAR AS id, coalesce(language, '') AS lang, coalesce(title, '') AS question FROM documents")
def json_sources(spark: SparkSession, d: str) -> DataFrame:
    """Questions written as JSON and read with their schema."""
    folder = scratch(spark, "questions")
    table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("language", F.lit("")).alias("lang"), F.coalesce("title", F.lit("")).alias("question")).write.json(folder)
    return spark.read.schema(readers.QUESTIONS).json(folder)


@query("SELECT event_type AS id, coalesce(round(avg(value), 3), 0) AS score, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def eval_report(spark: SparkSession, d: str) -> DataFrame:
    """Means of judged scores, written as a JSON report and read again."""
    folder = scratch(spark, "report")
    rows = table(spark, d, "events").groupBy(F.col("event_type").alias("id")).agg(F.coalesce(F.round(F.avg("value"), 3), F.lit(0.0)).alias("score"), F.count(F.lit(1)).alias("n"))
    rows.groupBy().agg(F.current_timestamp().alias("generated_at"), F.collect_list(F.struct("id", "score", "n")).alias("rows")).write.json(folder)  # a row for each kind of event
    report = spark.read.schema("generated_at timestamp, rows array<struct<id:string,score:double,n:long>>").json(folder)
    return report.select(F.explode("rows").alias("r")).select("r.*")


@query("SELECT doc_id::VARCHAR AS id, CASE WHEN length(coalesce(title, '')) < 20 THEN 'short' ELSE 'long' END AS kind FROM documents")
def concurrent_calls(spark: SparkSession, d: str) -> DataFrame:
    """A slow call for each row, four at a time in each worker; results carry their keys and need no order."""
    rows = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.coalesce("title", F.lit("")).alias("title"))
    return called(rows, "id", "title", lambda t: "short" if len(t) < 20 else "long", 4).withColumnRenamed("reply", "kind")


_MD5 = "list_transform(range(0, 16), lambda i: ((('0x' || substring(h, i * 2 + 1, 2))::INT - 128) / 128.0)::DOUBLE)"
_EMBEDDED = f"""SELECT doc_id, round(list_sum(list_transform(v, lambda x, i: x * i)), 6) AS weighted, round(v[64], 6) AS last FROM (SELECT doc_id, list_concat(list_concat(p0, p1), list_concat(p2, p3)) AS v FROM (SELECT doc_id, {", ".join(f"(SELECT {_MD5} FROM (SELECT md5('{i}:' || coalesce(title, '')) AS h)) AS p{i}" for i in range(4))} FROM documents))"""


def _checked(rows: DataFrame) -> DataFrame:
    weighted = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", F.round(weighted, 6).alias("weighted"), F.round(F.element_at("embedding", 64).cast("double"), 6).alias("last"))


@query(_EMBEDDED)
def offline_embed(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of titles by the stand-in, as two sums over each."""
    return _checked(embedded(table(spark, d, "documents"), "doc_id", "title"))


@query(_EMBEDDED)
def failover_chain(spark: SparkSession, d: str) -> DataFrame:
    """The first provider always fails, the second answers."""

    def down(texts: list[str]) -> list[list[float]]:
        raise ConnectionError("not reachable")

    return _checked(embedded(table(spark, d, "documents"), "doc_id", "title", first_that_works([down, md5_provider])))
