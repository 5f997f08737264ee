"""Queries over table states, counts and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables as S
from ..session import table
from .registry import query


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN coalesce(n, 0) ELSE 0 END::BIGINT AS n_lines FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def docs_list_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of children in one aggregate and join, shown for parents of one status only."""
    rows = S.child_counts(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey")
    return rows.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("n_children")).otherwise(F.lit(0).cast("long")).alias("n_lines"))


@query("SELECT d.id, d.title, coalesce(n, 0)::BIGINT AS chunks FROM documents d LEFT JOIN (SELECT document_id, count(DISTINCT id) AS n FROM chunks GROUP BY document_id) c ON c.document_id = d.id")
def documents_listing(spark: SparkSession, d: str) -> DataFrame:
    rows = S.child_counts(table(spark, d, "documents"), table(spark, d, "chunks").select("id", "document_id").distinct(), "id", "document_id")
    return rows.select("id", "title", F.col("n_children").alias("chunks"))


@query("SELECT id, title, status, tenant_id, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, id)::INT AS place FROM documents WHERE tenant_id IS NOT NULL")
def tenant_listing(spark: SparkSession, d: str) -> DataFrame:
    """Each tenant's documents, newest first: placed in parts, as a tenant may hold a third of all rows."""
    from ..operators.ordering import sequence_within, with_parts

    docs = table(spark, d, "documents").select("id", "title", "status", "created_at", "tenant_id").where(F.col("tenant_id").isNotNull())
    rows = with_parts(docs, "tenant_id", -F.unix_micros(F.col("created_at").cast("timestamp")))
    return sequence_within(rows, "tenant_id", [F.desc("created_at"), F.col("id")], "id", "place").select("id", "title", "status", "tenant_id", "place")


@query("SELECT doc_id, title, source FROM documents WHERE doc_id = 17 LIMIT 1")
def doc_point_lookup(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("doc_id = 17").select("doc_id", "title", "source").limit(1)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'new 1' FROM customer WHERE c_custkey % 3 = 0")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    """Every third customer is absent; each new row is delivered twice, and the first by name is kept."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name")
    new = rows.select("c_custkey", F.explode(F.array(F.lit("new 2"), F.lit("new 1"))).alias("c_name"))
    return S.insert_if_absent(rows.where("c_custkey % 3 <> 0"), new, "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'renamed 2' ELSE c_name END AS c_name, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN 'now' ELSE 'before' END AS updated FROM customer UNION ALL SELECT c_custkey + 1000000000, 'renamed 2', c_nationkey, 'now' FROM customer WHERE c_custkey % 10 = 0")
def upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    """Half of the customers get a new name, some are new; each new row comes in two versions, of which the later holds."""
    old = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", F.lit("before").alias("updated"))
    far = old.where("c_custkey % 10 = 0").withColumn("c_custkey", F.col("c_custkey") + 1000000000)
    new = old.where("c_custkey % 2 = 0").unionByName(far).withColumn("version", F.explode(F.array(F.lit(2), F.lit(1)))).withColumn("c_name", F.concat(F.lit("renamed "), F.col("version").cast("string")))
    return S.upsert(old, new, "c_custkey", ["c_name"], order="version", stamp="updated", now=F.lit("now"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ready' WHEN doc_id % 3 = 1 THEN 'failed' ELSE 'pending' END AS status, CASE WHEN doc_id % 3 = 0 THEN TIMESTAMP '2025-01-01 00:00:02' END AS processed_at, CASE WHEN doc_id % 3 = 2 THEN '{\"pageCount\":\"1\"}' WHEN doc_id % 3 = 1 THEN '{\"error\":\"late\",\"pageCount\":\"1\"}' ELSE '{\"error\":\"\",\"pageCount\":\"7\"}' END AS metadata FROM documents")
def status_patch(spark: SparkSession, d: str) -> DataFrame:
    """Status changes merged into documents: patches in order of time, the time of processing where one is ready."""
    base = table(spark, d, "documents").select("doc_id", F.lit("pending").alias("status"), F.lit(None).cast("timestamp_ntz").alias("processed_at"), F.lit('{"pageCount":"1"}').alias("metadata"))
    at = lambda s: F.lit(f"2025-01-01 00:00:0{s}").cast("timestamp_ntz")
    first = base.where("doc_id % 3 < 2").select("doc_id", at(1).alias("at"), F.lit("failed").alias("status"), F.lit('{"error":"late"}').alias("patch"))
    then = base.where("doc_id % 3 = 0").select("doc_id", at(2).alias("at"), F.lit("ready").alias("status"), F.lit('{"error":"","pageCount":"7"}').alias("patch"))
    return S.patched(base, then.unionByName(first), "doc_id", "at")


@query("SELECT count(*)::BIGINT AS n, count(DISTINCT id)::BIGINT AS keys, min(length(id))::BIGINT AS shortest, min(tenant_id) AS tenant, min(status) AS status FROM (SELECT md5(doc_id::VARCHAR) || '----' AS id, 'one' AS tenant_id, 'pending' AS status FROM documents)")
def insert_returning(spark: SparkSession, d: str) -> DataFrame:
    """New documents as they are stored, with made keys that a rerun makes again."""
    new = table(spark, d, "documents").select("doc_id", "title", "source")
    rows = S.inserted(new, "one", status="pending")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("keys"), F.min(F.length("id")).cast("long").alias("shortest"), F.min("tenant_id").alias("tenant"), F.min("status").alias("status"))


@query("SELECT count(*)::BIGINT AS added, count(*)::BIGINT AS stored, 0::BIGINT AS of_none FROM chunks WHERE content IS NOT NULL")
def bulk_insert(spark: SparkSession, d: str) -> DataFrame:
    """Rows written beside those there, with their number; none are no write."""
    from ..session import scratch

    folder = scratch(spark, "bulk")
    rows = table(spark, d, "chunks").where(F.col("content").isNotNull()).select("id", "document_id", "content")
    added, none = S.bulk_insert(rows.limit(0), rows, folder), S.bulk_insert(rows, rows.limit(0), f"{folder}-none")
    return spark.read.parquet(folder).agg(F.count(F.lit(1)).alias("stored")).select(F.lit(added).cast("long").alias("added"), "stored", F.lit(none).cast("long").alias("of_none"))


@query("SELECT 'orders' AS kept, count(*)::BIGINT AS n FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'lineitem', count(*)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    parents, children = S.delete_with_children(table(spark, d, "orders"), table(spark, d, "lineitem"), "o_orderkey", "l_orderkey", F.col("o_orderstatus") == "P")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kept"), "n")
    return count(parents, "orders").unionByName(count(children, "lineitem"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def status_latest(spark: SparkSession, d: str) -> DataFrame:
    return S.latest_state(table(spark, d, "events"), "user_id", "ts", "event_id", ["ts", "event_id", "event_type"]).select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 AND event_type IN ('view', 'click')")
def status_in_progress(spark: SparkSession, d: str) -> DataFrame:
    return status_latest(spark, d).where(F.col("event_type").isin("view", "click")).select("user_id", "event_type")


@query("""SELECT doc_id, CASE WHEN storage_path IS NULL THEN 'no file' WHEN mime_type IS NULL OR mime_type <> 'application/pdf' THEN 'not a PDF' WHEN file_size_bytes > 52428800 THEN 'too large' ELSE 'ok' END AS verdict, printf('%.1f MB', round(coalesce(file_size_bytes, 0) / 1048576.0::DOUBLE, 1)) AS size FROM documents""")
def upload_gate(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.when(F.col("storage_path").isNull(), "no file").when(F.col("mime_type").isNull() | (F.col("mime_type") != "application/pdf"), "not a PDF").when(F.col("file_size_bytes") > 50 * 1024**2, "too large").otherwise("ok")
    size = F.format_string("%.1f MB", F.round(F.coalesce("file_size_bytes", F.lit(0)) / F.lit(float(1024**2)), 1))
    return table(spark, d, "documents").select("doc_id", verdict.alias("verdict"), size.alias("size"))


@query("SELECT 'lineitem' AS child, count(*)::BIGINT AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'chunks', count(*)::BIGINT FROM chunks WHERE document_id IS NOT NULL AND document_id NOT IN (SELECT id FROM documents WHERE id IS NOT NULL) UNION ALL SELECT 'messages', count(*)::BIGINT FROM messages WHERE conversation_id IS NOT NULL AND conversation_id NOT IN (SELECT id FROM conversations WHERE id IS NOT NULL)")
def fk_check(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    checks = (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("chunks", "document_id", "documents", "id"), ("messages", "conversation_id", "conversations", "id"))
    out = [S.missing_parents(t(c), k, t(p), pk).agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(c).alias("child"), "orphans") for c, k, p, pk in checks]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT tenant_id, email, count(*)::BIGINT AS n FROM users GROUP BY tenant_id, email HAVING count(*) > 1 UNION ALL SELECT 'chunks', id, count(*)::BIGINT FROM chunks GROUP BY id HAVING count(*) > 1")
def unique_check(spark: SparkSession, d: str) -> DataFrame:
    users = S.repeated_keys(table(spark, d, "users"), "tenant_id", "email")
    return users.unionAll(S.repeated_keys(table(spark, d, "chunks"), "id").select(F.lit("chunks"), "id", "n"))


@query("SELECT count(DISTINCT document_id)::BIGINT AS documents, count(*)::BIGINT AS chunks, count(*) FILTER (WHERE coalesce(contextual_content, '') <> '')::BIGINT AS with_context FROM (SELECT id, arg_max(document_id, ingested_at) AS document_id, arg_max(contextual_content, ingested_at) AS contextual_content FROM chunks WHERE id IS NOT NULL GROUP BY id)")
def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by("document_id", "ingested_at").alias("document_id"), F.max_by("contextual_content", "ingested_at").alias("contextual_content"))
    return rows.agg(F.countDistinct("document_id").alias("documents"), F.count(F.lit(1)).alias("chunks"), F.count_if(F.coalesce("contextual_content", F.lit("")) != "").alias("with_context"))


@query(r"""SELECT doc_id, json_extract_string(metadata, '$.pageCount') AS page_count, substring(coalesce(json_extract_string(metadata, '$.error'), ''), 1, 200) AS error, (CASE WHEN processed_at IS NOT NULL THEN epoch_us(processed_at) // 1000 - epoch_us(created_at) // 1000 END)::VARCHAR AS duration_ms,
 strftime(created_at AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created FROM documents WHERE metadata IS NULL OR json_valid(metadata)""")
def status_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where(F.col("metadata").isNull() | F.try_parse_json("metadata").isNotNull())
    get = lambda f: F.get_json_object("metadata", f"$.{f}")
    took = F.when(F.col("processed_at").isNotNull(), F.unix_millis("processed_at") - F.unix_millis("created_at"))
    return rows.select("doc_id", get("pageCount").alias("page_count"), F.substring(F.coalesce(get("error"), F.lit("")), 1, 200).alias("error"), took.cast("string").alias("duration_ms"), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("created"))


@query("SELECT document_id, (r // 64)::BIGINT AS batch, count(*)::BIGINT AS n FROM (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY id) - 1 AS r FROM (SELECT DISTINCT id, document_id FROM chunks)) GROUP BY document_id, r // 64")
def embed_batches(spark: SparkSession, d: str) -> DataFrame:
    """Requests of at most 64 chunks of a document, as an embedding service takes them."""
    counts = table(spark, d, "chunks").select("id", "document_id").distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("total"))
    batches = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / 64)))
    return counts.select("document_id", "total", batches.alias("batch")).select("document_id", "batch", F.least(F.lit(64).cast("long"), F.col("total") - F.col("batch") * 64).alias("n"))


@query("SELECT c.id, c.document_id, d.title, substring(c.content, 1, 600) AS excerpt FROM (SELECT DISTINCT id, document_id, content FROM chunks ORDER BY id LIMIT 12) c JOIN documents d ON d.id = c.document_id")
def judge_sources(spark: SparkSession, d: str) -> DataFrame:
    """The sources a judge is shown: twelve chunks with their titles, 600 characters each."""
    few = table(spark, d, "chunks").select("id", "document_id", "content").distinct().orderBy("id").limit(12)
    titles = table(spark, d, "documents").select(F.col("id").alias("document_id"), "title")
    return few.join(titles, "document_id").select("id", "document_id", "title", F.substring("content", 1, 600).alias("excerpt"))
