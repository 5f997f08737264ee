"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.formats import power_bytes
from ..session import table
from .registry import query

# The white space of JavaScript for RE2.
WS = r"[\s\v\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_TRIM = rf"'^{WS}+|{WS}+$', '', 'g'"


@query(r"""SELECT doc_id, CAST(ceil(length(text) / CASE WHEN language = 'tr' THEN 3.0 ELSE 4.0 END) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL""")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", T.estimated_tokens(F.col("text"), F.coalesce("language", F.lit(""))).alias("tokens"))


@query(r"""SELECT doc_id, CASE WHEN s = '' OR s IS NULL THEN 'en' WHEN length(regexp_replace(s, '[^çğıöşüÇĞİÖŞÜ]', '', 'g')) / length(s)::DOUBLE > 0.005 THEN 'tr' ELSE 'en' END AS lang
FROM (SELECT doc_id, substring(text, 1, 5000) AS s FROM documents)""")
def doc_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.document_language(F.col("text")).alias("lang"))


@query(r"""SELECT id, CASE WHEN content = '' THEN 'en' WHEN length(regexp_replace(content, '[^çğıöşüÇĞİÖŞÜ]', '', 'g')) / length(content)::DOUBLE > 0.01 OR regexp_matches(content, '[şğüöçŞĞÜÖÇ]') THEN 'tr' ELSE 'en' END AS lang
FROM (SELECT DISTINCT id, content FROM messages WHERE content IS NOT NULL)""")
def query_language(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").where(F.col("content").isNotNull()).select("id", "content").distinct().select("id", T.query_language(F.col("content")).alias("lang"))


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('<p>' || coalesce(title, '') || '</p>  <br/>' || coalesce(text, ''), '<[^>]+>', '', 'g'), '{WS}+', ' ', 'g'), {_TRIM}) AS plain FROM documents""")
def html_strip(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("<p>"), F.coalesce("title", F.lit("")), F.lit("</p>  <br/>"), F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", T.without_tags(page).alias("plain"))


@query(r"""SELECT doc_id, trim(regexp_replace(lower(replace(title, 'İ', 'i' || chr(775))), '[^a-z0-9]+', ' ', 'g')) AS normal FROM documents WHERE title IS NOT NULL""")
def title_normalise(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("title").isNotNull()).select("doc_id", T.normal_title(F.col("title")).alias("normal"))


@query(r"""SELECT doc_id, regexp_replace(title || '.PDF', '[^a-zA-Z0-9._-]', '_', 'g') AS stored_name, regexp_replace(title || '.PDF', '\.[pP][dD][fF]$', '', 'g') AS shown_name FROM documents WHERE title IS NOT NULL""")
def filename_sanitise(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("title", F.lit(".PDF"))
    return table(spark, d, "documents").where(F.col("title").isNotNull()).select("doc_id", T.safe_filename(name).alias("stored_name"), T.without_pdf_suffix(name).alias("shown_name"))


@query(r"""WITH b AS (SELECT doc_id, file_size_bytes AS n FROM documents)
SELECT doc_id, CASE WHEN n IS NULL OR n <= 0 THEN '0 B' WHEN n < 1024 THEN n::VARCHAR || ' B'
 WHEN n < 1048576 THEN CASE WHEN n / 1024.0 < 10 THEN printf('%.1f KB', round(n / 1024.0::DOUBLE, 1)) ELSE round(n / 1024.0::DOUBLE)::BIGINT::VARCHAR || ' KB' END
 WHEN n < 1073741824 THEN CASE WHEN n / 1048576.0 < 10 THEN printf('%.1f MB', round(n / 1048576.0::DOUBLE, 1)) ELSE round(n / 1048576.0::DOUBLE)::BIGINT::VARCHAR || ' MB' END
 ELSE CASE WHEN n / 1073741824.0 < 10 THEN printf('%.1f GB', round(n / 1073741824.0::DOUBLE, 1)) ELSE round(n / 1073741824.0::DOUBLE)::BIGINT::VARCHAR || ' GB' END END AS shown FROM b""")
def format_bytes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.listed_bytes(F.col("file_size_bytes")).alias("shown"))


@query(r"""SELECT event_id, CASE WHEN m < 1 THEN 'az önce' WHEN m < 60 THEN m || ' dk önce' WHEN m < 1440 THEN (m // 60) || ' sa önce' ELSE (m // 1440) || ' gün önce' END AS shown
FROM (SELECT event_id, (epoch_us(TIMESTAMP '2024-02-01 00:00:00') // 1000 - epoch_us(ts) // 1000) // 60000 AS m FROM events)""")
def relative_time(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", T.elapsed(F.lit("2024-02-01 00:00:00").cast("timestamp"), F.col("ts").cast("timestamp")).alias("shown"))


@query(r"""SELECT doc_id, replace(replace(replace(url_encode(title), '%20', '+'), '~', '%7E'), '%2A', '*') AS form, replace(replace(url_encode(title), '~', '%7E'), '%2A', '*') AS component,
 regexp_replace('postgres://user:' || doc_id || '@host/db', '://([^:/@]+):[^@]*@', '://\1:***@') AS redacted FROM documents WHERE title IS NOT NULL""")
def url_encode(spark: SparkSession, d: str) -> DataFrame:
    link = F.concat(F.lit("postgres://user:"), F.col("doc_id").cast("string"), F.lit("@host/db"))
    return table(spark, d, "documents").where(F.col("title").isNotNull()).select("doc_id", T.form_encoded(F.col("title")).alias("form"), T.component_encoded(F.col("title")).alias("component"), T.redacted(link).alias("redacted"))


@query(r"""SELECT event_id, strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS shown FROM events""")
def display_timezone(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.date_format(F.from_utc_timestamp("ts", "Europe/Istanbul"), "yyyy-MM-dd HH:mm:ss").alias("shown"))


@query(r"""SELECT doc_id, CASE WHEN n = 0 THEN '0 B' ELSE regexp_replace(regexp_replace(printf('%.2f', round(n / power(1024.0::DOUBLE, p), 2)), '(\.\d*?)0+$', '\1'), '\.$', '') || ' ' || coalesce(['B', 'KB', 'MB', 'GB'][p + 1], 'undefined') END AS shown
FROM (SELECT doc_id, file_size_bytes AS n, floor(ln(file_size_bytes::DOUBLE) / ln(1024.0::DOUBLE) + 1e-12)::INT AS p FROM documents WHERE file_size_bytes > 0)""")
def format_bytes_powers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("file_size_bytes > 0").select("doc_id", power_bytes(F.col("file_size_bytes")).alias("shown"))


_SPLIT = rf"string_split(regexp_replace(text, '([.!?]){WS}+([A-ZÇĞİÖŞÜ])', '\1' || chr(1) || '\2', 'g'), chr(1))"


@query(rf"""SELECT doc_id, i - 1 AS sentence_no, s AS sentence FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) AS i FROM
 (SELECT doc_id, list_filter({_SPLIT}, lambda x: length(regexp_replace(x, {_TRIM})) > 0) AS l FROM documents WHERE text IS NOT NULL))""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", F.posexplode(T.packing_sentences(F.col("text"))).alias("sentence_no", "sentence"))
    return rows.withColumn("sentence_no", F.col("sentence_no").cast("long"))


@query(r"""SELECT id, CASE WHEN coalesce(contextual_content, '') <> '' THEN contextual_content || chr(10) || chr(10) || content ELSE content END AS embedding_text,
 CASE WHEN coalesce(section_path, '') <> '' THEN '[' || section_path || '] ' || content ELSE content END AS sectioned FROM (SELECT DISTINCT id, contextual_content, section_path, content FROM chunks)""")
def embed_text(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("id", "contextual_content", "section_path", "content").distinct()
    return rows.select("id", T.embedding_text(F.col("contextual_content"), F.col("content")).alias("embedding_text"), T.with_section(F.col("section_path"), F.col("content")).alias("sectioned"))


@query(r"""WITH m AS (SELECT DISTINCT id, content FROM messages WHERE content IS NOT NULL)
SELECT id, content || chr(10) || content AS joined, content || content AS run_on FROM m""")
def message_text(spark: SparkSession, d: str) -> DataFrame:
    """The text parts of a message made of parts: joined by line breaks on one side, run on at the other."""
    rows = table(spark, d, "messages").where(F.col("content").isNotNull()).select("id", "content").distinct()
    part = lambda kind: F.struct(F.lit(kind).alias("type"), F.col("content").alias("text"))
    texts = F.transform(F.filter(F.array(part("text"), part("file"), part("text")), lambda p: p["type"] == "text"), lambda p: p["text"])
    return rows.select("id", F.array_join(texts, "\n").alias("joined"), F.array_join(texts, "").alias("run_on"))
