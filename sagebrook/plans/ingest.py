"""Queries that turn texts into paragraphs, sections and chunks, and records into papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import packing as P
from ..operators import records as R
from ..session import table
from .registry import query
from .texts import _SPLIT, _TRIM, WS

_BLOCKS = rf"""list_filter(list_transform(string_split(regexp_replace(text, '\n{WS}*\n', chr(1), 'g'), chr(1)), lambda b: regexp_replace(replace(b, chr(10), ' '), {_TRIM})), lambda b: length(b) > 0)"""
_D = "(SELECT doc_id, language, text FROM documents WHERE text IS NOT NULL)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", "language", "text")


_FLAT = f"(SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS block_no FROM (SELECT doc_id, {_BLOCKS} AS l FROM {_D}))"


@query(f"""SELECT doc_id, block_no::BIGINT AS block_no, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
 (coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text))::BIGINT AS "end" FROM {_FLAT}""")
def paragraph_offsets(spark: SparkSession, d: str) -> DataFrame:
    rows = P.paged_paragraphs(_docs(spark, d).select("doc_id", F.array("text").alias("pages")), "doc_id", "pages")
    return rows.select("doc_id", F.col("paragraph_index").cast("long").alias("block_no"), F.col("char_offset_start").alias("start"), F.col("char_offset_end").alias("end"))


_HEAD = rf"(length(text) < 80 AND (regexp_matches(text, '^[\d.]+{WS}+[A-Z]') OR regexp_full_match(text, '[A-ZÇĞİÖŞÜ][^.!?]{{0,60}}')))"


@query(f"""SELECT doc_id, block_no::BIGINT AS block_no, heading, last_value(CASE WHEN heading THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY block_no ROWS UNBOUNDED PRECEDING) AS section FROM (SELECT *, {_HEAD} AS heading FROM {_FLAT})""")
def section_heading(spark: SparkSession, d: str) -> DataFrame:
    """Each block with the nearest heading at or before it."""
    rows = P.paged_paragraphs(_docs(spark, d).select("doc_id", F.array("text").alias("pages")), "doc_id", "pages")
    return rows.select("doc_id", F.col("paragraph_index").cast("long").alias("block_no"), T.is_section_heading(F.col("text")).alias("heading"), F.col("section_path").alias("section"))


@query(f"SELECT doc_id, len(l)::BIGINT AS blocks, array_to_string(l, '¦') AS joined FROM (SELECT doc_id, {_BLOCKS} AS l FROM {_D})")
def section_blocks(spark: SparkSession, d: str) -> DataFrame:
    b = T.blocks(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(b).cast("long").alias("blocks"), F.array_join(b, "¦").alias("joined"))


@query(r"""SELECT user_id, line_no::BIGINT AS line_no, string_agg(event_type, '' ORDER BY ts, event_id) AS line FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS line_no FROM
 (SELECT *, CASE WHEN abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 2 THEN 1 ELSE 0 END AS fresh FROM events)) GROUP BY user_id, line_no""")
def line_grouping(spark: SparkSession, d: str) -> DataFrame:
    lines = R.grouped_lines(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value", "event_type")
    return lines.select("user_id", F.col("line_no").cast("long").alias("line_no"), F.col("text").alias("line"))


_TOK = "CAST(ceil(length(p) / CASE WHEN language = 'tr' THEN 3.0 ELSE 4.0 END) AS BIGINT)"
_FOLD = """list_reduce(list_concat([{'i': -1, 't': 0::BIGINT, 'h': false, 'f': -1, 'n': 0::BIGINT, 'o': ''}], list_transform(sizes, lambda t, i: {'i': i::INT - 1, 't': t, 'h': false, 'f': -1, 'n': 0::BIGINT, 'o': ''})), lambda a, b:
 {'i': b.i, 't': b.t,
  'h': b.t <= 480 AND (CASE WHEN a.h AND NOT (a.n + b.t > 384 AND a.n >= 80) THEN a.n + b.t ELSE b.t END) < 480,
  'f': CASE WHEN a.h AND NOT (a.n + b.t > 384 AND a.n >= 80) THEN a.f ELSE b.i END,
  'n': CASE WHEN a.h AND NOT (a.n + b.t > 384 AND a.n >= 80) THEN a.n + b.t ELSE b.t END,
  'o': a.o || CASE WHEN b.t > 480 THEN CASE WHEN a.h THEN a.f || '-' || (b.i - 1) || ':' || a.n || ' ' ELSE '' END || b.i || '-' || b.i || ':' || b.t || '! '
   ELSE CASE WHEN a.h AND a.n + b.t > 384 AND a.n >= 80 THEN a.f || '-' || (b.i - 1) || ':' || a.n || ' ' ELSE '' END
    || CASE WHEN (CASE WHEN a.h AND NOT (a.n + b.t > 384 AND a.n >= 80) THEN a.n + b.t ELSE b.t END) >= 480 THEN (CASE WHEN a.h AND NOT (a.n + b.t > 384 AND a.n >= 80) THEN a.f ELSE b.i END) || '-' || b.i || ':' || (CASE WHEN a.h AND NOT (a.n + b.t > 384 AND a.n >= 80) THEN a.n + b.t ELSE b.t END) || ' ' ELSE '' END END})"""


_PACKED = f"""(SELECT doc_id, language, r.o || CASE WHEN r.h THEN r.f || '-' || r.i || ':' || r.n || ' ' ELSE '' END AS packed FROM
 (SELECT doc_id, language, {_FOLD} AS r FROM (SELECT doc_id, language, list_transform({_BLOCKS}, lambda p: {_TOK}) AS sizes FROM {_D})))"""


@query(f"SELECT doc_id, packed FROM {_PACKED} WHERE packed <> ''")
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of each document as first-last:tokens, those to be cut by sentences marked with !."""
    rows = P.pack_chunks(_docs(spark, d).select("doc_id", F.coalesce("language", F.lit("")).alias("language"), T.blocks(F.col("text")).alias("b")), "doc_id", "b", "language")
    one = F.concat(F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"), F.lit(":"), F.col("tokens").cast("string"), F.when(F.col("long"), "!").otherwise(""), F.lit(" "))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", one.alias("s")))), lambda x: x["s"]), "").alias("packed"))


@query(f"""SELECT language, count(*)::BIGINT AS documents, sum(len(string_split(trim(packed), ' ')))::BIGINT AS chunks FROM (SELECT coalesce(language, '') AS language, packed FROM {_PACKED} WHERE packed <> '') GROUP BY language""")
def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d).select("doc_id", F.coalesce("language", F.lit("")).alias("language"), T.blocks(F.col("text")).alias("b"))
    per = P.pack_chunks(docs, "doc_id", "b", "language").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return per.join(docs.select("doc_id", "language"), "doc_id").groupBy("language").agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("chunks"))


_STOK = "CAST(ceil(length(b.s) / CASE WHEN language = 'tr' THEN 3.0 ELSE 4.0 END) AS BIGINT)"


@query(rf"""SELECT doc_id, r.o || r.h AS packed FROM (SELECT doc_id, list_reduce(list_concat([{{'s': '', 'h': '', 'n': 0::BIGINT, 'o': ''}}], list_transform(sentences, lambda x: {{'s': x, 'h': '', 'n': 0::BIGINT, 'o': ''}})), lambda a, b:
 {{'s': '', 'h': CASE WHEN (a.n + {_STOK} > 384 AND a.h <> '') OR a.h = '' THEN b.s ELSE a.h || ' ' || b.s END, 'n': CASE WHEN a.n + {_STOK} > 384 AND a.h <> '' THEN {_STOK} ELSE a.n + {_STOK} END, 'o': a.o || CASE WHEN a.n + {_STOK} > 384 AND a.h <> '' THEN a.h || '¦' ELSE '' END}}) AS r
 FROM (SELECT doc_id, coalesce(language, '') AS language, list_filter({_SPLIT}, lambda x: length(regexp_replace(x, {_TRIM})) > 0) AS sentences FROM {_D}))""")
def chunk_pack_long(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as one paragraph, cut by sentences."""
    rows = P.pack_sentences(_docs(spark, d).select("doc_id", "text", F.coalesce("language", F.lit("")).alias("language")), "doc_id", "text", "language")
    return rows.select("doc_id", F.array_join("pieces", "¦").alias("packed"))


_PAGES = f"""(SELECT doc_id, coalesce(language, '') AS language, page, page_start, {_BLOCKS} AS l FROM (SELECT doc_id, language, i + 1 AS page, i * 3001 AS page_start, substring(text, i * 3000 + 1, 3000) AS text FROM (SELECT doc_id, language, text, unnest(range(0, (length(text) + 2999) // 3000)) AS i FROM {_D})))"""
_PARAS = f"""(SELECT *, {_HEAD} AS heading, page_start + coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id, page ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st, row_number() OVER (PARTITION BY doc_id ORDER BY page, idx) - 1 AS n
 FROM (SELECT doc_id, language, page, page_start, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS idx FROM {_PAGES}))"""
_SECTIONED = f"(SELECT *, last_value(CASE WHEN heading THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY idx ROWS UNBOUNDED PRECEDING) AS section FROM {_PARAS})"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Texts as pages of 3,000 characters; the tables hold no page breaks."""
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length("text") / 3000).cast("int") - 1, F.lit(0))), lambda i: F.substring("text", i * 3000 + 1, F.lit(3000)))
    return _docs(spark, d).select("doc_id", "language", cut.alias("pages"))


@query(f'SELECT doc_id, page::INT AS page_number, idx::INT AS paragraph_index, text, st::BIGINT AS "start", section FROM {_SECTIONED}')
def page_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of pages, with offsets over all pages and headings that hold to the end of their page."""
    rows = P.paged_paragraphs(_pages(spark, d), "doc_id", "pages")
    return rows.select("doc_id", "page_number", "paragraph_index", "text", F.col("char_offset_start").alias("start"), F.col("section_path").alias("section"))


_TOKENS = "CAST(ceil(length(X) / CASE WHEN language = 'tr' THEN 3.0 ELSE 4.0 END) AS BIGINT)"


@query(rf"""WITH p AS MATERIALIZED (SELECT * FROM {_SECTIONED}),
 k AS (SELECT doc_id, regexp_extract(c, '^(\d+)-', 1)::BIGINT AS f, regexp_extract(c, '-(\d+):', 1)::BIGINT AS t, c LIKE '%!' AS long FROM (SELECT doc_id, unnest(string_split(trim(r.o || CASE WHEN r.h THEN r.f || '-' || r.i || ':' || r.n || ' ' ELSE '' END), ' ')) AS c FROM
  (SELECT doc_id, {_FOLD} AS r FROM (SELECT doc_id, list({_TOKENS.replace("X", "text")} ORDER BY n) AS sizes FROM p GROUP BY doc_id))) WHERE c <> ''),
 a AS (SELECT k.doc_id, f, 0 AS piece, string_agg(CASE WHEN section IS NULL THEN text ELSE '[' || section || '] ' || text END, chr(10) || chr(10) ORDER BY n) AS content, arg_min(page, n) AS page, arg_min(idx, n) AS idx, min(st) AS st, arg_max(st + length(text), n) AS en, arg_min(section, n) FILTER (WHERE section IS NOT NULL) AS section, any_value(language) AS language FROM k JOIN p ON p.doc_id = k.doc_id AND n BETWEEN f AND t WHERE NOT long GROUP BY k.doc_id, f),
 s AS (SELECT p.*, f, list_filter({_SPLIT}, lambda x: length(regexp_replace(x, {_TRIM})) > 0) AS sentences FROM k JOIN p ON p.doc_id = k.doc_id AND n = f WHERE long),
 r AS (SELECT *, string_split(q.o || q.h, chr(1)) AS pieces FROM (SELECT *, list_reduce(list_concat([{{'s': '', 'h': '', 'n': 0::BIGINT, 'o': ''}}], list_transform(sentences, lambda x: {{'s': x, 'h': '', 'n': 0::BIGINT, 'o': ''}})), lambda a, b:
  {{'s': '', 'h': CASE WHEN (a.n + {_TOKENS.replace("X", "b.s")} > 384 AND a.h <> '') OR a.h = '' THEN b.s ELSE a.h || ' ' || b.s END, 'n': CASE WHEN a.n + {_TOKENS.replace("X", "b.s")} > 384 AND a.h <> '' THEN {_TOKENS.replace("X", "b.s")} ELSE a.n + {_TOKENS.replace("X", "b.s")} END, 'o': a.o || CASE WHEN a.n + {_TOKENS.replace("X", "b.s")} > 384 AND a.h <> '' THEN a.h || chr(1) ELSE '' END}}) AS q FROM s)),
 b AS (SELECT doc_id, f, i AS piece, CASE WHEN section IS NULL THEN x ELSE '[' || section || '] ' || x END AS content, page, idx, st + before AS st, st + before + length(x) AS en, section, language FROM (SELECT *, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id, f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT *, unnest(pieces) AS x, generate_subscripts(pieces, 1) AS i FROM r)))
 SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY f, piece) - 1)::INT AS chunk_no, content, page::INT AS page_number, idx::INT AS paragraph_index, st::BIGINT AS char_offset_start, en::BIGINT AS char_offset_end, section AS section_path, language FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""")
def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of each document with their texts, places and sections."""
    return P.chunk_rows(_pages(spark, d), "doc_id", "pages", "language")


_FIELDS = {"title": "Indications and Usage", "text": "Warnings", "metadata": "Drug Interactions"}


@query(" UNION ALL ".join(f"SELECT doc_id, 'Drug ' || doc_id AS title, '{name}' AS section, substring(regexp_replace(regexp_replace(x, '{WS}+', ' ', 'g'), {_TRIM}), 1, 3000) AS text FROM (SELECT doc_id, {expr} AS x FROM documents) WHERE length(substring(regexp_replace(regexp_replace(x, '{WS}+', ' ', 'g'), {_TRIM}), 1, 3000)) >= 40" for name, expr in (("Indications and Usage", "coalesce(title, '') || chr(10) || coalesce(text, '')"), ("Boxed Warning", "coalesce(text, '')"))))
def label_records(spark: SparkSession, d: str) -> DataFrame:
    """Labels in the form they are delivered in, some fields arrays and some texts, as titled sections."""
    from ..session import scratch
    from ..sources import readers

    folder = scratch(spark, "labels")
    text = F.coalesce("text", F.lit(""))
    given = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.struct(F.array(F.lit("HUMAN PRESCRIPTION DRUG")).alias("product_type"), F.array(F.lit("")).alias("brand_name")).alias("openfda"), F.array(F.coalesce("title", F.lit("")), text).alias("indications_and_usage"), text.alias("boxed_warning"))
    given.write.json(folder)
    rows = readers.labels(spark, folder, None)
    titled = rows.select("*", R.label_title(F.col("openfda.brand_name"), F.col("openfda.generic_name"), F.col("id")).alias("_title"))
    sections = R.label_sections(titled, "id", R.LABEL_FIELDS)
    return sections.join(titled.select("id", F.col("_title").alias("title")), "id").select(F.col("id").cast("long").alias("doc_id"), "title", "section", "text")


@query(rf"""SELECT doc_id, section_no::BIGINT AS section_no, section, start::BIGINT AS start, (start + length(text))::BIGINT AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY o) - 1 AS section_no, coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM
 (SELECT doc_id, o, section, substring(regexp_replace(regexp_replace(coalesce(x, ''), '{WS}+', ' ', 'g'), {_TRIM}), 1, 3000) AS text FROM (SELECT doc_id, 1 AS o, 'title' AS section, title AS x FROM documents UNION ALL SELECT doc_id, 2, 'text', text FROM documents UNION ALL SELECT doc_id, 3, 'metadata', metadata FROM documents)) WHERE length(text) >= 40)""")
def label_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = R.label_sections(table(spark, d, "documents"), "doc_id", ["title", "text", "metadata"])
    return rows.select("doc_id", F.col("section_no").cast("long").alias("section_no"), "section", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


_REC = """(SELECT doc_id AS position, coalesce(source, '') AS source, doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = 1 THEN (doc_id // 6)::VARCHAR ELSE '' END AS pmid, CASE WHEN doc_id % 3 = 0 THEN '10.1/' || (doc_id // 6) END AS doi, title, text AS abstract, document_type AS journal, '2024' AS year FROM documents)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    sixth = F.floor(i / 6).cast("long").cast("string")
    return table(spark, d, "documents").select(
        i.alias("position"), F.coalesce("source", F.lit("")).alias("source"), i.cast("string").alias("id"), F.when(i % 3 == 1, sixth).otherwise("").alias("pmid"), F.when(i % 3 == 0, F.concat(F.lit("10.1/"), sixth)).alias("doi"),
        "title", F.col("text").alias("abstract"), F.col("document_type").alias("journal"), F.lit("2024").alias("year"),
    )


_CLEAN = rf"regexp_replace(regexp_replace(regexp_replace(coalesce(COL, ''), '<[^>]+>', '', 'g'), '{WS}+', ' ', 'g'), {_TRIM})"
_PAPERS = f"""(SELECT coalesce(nullif(doi, ''), nullif(pmid, ''), source || ':' || id) AS paper_id, t AS title, a AS abstract, journal, year, doi, pmid, position,
 CASE WHEN coalesce(doi, '') <> '' THEN 'https://doi.org/' || doi WHEN pmid <> '' THEN 'https://pubmed.ncbi.nlm.nih.gov/' || pmid || '/' ELSE 'https://europepmc.org/article/' || source || '/' || id END AS url
 FROM (SELECT *, {_CLEAN.replace("COL", "title")} AS t, {_CLEAN.replace("COL", "abstract")} AS a FROM {_REC}) WHERE t <> '' AND length(a) >= 40)"""


@query(f"SELECT paper_id, title, abstract, url, position FROM {_PAPERS}")
def record_map(spark: SparkSession, d: str) -> DataFrame:
    return R.mapped_papers(_records(spark, d)).select("paper_id", "title", "abstract", "url", "position")


_KEY = "coalesce(nullif(doi, ''), nullif(pmid, ''), trim(regexp_replace(lower(replace(title, 'İ', 'i' || chr(775))), '[^a-z0-9]+', ' ', 'g')))"


@query(f"""SELECT paper_id, url, first_position FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY length(abstract) DESC, position) AS r, min(position) OVER (PARTITION BY k) AS first_position FROM (SELECT *, {_KEY} AS k FROM {_PAPERS})) WHERE r = 1""")
def literature_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return R.distinct_papers(R.mapped_papers(_records(spark, d))).select("paper_id", "url", "first_position")


@query(f"SELECT paper_id, position, title || chr(10) || chr(10) || abstract AS content, nullif(concat_ws(' ', nullif(journal, ''), nullif(year, '')), '') AS section FROM {_PAPERS}")
def paper_to_chunk(spark: SparkSession, d: str) -> DataFrame:
    return R.mapped_papers(_records(spark, d)).select("paper_id", "position", R.paper_chunk(F.col("title"), F.col("abstract")).alias("content"), R.paper_section(F.col("journal"), F.col("year")).alias("section"))
