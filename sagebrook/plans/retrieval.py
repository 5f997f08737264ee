"""Search and fusion queries. Vectors: embeddings; texts: chunks; both: chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import NO_SOURCES, no_sources, rerank_prompts
from ..functions.text import query_language
from ..operators import retrieval as R
from ..operators.tables import latest_state
from ..session import table
from .registry import query

_SIM = "list_dot_product(e.embedding::DOUBLE[], q.v) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v)))"


def _one_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector that is asked about: the one with the smallest id."""
    return table(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]


@query(f"SELECT e.vec_id, round({_SIM}, 6) AS similarity FROM embeddings e, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q ORDER BY {_SIM} DESC, vec_id LIMIT 25")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    return R.vector_top(rows, _one_vector(spark, d), key="vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"""SELECT query_id, vec_id, round(s, 6) AS similarity, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM
 (SELECT q.vec_id AS query_id, e.vec_id, {_SIM} AS s FROM embeddings e, (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0) q)) WHERE rank <= 25""")
def vector_topk_batch(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by fifty is a query, against all rows."""
    rows = table(spark, d, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.vector_search(rows, asked, key="vec_id").select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"SELECT e.vec_id, round({_SIM}, 6) AS similarity FROM (SELECT * FROM embeddings WHERE label IN (1, 3, 5)) e, (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q ORDER BY {_SIM} DESC, vec_id LIMIT 25")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").where(F.col("label").isin(1, 3, 5))
    return R.vector_top(rows, _one_vector(spark, d), key="vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


_C = "(SELECT id, arg_max(content, ingested_at) AS content FROM chunks WHERE id IS NOT NULL GROUP BY id)"
_TERMS = r"list_filter(string_split(regexp_replace(lower(translate(content, 'Iİ', 'ıi')), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'), ' '), lambda t: length(t) > 0)"
_TOK = f"(SELECT id, t AS term, p - 1 AS position FROM (SELECT id, unnest(l) AS t, generate_subscripts(l, 1) AS p FROM (SELECT id, {_TERMS} AS l FROM {_C})))"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks once each, as delivered last."""
    rows = table(spark, d, "chunks").where(F.col("id").isNotNull())
    return latest_state(rows, "id", "ingested_at", "content", ["ingested_at", "content"]).select("id", "content")


@query(f"SELECT term, count(*)::BIGINT AS n, count(DISTINCT id)::BIGINT AS chunks FROM {_TOK} GROUP BY term")
def postings_build(spark: SparkSession, d: str) -> DataFrame:
    per = R.postings(_texts(spark, d)).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    return per.groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("chunks"))


_STOPPED = ", ".join(f"'{w}'" for w in R.STOP_WORDS_EN + R.STOP_WORDS_TR)


@query(f"SELECT id, count(*)::BIGINT AS terms FROM {_TOK} WHERE term NOT IN ({_STOPPED}) GROUP BY id")
def lexical_stopwords(spark: SparkSession, d: str) -> DataFrame:
    return R.postings(_texts(spark, d), stop_words=R.STOP_WORDS_EN + R.STOP_WORDS_TR).groupBy("id").agg(F.count(F.lit(1)).alias("terms"))


@query(f"SELECT id, round(count(*) * 0.1::DOUBLE, 6) AS score FROM {_TOK} WHERE term = 'tablets' GROUP BY id ORDER BY 2 DESC, 1 LIMIT 25")
def lexical_topk_single_term(spark: SparkSession, d: str) -> DataFrame:
    return R.lexical_top(_texts(spark, d), ["tablets"]).select("id", F.round("score", 6).alias("score"))


@query(rf"""SELECT stem, count(*)::BIGINT AS n, count(DISTINCT term)::BIGINT AS forms FROM (SELECT term, CASE WHEN length(s) >= 3 THEN s ELSE term END AS stem FROM (SELECT term, regexp_replace(regexp_replace(term, '(?:nd[ae]n?|[dt][ae]n?|n[ıiuü]n|[ıiuü]n|yl[ae]|l[ae])$', ''), '(?:l[ae]r[ıiuü]?|s[ıiuü])$', '') AS s FROM {{_TOK}})) GROUP BY stem""".replace("{_TOK}", _TOK))
def lexical_stems(spark: SparkSession, d: str) -> DataFrame:
    """Terms by light Turkish stems, and how many forms each stem stands for."""
    per = R.postings(_texts(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(R.light_stem(F.col("term")).alias("stem")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("forms"))


def _covers(a: str, b: str, most: str) -> str:
    return f"""SELECT id, round(sum(0.1::DOUBLE / (1 + greatest(0, p - f - 1))), 6) AS score, sum(0.1::DOUBLE / (1 + greatest(0, p - f - 1))) AS raw FROM
 (SELECT id, position AS p, term, lag(position) OVER w AS f, lag(term) OVER w AS g FROM {_TOK} WHERE term IN ('{a}', '{b}') WINDOW w AS (PARTITION BY id ORDER BY position)) WHERE g <> term GROUP BY id ORDER BY round(raw, 9) DESC, id {most}"""


@query(f"SELECT id, score FROM ({_covers('exposure', 'doubles', 'LIMIT 25')})")
def lexical_topk_all_terms(spark: SparkSession, d: str) -> DataFrame:
    return R.lexical_top(_texts(spark, d), ["exposure", "doubles"]).select("id", F.round("score", 6).alias("score"))


@query(f"SELECT id, score FROM ({_covers('lower', 'dose', 'LIMIT 100')})")
def lexical_cover_density(spark: SparkSession, d: str) -> DataFrame:
    return R.lexical_top(_texts(spark, d), ["lower", "dose"], 100).select("id", F.round("score", 6).alias("score"))


_ROWS = "(SELECT * FROM (SELECT id, arg_max(content, ingested_at) AS content, arg_max(embedding, ingested_at) AS embedding, arg_max(document_id, ingested_at) AS document_id, arg_max(tenant_id, ingested_at) AS tenant_id FROM chunks WHERE id IS NOT NULL GROUP BY id) WHERE document_id IN (SELECT id FROM documents WHERE id IS NOT NULL))"
_USABLE = f"(SELECT id, embedding::DOUBLE[] AS embedding FROM {_ROWS} WHERE embedding IS NOT NULL AND len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x))) AND list_dot_product(embedding, embedding) > 0)"


def _fused(k: int, top: int, where: str = "") -> str:
    return f"""WITH u AS (SELECT * FROM {_USABLE} {where}), q AS (SELECT embedding AS v FROM u WHERE id = (SELECT min(id) FROM u)),
 v AS (SELECT id, s, row_number() OVER (ORDER BY s DESC, id) AS r FROM (SELECT e.id, {_SIM} AS s FROM u e, q ORDER BY s DESC, id LIMIT 25)),
 t AS (SELECT * FROM {_TOK.replace(_C, _ROWS)} {where}),
 w AS (SELECT id, n, row_number() OVER (ORDER BY n DESC, id) AS r FROM (SELECT id, round(count(*) * 0.1::DOUBLE, 9) AS n FROM t WHERE term = 'tablets' GROUP BY id ORDER BY 2 DESC, 1 LIMIT 25)),
 f AS (SELECT coalesce(v.id, w.id) AS id, coalesce(1.0::DOUBLE / ({k} + v.r), 0) + coalesce(1.0::DOUBLE / ({k} + w.r), 0) AS score, v.r AS vr, w.r AS wr FROM v FULL JOIN w ON v.id = w.id)
 SELECT id, round(score, 6) AS score, concat_ws(',', CASE WHEN vr IS NOT NULL THEN 'vector' END, CASE WHEN wr IS NOT NULL THEN 'keyword' END) AS sources FROM f ORDER BY round(score, 12) DESC, vr NULLS LAST, wr LIMIT {top}"""


def _usable(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of known documents, once each, as delivered last."""
    rows = table(spark, d, "chunks").where(F.col("id").isNotNull())
    last = latest_state(rows, "id", "ingested_at", "content", ["ingested_at", "content", "embedding", "document_id", "tenant_id"])
    return last.join(table(spark, d, "documents").select(F.col("id").alias("document_id")), "document_id", "left_semi")


def _hybrid(spark: SparkSession, d: str, k: int | list[int] = R.RRF_K, top: int = 10, documents: DataFrame | None = None) -> DataFrame:
    rows = _usable(spark, d)
    if documents is not None:
        rows = rows.join(documents, "document_id", "left_semi")
    whole = rows.where(F.col("embedding").isNotNull() & (F.size("embedding") == 64) & ~F.exists("embedding", F.isnan) & F.exists("embedding", lambda x: x != 0))
    first = whole.orderBy("id").select("embedding").limit(1).collect()
    near = R.ranked(R.vector_top(whole, first[0][0] if first else [0.0] * 64), "similarity")
    words = R.ranked(R.lexical_top(rows, ["tablets"]), "score")
    return R.fuse(near, words, k, top)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("score", 6).alias("score"), "sources")


@query(_fused(60, 20))
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_hybrid(spark, d, top=20))


@query(" UNION ALL ".join(f"SELECT {k}::INT AS k, * FROM ({_fused(k, 10)})" for k in (10, 60, 100)))
def rrf_k_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The candidates are searched once for all three constants."""
    return _hybrid(spark, d, [10, 60, 100]).select("k", "id", F.round("score", 6).alias("score"), "sources")


@query(f"""SELECT f.id, f.score, f.sources, d.title FROM ({_fused(60, 10)}) f LEFT JOIN (SELECT id, arg_max(document_id, ingested_at) AS document_id FROM chunks GROUP BY id) c ON c.id = f.id LEFT JOIN documents d ON d.id = c.document_id""")
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: the ten best chunks by vector and words together, joined to their titles only after the cut."""
    best = _hybrid(spark, d)
    rows = table(spark, d, "chunks").select("id", "document_id", "ingested_at").join(F.broadcast(best.select("id")), "id", "left_semi")  # ten rows
    place = rows.groupBy("id").agg(F.max_by("document_id", "ingested_at").alias("document_id"))
    titles = table(spark, d, "documents").select(F.col("id").alias("document_id"), "title")
    return _shown(best).join(place, "id", "left").join(titles, "document_id", "left").select("id", "score", "sources", "title")


@query(_fused(60, 10, "WHERE id IN (SELECT c.id FROM chunks c JOIN documents d ON d.id = c.document_id WHERE d.language = 'tr')"))
def hybrid_document_filter(spark: SparkSession, d: str) -> DataFrame:
    """Only chunks of a list of documents: here those labelled Turkish."""
    return _shown(_hybrid(spark, d, documents=table(spark, d, "documents").where("language = 'tr'").select(F.col("id").alias("document_id"))))


_STEM = r"regexp_replace(regexp_replace(t, '(?:nd[ae]n?|[dt][ae]n?|n[ıiuü]n|[ıiuü]n|yl[ae]|l[ae])$', ''), '(?:l[ae]r[ıiuü]?|s[ıiuü])$', '')"
_ASKED = f"(SELECT id AS query_id, tenant_id, embedding, substring(content, 1, 40) AS content, id AS id FROM {_ROWS} WHERE ('0x' || substring(md5(id), 1, 8))::UBIGINT % 50 = 0)"


def _lexemes(source: str, keep: str) -> str:
    return f"(SELECT {keep}, p - 1 AS position, CASE WHEN length({_STEM}) >= 3 THEN {_STEM} ELSE t END AS term FROM (SELECT {keep}, unnest(l) AS t, generate_subscripts(l, 1) AS p FROM (SELECT {keep}, {_TERMS} AS l FROM {source})) WHERE t NOT IN ({_STOPPED}))"


_LEXICAL = f"""l AS MATERIALIZED {_lexemes(_ROWS, "id, tenant_id")}, a AS (SELECT DISTINCT query_id, tenant_id, term FROM {_lexemes(_ASKED, "query_id, tenant_id")}), n AS (SELECT query_id, count(*) AS n FROM a GROUP BY query_id),
 h AS MATERIALIZED (SELECT query_id, l.id, position AS p, l.term, row_number() OVER (PARTITION BY query_id, l.id ORDER BY position) AS i FROM a JOIN l ON l.tenant_id = a.tenant_id AND l.term = a.term),
 w AS (SELECT h.* FROM h JOIN (SELECT query_id, id, count(DISTINCT term) AS c FROM h GROUP BY query_id, id) k ON k.query_id = h.query_id AND k.id = h.id JOIN n ON n.query_id = h.query_id AND n.n = k.c),
 c AS (SELECT query_id, id, i, p, min(last) AS f, count(*) AS held FROM (SELECT x.query_id, x.id, x.i, x.p, y.term, max(y.i) AS last FROM w x JOIN w y ON y.query_id = x.query_id AND y.id = x.id AND y.i <= x.i GROUP BY x.query_id, x.id, x.i, x.p, y.term) GROUP BY query_id, id, i, p),
 m AS (SELECT *, lag(f) OVER (PARTITION BY query_id, id ORDER BY i) AS g FROM (SELECT c.* FROM c JOIN n ON n.query_id = c.query_id AND n.n = c.held)),
 s AS (SELECT m.query_id, m.id, sum(0.1::DOUBLE / (1 + greatest(0, m.p - w.p - (m.i - m.f)))) AS score FROM m JOIN w ON w.query_id = m.query_id AND w.id = m.id AND w.i = m.f WHERE g IS NULL OR g < f GROUP BY m.query_id, m.id),
 kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM s) WHERE rank <= 25)"""
_VECTORS = f"""u AS MATERIALIZED (SELECT id, tenant_id, list_transform(embedding::DOUBLE[], x -> x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS x FROM {_ROWS} WHERE embedding IS NOT NULL AND len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: isnan(x))) AND list_dot_product(embedding, embedding) > 0),
 vc AS (SELECT * FROM (SELECT q.id AS query_id, u.id, list_dot_product(q.x, u.x) AS similarity, row_number() OVER (PARTITION BY q.id ORDER BY round(list_dot_product(q.x, u.x), 12) DESC, u.id) AS rank FROM u q SEMI JOIN {_ASKED} k ON k.query_id = q.id JOIN u ON u.tenant_id = q.tenant_id) WHERE rank <= 25)""".replace("x -> ", "lambda x: ", 1)
_BOTH = f"""{_VECTORS}, {_LEXICAL}, fu AS (SELECT coalesce(vc.query_id, kw.query_id) AS query_id, coalesce(vc.id, kw.id) AS id, coalesce(1.0::DOUBLE / (60 + vc.rank), 0) + coalesce(1.0::DOUBLE / (60 + kw.rank), 0) AS score, vc.rank AS vr, kw.rank AS wr FROM vc FULL JOIN kw ON vc.query_id = kw.query_id AND vc.id = kw.id),
 pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vr NULLS LAST, wr) AS place FROM fu) WHERE place <= 20)"""


def _questions(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """A stated fiftieth of all chunks asks: with its vector and its first forty characters, in its own tenant."""
    fiftieth = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % 50 == 0
    return rows.where(fiftieth).select(F.col("id").alias("query_id"), "tenant_id", "embedding", F.substring("content", 1, 40).alias("text"), F.lit(None).cast("array<string>").alias("document_ids"))


def _postings(rows: DataFrame) -> DataFrame:
    return R.stored_postings(rows, keep=("tenant_id", "document_id"))


@query(f"WITH {_LEXICAL} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM kw")
def question_lexical(spark: SparkSession, d: str) -> DataFrame:
    """Texts with all lexemes of each question, three and more among them, within its tenant."""
    rows = _usable(spark, d)
    found = R.lexical_search(_postings(rows), _questions(spark, d, rows), tenant="tenant_id", document="document_id")
    return found.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_VECTORS} SELECT query_id, id, round(similarity, 6) AS similarity, rank::INT AS rank FROM vc")
def question_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = _usable(spark, d)
    found = R.vector_search(rows, _questions(spark, d, rows), tenant="tenant_id", document="document_id")
    return found.select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = _usable(spark, d)
    return R.hybrid_search(rows, _postings(rows), _questions(spark, d, rows), table(spark, d, "documents"))


@query(f"WITH {_BOTH} SELECT query_id, id, place::INT AS place, round(score, 6) AS score FROM pl")
def question_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Both searches for all questions in one plan, fused."""
    return _candidates(spark, d).select("query_id", "id", "place", F.round("score", 6).alias("score"))


@query(f"""WITH {_BOTH}, sz AS (SELECT query_id, max(place) AS n FROM pl GROUP BY query_id),
 re AS (SELECT pl.query_id, pl.id, CASE WHEN n <= 4 OR 3 > n THEN place WHEN place = 3 THEN 1 WHEN place = 1 THEN 2 WHEN place = 2 THEN 3 ELSE place END AS place FROM pl JOIN sz ON sz.query_id = pl.query_id)
 SELECT re.query_id, re.place::INT AS place, re.id, d.title, c.document_id FROM re JOIN {_ROWS} c ON c.id = re.id JOIN documents d ON d.id = c.document_id WHERE re.place <= 4""")
def question_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The four sources of each question as a model orders them: the stand-in names the third and the first candidate."""
    rows = _usable(spark, d)
    asked = _questions(spark, d, rows)
    found = R.hybrid_search(rows, _postings(rows), asked, table(spark, d, "documents"))
    texts = rows.select("id", "content", "document_id")
    prompts = rerank_prompts(asked, found.join(texts.select("id", "content"), "id"))
    best = R.reranked(found, prompts, lambda prompt: "2, 0", 4)
    titles = table(spark, d, "documents").select(F.col("id").alias("document_id"), "title")
    return best.join(texts.select("id", "document_id"), "id").join(titles, "document_id").select("query_id", "place", "id", "title", "document_id")


def _said(lang: str) -> str:
    return "'" + NO_SOURCES[lang, "documents"].replace("'", "''") + "'"


@query(f"""SELECT q.id AS query_id, CASE WHEN regexp_matches(content, '[şğüöçŞĞÜÖÇ]') OR (content <> '' AND length(regexp_replace(content, '[^çğıöşüÇĞİÖŞÜ]', '', 'g')) / length(content)::DOUBLE > 0.01) THEN {_said("tr")} ELSE {_said("en")} END AS message
 FROM (SELECT DISTINCT id, content FROM messages WHERE content IS NOT NULL) q WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT content FROM chunks) c WHERE c.content = q.content)""")
def zero_source_guard(spark: SparkSession, d: str) -> DataFrame:
    """Questions without any candidate get a fixed message and reach no model; here a candidate is a chunk of the same text."""
    asked = table(spark, d, "messages").where(F.col("content").isNotNull()).select(F.col("id").alias("query_id"), "content").distinct()
    left = asked.join(table(spark, d, "chunks").select("content").distinct(), "content", "left_anti")
    return left.select("query_id", no_sources(query_language(F.col("content"))).alias("message"))
