"""Vector and lexical search, rank fusion and reordering.

vector_top and lexical_top serve one question; the searches keyed by query_id and tenant serve any
number of questions in one plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

POOL = 25  # candidates a branch
RRF_K = 60
QUERY_BLOCK = 4096  # questions and rows that one task compares at once, about
ROW_BLOCK = 20_000

# Frequent words left out of lexical search.
STOP_WORDS_EN = "a an and are as at be been by for from had has have if in into is it its may no not of on or such that the their then there these they this to was were will with".split()
STOP_WORDS_TR = "acaba ama ancak bazı belki ben bile bir biri birkaç biz bu çok çünkü da daha de defa diye en eğer gibi göre hem hep her için ile ise kadar ki kim mı mi mu mü nasıl ne neden nerede niçin o olan olarak sonra şey siz şu tüm ve veya ya yani".split()


def cosine(a: Column, b: Column) -> Column:
    """1 minus cosine distance, in doubles; null where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_top(rows: DataFrame, query: list[float], k: int = POOL, key: str = "id", vector: str = "embedding", ids: list | None = None) -> DataFrame:
    """The k rows most similar to one vector: key, similarity. Null vectors take no part; an empty id list restricts nothing."""
    if ids:
        rows = rows.where(F.col(key).isin(ids))
    near = rows.where(F.col(vector).isNotNull()).select(key, cosine(F.col(vector), F.array(*map(F.lit, map(float, query)))).alias("similarity"))
    return near.where(F.col("similarity").isNotNull()).orderBy(F.desc("similarity"), key).limit(k)


def _usable(vectors: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit forms of vectors of `size` finite numbers that are not all zero."""
    at = np.array([i for i, v in enumerate(vectors) if len(v) == size], np.int64)
    x = np.array([vectors.iat[i] for i in at], np.float64).reshape(len(at), size)
    norm = np.linalg.norm(x, axis=1)
    ok = np.isfinite(norm) & (norm > 0)
    return at[ok], x[ok] / norm[ok, None]


def vector_search(rows: DataFrame, queries: DataFrame, k: int = POOL, key: str = "id", vector: str = "embedding", tenant: str | None = None, document: str | None = None) -> DataFrame:
    """query_id, key, similarity and rank of the k rows most similar to each question's vector, exactly.

    queries: query_id, the vector, the tenant's column where `tenant` is given (rows of other
    tenants are not seen), and where `document` is given document_ids, an array of the only values
    of that column searched (null or empty: all). Both sides are dealt to blocks, each pair of blocks
    that share a tenant is multiplied by one task, which hands on its best k a question. Vectors
    that are null, of another length than the question's, zero or not finite take no part. Ties go to the
    smaller key. Nothing is gathered on the driver but two counts.
    """
    kinds = rows.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    shared = F.col(tenant).cast("string") if tenant else F.lit("")
    n_rows, n_queries = rows.count(), queries.count()
    row_blocks, query_blocks = -(-max(1, n_rows) // ROW_BLOCK), -(-max(1, n_queries) // QUERY_BLOCK)
    given = [F.col(document).cast("string").alias("_d")] if document else [F.lit(None).cast("string").alias("_d")]
    wanted = [F.col("document_ids").cast("array<string>").alias("_only")] if document else [F.lit(None).cast("array<string>").alias("_only")]
    x = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.col(vector).alias("_v"), shared.alias("_t"), *given, F.pmod(F.xxhash64(key), F.lit(row_blocks)).alias("_r"))
    q = queries.where(F.col(vector).isNotNull()).select("query_id", F.col(vector).alias("_v"), shared.alias("_t"), *wanted, F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("_q"))
    x_dealt = x.join(q.select("_t", F.col("_q").alias("_q_of_x")).distinct(), "_t").withColumnRenamed("_t", "_t_of_x")
    q_dealt = q.join(x.select("_t", F.col("_r").alias("_r_of_q")).distinct(), "_t")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            for size, some in right.groupby(right["_v"].map(len)):
                at, base = _usable(left["_v"], size)
                asked, unit = _usable(some["_v"], size)
                names, only = some["query_id"].to_numpy()[asked], some["_only"].to_numpy()[asked]
                ids, docs = left["_k"].to_numpy()[at], left["_d"].to_numpy()[at]
                for i in range(0, len(unit), 256):
                    for name, chosen, near in zip(names[i : i + 256], only[i : i + 256], unit[i : i + 256] @ base.T):
                        if chosen is not None and len(chosen):
                            near = np.where(np.isin(docs.astype(str), list(map(str, chosen))), near, -np.inf)
                        low = -np.inf if len(near) <= k else np.partition(near, -k)[-k]
                        t = np.flatnonzero((near >= low) & (near > -np.inf))
                        t = t[np.lexsort((ids[t], -near[t]))][:k]
                        out.append(pd.DataFrame({"query_id": name, key: ids[t], "similarity": near[t]}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], key: [], "similarity": []}).astype({"query_id": object, key: object})

    made = x_dealt.groupBy("_t_of_x", "_r", "_q_of_x").cogroup(q_dealt.groupBy("_t", "_r_of_q", "_q")).applyInPandas(run, f"query_id {kinds[1]}, `{key}` {kinds[0]}, similarity double")
    return top_ranked(made, F.round("similarity", 12), k, key)


def top_ranked(rows: DataFrame, by: Column, k: int, key: str = "id") -> DataFrame:
    """The k best rows of each query_id with their rank, ties to the smaller key. Window groups are cut to k before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc(by), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def analyzed(text: Column) -> Column:
    """Lower-case terms of letters and digits, Turkish capitals included."""
    return F.filter(F.split(F.lower(F.translate(text, "Iİ", "ıi")), "[^\\p{L}\\p{M}\\p{N}]+"), lambda t: F.length(t) > 0)


def light_stem(term: Column) -> Column:
    """A Turkish term without a case ending and then without plural or possessive, if three letters stay. An own rule, not Snowball's."""
    bare = F.regexp_replace(F.regexp_replace(term, "(?:nd[ae]n?|[dt][ae]n?|n[ıiuü]n|[ıiuü]n|yl[ae]|l[ae])\\z", ""), "(?:l[ae]r[ıiuü]?|s[ıiuü])\\z", "")
    return F.when(F.length(bare) >= 3, bare).otherwise(term)


def lexemes(text: Column) -> Column:
    """An array of (term, position): stems of the terms that are no stop words, positions counting stop words, from 0."""
    placed = F.transform(analyzed(text), lambda t, i: F.struct(t.alias("term"), i.alias("position")))
    kept = F.filter(placed, lambda s: ~s["term"].isin(*STOP_WORDS_EN, *STOP_WORDS_TR))
    return F.transform(kept, lambda s: F.struct(light_stem(s["term"]).alias("term"), s["position"].alias("position")))


def postings(rows: DataFrame, key: str = "id", text: str = "content", stop_words: list[str] | None = None) -> DataFrame:
    """key, term, position (from 0, counting stop words) of every term of every text."""
    out = rows.select(key, F.posexplode(analyzed(F.col(text))).alias("position", "term"))
    return out.where(~F.col("term").isin(stop_words)) if stop_words else out


def stored_postings(rows: DataFrame, key: str = "id", text: str = "content", keep: tuple[str, ...] = ()) -> DataFrame:
    """`keep`, key, term (stemmed, no stop words) and position: what lexical_search looks terms up in. Write it once, partitioned or bucketed by term, and search it often."""
    return rows.select(*keep, key, F.explode(lexemes(F.col(text))).alias("l")).select(*keep, key, "l.term", "l.position")


def lexical_search(stored: DataFrame, queries: DataFrame, k: int = POOL, key: str = "id", text: str = "text", tenant: str | None = None, document: str | None = None) -> DataFrame:
    """query_id, key, score and rank of the k texts with all lexemes of each question, by cover density.

    Questions go through the same analysis as the texts. Those without a lexeme find nothing. Only
    postings of the questions' own terms leave the join; what is put together afterwards is the
    hits of one question in one text. See lexical_top for the score. `tenant` and `document` as in
    vector_search.
    """
    on = [tenant] if tenant else []
    asked = queries.select("query_id", *on, *(["document_ids"] if document else []), F.array_distinct(F.transform(lexemes(F.col(text)), lambda s: s["term"])).alias("_all"))
    terms = asked.select("query_id", *on, *(["document_ids"] if document else []), F.size("_all").alias("_n"), F.explode("_all").alias("term"))
    hits = stored.join(terms, [*on, "term"])
    if document:
        hits = hits.where(F.coalesce(F.size("document_ids"), F.lit(0)).isin(0, -1) | F.array_contains("document_ids", F.col(document)))
    found = hits.groupBy("query_id", key).agg(F.array_sort(F.collect_list(F.struct("position", "term"))).alias("_h"), F.first("_n").alias("_n"), F.count_distinct("term").alias("_own"))
    whole = found.where(F.col("_own") == F.col("_n")).select("query_id", key, F.transform("_h", lambda h: h["position"]).alias("_p"), F.transform("_h", lambda h: h["term"]).alias("_t"), "_n")
    kinds = (whole.schema["query_id"].dataType.simpleString(), whole.schema[key].dataType.simpleString())

    def density(places: list[int], names: list[str], n: int) -> float:
        last: dict[str, int] = {}
        score, begun = 0.0, -1
        for i, (p, name) in enumerate(zip(places, names)):
            last[name] = i
            first = min(last.values())
            if len(last) == n and first > begun:
                begun = first
                score += 0.1 / (1 + max(0, p - places[first] - (i - first)))
        return score

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"query_id": b["query_id"], key: b[key], "score": [density(p, t, n) for p, t, n in zip(b["_p"], b["_t"], b["_n"])]})

    return top_ranked(whole.mapInPandas(run, f"query_id {kinds[0]}, `{key}` {kinds[1]}, score double"), F.round("score", 9), k, key)


def lexical_top(rows: DataFrame, terms: list[str], k: int = POOL, key: str = "id", text: str = "content") -> DataFrame:
    """The k texts that hold all terms, by cover density: key, score.

    A cover is a shortest stretch that holds every term; each adds 0.1 / (1 + words in it that
    are no terms). For one term that is 0.1 for each occurrence. Ties go to the smaller key.
    """
    terms = list(dict.fromkeys(terms))
    cut = analyzed(F.col(text))
    held = rows.select(key, cut.alias("_t")).where(F.forall(F.array(*map(F.lit, terms)), lambda t: F.array_contains("_t", t)))
    hits = F.filter(F.transform("_t", lambda t, i: F.struct(t.alias("t"), i.alias("p"))), lambda s: s["t"].isin(terms))
    hits = held.select(key, F.posexplode(hits).alias("_n", "_h")).select(key, "_n", F.col("_h.t").alias("_term"), F.col("_h.p").alias("_p"))
    own = Window.partitionBy(key).orderBy("_n")
    back = own.rowsBetween(Window.unboundedPreceding, 0)
    lasts = [F.last(F.when(F.col("_term") == t, F.col("_n")), ignorenulls=True).over(back) for t in terms]
    complete = F.lit(True)
    for x in lasts:
        complete = complete & x.isNotNull()
    begun = hits.withColumn("_from", F.when(complete, F.least(*lasts) if len(lasts) > 1 else lasts[0]))
    minimal = begun.withColumn("_old", F.lag("_from").over(own)).where(F.col("_from").isNotNull() & (F.col("_old").isNull() | (F.col("_old") < F.col("_from"))))
    starts = hits.select(key, F.col("_n").alias("_from"), F.col("_p").alias("_start"))
    covers = minimal.join(starts, [key, "_from"])
    noise = F.greatest(F.lit(0), (F.col("_p") - F.col("_start")) - (F.col("_n") - F.col("_from")))
    return covers.groupBy(key).agg(F.sum(0.1 / (1 + noise)).alias("score")).orderBy(F.desc("score"), key).limit(k)


def ranked(rows: DataFrame, by: str, key: str = "id", query: str | None = None) -> DataFrame:
    """Adds rank (from 1) by descending `by`, ties to the smaller key. For short candidate lists."""
    w = Window.partitionBy(*([query] if query else [F.lit(0)])).orderBy(F.desc(by), key)
    return rows.withColumn("rank", F.row_number().over(w))


def fuse(vector: DataFrame, keyword: DataFrame, k: int | list[int] = RRF_K, top: int = 10, key: str = "id", query: str | None = None) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: key, score, sources, vector_rank, keyword_rank, similarity, fts_score.

    Equal scores keep the order of the vector list, then of the keyword list. For a list of
    constants the candidates are found once and the result has a column k. With `query`, lists of
    many questions are fused at once and places are numbered in the column place.
    """
    own = [query] if query else []
    v = vector.select(*own, key, F.lit("vector").alias("source"), "rank", F.col("similarity").alias("similarity"), F.lit(None).cast("double").alias("fts_score"))
    w = keyword.select(*own, key, F.lit("keyword").alias("source"), "rank", F.lit(None).cast("double").alias("similarity"), F.col("score").alias("fts_score"))
    many = k if isinstance(k, list) else [k]
    lists = v.unionByName(w).withColumn("k", F.explode(F.array(*map(F.lit, many))))
    fused = lists.groupBy(*own, "k", key).agg(
        F.sum(1.0 / (F.col("k") + F.col("rank"))).alias("score"),
        F.array_join(F.sort_array(F.collect_set("source"), asc=False), ",").alias("sources"),
        F.max(F.when(F.col("source") == "vector", F.col("rank"))).alias("vector_rank"),
        F.max(F.when(F.col("source") == "keyword", F.col("rank"))).alias("keyword_rank"),
        F.max("similarity").alias("similarity"),
        F.max("fts_score").alias("fts_score"),
    )
    order = (F.desc(F.round("score", 12)), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("keyword_rank"))
    if not isinstance(k, list) and not query:
        return fused.drop("k").orderBy(*order).limit(top)
    best = Window.partitionBy(*own, "k").orderBy(*order)
    placed = fused.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top)
    return placed.drop("k") if query else placed.drop("place")


def hybrid_search(chunks: DataFrame, stored: DataFrame, queries: DataFrame, documents: DataFrame, top: int = 20, k: int = RRF_K) -> DataFrame:
    """Both searches for many questions, fused: query_id, id, place, score, sources, ranks and scores of both.

    chunks: id, tenant_id, document_id, embedding; stored: their postings with tenant_id and
    document_id; queries: query_id, tenant_id, embedding, text, document_ids; documents: id. Chunks
    of unknown documents and of other tenants are out before anything is ranked.
    """
    known = documents.select(F.col("id").alias("document_id"))
    near = vector_search(chunks.join(known, "document_id", "left_semi"), queries, tenant="tenant_id", document="document_id")
    words = lexical_search(stored.join(known, "document_id", "left_semi"), queries, tenant="tenant_id", document="document_id")
    return fuse(near, words, k, top, query="query_id")


def reranked(candidates: DataFrame, prompts: DataFrame, call: Callable[[str], str], top: int, at_once: int = 4) -> DataFrame:
    """The `top` best candidates of each question in the order a model names: the candidates' columns with a new place from 1.

    candidates: query_id, place; prompts: query_id, prompt. Questions with at most `top`
    candidates reach no model. A call that fails, or names nothing, leaves the order as it was.
    """
    from ..functions.providers import called
    from ..functions.replies import reordered

    sizes = candidates.groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    asked = prompts.join(sizes.where(F.col("_n") > top), "query_id", "left_semi")
    replies = called(asked, "query_id", "prompt", call, at_once, failed="")
    order = sizes.join(replies, "query_id", "left").select("query_id", F.posexplode(reordered(F.coalesce("reply", F.lit("")), F.col("_n"))).alias("_p", "_old")).where(F.col("_p") < top)
    moved = order.select("query_id", (F.col("_old") + 1).alias("place"), (F.col("_p") + 1).alias("_place"))
    return candidates.join(moved, ["query_id", "place"]).drop("place").withColumnRenamed("_place", "place")
