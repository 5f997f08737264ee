"""Queries over answers: citations, context, replies, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import formats as FM
from ..functions import replies as R
from ..functions import text as T
from ..operators.ordering import sequence_within, with_parts
from ..operators.tables import latest_state
from ..session import table
from .registry import query
from .texts import _TRIM, WS

_M = "(SELECT * FROM (SELECT id, arg_max(content, ingested_at) AS content FROM messages WHERE content IS NOT NULL GROUP BY id))"
_NUMS = r"list_transform(regexp_extract_all(content, '\[\^(\d+)\]', 1), lambda x: regexp_replace(x, '^0+([0-9])', '\1'))"
_SORTED = f"list_transform(list_sort(list_transform(list_distinct({_NUMS}), lambda x: {{'n': length(x), 's': x}})), lambda p: p.s)"
_IN = "(length(x) <= 9 AND coalesce(TRY_CAST(x AS BIGINT) BETWEEN 1 AND 3, false))"
_CLAIMS = rf"""list_filter(list_transform(string_split(regexp_replace(regexp_replace(content, '([.!?]){WS}+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, {_TRIM})),
 lambda x: length(x) > 0 AND regexp_matches(regexp_replace(x, '\[\^(\d+)\]', '', 'g'), '[\p{{L}}\p{{N}}]') AND NOT regexp_matches(x, '^#{{1,6}}{WS}+') AND NOT regexp_full_match(x, '\*\*[^*]+\*\*:?'))"""


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages with content, once each, as delivered last."""
    rows = table(spark, d, "messages").where(F.col("content").isNotNull())
    return latest_state(rows, "id", "ingested_at", "content", ["ingested_at", "content"]).select("id", "content")


def _joined(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: x.cast("string")), ",")


@query(f"SELECT id, array_to_string({_NUMS}, ',') AS numbers, array_to_string({_SORTED}, ',') AS distinct_numbers FROM {_M}")
def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("content")
    return _messages(spark, d).select("id", _joined(C.cited_numbers(x)).alias("numbers"), _joined(C.distinct_numbers(x)).alias("distinct_numbers"))


@query(rf"SELECT id, regexp_matches(content, '\[\^(\d+)\]') AS cited FROM {_M}")
def contains_citation(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("id", C.has_citation(F.col("content")).alias("cited"))


@query(f"""SELECT id, array_to_string(list_filter(n, lambda x: {_IN}), ',') AS valid, array_to_string(list_filter(n, lambda x: NOT {_IN}), ',') AS invalid FROM
 (SELECT id, {_SORTED} AS n FROM {_M})""")
def citation_partition(spark: SparkSession, d: str) -> DataFrame:
    v = C.validation(F.col("content"), F.lit(3), 0.6)
    return _messages(spark, d).select("id", v.alias("v")).select("id", _joined(F.col("v.valid")).alias("valid"), _joined(F.col("v.invalid")).alias("invalid"))


@query(f"SELECT id, len(c)::BIGINT AS n_claims, array_to_string(c, '|') AS claims FROM (SELECT id, {_CLAIMS} AS c FROM {_M})")
def claim_sentences(spark: SparkSession, d: str) -> DataFrame:
    c = C.claim_sentences(F.col("content"))
    return _messages(spark, d).select("id", F.size(c).cast("long").alias("n_claims"), F.array_join(c, "|").alias("claims"))


def _validated(threshold: float, messages: str = _M) -> str:
    return rf"""SELECT id, len(c)::BIGINT AS total, (len(c) - h)::BIGINT AS uncited, round(CASE WHEN len(c) = 0 THEN 0 ELSE h / len(c)::DOUBLE END, 2) AS coverage,
 (len(list_filter(n, lambda x: NOT {_IN})) = 0 AND len(list_filter(n, lambda x: {_IN})) > 0 AND CASE WHEN len(c) = 0 THEN 0 ELSE h / len(c)::DOUBLE END >= {threshold}) AS ok
FROM (SELECT id, c, n, len(list_filter(c, lambda x: regexp_matches(x, '\[\^(\d+)\]'))) AS h FROM (SELECT id, {_CLAIMS} AS c, {_SORTED} AS n FROM {messages}))"""


def _validate(spark: SparkSession, d: str, threshold: float) -> DataFrame:
    v = C.validation(F.col("content"), F.lit(3), threshold)
    return _messages(spark, d).select("id", v.alias("v")).select("id", F.col("v.total").cast("long").alias("total"), F.col("v.uncited").cast("long").alias("uncited"), "v.coverage", "v.ok")


@query(_validated(0.6))
def citation_validate_documents(spark: SparkSession, d: str) -> DataFrame:
    return _validate(spark, d, 0.6)


@query(_validated(0.5))
def citation_validate_synthesis(spark: SparkSession, d: str) -> DataFrame:
    return _validate(spark, d, 0.5)


_LONG = f"(SELECT id, content || ' Also [^2], as in [^' || CASE WHEN length(content) % 2 = 0 THEN repeat('9', 20) ELSE repeat('0', 40) || '3' END || '].' AS content FROM {_M})"


@query(_validated(0.5, _LONG))
def citation_validate_long(spark: SparkSession, d: str) -> DataFrame:
    """Answers that name a source by a number of more digits than fit any integer, or by many zeros and a 3."""
    long = F.when(F.length("content") % 2 == 0, "9" * 20).otherwise("0" * 40 + "3")
    rows = _messages(spark, d).withColumn("content", F.concat("content", F.lit(" Also [^2], as in [^"), long, F.lit("].")))
    v = C.validation(F.col("content"), F.lit(3), 0.5)
    return rows.select("id", v.alias("v")).select("id", F.col("v.total").cast("long").alias("total"), F.col("v.uncited").cast("long").alias("uncited"), "v.coverage", "v.ok")


@query(f"""SELECT total, count(*)::BIGINT AS messages, sum(total - uncited)::BIGINT AS covered, round(avg(coverage), 6) AS mean_coverage FROM ({_validated(0.6)}) GROUP BY total""")
def citation_coverage(spark: SparkSession, d: str) -> DataFrame:
    v = _validate(spark, d, 0.6)
    return v.groupBy("total").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.col("total") - F.col("uncited")).alias("covered"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))


@query(f"""SELECT id, CASE WHEN ok THEN v || ' citations verified · ' || round(coverage * 100)::BIGINT || '% coverage' ELSE 'Check: ' || concat_ws(' · ', CASE WHEN i > 0 THEN i || ' invalid citation' || CASE WHEN i > 1 THEN 's' ELSE '' END || ' (^' || bad || ')' END,
 CASE WHEN uncited > 0 THEN uncited || ' uncited sentence' || CASE WHEN uncited > 1 THEN 's' ELSE '' END END, CASE WHEN v = 0 THEN 'no valid citations' END) END AS label
FROM ({_validated(0.6)}) JOIN (SELECT id AS k, len(list_filter(n, lambda x: {_IN})) AS v, len(list_filter(n, lambda x: NOT {_IN})) AS i, array_to_string(list_filter(n, lambda x: NOT {_IN}), ', ^') AS bad FROM (SELECT id, {_SORTED} AS n FROM {_M})) ON k = id""")
def citation_badge_label(spark: SparkSession, d: str) -> DataFrame:
    v = C.validation(F.col("content"), F.lit(3), 0.6)
    return _messages(spark, d).select("id", v.alias("v")).select("id", FM.validation_label(F.col("v")).alias("label"))


@query(rf"""SELECT id, array_to_string(list_filter(string_split(regexp_replace(content, '(\[\^\d+\])', chr(1) || '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) > 0), '¦') AS parts FROM {_M}""")
def citation_text_parts(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).select("id", F.array_join(C.text_parts(F.col("content")), "¦").alias("parts"))


_ROLE = "CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'bot', 'ai', 'model') THEN 'assistant' ELSE 'other' END"
_LAST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC) AS rn FROM messages) WHERE rn = 1 AND conversation_id IS NOT NULL)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    rows = latest_state(table(spark, d, "messages").where(F.col("id").isNotNull()), "id", "ingested_at", "created_at", ["conversation_id", "role", "content", "created_at"])
    bare = F.lower(F.trim("role"))
    role = F.when(bare.isin("user", "human"), "user").when(bare.isin("assistant", "bot", "ai", "model"), "assistant").otherwise("other")
    return rows.where(F.col("conversation_id").isNotNull()).withColumn("role", role)


@query(f"""SELECT id, previous FROM (SELECT id, r, last_value(CASE WHEN r = 'user' THEN content END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous
 FROM (SELECT *, {_ROLE} AS r FROM {_LAST})) WHERE r = 'assistant' AND previous IS NOT NULL""")
def prev_user_message(spark: SparkSession, d: str) -> DataFrame:
    """For each assistant message the nearest user message with content before it; as-of joined backwards over the turns of hot conversations in parts."""
    from pyspark.sql import Window

    rows = with_parts(_turns(spark, d), "conversation_id", "created_at")
    said = F.when(F.col("role") == "user", F.col("content"))
    own = Window.partitionBy("conversation_id", "_part").orderBy("created_at", "id")
    near = rows.withColumn("_near", F.last(said, ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1)))
    ends = rows.groupBy("conversation_id", "_part").agg(F.max_by(said, F.when(said.isNotNull(), F.struct("created_at", "id"))).alias("_end"))
    along = Window.partitionBy("conversation_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("conversation_id", "_part", F.last("_end", ignorenulls=True).over(along).alias("_carried"))
    out = near.join(carried, ["conversation_id", "_part"]).select("id", "role", F.coalesce("_near", "_carried").alias("previous"))
    return out.where((F.col("role") == "assistant") & F.col("previous").isNotNull()).select("id", "previous")


@query(f"""SELECT conversation_id, arg_max(id, (created_at, id)) AS last_user_message FROM (SELECT *, {_ROLE} AS r FROM {_LAST}) WHERE r = 'user' GROUP BY conversation_id""")
def latest_message_by_role(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).where("role = 'user'").groupBy("conversation_id").agg(F.max(F.struct("created_at", "id"))["id"].alias("last_user_message"))


@query(f"""SELECT conversation_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id)::INT AS turn_no FROM {_LAST}""")
def message_numbers(spark: SparkSession, d: str) -> DataFrame:
    rows = with_parts(_turns(spark, d), "conversation_id", "created_at")
    return sequence_within(rows, "conversation_id", [F.col("created_at"), F.col("id")], "role", "turn_no").select("conversation_id", "id", "turn_no")


@query(rf"""SELECT id, length(regexp_replace(content, {_TRIM})) < 80 AS skipped, CASE WHEN length(regexp_replace(content, {_TRIM})) < 80 THEN 0.95::DOUBLE END AS confidence FROM {_M}""")
def short_answer_skip(spark: SparkSession, d: str) -> DataFrame:
    short = F.length(T.trimmed(F.col("content"))) < 80
    return _messages(spark, d).select("id", short.alias("skipped"), F.when(short, F.lit(0.95)).alias("confidence"))


_REPLY = "(SELECT event_id, (event_id % 7) || ', ' || (event_id % 3) || ' then ' || (event_id % 11) || ', 99' AS reply FROM events)"


@query(rf"""SELECT event_id, array_to_string(list_slice(o, 1, 4), ',') AS places FROM (SELECT event_id, list_transform(list_filter(list_zip(p, list_transform(range(1, len(p) + 1), lambda i: list_position(p, p[i]))), lambda z: true), lambda z: z[1]) AS q,
 list_filter(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN list_position(p, p[i]) = i THEN p[i] END), lambda x: x IS NOT NULL) AS o FROM
 (SELECT event_id, list_concat(list_filter(list_transform(regexp_extract_all(reply, '(\d+)', 1), lambda x: x::INT), lambda x: x < 6), [0, 1, 2, 3, 4, 5]) AS p FROM {_REPLY}))""")
def rerank_reorder(spark: SparkSession, d: str) -> DataFrame:
    """The first four of six candidates in the order a reply names them, the others after."""
    e = F.col("event_id")
    reply = F.concat((e % 7).cast("string"), F.lit(", "), (e % 3).cast("string"), F.lit(" then "), (e % 11).cast("string"), F.lit(", 99"))
    return table(spark, d, "events").select("event_id", _joined(F.slice(R.reordered(reply, F.lit(6)), 1, 4)).alias("places"))


@query(r"""SELECT event_id, CASE WHEN regexp_extract(reply, '(\d*\.?\d+)', 1) = '' THEN 0 ELSE greatest(0, least(1, regexp_extract(reply, '(\d*\.?\d+)', 1)::DOUBLE)) END AS score
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Score: 0.' || (event_id % 97) WHEN 1 THEN '.' || (event_id % 10) WHEN 2 THEN (event_id % 4) || '/10' WHEN 3 THEN 'none' ELSE 'about ' || value END AS reply FROM events)""")
def judge_score_parse(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    text = lambda m: (e % m).cast("string")
    reply = F.when(e % 5 == 0, F.concat(F.lit("Score: 0."), text(97))).when(e % 5 == 1, F.concat(F.lit("."), text(10))).when(e % 5 == 2, F.concat(text(4), F.lit("/10"))).when(e % 5 == 3, "none").otherwise(F.concat(F.lit("about "), F.col("value").cast("string")))
    return table(spark, d, "events").select("event_id", R.judged(reply).alias("score"))


@query("SELECT event_type, coalesce(round(avg(value), 3), 0) AS mean_value, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def eval_means(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.coalesce(F.round(F.avg("value"), 3), F.lit(0.0)).alias("mean_value"), F.count(F.lit(1)).alias("n"))


_REPLIES = """(SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'no object here' ELSE 'Here:' || chr(10) || '```json' || chr(10) || '{"studyType": "' || CASE event_id % 3 WHEN 0 THEN 'RCT' WHEN 1 THEN ' ' ELSE ' kohort ' END || '", "population": "' || event_type || '", "keyFinding": "", "qualityFlags": ["small ", "", 3, "late", "a' || event_id % 5 || '"]}' || chr(10) || '```' END AS reply, event_type || ' ' || props AS abstract FROM events)"""


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies of a model that extracts evidence, some without an object, and the abstracts they are about."""
    e = F.col("event_id")
    kind = F.when(e % 3 == 0, "RCT").when(e % 3 == 1, " ").otherwise(" kohort ")
    made = F.concat(F.lit('Here:\n```json\n{"studyType": "'), kind, F.lit('", "population": "'), F.col("event_type"), F.lit('", "keyFinding": "", "qualityFlags": ["small ", "", 3, "late", "a'), (e % 5).cast("string"), F.lit('"]}\n```'))
    return table(spark, d, "events").select("event_id", F.when(e % 7 == 0, "no object here").otherwise(made).alias("reply"), F.concat_ws(" ", "event_type", "props").alias("abstract"))


@query(f"""SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 3 = 1 THEN '{FM.UNKNOWN_STUDY}' WHEN event_id % 3 = 0 THEN 'RCT' ELSE 'kohort' END AS study_type, CASE WHEN event_id % 7 = 0 THEN '{FM.NOT_STATED}' ELSE trim(split_part(abstract, ' ', 1)) END AS population, '{FM.NOT_STATED}' AS sample_size,
 substring(abstract, 1, 200) AS key_finding, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'small|3|late|a' || event_id % 5 END AS flags FROM {_REPLIES}""")
def evidence_parse(spark: SparkSession, d: str) -> DataFrame:
    rows = _replies(spark, d).select("event_id", R.evidence(F.col("reply"), F.col("abstract")).alias("e"))
    return rows.select("event_id", "e.study_type", "e.population", "e.sample_size", "e.key_finding", F.array_join("e.flags", "|").alias("flags"))


@query(f"""SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 3 = 1 THEN NULL WHEN event_id % 3 = 0 THEN 'RCT' ELSE 'kohort' END AS study_type, NULL::VARCHAR AS sample_size, CASE WHEN event_id % 7 = 0 THEN '' ELSE 'small|3|late' END AS flags FROM {_REPLIES}""")
def evidence_shown(spark: SparkSession, d: str) -> DataFrame:
    """Evidence as readers see it: what isn't known is hidden, and three flags at most."""
    rows = _replies(spark, d).select("event_id", R.evidence(F.col("reply"), F.col("abstract")).alias("e"))
    shown = lambda c, unknown: F.when(F.col(c) != unknown, F.col(c))
    return rows.select("event_id", shown("e.study_type", FM.UNKNOWN_STUDY).alias("study_type"), shown("e.sample_size", FM.NOT_STATED).alias("sample_size"), F.array_join(F.slice("e.flags", 1, 3), "|").alias("flags"))


_CONTEXT = rf"""SELECT document_id, string_agg('## Kaynak [^' || n || '] — ' || label || chr(10) || regexp_replace(content, {_TRIM}), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS context,
 string_agg('Source [' || n || '] (' || title || CASE WHEN coalesce(section_path, '') <> '' THEN ', ' || section_path ELSE '' END || '):' || chr(10) || substring(content, 1, 600), chr(10) || chr(10) ORDER BY n) AS judged FROM
 (SELECT document_id, content, section_path, coalesce(d.title, 'Untitled') AS title, row_number() OVER (PARTITION BY document_id ORDER BY c.id) AS n, coalesce(d.title, 'Untitled') || CASE WHEN coalesce(page_number, 0) <> 0 THEN ', sayfa ' || page_number ELSE '' END || CASE WHEN coalesce(section_path, '') <> '' THEN ', ' || section_path ELSE '' END AS label
 FROM (SELECT DISTINCT id, document_id, content, page_number, section_path FROM chunks) c JOIN documents d ON d.id = c.document_id) WHERE n <= 4 GROUP BY document_id"""


@query(_CONTEXT)
def context_block(spark: SparkSession, d: str) -> DataFrame:
    """Numbered sources of each document, the first four of its chunks by id, as a model and as a judge see them."""
    from pyspark.sql import Window

    chunks = table(spark, d, "chunks").select("id", "document_id", "content", "page_number", "section_path").distinct()
    own = Window.partitionBy("document_id").orderBy("id")
    few = chunks.withColumn("n", F.row_number().over(own)).where("n <= 4")  # cut before the shuffle
    rows = few.join(table(spark, d, "documents").select(F.col("id").alias("document_id"), F.coalesce("title", F.lit("Untitled")).alias("title")), "document_id")
    block = FM.source_block(F.col("n"), FM.source_label(F.col("title"), F.col("page_number"), F.col("section_path")), F.col("content"))
    judged = FM.judge_block(F.col("n"), F.col("title"), F.col("section_path"), F.col("content"))
    held = F.array_sort(F.collect_list(F.struct("n", block.alias("b"), judged.alias("j"))))
    joined = lambda name, separator: F.array_join(F.transform("_held", lambda s: s[name]), separator)
    return rows.groupBy("document_id").agg(held.alias("_held")).select("document_id", joined("b", FM.SOURCE_SEPARATOR).alias("context"), joined("j", "\n\n").alias("judged"))


@query(r"""SELECT id, row_number() OVER (PARTITION BY document_id ORDER BY id)::INT AS n, document_id, coalesce(page_number, 0) AS page_number, section_path, substring(content, 1, 240) AS preview FROM (SELECT DISTINCT id, document_id, content, page_number, section_path FROM chunks)""")
def citation_projection(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").select("id", "document_id", "content", "page_number", "section_path").distinct()
    rows = sequence_within(with_parts(rows, "document_id", "id"), "document_id", [F.col("id")], "id", "n")
    return rows.select("id", "n", "document_id", F.coalesce("page_number", F.lit(0)).alias("page_number"), "section_path", T.prefix(F.col("content"), 240).alias("preview"))


_TR = "(regexp_matches(content, '[şğüöçŞĞÜÖÇ]') OR (content <> '' AND length(regexp_replace(content, '[^çğıöşüÇĞİÖŞÜ]', '', 'g')) / length(content)::DOUBLE > 0.01))"


def _prompt_sql(lang: str, context: str = f"'{FM.NO_CONTEXT}'") -> str:
    intro, sources, head = FM.PROMPT_PARTS[lang]
    return f"'{intro}' || repeat(chr(10), 2) || '{sources}' || repeat(chr(10), 2) || {context} || repeat(chr(10), 2) || '{head}' || repeat(chr(10), 2) || content"


@query(f"SELECT id, CASE WHEN {_TR} THEN {_prompt_sql('tr')} ELSE {_prompt_sql('en')} END AS prompt FROM {_M}")
def user_prompt(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("content")
    return _messages(spark, d).select("id", FM.user_prompt(x, F.lit(None).cast("string"), T.query_language(x)).alias("prompt"))


_HELD = f"coalesce(context, '{FM.NO_CONTEXT}')"


@query(f"SELECT id AS document_id, CASE WHEN {_TR} THEN {_prompt_sql('tr', _HELD)} ELSE {_prompt_sql('en', _HELD)} END AS prompt FROM (SELECT id, coalesce(title, 'Untitled') AS content FROM documents) q LEFT JOIN ({_CONTEXT}) c ON c.document_id = q.id")
def user_prompt_sources(spark: SparkSession, d: str) -> DataFrame:
    """The title of each document asked of its own numbered sources; messages hold no link to theirs."""
    asked = table(spark, d, "documents").select(F.col("id").alias("document_id"), F.coalesce("title", F.lit("Untitled")).alias("question"))
    x = F.col("question")
    return asked.join(context_block(spark, d), "document_id", "left").select("document_id", FM.user_prompt(x, F.col("context"), T.query_language(x)).alias("prompt"))


@query(r"""SELECT doc_id, concat_ws(chr(10), '### Makale [^1] — ' || coalesce(title, '') || CASE WHEN coalesce(document_type, '') <> '' THEN ' (' || document_type || ')' ELSE '' END, '- Study type: bilinmiyor', '- Population (P): belirtilmemiş', '- Intervention (I): belirtilmemiş', '- Comparison (C): belirtilmemiş', '- Outcome (O): belirtilmemiş', '- Sample size: belirtilmemiş',
 '- Key finding: ' || substring(coalesce(text, ''), 1, 200), '- Evidence: "' || substring(coalesce(text, ''), 1, 160) || '"', CASE WHEN source IS NOT NULL THEN '- Quality flags: ' || source || ', ' || coalesce(lang, 'none') END) AS prompt FROM documents""")
def synthesis_prompt(spark: SparkSession, d: str) -> DataFrame:
    """The entry of a paper whose reply could not be read: defaults and the start of its text."""
    text = F.coalesce("text", F.lit(""))
    flags = F.when(F.col("source").isNotNull(), F.array("source", F.coalesce("lang", F.lit("none")))).otherwise(F.array().cast("array<string>"))
    entry = FM.evidence_block(F.lit(1), F.coalesce("title", F.lit("")), F.col("document_type"), FM.fallback_evidence(text), flags)
    return table(spark, d, "documents").select("doc_id", entry.alias("prompt"))


@query(r"""SELECT event_id, coalesce(g AND c BETWEEN 0 AND 1, false) AS detected, coalesce(g AND c BETWEEN 0 AND 1 AND c >= 0.7, false) AS shown
FROM (SELECT event_id, event_id % 3 = 0 AS g, CASE WHEN event_id % 5 = 4 THEN NULL ELSE (event_id % 12) / 10.0::DOUBLE END AS c FROM events)""")
def off_label_gate(spark: SparkSession, d: str) -> DataFrame:
    """JSON replies of a judge: out-of-range and unreadable ones detect nothing."""
    e = F.col("event_id")
    reply = F.when(e % 5 == 4, "no object").otherwise(F.to_json(F.struct((e % 3 == 0).alias("detected"), ((e % 12) / 10).alias("confidence"))))
    rows = table(spark, d, "events").select("event_id", FM.risk(reply).alias("r"))
    return rows.select("event_id", "r.detected", (F.col("r.detected") & (F.col("r.confidence") >= 0.7)).alias("shown"))


@query(r"""SELECT c.id, d.title, coalesce(d.document_type, 'not stated') AS design, CASE WHEN d.id IS NULL THEN 'document' ELSE 'paper' END AS kind FROM (SELECT DISTINCT id, document_id FROM chunks) c LEFT JOIN (SELECT * FROM documents WHERE source = 'literature') d ON d.id = c.document_id""")
def evidence_overlay(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "documents").where("source = 'literature'").select(F.col("id").alias("document_id"), "title", "document_type", F.lit(True).alias("known"))
    rows = table(spark, d, "chunks").select("id", "document_id").distinct().join(papers, "document_id", "left")
    return rows.select("id", "title", F.coalesce("document_type", F.lit("not stated")).alias("design"), F.when(F.col("known"), "paper").otherwise("document").alias("kind"))
