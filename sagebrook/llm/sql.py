"""SQL equivalents, by brute force, of the queries that SQL can express on whole tables."""

from .textstats import BLANKS, COMMON_WORDS, ENDED, MARKS, UNSPACED_WORDS, WORD

_SPACE = r"[\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_BLANK = r"[\s\v\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"

P2_FOUND = rf"""SELECT id AS chunk_id, CASE WHEN list_max(list_transform(regexp_split_to_array(content, '{_SPACE}|[.!?…。！？]'), lambda x: length(x))) > amount THEN 'forced' ELSE 'natural' END AS cut_kind
FROM (SELECT id, arg_max(content, ingested_at) AS content FROM chunks WHERE id IS NOT NULL GROUP BY id), (SELECT amount FROM size_limits WHERE limit_name = 'split_limit_chars') WHERE length(content) > amount"""


_NORM = rf"regexp_replace(regexp_replace(lower(replace(text, 'İ', 'i' || chr(775))), '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g')"
_CONTENTS = "(SELECT id, arg_max(content, ingested_at) AS text FROM chunks WHERE id IS NOT NULL GROUP BY id HAVING length(arg_max(content, ingested_at)) >= 200)"
_TITLES = "(SELECT doc_id::VARCHAR AS id, title AS text FROM documents WHERE doc_id IS NOT NULL AND title IS NOT NULL)"


def _pairs(piece: int, threshold: float, before: str) -> str:
    """Tables after a table t (id, x): p, n and l, the pairs a, b at or above the threshold with their similarity."""
    return f"""p AS (SELECT DISTINCT id, unnest(list_transform(range(1, length(x) - {piece - 2}), lambda i: substring(x, i, {piece}))) AS s FROM t WHERE length(x) >= {piece}), n AS (SELECT id, count(*) AS n FROM p GROUP BY id),
 l AS (SELECT a, b, c / (x.n + y.n - c)::DOUBLE AS similarity FROM (SELECT u.id AS a, v.id AS b, count(*) AS c FROM p u JOIN p v ON u.s = v.s AND {before} GROUP BY u.id, v.id) JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= {threshold} * (x.n + y.n - c) - 1e-9)"""


def _similar(source: str, kind: str, piece: int, threshold: float, before: str) -> str:
    return f"SELECT '{kind}' AS record_kind, a AS id_a, b AS id_b FROM (WITH t AS (SELECT id, {_NORM} AS x FROM {source}), {_pairs(piece, threshold, before)} SELECT a, b FROM l)"


def _classes(source: str, piece: int, threshold: float, before: str, number: str) -> str:
    return f"""m AS (SELECT id, x, min_by(id, id{number}) OVER (PARTITION BY x) AS class_id FROM (SELECT id, {_NORM} AS x FROM {source}) WHERE length(x) >= {piece}),
 t AS (SELECT id, x FROM m WHERE id = class_id), {_pairs(piece, threshold, before)}"""


def _links(source: str, kind: str, piece: int, threshold: float, before: str, number: str = "") -> str:
    return f"SELECT '{kind}' AS record_kind, a AS id_a, b AS id_b, round(similarity, 6) AS similarity FROM (WITH {_classes(source, piece, threshold, before, number)} SELECT * FROM l)"


def _groups(source: str, kind: str, piece: int, threshold: float, before: str, number: str = "") -> str:
    return f"""SELECT '{kind}' AS record_kind, id AS record_id, class_id, group_id, n_links FROM (WITH RECURSIVE {_classes(source, piece, threshold, before, number)},
 e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), r AS (SELECT id, id AS g FROM t UNION SELECT r.id, e.b FROM r JOIN e ON r.g = e.a),
 k AS (SELECT id, min_by(g, g{number}) AS group_id FROM r GROUP BY id), d AS (SELECT a, count(*)::BIGINT AS n FROM e GROUP BY a)
 SELECT m.id, class_id, group_id, coalesce(n, 0) AS n_links FROM m JOIN k ON k.id = class_id LEFT JOIN d ON d.a = class_id)"""


_ON_CONTENTS, _ON_TITLES = (_CONTENTS, "chunks", 5, 0.6, "u.id < v.id"), (_TITLES, "documents", 3, 0.7, "u.id::BIGINT < v.id::BIGINT")
P5_FOUND = _similar(*_ON_CONTENTS) + " UNION ALL " + _similar(*_ON_TITLES)
P5_LINKS = _links(*_ON_CONTENTS) + " UNION ALL " + _links(*_ON_TITLES, "::BIGINT")
P5_GROUPS = _groups(*_ON_CONTENTS) + " UNION ALL " + _groups(*_ON_TITLES, "::BIGINT")


def _nearest(field: str) -> str:
    return f"""SELECT '{field}' AS vector_field, q AS chunk_id, n AS neighbour_id FROM (WITH v AS (SELECT id, list_transform(x, lambda e: e / sqrt(list_dot_product(x, x))) AS x FROM
 (SELECT id, arg_max({field}, ingested_at)::DOUBLE[] AS x FROM chunks WHERE id IS NOT NULL GROUP BY id) WHERE x IS NOT NULL AND len(x) = 64 AND NOT list_bool_or(list_transform(x, lambda e: isnan(e) OR isinf(e))) AND list_dot_product(x, x) > 0)
 SELECT q.id AS q, r.id AS n, row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.x, r.x) DESC, r.id) AS k FROM v q SEMI JOIN probe_chunks p ON p.chunk_id = q.id JOIN v r ON r.id <> q.id) WHERE k <= 10"""


P6_FOUND = _nearest("embedding") + " UNION ALL " + _nearest("embedding_translated")

P6_NEIGHBOURS = " UNION ALL ".join(
    _nearest(f).replace("q.id AS q, r.id AS n,", "q.id AS q, r.id AS n, list_dot_product(q.x, r.x) AS s,").replace("n AS neighbour_id FROM", "n AS neighbour_id, round(s, 4) AS similarity FROM").replace("FROM v q SEMI JOIN probe_chunks p ON p.chunk_id = q.id JOIN", "FROM (SELECT * FROM v WHERE ('0x' || substring(md5(id), 1, 8))::UBIGINT % 50 = 0) q JOIN")
    for f in ("embedding", "embedding_translated")
)

P7_FOUND = rf"""WITH m AS (SELECT id, c, r, t FROM (SELECT id, arg_max(conversation_id, ingested_at) AS c, arg_max(role, ingested_at) AS r, arg_max(coalesce(content, ''), ingested_at) AS x, max(created_at) AS t FROM messages WHERE id IS NOT NULL GROUP BY id) WHERE c IS NOT NULL AND regexp_replace(x, '{_BLANK}+', '', 'g') <> ''),
 s AS (SELECT *, CASE WHEN lower(trim(r)) IN ('user', 'human') THEN 'u' WHEN lower(trim(r)) IN ('assistant', 'bot', 'ai', 'model') THEN 'a' WHEN lower(trim(r)) = 'system' THEN 's' ELSE 'x' END AS k FROM m),
 o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY t, CASE k WHEN 's' THEN 0 WHEN 'u' THEN 1 ELSE 2 END, id) AS n FROM s),
 g AS (SELECT c FROM o GROUP BY c HAVING regexp_full_match(string_agg(k, '' ORDER BY n), 's*(ua)+'))
 SELECT c AS conversation_id, n::INT AS turn_no, id AS message_id FROM o WHERE c IN (SELECT c FROM g) AND c IN (SELECT id FROM conversations)"""


_ROLE = """CASE WHEN lower(trim(r)) IN ('user', 'human', 'customer', 'question') THEN 'user' WHEN lower(trim(r)) IN ('assistant', 'bot', 'ai', 'model', 'answer') THEN 'assistant' WHEN lower(trim(r)) IN ('system', 'developer') THEN 'system' ELSE 'other' END"""
_PLAIN = rf"trim(regexp_replace(lower(TEXT), '[\s\x{{a0}}\x{{200b}}]+', ' ', 'g'))"
P7_RECOVERED = rf"""WITH RECURSIVE m AS (SELECT id, arg_max(conversation_id, ingested_at) AS c, arg_max(role, ingested_at) AS r, arg_max(coalesce(content, ''), ingested_at) AS x, arg_max(tenant_id, ingested_at) AS tenant, max(created_at) AS t FROM messages WHERE id IS NOT NULL GROUP BY id HAVING c IS NULL),
 s AS (SELECT id, tenant, {_PLAIN.replace('TEXT', 'x')} AS held, {_PLAIN.replace('TEXT', "array_to_string(list_transform(list_filter(string_split(x, chr(10)), lambda l: l LIKE '>%'), lambda l: regexp_replace(l, '^[>[:space:]]+', '')), ' ')")} AS quoted FROM m),
 k AS (SELECT tenant, held FROM s WHERE length(held) >= 20 GROUP BY tenant, held HAVING count(*) <= 3),
 q AS (SELECT DISTINCT s.id, q.id AS other FROM s JOIN k USING (tenant, held) JOIN s q ON q.tenant IS NOT DISTINCT FROM s.tenant AND q.quoted = s.held),
 e AS (SELECT * FROM q UNION SELECT other, id FROM q), g AS (SELECT id, id AS root FROM m UNION SELECT g.id, e.other FROM g JOIN e ON g.root = e.id), d AS (SELECT id, min(root) AS root FROM g GROUP BY id),
 o AS (SELECT m.id, root, {_ROLE} AS role, row_number() OVER (PARTITION BY root ORDER BY t NULLS FIRST, CASE {_ROLE} WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, m.id) AS n FROM m JOIN d ON d.id = m.id WHERE regexp_replace(x, '{_BLANK}+', '', 'g') <> ''),
 v AS (SELECT root, regexp_full_match(string_agg(CASE role WHEN 'other' THEN 'x' ELSE role[1] END, '' ORDER BY n), 's*(ua)+') AS sound FROM o GROUP BY root)
 SELECT 'lost:' || o.root AS conversation_id, n::INT AS turn_no, id AS message_id, role, sound FROM o JOIN v ON v.root = o.root"""

P7_QUOTATIONS = (
    P7_RECOVERED.split(",\n k AS")[0].replace("coalesce(content, '')", "coalesce(replace(content, 'İ', 'i' || chr(775)), '')")
    + """,
 h AS (SELECT tenant, held, min(id) AS text_id, count(*) AS n FROM s WHERE held <> '' GROUP BY tenant, held),
 k AS (SELECT * FROM h WHERE EXISTS (SELECT 1 FROM s WHERE s.tenant IS NOT DISTINCT FROM h.tenant AND s.quoted = h.held))
 SELECT text_id, id AS message_id, quotes, n AS n_holders, n <= 3 AND length(k.held) >= 20 AS links
 FROM k JOIN (SELECT id, tenant, held AS t, false AS quotes FROM s UNION ALL SELECT id, tenant, quoted, true FROM s) x ON x.tenant IS NOT DISTINCT FROM k.tenant AND x.t = k.held"""
)

P2_SOUNDNESS = "SELECT id AS chunk_id, true AS gives_back, true AS within_limit, true AS overlaps FROM (SELECT id, arg_max(content, ingested_at) AS content FROM chunks WHERE id IS NOT NULL GROUP BY id), (SELECT amount FROM size_limits WHERE limit_name = 'split_limit_chars') WHERE length(content) > amount"
P8_SOUNDNESS = "SELECT count(DISTINCT doc_id)::BIGINT AS documents, 0::BIGINT AS overfull, 0::BIGINT AS needless, 0::BIGINT AS uneven FROM documents"

_RE2 = lambda pattern: pattern.replace("\\p{Is", "\\p{").replace("'", "''")
_KNOWN = ", ".join(f"'{w}'" for w in (*sorted(COMMON_WORDS), *UNSPACED_WORDS))
P10_WORDS = f"""SELECT doc_id, length(t)::BIGINT AS n_chars, len(l)::INT AS n_lines, len(w)::BIGINT AS n_words, round(CASE WHEN len(w) = 0 THEN 0 ELSE list_sum(list_transform(w, lambda x: length(x))) / len(w)::DOUBLE END, 6) AS mean_word_length,
 round(CASE WHEN solid = 0 THEN 0 ELSE coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / solid::DOUBLE END, 6) AS letter_ratio, round(CASE WHEN len(l) = 0 THEN 0 ELSE len(list_filter(l, lambda x: regexp_matches(x, '{_RE2(ENDED)}'))) / len(l)::DOUBLE END, 6) AS punctuation_end_share,
 round(CASE WHEN len(w) = 0 THEN 0 ELSE len(list_filter(w, lambda x: x IN ({_KNOWN}))) / len(w)::DOUBLE END, 6) AS common_word_share
 FROM (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda x: length(regexp_replace(x, '{BLANKS}', '', 'g')) > 0) AS l, regexp_extract_all(regexp_replace(lower(replace(t, 'İ', 'i' || chr(775))), '{MARKS}', '', 'g'), '{_RE2(WORD)}') AS w, length(regexp_replace(t, '{BLANKS}', '', 'g')) AS solid FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""
