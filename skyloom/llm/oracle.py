"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op6_exact_dedup"] = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                           'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


def _identifier(parts: str) -> str:
    digest = f"sha256(concat_ws('|', {parts}))"
    pieces = ", ".join(f"substr({digest}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || concat_ws('-', {pieces}) || '>'"


def _replaced(text: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        text = f"regexp_replace({text}, {pattern}, {by}, 'g')"
    return text


def _decoded(text: str) -> str:
    for entity, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{character}')"
    return text


_STRIPPED = _replaced(
    "payload", ("'(?s)<!--.*?(?:-->|\\z)'", "''"), ("'(?is)<script\\b.*?(?:</script\\s*>|\\z)'", "''"),
    ("'(?is)<style\\b.*?(?:</style\\s*>|\\z)'", "''"), ("'(?is)<head\\b.*?(?:</head\\s*>|\\z)'", "''"), ("'[\\r\\n\\t ]+'", "' '"),
    ("'(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|header|footer|title|body)\\b[^<>]*>'", "chr(10)"),
    ("'<[^<>]*>'", "''"))
_TEXT = _replaced(_decoded(_STRIPPED), ("'[ ]*\\n[ \\n]*'", "chr(10)"), ("'^[ \\n]+|[ \\n]+$'", "''"))
_TITLE = f"trim({_replaced(_decoded("regexp_extract(payload, '(?is)<title[^<>]*>(.*?)(?:</title|\\z)', 1)"), ("'[\\r\\n\\t ]+'", "' '"))})"

SQL["op10_warc_derivatives"] = f"""
WITH p AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS payload, chr(13) || chr(10) AS eol FROM pages),
r AS (SELECT *, 'HTTP/1.1 200 OK' || eol || 'Content-Type: text/html; charset=utf-8' || eol || 'Content-Length: '
             || strlen(payload) || eol || eol || payload AS block, {_identifier(
    "'response', coalesce(page_id::VARCHAR, ''), coalesce(target_uri, ''), sha256(payload)")} AS record_id FROM p),
m AS (SELECT page_id, 'metadata' AS record_type, record_id AS refers_to, target_uri, 'application/warc-fields' AS content_type,
             'source-content-type: application/http; msgtype=response' || eol || 'source-content-length: ' || strlen(block)
             || eol || 'source-block-digest: sha256:' || sha256(block) || eol || 'source-payload-digest: sha256:'
             || sha256(payload) || eol || 'title: ' || {_TITLE} || eol
             || 'language: ' || regexp_extract(payload, '(?i)<html[^<>]*\\blang="([^"]*)"', 1) || eol
             || 'outlinks: ' || len(regexp_extract_all(payload, '(?i)<a\\b[^<>]*\\bhref\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1)) || eol AS block FROM r
      UNION ALL
      SELECT page_id, 'conversion', record_id, target_uri, 'text/plain; charset=utf-8', {_TEXT} FROM r)
SELECT page_id, 'response' AS record_type, record_id, NULL::VARCHAR AS refers_to, target_uri, '1970-01-01T00:00:00Z' AS date,
       'application/http; msgtype=response' AS content_type, strlen(block)::BIGINT AS content_length,
       'sha256:' || sha256(payload) AS payload_digest, 'sha256:' || sha256(block) AS block_digest FROM r
UNION ALL
SELECT page_id, record_type, {_identifier("'derived', record_type, refers_to, sha256(block)")}, refers_to, target_uri,
       '1970-01-01T00:00:00Z', content_type, strlen(block)::BIGINT, 'sha256:' || sha256(block), 'sha256:' || sha256(block) FROM m
"""


def _nearest(name: str, centroids: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT r, vec_id, v, c, d FROM (
    SELECT r, vec_id, kept.v AS v, c, list_sum([(kept.v[i] - {centroids}.v[i]) * (kept.v[i] - {centroids}.v[i]) for i in range(1, 65)]) AS d
    FROM kept, {centroids}) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""


def _means(name: str, assigned: str, before: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT c, list(m ORDER BY i) AS v FROM (
    SELECT c, i, ((sum(v[i]) - ((sum(v[i]) % count(*) + count(*)) % count(*))) // count(*))::BIGINT AS m
    FROM {assigned}, range(1, 65) t(i) GROUP BY c, i) GROUP BY c
    UNION ALL SELECT c, v FROM {before} WHERE c NOT IN (SELECT c FROM {assigned}))"""


SQL["op12_centroid_clusters"] = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
    WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NOT NULL AND isfinite(x)]) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept QUALIFY c < 16),
{_nearest("a0", "c0")}, {_means("c1", "a0", "c0")}, {_nearest("a1", "c1")}, {_means("c2", "a1", "c1")},
{_nearest("a2", "c2")}, {_means("c3", "a2", "c2")}, {_nearest("a3", "c3")}
SELECT vec_id, a3.c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a3.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c3.v, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON a3.c = c3.c
"""


def _escaped(text: str) -> str:
    return rf"regexp_replace({text}, '<(\\*)\|', '<\\\1|', 'g')"


SQL["op11_chat_format"] = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, n, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>') + length('<|im_end|>') + 2 + length({_escaped("text")})
           + length(replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<|', '<\|')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
