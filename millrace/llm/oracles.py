"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from .secrets import RULES

_KINDS = [
    f"SELECT doc_id, {k} AS place, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, $re${r.pattern}$re$) AS gaps,"
    f" regexp_extract_all(t, $re${r.pattern}$re$) AS hits, regexp_extract_all(t, $re${r.pattern}$re$, {r.group}) AS kept FROM d"
    for k, r in enumerate(RULES)
]

SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({" UNION ALL ".join(_KINDS)}),
 u AS (SELECT doc_id, place, kind, least, i, length(gaps[i]) AS gap, length(hits[i]) AS n, length(kept[i]) AS kept FROM m, unnest(range(1, len(hits) + 1)) x(i)),
 s AS (SELECT *, sum(gap + n) OVER (PARTITION BY doc_id, place ORDER BY i) AS stop FROM u), g AS (SELECT *, CAST(stop - n AS BIGINT) AS start FROM s WHERE kept >= least),
 a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
 coalesce(string_agg(kind || ':' || start || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, place) FILTER (place < 3), '') AS base,
 string_agg(kind || ':' || start || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, place) AS spans FROM g GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
 FROM d LEFT JOIN a USING (doc_id)"""

# Words by the contract's rule; windows of an item are joined to those of the documents of equal length.
CONTAMINATION = r"""WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
 iw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
 win AS (SELECT DISTINCT item_id, least(len(w), 13) AS k, w[i : i + least(len(w), 13) - 1] AS g FROM iw, unnest(range(1, len(w) - least(len(w), 13) + 2)) x(i) WHERE len(w) > 0),
 sizes AS (SELECT DISTINCT k FROM win),
 place AS (SELECT doc_id, i, k, w[i : i + k - 1] AS g FROM dw, sizes, unnest(range(1, len(w) - k + 2)) x(i)),
 hit AS (SELECT DISTINCT doc_id, i, place.k, item_id FROM place JOIN win ON place.k = win.k AND place.g = win.g),
 n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + k)) x(p) GROUP BY doc_id),
 t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""

CHAT = """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
 SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '</s>[INST] ok [/INST]'),
 l AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM c),
 p AS (SELECT *, CASE WHEN before IS NULL THEN 17 + length(replace(role, '<', '<.')) WHEN before = role THEN 8 ELSE 24 + length(replace(role, '<', '<.')) END + length(replace(text, '<', '<.')) AS chars FROM l)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, (sum(chars) + 7)::BIGINT AS formatted_chars FROM p GROUP BY conv_id"""
