"""DuckDB SQL for the queries that SQL can express, from their definitions."""

from __future__ import annotations

from loomline.llm.secrets import BASE_KINDS, MUST_HOLD, OWNED_KINDS

_WORDS = r"'[^\x20\x09-\x0D]+'"

SUBSTRING_DEDUP = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
p AS (SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN md5(array_to_string(w[i:i + 19], ' ')) END AS k FROM x),
r AS (SELECT doc_id, i, word, k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 AS again FROM p),
c AS (SELECT doc_id, i, word, coalesce(bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM r),
k AS (SELECT doc_id, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""

SUFFIX_DEDUP = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, o, substr(h, 2 * o + 1, 2 * 1049) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(1, len(h) // 2), 1000)) AS o FROM d)),
b AS (SELECT doc_id, o + j AS i, substr(s, 2 * j + 1, 2) AS byte, CASE WHEN 2 * j + 100 <= len(s) THEN md5(substr(s, 2 * j + 1, 100)) END AS k FROM (SELECT doc_id, o, s, unnest(range(0, least(1000, len(s) // 2))) AS j FROM q)),
least AS (SELECT k, min(doc_id) AS first FROM b WHERE k IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT b.doc_id, i, byte, coalesce(first < b.doc_id, false) AS again FROM b LEFT JOIN least ON b.k = least.k),
c AS (SELECT doc_id, i, byte, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM r),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM c),
k AS (SELECT doc_id, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (begins) AS BIGINT) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM e GROUP BY 1)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id"""

NEAR_DEDUP = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) AS i FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT c.doc_id, coalesce(n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON c.doc_id = n.doc_id"""


def _kind_sql(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    holds = "".join(f" AND regexp_matches(value, '{h}')" for h in MUST_HOLD.get(kind, ()))
    return f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, CAST(upto - len(m) AS BIGINT) AS a, CAST(upto AS BIGINT) AS b, value FROM (
  SELECT doc_id, m, value, sum(len(gap) + len(m)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
    SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(vs) AS value, unnest(gaps[1:len(ms)]) AS gap FROM (
      SELECT doc_id, regexp_extract_all(t, {p}) AS ms, regexp_extract_all(t, {p}, {group}) AS vs, regexp_split_to_array(t, {p}) AS gaps FROM d WHERE regexp_matches(t, {p}))))
  WHERE len(value) >= {least}{holds}"""


_KINDS = [(rank, *kind) for rank, kind in enumerate(BASE_KINDS + OWNED_KINDS)]
SECRET_SCAN = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source FROM documents),
base AS ({" UNION ALL ".join(_kind_sql(*k) for k in _KINDS[: len(BASE_KINDS)])}),
more AS ({" UNION ALL ".join(_kind_sql(*k) for k in _KINDS[len(BASE_KINDS) :])}),
owned AS (SELECT * FROM more m WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = m.doc_id AND b.a < m.b AND m.a < b.b)),
found AS (SELECT * FROM base UNION ALL SELECT * FROM owned),
owners AS (SELECT value, count(DISTINCT source) AS n FROM found f JOIN d ON d.doc_id = f.doc_id GROUP BY 1),
told AS (SELECT f.*, n <= 2 AS live FROM found f JOIN owners o ON f.value = o.value WHERE rank < {len(BASE_KINDS)} OR n <= 2),
per AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (live) AS n_live,
  string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) FILTER (rank < {len(BASE_KINDS)}) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, rank) AS spans FROM told GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN per ON d.doc_id = per.doc_id"""

ORACLE_SQL = {"op1_substring_dedup": SUBSTRING_DEDUP, "op6_near_dedup": NEAR_DEDUP, "op7_suffix_dedup": SUFFIX_DEDUP, "op10_secret_scan": SECRET_SCAN}
