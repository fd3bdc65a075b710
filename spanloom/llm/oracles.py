"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         greatest(0.05, coalesce(length(regexp_replace(text, '[^\p{L}]+', '', 'g')) / nullif(length(text), 0), 0.0)) AS quality
  FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':17'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE) / quality AS key FROM rows),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
listed AS (
  SELECT *, 2 * source_size AS cap, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS nth FROM per),
leveled AS (
  SELECT *, cap::DOUBLE / weight < (1.5::DOUBLE * (SELECT sum(source_size)::BIGINT FROM per) - coalesce(sum(cap) OVER before, 0)::BIGINT) / ((SELECT sum(weight) FROM listed) - coalesce(sum(weight) OVER before, 0))::DOUBLE AS capped
  FROM listed WINDOW before AS (ORDER BY cap::DOUBLE / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rest AS (
  SELECT (1.5::DOUBLE * sum(source_size)::BIGINT - coalesce(sum(cap) FILTER (capped), 0)::BIGINT) / greatest(1, sum(weight) - coalesce(sum(weight) FILTER (capped), 0))::DOUBLE AS level FROM leveled),
targets AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE level * weight END AS target FROM leveled, rest),
placed AS (
  SELECT doc_id, size, source_size, target, floor(target)::BIGINT AS budget,
         (sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT - size AS before
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (budget // greatest(source_size, 1) * size + least(size, greatest(0, budget % greatest(source_size, 1) - before)))::BIGINT AS taken
FROM placed
"""

OP6 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                               ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reached AS (SELECT doc_id AS start, doc_id AS here FROM documents UNION SELECT start, y FROM reached JOIN edges ON here = x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT start, min(here) AS component_id FROM reached GROUP BY start) ON start = d.doc_id
"""

OP9 = """
WITH rows AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP10 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
HOST = r"[a-z0-9-]+(?:\.[a-z0-9-]+)*\.amazonaws\.com"
URL = r"https?://[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?"


def _found(kind: int, pattern: str, where: str = "true", lead: str = "0", size: str = "length(m)") -> str:
    """Matches of a pattern with their places: the text between matches and the matches, added up. `lead` is the length
    of what a match holds in front of itself, as this dialect cannot look behind."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, {kind} AS kind, before + {lead} AS s, before + length(m) AS e, {size} AS size, substr(m, ({lead}) + 1) AS m FROM (
  SELECT doc_id, m, k, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id ORDER BY k) - length(m) AS before FROM (
    SELECT doc_id, generate_subscripts(ms, 1) AS k, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap
    FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}') AS ms, string_split_regex(text, '{quoted}') AS gaps FROM documents WHERE {where}) WHERE len(ms) > 0))"""


#: Parts that need a look around are maximal runs here, of which the right ones are kept.
OP8 = f"""
WITH assigned AS ({_found(0, ASSIGN, size="length(regexp_extract(m, '" + ASSIGN.replace("'", "''") + "', 1))")}),
base AS (
  SELECT doc_id, kind, s, e FROM assigned WHERE size >= 12
  UNION ALL SELECT doc_id, kind, s, e FROM ({_found(1, "AKIA[A-Z0-9]+", "contains(text, 'AKIA')")}) WHERE e - s >= 18
  UNION ALL SELECT doc_id, kind, s, e FROM ({_found(2, "[0-9a-f]+")}) WHERE e - s >= 16),
weak AS (
  SELECT doc_id, 3 AS kind, s, e FROM ({_found(3, "[A-Z0-9]+", "contains(text, 'AKIA')")}) WHERE e - s BETWEEN 12 AND 17 AND starts_with(m, 'AKIA')
  UNION ALL SELECT doc_id, 4, s, e FROM ({_found(4, "[A-Za-z0-9+/=]+")}) WHERE e - s = 40 AND NOT contains(m, '=')
  UNION ALL SELECT doc_id, 4, s, e FROM assigned WHERE size BETWEEN 6 AND 11
  UNION ALL SELECT doc_id, 5, s, e FROM ({_found(5, f"{URL}|(?:^|[^A-Za-z0-9.-]){HOST}", "contains(text, '://') OR contains(text, '.amazonaws.com')", lead=f"CASE WHEN regexp_full_match(m, '{URL}') OR regexp_full_match(m, '{HOST}') THEN 0 ELSE 1 END")})),
parts AS (SELECT DISTINCT *, CASE WHEN kind IN (1, 3) THEN 0 WHEN kind = 5 THEN 2 ELSE 1 END AS role FROM (SELECT * FROM base UNION ALL SELECT * FROM weak)),
asked AS (SELECT * FROM parts w WHERE kind >= 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.s < w.e AND w.s < b.e)),
extra AS (
  SELECT w.doc_id, w.kind, w.s, w.e FROM asked w JOIN parts p ON p.doc_id = w.doc_id AND p.role <> w.role AND abs(p.s - w.s) <= 256 GROUP BY w.doc_id, w.kind, w.s, w.e, w.role
  HAVING CASE w.role WHEN 0 THEN bool_or(p.role = 1) WHEN 1 THEN true ELSE bool_or(p.role = 0) AND bool_or(p.role = 1) END),
named AS (
  SELECT *, ['assign', 'access', 'hex', 'id', 'key', 'endpoint'][kind + 1] || ':' || s || ':' || e AS shown FROM (SELECT *, true AS own FROM base UNION ALL SELECT *, false FROM extra)),
per AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(shown, ',' ORDER BY s, kind, e) FILTER (own) AS base, string_agg(shown, ',' ORDER BY s, kind, e) AS spans FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN per USING (doc_id)
"""

ORACLES: dict[str, str] = {"op1_source_mixing": OP1, "op6_near_dedup": OP6, "op8_secret_scan": OP8, "op9_vector_search": OP9, "op10_exact_dedup": OP10}
