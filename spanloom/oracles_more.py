"""DuckDB SQL for the queries of `queries_more`, and for those of `queries` that need a recursive form."""

from __future__ import annotations

from spanloom.oracles import BASE, ORACLES as SEARCHES
from spanloom.oracles import PIVOT_TOP, by_freq, hits, pivot, pos, rescored


def turns(terms: list[str], offsets: list[int], slop: int) -> str:
    """Sloppy frequencies of different terms: a turn takes the foremost term to its last place not beyond the others."""
    ks = range(len(terms))
    lists = ", ".join(f"list(pos - {o} ORDER BY pos) FILTER (term = '{x}') AS p{k}" for k, (x, o) in enumerate(zip(terms, offsets)))
    some = " AND ".join(f"p{k} IS NOT NULL" for k in ks)
    at = ", ".join(f"p{k}[a{k}] AS v{k}" for k in ks)
    first = " ".join(f"WHEN {' AND '.join(f'v{k} {chr(60) if j < k else chr(60) + chr(61)} v{j}' for j in ks if j != k)} THEN {k}" for k in ks)
    others = lambda f: " ".join(f"WHEN {k} THEN {f}({', '.join(f'v{j}' for j in ks if j != k)})" for k in ks)
    own = lambda col: " ".join(f"WHEN {k} THEN {col}{k}" for k in ks)
    step = ", ".join(f"CASE WHEN k = {k} THEN j + 1 ELSE a{k} END AS a{k}" for k in ks)
    return f"""SELECT doc_id, sum(1.0 / (1 + length)) AS freq FROM (
  WITH RECURSIVE l AS (SELECT doc_id, {lists} FROM toks GROUP BY doc_id), lists AS (SELECT * FROM l WHERE {some}),
  s AS (
    SELECT doc_id, {', '.join(f'1::BIGINT AS a{k}' for k in ks)}, NULL::BIGINT AS length, true AS more FROM lists
    UNION ALL
    SELECT doc_id, {step}, hind - p[j], j < len(p) FROM (
      SELECT *, CASE k {own('p')} END AS p, len(list_filter(CASE k {own('p')} END, lambda x: x <= fore)) AS j FROM (
        SELECT *, CASE k {others('least')} END AS fore, CASE k {others('greatest')} END AS hind FROM (
          SELECT *, CASE {first} END AS k FROM (SELECT s.*, {', '.join(f'p{k}' for k in ks)}, {at} FROM s JOIN lists USING (doc_id) WHERE more)))))
  SELECT doc_id, length FROM s)
WHERE length <= {slop} GROUP BY doc_id"""


def windows(terms: list[str], slop: int) -> str:
    """Unordered nearness of terms: all stand at their first place, and the foremost moves on in turn."""
    ks = range(len(terms))
    lists = ", ".join(f"list(pos ORDER BY pos) FILTER (term = '{x}') AS p{k}" for k, x in enumerate(terms))
    some = " AND ".join(f"p{k} IS NOT NULL" for k in ks)
    v = ", ".join(f"p{k}[a{k}]" for k in ks)
    step = ", ".join(f"a{k} + (p{k}[a{k}] = low)::BIGINT AS a{k}" for k in ks)
    left = " AND ".join(f"a{k} <= len(p{k})" for k in ks)
    return f"""SELECT doc_id, sum(1.0 / (1 + width)) AS freq FROM (
  WITH RECURSIVE l AS (SELECT doc_id, {lists} FROM toks GROUP BY doc_id), lists AS (SELECT * FROM l WHERE {some}),
  s AS (
    SELECT doc_id, {', '.join(f'1::BIGINT AS a{k}' for k in ks)}, NULL::BIGINT AS width FROM lists
    UNION ALL
    SELECT doc_id, {step}, high - low FROM (SELECT s.doc_id, {', '.join(f'a{k}, p{k}' for k in ks)}, least({v}) AS low, greatest({v}) AS high FROM s JOIN lists USING (doc_id) WHERE {left}))
  SELECT doc_id, width FROM s WHERE width IS NOT NULL)
WHERE width + 1 - {len(terms)} <= {slop} GROUP BY doc_id"""


def where(sql: str, condition: str) -> str:
    """BASE and what follows, over some documents only."""
    return sql.replace("FROM documents", f"FROM (SELECT * FROM documents WHERE {condition})")


HEAD = "WITH RECURSIVE"
_html = "replace(replace(replace(replace(replace(replace({}, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;'), '''', '&#x27;'), '/', '&#x2F;')"
EXPLAINED = pivot(a="the", b="and") + """, n AS (SELECT (SELECT idf FROM idf WHERE term = 'the') AS ia, (SELECT idf FROM idf WHERE term = 'and') AS ib)
SELECT doc_id, node::INT AS node, depth::INT AS depth, part, round(value, 6) AS value FROM (
  SELECT doc_id, 0 AS node, 0 AS depth, 'Boolean' AS part, a + 2 * coalesce(b, 0) AS value FROM p WHERE a IS NOT NULL
  UNION ALL SELECT doc_id, 1, 1, 'Term', a FROM p WHERE a IS NOT NULL
  UNION ALL SELECT doc_id, 1, 2, 'idf', ia FROM p, n WHERE a IS NOT NULL
  UNION ALL SELECT doc_id, 1, 2, 'tfNorm', a / ia FROM p, n WHERE a IS NOT NULL
  UNION ALL SELECT doc_id, 2, 1, 'Boost', 2 * coalesce(b, 0) FROM p WHERE a IS NOT NULL
  UNION ALL SELECT doc_id, 3, 2, 'Term', 2 * coalesce(b, 0) FROM p WHERE a IS NOT NULL
  UNION ALL SELECT doc_id, 3, 3, 'idf', ib FROM p, n WHERE a IS NOT NULL AND b IS NOT NULL
  UNION ALL SELECT doc_id, 3, 3, 'tfNorm', b / ib FROM p, n WHERE a IS NOT NULL AND b IS NOT NULL)"""

ORACLES: dict[str, str] = {
    "phrase_sloppy_scored": by_freq(turns(["the", "of"], [0, 1], 3), ["the", "of"]),
    "phrase_sloppy_three": by_freq(turns(["the", "of", "and"], [0, 1, 2], 6), ["the", "of", "and"]),
    "span_near_unordered_three": by_freq(windows(["the", "is", "and"], 6), ["the", "is", "and"]),
    "query_string_phrase": f"{BASE}, p AS (SELECT a.doc_id, count(*) AS freq FROM {pos('a', 'of')} JOIN {pos('b', 'the')} ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 GROUP BY a.doc_id), x AS (SELECT doc_id, (SELECT sum(idf) FROM idf WHERE term IN ('of', 'the')) * 2.2 * freq / (freq + nrm) AS s FROM p JOIN norm USING (doc_id)) SELECT sc.doc_id, round(2 * sc.s + 2 * coalesce(x.s, 0), 6) AS score FROM sc LEFT JOIN x ON x.doc_id = sc.doc_id WHERE term = 'and'",
    "stored_count": SEARCHES["term_count"],
    "stored_top_k": SEARCHES["top_k"],
    "stored_term_dict": SEARCHES["term_dict_stats"],
    "stored_postings": SEARCHES["inverted_index"],
    "stored_lookup": f"{BASE} SELECT doc_id, pos::INT AS pos FROM toks WHERE term = 'the'",
    "term_seek_exact": f"{BASE} SELECT doc_id, tf::INT AS tf FROM tf WHERE term = 'que'",
    "term_seek_floor": f"{BASE} SELECT max(term) AS found FROM df WHERE term <= 'thf'",
    "segments_hits": SEARCHES["bool_must_should"],
    "segments_term_dict": SEARCHES["term_dict_stats"],
    "segments_merged": SEARCHES["phrase_exact"],
    "live_docs": where(hits("a", "a IS NOT NULL", a="and"), "lang IS DISTINCT FROM 'de'"),
    "live_docs_merged": where(SEARCHES["term_dict_stats"], "lang IS DISTINCT FROM 'de'"),
    "stored_update": "SELECT doc_id, CASE WHEN source = 'src1' THEN 'xx' ELSE lang END AS lang, source FROM documents",
    "point_multi_range": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_discount <= 0.03::DOUBLE AND l_tax >= 0.02::DOUBLE",
    "custom_query": hits("a", "a IS NOT NULL AND n_chars % 7 = 0", a="the"),
    "custom_similarity": f"{BASE} SELECT doc_id, round(tf::DOUBLE * 2.0 / df, 9) AS score FROM tf JOIN df USING (term) WHERE term = 'the'",
    "non_scoring": hits("0.0::DOUBLE", "a IS NOT NULL OR b IS NOT NULL", a="the", b="is"),
    "span_positions": f"{BASE}, x AS (SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM {pos('a', 'the')} JOIN {pos('b', 'of')} ON a.doc_id = b.doc_id AND b.pos > a.pos GROUP BY a.doc_id, a.pos) SELECT doc_id, s::INT AS start, (e + 1)::INT AS \"end\", (e - s - 1)::INT AS width FROM x WHERE e - s - 1 <= 3",
    "query_texts": """SELECT * FROM (VALUES
  ('term_bm25', 'TermQuery(field: text, term: the, boost: 1)'),
  ('bool_filter_must', 'BooleanQuery(must: [TermQuery(field: text, term: and, boost: 1)], should: [], filters: [TermQuery(field: lang, term: en, boost: 1), PointRangeQuery(field: n_chars, [1000] TO [None])], must_not: [], match: 0)'),
  ('dismax', 'DisjunctionMaxQuery(disjunctions: TermQuery(field: text, term: the, boost: 1), TermQuery(field: text, term: and, boost: 1), TermQuery(field: text, term: le, boost: 1), tie_breaker_multiplier: 0.3)'),
  ('boosting', 'BoostingQuery(positive: TermQuery(field: text, term: the, boost: 1), negative: TermQuery(field: text, term: is, boost: 1), negative_boost: 0.25)'),
  ('phrase_gap_positions', 'PhraseQuery(field: text, terms: [the, and], positions: [0, 2], slop: 0)'),
  ('span_gap', 'SpanNearQuery(clauses: [SpanTermQuery(field: text, term: the), SpanGapQuery(field: text, width: 1), SpanTermQuery(field: text, term: and)], slop: 0, in_order: true)'),
  ('query_string_phrase', 'BooleanQuery(must: [TermQuery(field: text, term: and, boost: 2)], should: [BoostQuery(query: PhraseQuery(field: text, terms: [of, the], positions: [0, 1], slop: 0), boost: 2)], filters: [], must_not: [], match: 0)')) AS x(name, shown)""",
    "query_terms": "SELECT * FROM (VALUES ('bool_nested', 'text', 'the'), ('bool_nested', 'text', 'le'), ('bool_nested', 'text', 'and'), ('bool_nested', 'text', 'of'), ('boosting', 'text', 'the'), ('span_near_or', 'text', 'is'), ('span_near_or', 'text', 'was'), ('span_near_or', 'text', 'the')) AS x(name, field, term)",
    "query_cached": SEARCHES["term_bm25"],
    "collapse_sorted": f"{pivot(a='the')}, r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY coalesce(n_chars, -1) DESC, doc_id) AS n, count(*) OVER (PARTITION BY source) AS group_hits FROM p WHERE a IS NOT NULL), g AS (SELECT *, count(*) OVER () AS total_groups FROM r WHERE n = 1) SELECT (row_number() OVER (ORDER BY coalesce(n_chars, -1) DESC, doc_id))::INT AS rank, source, group_hits, total_groups, doc_id, n_chars FROM g ORDER BY rank LIMIT 3",
    "sort_custom": f"{pivot(a='and')} SELECT (row_number() OVER (ORDER BY n_chars % 100 DESC, doc_id))::INT AS rank, doc_id, n_chars FROM p WHERE a IS NOT NULL ORDER BY rank LIMIT 20",
    "rescore_request": rescored("a * 0.5 + b * 2"),
    "score_refreshed": f"{PIVOT_TOP} SELECT doc_id, round(CASE WHEN rank <= 12 AND b IS NOT NULL THEN a * 0.5 + b * 2 ELSE a * 0.5 END, 6) AS sort_score FROM top",
    "feature_map": f"{PIVOT_TOP} SELECT doc_id, round(a, 6) AS previous_score, round(b, 6) AS is_score, 2 AS n_features FROM top WHERE b IS NOT NULL",
    "explain": EXPLAINED,
    "two_collectors": f"{pivot(a='the')} SELECT 'all' AS part, count(*) AS hits FROM p WHERE a IS NOT NULL UNION ALL SELECT lang, count(*) FROM p WHERE a IS NOT NULL GROUP BY lang",
    "ordinal_map": "WITH c AS (SELECT DISTINCT (c_custkey % 3)::VARCHAR AS segment, c_mktsegment || '/' || c_nationkey AS value FROM customer) SELECT segment, value, row_number() OVER (PARTITION BY segment ORDER BY value) - 1 AS local_ord, dense_rank() OVER (ORDER BY value) - 1 AS ord FROM c",
    "binary_tokens": "SELECT doc_id, hex(source) AS term, 1::INT AS tf, 1::INT AS len FROM documents WHERE source IS NOT NULL",
    "word_tokens": f"{BASE} SELECT doc_id, pos::INT AS pos, left(term, 128) AS term FROM toks",
    "multivalued_inversion": BASE.replace("doc_id", "conv_id").replace("FROM documents", "FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn, role, text) AS text FROM conversations WHERE text IS NOT NULL GROUP BY conv_id)") + " SELECT conv_id, term, tf::INT AS tf, first_pos::INT AS first_pos, last_pos::INT AS last_pos, len::INT AS len FROM tf JOIN lens USING (conv_id)",
    "inversion_rules": "SELECT unnest(['no such column', 'numbers are not indexed', 'binary is not tokenized', 'vectors need an index', 'dimensions', 'phrases need positions']) AS name, 'ValueError' AS raised",
    "base36_names": "SELECT o_orderkey, lower(to_base(o_orderkey, 36)) AS base36, '_' || lower(to_base(o_orderkey, 36)) AS segment FROM orders",
    "sortable_numbers": "SELECT c_custkey, lpad(hex((c_custkey::HUGEINT - 700 + 9223372036854775808)::UBIGINT), 16, '0') AS code FROM customer",
    "merged_by_policy": hits("a", "a IS NOT NULL", a="is").replace("AS score FROM p", "AS score, 1::INT AS segments FROM p"),
    "sloppy_factors": "SELECT d::INT AS distance, round(1.0::DOUBLE / (d + 1), 9) AS factor FROM range(20) r(d)",
    "writer_log": """WITH a AS (SELECT doc_id, lang, source, n_chars FROM documents WHERE NOT (doc_id % 3 = 0 AND lang IS NOT DISTINCT FROM 'de') AND coalesce(n_chars, 0) < 5000 AND source IS DISTINCT FROM 'src1'
  UNION ALL SELECT doc_id, 'xx', source, n_chars FROM documents WHERE source = 'src1')
SELECT doc_id, lang, CASE WHEN lang = 'en' THEN -5 ELSE n_chars END AS n_chars FROM a""",
    "writer_delete_all": "SELECT doc_id FROM documents WHERE lang = 'fr'",
    "writer_rollback": "SELECT doc_id, 1::INT AS first, 2::INT AS second, true AS dirty FROM documents WHERE lang = 'fr'",
    "writer_modes": "SELECT * FROM (VALUES ('exists before', 'false'), ('append before', 'refused'), ('exists after', 'true'), ('current', '3'), ('removed by policy', '1,2'), ('second publisher', 'refused'), ('files after force_merge', '1'), ('num_docs', '3')) AS x(name, value)",
    "update_binary_dv": f"{pivot(a='the')} SELECT doc_id, CASE WHEN a IS NOT NULL THEN hex('new') ELSE hex(source) END AS blob FROM p",
    "highlight_whole": BASE + ", n AS (SELECT doc_id, pos, term, term IN ('the', 'of') AND count(*) FILTER (term IN ('the', 'of')) OVER (PARTITION BY doc_id ORDER BY pos) <= 256 AS hit FROM toks), g AS (SELECT doc_id, regexp_extract_all(text, '\\s+') AS gaps, regexp_matches(text, '^\\s') AS led, regexp_matches(text, '\\s$') AS trailed FROM documents), j AS (SELECT n.doc_id, string_agg(CASE WHEN pos > 0 THEN gaps[(pos + led::INT)::INT] WHEN led THEN gaps[1] ELSE '' END || CASE WHEN hit AND term = 'the' THEN '<i>the</i>' WHEN hit THEN '<u>of</u>' ELSE " + _html.format("term") + " END, '' ORDER BY pos) || CASE WHEN any_value(trailed) THEN any_value(gaps)[-1] ELSE '' END AS marked FROM n JOIN g ON g.doc_id = n.doc_id GROUP BY n.doc_id) SELECT doc_id, marked FROM j WHERE doc_id IN (SELECT doc_id FROM toks WHERE term = 'the')",
    **{f"stored_{name}": sql for name, sql in SEARCHES.items() if name in ("term_bm25", "term_keyword", "match_all", "dismax", "boosting", "boost_nested", "constant_score") or name.startswith(("bool_", "phrase_", "span_", "query_string", "point_int", "point_boosted")) and name != "phrase_sloppy2"},
}
ORACLES["highlight_any_field"] = ORACLES["highlight_whole"]
ORACLES |= {f"stored_{name}": ORACLES[name] for name in ("phrase_sloppy_scored", "phrase_sloppy_three", "span_near_unordered_three", "query_string_phrase")}
