"""DuckDB SQL that gives each query's rows."""

from __future__ import annotations

import math

from spanloom.functions.similarity import STEPS

_DL = "CASE " + " ".join(f"WHEN len <= {math.floor(x)} THEN {x!r}::DOUBLE" for x in STEPS if x < 1e7) + " END"

BASE = rf"""WITH toks AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS term
  FROM (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS l FROM documents)),
lens AS (SELECT doc_id, count(*) AS len FROM toks GROUP BY doc_id),
st AS (SELECT count(*)::DOUBLE AS dc, sum(len)::DOUBLE AS total FROM lens),
dl AS (SELECT doc_id, len, {_DL} AS dl FROM lens),
tf AS (SELECT doc_id, term, count(*) AS tf, min(pos) AS first_pos, max(pos) AS last_pos FROM toks GROUP BY doc_id, term),
df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS ttf FROM tf GROUP BY term),
idf AS (SELECT term, ln(1 + (dc - df + 0.5) / (df + 0.5)) AS idf FROM df, st),
norm AS (SELECT doc_id, 1.2 * (0.25 + 0.75 * dl / (total / dc)) AS nrm FROM dl, st),
sc AS (SELECT doc_id, term, tf, idf * 2.2 * tf / (tf + nrm) AS s FROM tf JOIN idf USING (term) JOIN norm USING (doc_id))"""


def pivot(**terms: str) -> str:
    """BASE and p: a row per document with each term's score, null where it lacks the term."""
    cols = ", ".join(f"max(s) FILTER (term = '{t}') AS {a}" for a, t in terms.items())
    return f"{BASE}, p AS (SELECT d.doc_id, any_value(d.lang) AS lang, any_value(d.source) AS source, any_value(d.n_chars) AS n_chars, {cols} FROM documents d LEFT JOIN sc ON sc.doc_id = d.doc_id AND sc.term IN ({', '.join(repr(t) for t in terms.values())}) GROUP BY d.doc_id)"


def hits(score: str, where: str, **terms: str) -> str:
    return f"{pivot(**terms)} SELECT doc_id, round({score}, 6) AS score FROM p WHERE {where}"


def by_freq(freqs: str, terms: list[str], boost: float = 1.0) -> str:
    """Scores from freqs, a query of (doc_id, freq)."""
    idfs = " + ".join(f"(SELECT idf FROM idf WHERE term = '{t}')" for t in terms)
    return f"{BASE}, fr AS ({freqs}) SELECT doc_id, round({boost!r} * ({idfs}) * 2.2 * freq / (freq + nrm), 6) AS score FROM fr JOIN norm USING (doc_id)"


def pos(alias: str, term: str) -> str:
    return f"(SELECT doc_id, pos FROM toks WHERE term = '{term}') {alias}"


def z(*names: str) -> str:
    return " + ".join(f"coalesce({n}, 0)" for n in names)


ORDERED = """SELECT doc_id, sum(1.0 / (1 + gap)) AS freq FROM (
  SELECT a.doc_id, a.pos AS p0, min(b.pos) - a.pos - 1 AS gap FROM {a} JOIN {b} ON a.doc_id = b.doc_id AND b.pos > a.pos GROUP BY a.doc_id, a.pos)
WHERE gap <= {slop} GROUP BY doc_id"""


def ordered(a: str, b: str, slop: int) -> str:
    return ORDERED.format(a=pos("a", a), b=pos("b", b), slop=slop)


PIVOT_TOP = pivot(a="the", b="is") + ", top AS (SELECT row_number() OVER (ORDER BY a DESC, doc_id) AS rank, doc_id, a, b FROM p WHERE a IS NOT NULL ORDER BY rank LIMIT 20)"


def rescored(expr: str) -> str:
    return f"""{PIVOT_TOP}, re AS (SELECT rank AS old, doc_id, rank <= 12 AS inside, CASE WHEN rank <= 12 AND b IS NOT NULL THEN {expr} ELSE a * 0.5 END AS score FROM top)
SELECT (row_number() OVER (ORDER BY inside DESC, CASE WHEN inside THEN -score END, CASE WHEN NOT inside THEN old END, doc_id))::INT AS rank, doc_id, round(score, 6) AS score FROM re"""


KEYWORD = """kw AS (SELECT lang AS term, ln(1 + ((SELECT count(lang) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) * 2.2 / 2.2 AS s FROM documents WHERE lang IS NOT NULL GROUP BY lang)"""

ORACLES: dict[str, str] = {
    "term_bm25": hits("a", "a IS NOT NULL", a="the"),
    "term_keyword": f"WITH {KEYWORD} SELECT doc_id, round(s, 6) AS score FROM documents JOIN kw ON lang = term WHERE lang = 'fr'",
    "bool_must_should": hits(f"a + {z('b', 'c')}", "a IS NOT NULL", a="the", b="and", c="is"),
    "bool_filter_only": hits("0.0", "a IS NOT NULL", a="le"),
    "bool_filter_must": hits("a", "a IS NOT NULL AND lang = 'en' AND n_chars >= 1000", a="and"),
    "bool_must_not_only": hits("0.0", "a IS NULL AND b IS NULL", a="the", b="de"),
    "bool_min_should_match": hits(z("a", "b", "c", "d"), "(a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT + (d IS NOT NULL)::INT >= 3", a="the", b="and", c="of", d="que"),
    "bool_nested": hits(f"{z('a', 'b')} + CASE WHEN c IS NOT NULL AND d IS NOT NULL THEN c + d ELSE 0 END", "(a IS NOT NULL OR b IS NOT NULL) AND e IS NULL AND f IS NULL", a="the", b="le", c="and", d="of", e="is", f="qui"),
    "dismax": hits(f"greatest(coalesce(a, 0), coalesce(b, 0), coalesce(c, 0)) + 0.3 * ({z('a', 'b', 'c')} - greatest(coalesce(a, 0), coalesce(b, 0), coalesce(c, 0)))", "coalesce(a, b, c) IS NOT NULL", a="the", b="and", c="le"),
    "boosting": hits("CASE WHEN b IS NOT NULL THEN a * 0.25 ELSE a END", "a IS NOT NULL", a="the", b="is"),
    "boost_nested": hits("2 * a + 6 * b + 1.0", "a IS NOT NULL AND b IS NOT NULL", a="the", b="and"),
    "constant_score": hits("1.5", "a IS NOT NULL OR b IS NOT NULL", a="the", b="de"),
    "match_all": "SELECT doc_id, 0.0::DOUBLE AS score FROM documents",
    "phrase_exact": by_freq(f"SELECT a.doc_id, count(*) AS freq FROM {pos('a', 'of')} JOIN {pos('b', 'the')} ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 GROUP BY a.doc_id", ["of", "the"]),
    "phrase_gap_positions": by_freq(f"SELECT a.doc_id, count(*) AS freq FROM {pos('a', 'the')} JOIN {pos('b', 'and')} ON a.doc_id = b.doc_id AND b.pos = a.pos + 2 GROUP BY a.doc_id", ["the", "and"]),
    "phrase_repeated_term": by_freq(f"SELECT a.doc_id, count(*) AS freq FROM {pos('a', 'the')} JOIN {pos('b', 'of')} ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN {pos('c', 'the')} ON a.doc_id = c.doc_id AND c.pos = a.pos + 3 GROUP BY a.doc_id", ["the", "of", "the"]),
    "phrase_sloppy2": f"{BASE} SELECT DISTINCT a.doc_id FROM {pos('a', 'the')} JOIN {pos('b', 'of')} ON a.doc_id = b.doc_id AND abs(b.pos - 1 - a.pos) <= 2",
    "span_term": hits("a", "a IS NOT NULL", a="and"),
    "span_near_ordered": by_freq(ordered("the", "of", 3), ["the", "of"]),
    "span_near_ordered_three": by_freq(
        f"""SELECT doc_id, sum(1.0 / (1 + gap)) AS freq FROM (
  SELECT x.doc_id, x.p0, any_value(x.p1) - x.p0 - 1 + min(c.pos) - any_value(x.p1) - 1 AS gap
  FROM (SELECT a.doc_id, a.pos AS p0, min(b.pos) AS p1 FROM {pos('a', 'the')} JOIN {pos('b', 'of')} ON a.doc_id = b.doc_id AND b.pos > a.pos GROUP BY a.doc_id, a.pos) x
  JOIN {pos('c', 'and')} ON x.doc_id = c.doc_id AND c.pos > x.p1 GROUP BY x.doc_id, x.p0)
WHERE gap <= 10 GROUP BY doc_id""", ["the", "of", "and"]),
    "span_near_unordered": by_freq(
        f"""SELECT doc_id, sum(1.0 / (1 + w)) AS freq FROM (
  SELECT a.doc_id, a.pos, min(b.pos) - a.pos AS w FROM {pos('a', 'the')} JOIN {pos('b', 'is')} ON a.doc_id = b.doc_id AND b.pos >= a.pos GROUP BY a.doc_id, a.pos
  UNION ALL SELECT a.doc_id, a.pos, min(b.pos) - a.pos AS w FROM {pos('a', 'is')} JOIN {pos('b', 'the')} ON a.doc_id = b.doc_id AND b.pos >= a.pos GROUP BY a.doc_id, a.pos)
WHERE w - 1 <= 2 GROUP BY doc_id""", ["the", "is"]),
    "span_or": by_freq("SELECT doc_id, count(*) AS freq FROM toks WHERE term IN ('is', 'was') GROUP BY doc_id", ["is", "was"]),
    "span_near_or": by_freq(
        f"""SELECT doc_id, sum(1.0 / (1 + gap)) AS freq FROM (
  SELECT a.doc_id, a.pos, min(b.pos) - a.pos - 1 AS gap FROM (SELECT doc_id, pos FROM toks WHERE term IN ('is', 'was')) a JOIN {pos('b', 'the')} ON a.doc_id = b.doc_id AND b.pos > a.pos GROUP BY a.doc_id, a.pos)
WHERE gap <= 2 GROUP BY doc_id""", ["is", "was", "the"]),
    "span_gap": by_freq(f"SELECT a.doc_id, count(*) AS freq FROM {pos('a', 'the')} JOIN {pos('b', 'and')} ON a.doc_id = b.doc_id AND b.pos = a.pos + 2 GROUP BY a.doc_id", ["the", "and"]),
    "span_boost": by_freq(ordered("and", "the", 1), ["and", "the"], 2.5),
    "point_int_range": "SELECT doc_id, 0.0::DOUBLE AS score FROM documents WHERE n_chars BETWEEN 1000 AND 2000",
    "point_boosted": "SELECT doc_id, 4.0::DOUBLE AS score FROM documents WHERE n_chars <= 500",
    "query_string": hits(f"a + 2 * coalesce(b, 0) + {z('c', 'd')}", "a IS NOT NULL", a="the", b="and", c="of", d="is"),
    "query_string_multifield": f"{pivot(a='fr', b='le', c='de')}, {KEYWORD} SELECT doc_id, round({z('a')} + CASE WHEN lang = 'fr' THEN 2 * s ELSE 0 END + 2 * coalesce(b, 0) + coalesce(c, 0) + CASE WHEN lang = 'de' THEN 2 * s ELSE 0 END, 6) AS score FROM p LEFT JOIN kw ON lang = term WHERE b IS NOT NULL OR c IS NOT NULL OR lang = 'de'",
    "query_string_quoted": hits(f"0.5 * coalesce(a, 0) + b", "b IS NOT NULL", a="the", b="of"),
    "top_k": f"{pivot(a='the', b='and', c='is')} SELECT (row_number() OVER (ORDER BY a + {z('b', 'c')} DESC, doc_id))::INT AS rank, doc_id, round(a + {z('b', 'c')}, 6) AS score FROM p WHERE a IS NOT NULL ORDER BY rank LIMIT 10",
    "term_count": hits("a", "a IS NOT NULL", a="the").replace("SELECT doc_id, round(a, 6) AS score FROM p", "SELECT count(*) AS hits FROM p"),
    "point_double_range": "SELECT c_custkey FROM customer WHERE c_acctbal BETWEEN -500 AND 1000",
    "point_exclusive_range": "SELECT event_id FROM events WHERE value > 10 AND value < 20",
    "point_long_exact": "SELECT o_orderkey FROM orders WHERE o_custkey IN (7, 11)",
    "point_2d_box": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 10 AND l_discount BETWEEN 0.02::DOUBLE AND 0.05::DOUBLE",
    "point_multivalued": "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity BETWEEN 49.5 AND 60",
    "exists_dv": hits("a", "a IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)", a="the"),
    "filter_expression": hits("a", "a IS NOT NULL AND n_chars % 2 = 0", a="the"),
    "filter_udf": hits("a", "a IS NOT NULL AND n_chars % 3 = 0", a="the"),
    "min_score": hits("a", "a > 0.5", a="is"),
    "early_terminate": f"{pivot(a='the')}, r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY source) AS c FROM p WHERE a IS NOT NULL) SELECT source, doc_id, c > 3 AS terminated FROM r WHERE n <= 3",
    "sort_numeric_missing": f"{pivot(a='and')} SELECT (row_number() OVER (ORDER BY coalesce(quality, -1) DESC, n_chars, doc_id))::INT AS rank, doc_id, quality, n_chars FROM p LEFT JOIN labels USING (doc_id) WHERE a IS NOT NULL ORDER BY rank LIMIT 25",
    "sort_string": f"{pivot(a='and')} SELECT (row_number() OVER (ORDER BY source, a DESC, doc_id))::INT AS rank, doc_id, source FROM p WHERE a IS NOT NULL ORDER BY rank LIMIT 20",
    "sort_sorted_numeric_min": "SELECT (row_number() OVER (ORDER BY min(l_extendedprice), l_orderkey))::INT AS rank, l_orderkey, min(l_extendedprice) AS least FROM lineitem GROUP BY l_orderkey ORDER BY rank LIMIT 15",
    "collapse": f"{pivot(a='the')}, r AS (SELECT source, doc_id, a, row_number() OVER (PARTITION BY source ORDER BY a DESC, doc_id) AS n, count(*) OVER (PARTITION BY source) AS group_hits FROM p WHERE a IS NOT NULL) SELECT source, group_hits, doc_id, round(a, 6) AS score FROM r WHERE n = 1",
    "rescore_avg": rescored("(a * 0.5 + b * 2) / 2"),
    "rescore_max": rescored("greatest(a * 0.5, b * 2)"),
    "rescore_min": rescored("least(a * 0.5, b * 2)"),
    "rescore_total": rescored("a * 0.5 + b * 2"),
    "rescore_multiply": rescored("a * 0.5 * b * 2"),
    "rescore_model": f"{PIVOT_TOP}, re AS (SELECT rank AS old, doc_id, rank <= 12 AS inside, CASE WHEN rank <= 12 THEN a + n_chars / 1000.0 ELSE a END AS score FROM top JOIN documents USING (doc_id)) SELECT (row_number() OVER (ORDER BY inside DESC, CASE WHEN inside THEN -score END, CASE WHEN NOT inside THEN old END, doc_id))::INT AS rank, doc_id, round(score, 6) AS score FROM re",
    "rescore_features": f"{PIVOT_TOP} SELECT doc_id, round(a, 6) AS previous_score, round(b, 6) AS feature_score FROM top WHERE b IS NOT NULL",
    "facets": f"{pivot(a='the')} SELECT lang, count(*) AS hits, sum(n_chars)::BIGINT AS chars FROM p WHERE a IS NOT NULL GROUP BY lang",
    "inverted_index": f"{BASE} SELECT term, doc_id, tf::INT AS tf, first_pos::INT AS first_pos, last_pos::INT AS last_pos, len::INT AS len FROM tf JOIN lens USING (doc_id)",
    "term_dict_stats": f"{BASE} SELECT term, df, ttf FROM df",
    "dictionary_stats": f"{BASE}, x AS (SELECT 'text' AS field, term, doc_id, tf FROM tf UNION ALL SELECT 'lang', lang, doc_id, 1 FROM documents WHERE lang IS NOT NULL UNION ALL SELECT 'source', source, doc_id, 1 FROM documents WHERE source IS NOT NULL) SELECT field, count(DISTINCT term) AS size, sum(tf)::BIGINT AS sum_ttf, count(*) AS sum_df, min(term) AS min_term, max(term) AS max_term, count(DISTINCT doc_id) AS doc_count FROM x GROUP BY field",
    "term_seek_ceil": f"{BASE}, f AS (SELECT 'thf' AS asked, min(term) AS found FROM df WHERE term >= 'thf' UNION ALL SELECT 'fr', min(lang) FROM documents WHERE lang >= 'fr' UNION ALL SELECT 'zz', min(lang) FROM documents WHERE lang >= 'zz') SELECT asked, found, CASE WHEN found IS NULL THEN 'end' WHEN found = asked THEN 'found' ELSE 'not_found' END AS status FROM f",
    "term_prefix": f"{BASE} SELECT term, df FROM df WHERE starts_with(term, 'tha')",
    "field_stats": f"{BASE} SELECT (SELECT count(*) FROM documents) AS max_doc, dc::BIGINT AS doc_count, total::BIGINT AS sum_ttf, round(total / dc, 6) AS avg_length FROM st",
    "point_stats": "SELECT count(c_acctbal) AS size, count(c_acctbal) AS doc_count, min(c_acctbal) AS min_value, max(c_acctbal) AS max_value FROM customer",
    "dv_ordinals": "SELECT n_name AS value, row_number() OVER (ORDER BY n_name) - 1 AS ord FROM (SELECT DISTINCT n_name FROM nation)",
    "norms": f"{BASE} SELECT doc_id, len::INT AS len, round(dl, 6) AS dl FROM dl",
    "term_vectors": f"{BASE} SELECT doc_id, term, tf::INT AS tf, first_pos::INT AS first_pos FROM tf",
    "stored_fields": f"{pivot(a='qui')} SELECT doc_id, source, n_chars FROM p WHERE a IS NOT NULL",
    "token_offsets": r"""WITH parts AS (
  SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS term, unnest(list_concat(g, [''])) AS gap
  FROM (SELECT doc_id, string_split_regex(text, '\s+') AS l, regexp_extract_all(text, '\s+') AS g FROM documents WHERE text IS NOT NULL)),
placed AS (SELECT doc_id, k, term, sum(length(term) + length(gap)) OVER (PARTITION BY doc_id ORDER BY k) - length(term) - length(gap) AS start FROM parts)
SELECT doc_id, term, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS pos, start::INT AS start, (start + length(term))::INT AS "end" FROM placed WHERE term <> ''""",
    "sorted_set_dv": "SELECT user_id, array_to_string(l, ',') AS kinds, l[(len(l) + 1) // 2] AS middle FROM (SELECT user_id, list_sort(list_distinct(list(event_type))) AS l FROM events GROUP BY user_id)",
    "doc_set_algebra": f"{pivot(a='the', b='is', c='de')} SELECT doc_id, 'and_not' AS kind FROM p WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NULL UNION ALL SELECT doc_id, 'or' FROM p WHERE b IS NOT NULL OR c IS NOT NULL",
    "required_optional": hits("a + coalesce(b, 0)", "a IS NOT NULL", a="the", b="is"),
    "delete_by_term": f"{pivot(a='the')} SELECT doc_id, lang FROM p WHERE a IS NULL AND lang IS DISTINCT FROM 'de'",
    "delete_by_query": f"{pivot(a='the')} SELECT doc_id, n_chars FROM p WHERE NOT (a IS NOT NULL AND coalesce(n_chars >= 2000, false))",
    "update_document": "SELECT doc_id, CASE WHEN source = 'src1' THEN 'xx' ELSE lang END AS lang, CASE WHEN source = 'src1' THEN 0 ELSE n_chars END AS n_chars, source FROM documents",
    "update_numeric_dv": f"{pivot(a='the')} SELECT doc_id, CASE WHEN a IS NOT NULL THEN -1 ELSE n_chars END AS n_chars FROM p",
    "last_update_wins": "SELECT c_custkey, coalesce(v, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT user_id, arg_max(value, event_id) AS v FROM events GROUP BY user_id) ON user_id = c_custkey",
    "change_log_latest": "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1",
    "index_sort": "SELECT o_orderkey, o_totalprice FROM orders",
    "compaction": "SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "nrt_stream": "SELECT o_custkey AS doc_id, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders) WHERE n = 1 AND o_orderstatus <> 'P' AND o_orderpriority = '1-URGENT'",
}
