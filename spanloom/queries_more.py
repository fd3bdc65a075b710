"""Queries on a stored index, by writers, and of the operators beside the search itself. Each runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import analysis, scalars
from spanloom.functions.similarity import NonScoring, Similarity, sloppy_factor
from spanloom.operators import dictionary as D
from spanloom.operators import highlight as H
from spanloom.operators import mutation as M
from spanloom.operators import ranking as R
from spanloom.plans import query as Q
from spanloom.queries import TREES, index, rounded, searcher, st, t, table
from spanloom.schema import FieldSpec, IndexOptions, keyword, numeric, text
from spanloom.sources import snapshots
from spanloom.sources.index import Searcher, StoredIndex, TableIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FIELDS = [text("text"), keyword("lang"), keyword("source")]
_written: dict[tuple[str, str], str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def stored(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """The documents' stored index, written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        path = snapshots.new_folder(spark)
        StoredIndex.write(index(spark, sf_dir), path)
        _written[key] = path
    return StoredIndex(spark, _written[key], "doc_id", index(spark, sf_dir).schema)


def _on_stored(name: str, tree: Q.Query) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(Searcher(stored(spark, sf_dir)).hits(tree))

    run.__name__ = f"stored_{name}"
    query(run)


for _name, _tree in TREES.items():
    _on_stored(_name, _tree)


@query
def stored_top_k(spark, sf_dir):
    return rounded(Searcher(stored(spark, sf_dir)).top(Q.boolean([t("the")], [t("and"), t("is")]), 10))


@query
def stored_count(spark, sf_dir):
    """The shortcut: a term's count comes from the dictionary."""
    return spark.createDataFrame([(Searcher(stored(spark, sf_dir)).count(t("the")),)], "hits long")


@query
def stored_term_dict(spark, sf_dir):
    return stored(spark, sf_dir).term_counts(["text"]).select("term", "df", "ttf")


@query
def stored_postings(spark, sf_dir):
    return stored(spark, sf_dir).postings(["text"]).select("term", "doc_id", "tf", F.element_at("positions", 1).alias("first_pos"), F.element_at("positions", -1).alias("last_pos"), "len")


@query
def stored_lookup(spark, sf_dir):
    """A term's postings with positions, as a script asks for them."""
    return D.lookup(stored(spark, sf_dir).postings(), "text", "the", "tf", "positions").select("doc_id", F.explode("positions").alias("pos"))


@query
def term_seek_exact(spark, sf_dir):
    return D.seek_exact(stored(spark, sf_dir).postings(), "text", "que").select("doc_id", "tf")


@query
def term_seek_floor(spark, sf_dir):
    return D.seek_floor(stored(spark, sf_dir).term_counts(), "text", "thf")


def _halves(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """An index of two segments."""
    docs, path = table(spark, sf_dir, "documents"), snapshots.new_folder(spark)
    odd = F.col("doc_id") % 2 == 1
    return StoredIndex.write(TableIndex(docs.where(~odd), "doc_id", FIELDS), path).append(docs.where(odd))


@query
def segments_hits(spark, sf_dir):
    return rounded(Searcher(_halves(spark, sf_dir)).hits(Q.boolean([t("the")], [t("and"), t("is")])))


@query
def segments_term_dict(spark, sf_dir):
    return _halves(spark, sf_dir).term_counts(["text"]).select("term", "df", "ttf")


@query
def segments_merged(spark, sf_dir):
    merged = _halves(spark, sf_dir).merge()
    if len(merged.segments) != 1:
        raise ValueError("a merge leaves one segment")
    return rounded(Searcher(merged).hits(Q.Phrase("text", ("of", "the"))))


@query
def merged_by_policy(spark, sf_dir):
    """Segments merged as their sizes call for; hits stay what they were."""
    docs, path = table(spark, sf_dir, "documents"), snapshots.new_folder(spark)
    made = StoredIndex.write(TableIndex(docs.where("doc_id % 3 = 0"), "doc_id", FIELDS), path)
    for k in (1, 2):
        made = made.append(docs.where(F.col("doc_id") % 3 == k))
    merged = M.merge_by_policy(made, per_tier=1, at_once=3)
    return rounded(Searcher(merged).hits(t("is"))).withColumn("segments", F.lit(len(merged.segments)))


@query
def live_docs(spark, sf_dir):
    """Deletions are ids beside the segments; scores are those of the live documents alone."""
    return rounded(Searcher(_halves(spark, sf_dir).delete(Q.Term("lang", "de"))).hits(t("and")))


@query
def live_docs_merged(spark, sf_dir):
    merged = _halves(spark, sf_dir).delete(Q.Term("lang", "de")).merge()
    return merged.term_counts(["text"]).select("term", "df", "ttf")


@query
def stored_update(spark, sf_dir):
    new = table(spark, sf_dir, "documents").where("source = 'src1'").withColumns({"text": F.lit("the new text"), "lang": F.lit("xx")})
    return _halves(spark, sf_dir).update(Q.Term("source", "src1"), new).docs.select("doc_id", "lang", "source")


@query
def point_multi_range(spark, sf_dir):
    """Several dimensions, of which some are open on a side, over a struct column."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_quantity", "l_discount", "l_tax").alias("p"))
    hits = Searcher(TableIndex(rows, "l_orderkey", [])).hits(Q.point_box("p", (10.0, None, 0.02), (20.0, 0.03, None)), "l_linenumber")
    return hits.select(F.col("doc_id").alias("l_orderkey"), "l_linenumber")


@dataclass(frozen=True)
class Divisible(Q.Constant):
    """A query of one's own."""

    field: str
    by: int

    def condition(self, context: Q.Context) -> Column:
        return context.column(self.field) % self.by == 0


class Frequency(Similarity):
    """A similarity of one's own: how often the term occurs, by its rarity."""

    def score(self, freq, length, field, terms, boost=1.0):
        return freq.cast("double") * boost / sum(x.df for x in terms)


@query
def custom_query(spark, sf_dir):
    return rounded(searcher(spark, sf_dir).hits(Q.boolean([t("the")], filters=[Divisible("n_chars", 7)])))


@query
def custom_similarity(spark, sf_dir):
    return Searcher(index(spark, sf_dir), Frequency()).hits(t("the", 2.0)).withColumn("score", F.round("score", 9))


@query
def non_scoring(spark, sf_dir):
    return Searcher(index(spark, sf_dir), NonScoring()).hits(Q.boolean(shoulds=[t("the"), t("is")]))


@query
def span_positions(spark, sf_dir):
    return searcher(spark, sf_dir).spans(Q.SpanNear((st("the"), st("of")), 3, True))


@query
def query_texts(spark, sf_dir):
    names = ["term_bm25", "bool_filter_must", "dismax", "boosting", "phrase_gap_positions", "span_gap", "query_string_phrase"]
    return spark.createDataFrame([(n, str(TREES[n])) for n in names], "name string, shown string")


@query
def query_terms(spark, sf_dir):
    """Terms that a hit is marked for: those of required and optional clauses."""
    return spark.createDataFrame([(n, f, x) for n in ("bool_nested", "boosting", "span_near_or") for f, x in TREES[n].terms()], "name string, field string, term string")


@query
def query_cached(spark, sf_dir):
    cache = R.QueryCache(searcher(spark, sf_dir), 2)
    cache.hits(t("the"))
    return rounded(cache.hits(t("the")))


@query
def collapse_sorted(spark, sf_dir):
    hits = searcher(spark, sf_dir).hits(t("the"), "source", "n_chars")
    out = R.collapse_sorted(hits, "source", [R.SortKey("n_chars", reverse=True, missing=-1)], 3)
    return out.select("rank", F.col("collapse_value").alias("source"), "group_hits", "total_groups", "doc_id", "n_chars")


@query
def sort_custom(spark, sf_dir):
    hits = searcher(spark, sf_dir).hits(t("and"), "n_chars", scoring=False)
    return R.top_sorted(hits, [R.SortKey(F.col("n_chars") % 100, reverse=True)], 20).select("rank", "doc_id", "n_chars")


@query
def rescore_request(spark, sf_dir):
    s = searcher(spark, sf_dir)
    return rounded(R.rescore_all(s, s.top(t("the"), 20), [R.RescoreRequest(t("is"), 12, "total", 0.5, 2.0)]))


@query
def score_refreshed(spark, sf_dir):
    s = searcher(spark, sf_dir)
    top = s.top(t("the"), 20)
    out = R.refreshed(top.withColumn("sort_score", F.col("score")), R.rescore(s, top, t("is"), 12, "total", 0.5, 2.0), "sort_score")
    return out.select("doc_id", F.round("sort_score", 6).alias("sort_score"))


@query
def feature_map(spark, sf_dir):
    s = searcher(spark, sf_dir)
    made = R.feature_map(s, s.top(t("the"), 20), {"is": t("is"), "none": t("zzzzzz")})
    return made.select("doc_id", F.round(F.col("features")["previous_score"], 6).alias("previous_score"), F.round(F.col("features")["is"], 6).alias("is_score"), F.size("features").alias("n_features"))


@query
def explain(spark, sf_dir):
    tree = Q.boolean([t("the")], [Q.boosted(t("and"), 2.0)])
    return R.explanations(searcher(spark, sf_dir), tree).withColumn("value", F.round("value", 6))


@query
def two_collectors(spark, sf_dir):
    hits = searcher(spark, sf_dir).hits(t("the"), "lang", scoring=False)
    with R.chained(hits, lambda h: h.agg(F.count("*").alias("n")), lambda h: h.groupBy("lang").count()) as (total, by_lang):
        rows = [("all", total.first()["n"]), *((r["lang"], r["count"]) for r in by_lang.collect())]  # a row per language
    return spark.createDataFrame(rows, "part string, hits long")


@query
def ordinal_map(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").withColumn("key", F.concat_ws("/", "c_mktsegment", F.col("c_nationkey").cast("string")))
    parts = {str(k): customers.where(F.col("c_custkey") % 3 == k) for k in range(3)}
    return D.ordinal_map(parts, "key").select("segment", "local_ord", "value", "ord")


@query
def binary_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("blob", F.encode("source", "utf-8"))
    return TableIndex(docs, "doc_id", [keyword("blob")]).postings().select("doc_id", F.hex("term").alias("term"), "tf", "len")


@query
def word_tokens(spark, sf_dir):
    """Pre-segmented words: value, begin and length."""
    words = F.transform(analysis.offsets(F.col("text")), lambda x: F.struct(x["term"].alias("value"), x["start"].alias("begin"), (x["end"] - x["start"]).alias("length")))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(analysis.words(words)).alias("pos", "term"))


@query
def multivalued_inversion(spark, sf_dir):
    """Values of a field one after the other, positions without a gap."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    values = turns.select("conv_id", F.transform("t", lambda x: x["text"]).alias("values"))
    return TableIndex(values, "conv_id", ["values"]).postings().select(F.col("doc_id").alias("conv_id"), "term", "tf", F.element_at("positions", 1).alias("first_pos"), F.element_at("positions", -1).alias("last_pos"), "len")


@query
def inversion_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cases = {
        "no such column": lambda: TableIndex(docs, "doc_id", ["title"]),
        "numbers are not indexed": lambda: TableIndex(docs, "doc_id", ["n_chars"]),
        "binary is not tokenized": lambda: TableIndex(docs.withColumn("b", F.encode("text", "utf-8")), "doc_id", ["b"]),
        "vectors need an index": lambda: FieldSpec("f", term_vectors=True),
        "dimensions": lambda: numeric("f").merged(keyword("f")),
        "phrases need positions": lambda: Searcher(TableIndex(docs, "doc_id", [text("text", index_options=IndexOptions.FREQS)])).hits(TREES["phrase_exact"]),
    }
    rows = []
    for name, make in cases.items():
        try:
            make()
            rows.append((name, "none"))
        except ValueError:
            rows.append((name, "ValueError"))
    return spark.createDataFrame(rows, "name string, raised string")


@query
def base36_names(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.base36(F.col("o_orderkey")).alias("base36"), scalars.segment_name(F.col("o_orderkey")).alias("segment"))


@query
def sortable_numbers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.sortable_hex(F.col("c_custkey") - 700).alias("code"))


@query
def sloppy_factors(spark, sf_dir):
    return spark.createDataFrame([(d, sloppy_factor(d)) for d in range(20)], "distance int, factor double").withColumn("factor", F.round("factor", 9))


def _writer(spark: SparkSession, path: str, **options) -> M.IndexWriter:
    return M.IndexWriter(spark, path, "doc_id", FIELDS, **options)


def _slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")


@query
def writer_log(spark, sf_dir):
    """Additions, a delete by term, a delete by query, an update and a numeric update, in this order, by one commit. A
    delete reaches what was added before it."""
    docs, path = _slim(spark, sf_dir), snapshots.new_folder(spark)
    w = _writer(spark, path)
    w.add_documents(docs.where("doc_id % 3 = 0"))
    w.delete_by_terms(("lang", "de"))
    w.add_documents(docs.where("doc_id % 3 <> 0"))
    w.delete_by_queries(Q.point_range("n_chars", 5000, None))
    w.update_documents(("source", "src1"), docs.where("source = 'src1'").withColumn("lang", F.lit("xx")))
    w.update_numeric(("lang", "en"), "n_chars", -5)
    w.commit()
    return snapshots.read(spark, path).select("doc_id", "lang", "n_chars")


@query
def writer_delete_all(spark, sf_dir):
    docs, path = _slim(spark, sf_dir), snapshots.new_folder(spark)
    w = _writer(spark, path)
    w.add_documents(docs)
    w.delete_all()
    w.add_documents(docs.where("lang = 'fr'"))
    w.close()
    return snapshots.read(spark, path).select("doc_id")


@query
def writer_rollback(spark, sf_dir):
    """What was committed stays, what was not is gone; a numbered change each, and the flag that tells of open ones."""
    docs, path = _slim(spark, sf_dir), snapshots.new_folder(spark)
    w = _writer(spark, path)
    first = w.add_documents(docs.where("lang = 'fr'"))
    w.commit()
    second = w.add_documents(docs.where("lang = 'en'"))
    dirty = w.has_uncommitted_changes()
    w.rollback()
    return snapshots.read(spark, path).select("doc_id", F.lit(first).alias("first"), F.lit(second).alias("second"), F.lit(dirty).alias("dirty"))


@query
def writer_modes(spark, sf_dir):
    """Whether an index exists before and after a commit, and what opening it, and publishing twice, does."""
    docs, path = _slim(spark, sf_dir).where("lang = 'fr'"), snapshots.new_folder(spark)
    rows = [("exists before", str(snapshots.exists(spark, path)).lower())]
    try:
        _writer(spark, path, mode="append")
    except FileNotFoundError:
        rows.append(("append before", "refused"))
    w = _writer(spark, path, mode="create", keep=1)
    for _ in range(3):
        w.add_documents(docs)
        w.commit()
    rows += [("exists after", str(snapshots.exists(spark, path)).lower()), ("current", str(snapshots.current(spark, path)))]
    rows.append(("removed by policy", ",".join(str(v) for v in (1, 2) if v not in snapshots._versions(spark, path))))
    try:
        snapshots.publish(spark, path, 3)
    except FileExistsError:
        rows.append(("second publisher", "refused"))
    again = _writer(spark, path, mode="append")
    again.force_merge(1)
    rows.append(("files after force_merge", str(len(snapshots.read(spark, path).inputFiles()))))
    rows.append(("num_docs", str(again.counts()["num_docs"] // docs.count())))
    return spark.createDataFrame(rows, "name string, value string")


@query
def update_binary_dv(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("blob", F.encode("source", "utf-8"))
    return M.update_numeric(TableIndex(docs, "doc_id", ["text"]), t("the"), "blob", b"new").select("doc_id", F.hex("blob").alias("blob"))


@query
def merge_plan(spark, sf_dir):
    """Merges planned by size: 30 small files, one above half of the most."""
    sizes = {f"s{k:02d}": 1 << 20 for k in range(30)} | {"big": 4 << 30}
    groups = M.plan_merges(sizes)
    return spark.createDataFrame([(len(groups), max(map(len, groups)), "big" in {n for g in groups for n in g})], "groups int, most int, has_big boolean")


def _marked(spark, sf_dir, **options) -> DataFrame:
    i = index(spark, sf_dir)
    q = Q.boolean([t("the")], [t("of")])
    return H.highlight(i, q, Searcher(i).hits(q, scoring=False), "text", 100, **options)


@query
def highlight_whole(spark, sf_dir):
    """The whole field as one fragment, its first 256 matches marked by the number of their term, encoded."""
    return _marked(spark, sf_dir, builder="single", encoder="html", pre=("<i>", "<u>"), post=("</i>", "</u>")).select("doc_id", F.element_at("fragments", 1).alias("marked"))


@query
def highlight_any_field(spark, sf_dir):
    """Terms of any field of the query, the whole text marked for them."""
    i = index(spark, sf_dir)
    q = Q.boolean([t("the")], [Q.Term("lang", "of")])
    marked = H.highlight(i, q, Searcher(i).hits(q, scoring=False), "text", 100, field_match=False, builder="single", encoder="html", pre=("<i>", "<u>"), post=("</i>", "</u>"))
    return marked.select("doc_id", F.element_at("fragments", 1).alias("marked"))


@query
def highlight_best(spark, sf_dir):
    """One fragment of most weight."""
    return _marked(spark, sf_dir).select("doc_id", F.element_at("fragments", 1).alias("marked"))


@query
def highlight_fields(spark, sf_dir):
    """Terms of two fields, marked in one; fragments by weight."""
    docs = table(spark, sf_dir, "documents").withColumn("again", F.col("text"))
    i = TableIndex(docs, "doc_id", ["text", "again"])
    q = Q.boolean([t("the")], [Q.Term("again", "of")])
    return H.highlight(i, q, Searcher(i).hits(q, scoring=False), "text", 100, ["again"], number=2, builder="windows", by_score=True).select("doc_id", F.array_join("fragments", " ... ").alias("marked"))


@query
def highlight_discrete(spark, sf_dir):
    """Several values: fragments span none of their borders."""
    turns = table(spark, sf_dir, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    values = turns.select("conv_id", F.transform("t", lambda x: x["text"]).alias("values"))
    i = TableIndex(values, "conv_id", ["values"])
    q = Q.Term("values", "the")
    return H.highlight(i, q, Searcher(i).hits(q, scoring=False), "values", 60, number=3, builder="windows", discrete=True).select(F.col("doc_id").alias("conv_id"), F.array_join("fragments", " ... ").alias("marked"))
