"""Operators on hits: sorting, collapsing, limits, rescoring, features, explanation.

Hits are DataFrames (doc_id, score, further columns). User aggregates are groupBy().agg() or grouped pandas functions
on them; several collectors on one search share the cached hits.
"""

from __future__ import annotations

import threading
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.scalars import select
from spanloom.functions.similarity import quantised_length
from spanloom.plans.query import Boost, Phrase, Query, Term
from spanloom.sources.index import Frame, Searcher


@dataclass(frozen=True)
class SortKey:
    """A column, or `score` or `doc_id`, or an expression of one's own (a custom comparator); `selector` picks of a
    multi-valued one; `missing` stands for null, or nulls go first or last."""

    name: str | Column
    reverse: bool = False
    missing: object = None
    selector: str | None = None
    nulls_first: bool = False

    def column(self) -> Column:
        col = F.col(self.name) if isinstance(self.name, str) else self.name
        col = col if self.selector is None else select(col, self.selector)
        return col if self.missing is None else F.coalesce(col, F.lit(self.missing))

    def order(self) -> Column:
        return self.order_of(self.column())

    def order_of(self, col: Column) -> Column:
        if self.reverse:
            return col.desc_nulls_first() if self.nulls_first else col.desc_nulls_last()
        return col.asc_nulls_first() if self.nulls_first else col.asc_nulls_last()


def top_sorted(hits: DataFrame, keys: Sequence[SortKey], k: int) -> DataFrame:
    """rank and the k first hits by the keys; ties by id."""
    order = [*(s.order() for s in keys), F.col("doc_id").asc()]
    best = hits.orderBy(*order).limit(k)
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), *hits.columns)


def collapse(hits: DataFrame, key: str, k: int | None = None) -> DataFrame:
    """The best hit of each value of a key, and the value's number of hits; nulls are a value. Partial aggregates keep
    a value that most hits have from gathering in one task."""
    best = F.max_by(F.struct(*hits.columns), F.struct(F.col("score"), -F.col("doc_id"))).alias("best")
    out = hits.groupBy(F.col(key).alias("collapse_value")).agg(best, F.count("*").alias("group_hits")).select("collapse_value", "group_hits", "best.doc_id", "best.score")
    return out if k is None else out.orderBy(F.col("score").desc(), "doc_id").limit(k)


def collapse_sorted(hits: DataFrame, key: str, keys: Sequence[SortKey], k: int) -> DataFrame:
    """rank, collapse_value, group_hits, total_groups and the first hit of each value in order of the keys, then id; the
    k first of these groups in the same order. Only one row a group is ordered."""
    order = [s.column() for s in keys]
    ids = [f"__o{n}" for n in range(len(order))]
    kept = hits.select("*", *[c.alias(n) for c, n in zip(order, ids)])
    # The first in a window by value gathers a group in a task; a partial aggregate over ordered structs does not.
    directed = [_ascending(F.col(n), s, kept.schema[n].dataType.typeName()) for n, s in zip(ids, keys)]
    best = kept.groupBy(F.col(key).alias("collapse_value")).agg(F.min_by(F.struct(*hits.columns, *ids), F.struct(*directed, F.col("doc_id"))).alias("best"), F.count("*").alias("group_hits"))
    sort = [*(s.order_of(F.col(n)) for s, n in zip(keys, ids)), F.col("doc_id").asc()]
    out = best.select("collapse_value", "group_hits", "best.*")
    groups = out.agg(F.count("*").alias("total_groups"))
    first = out.orderBy(*sort).limit(k).crossJoin(F.broadcast(groups))  # one row
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*sort))).drop(*ids)


def _ascending(col: Column, key: SortKey, kind: str) -> Column:
    """A struct whose natural order is the key's: numbers are negated to turn them round."""
    if key.reverse and kind not in ("long", "integer", "double", "float", "short", "byte", "decimal"):
        raise ValueError("a collapse turns the order of numbers only")
    last = col.isNull() if not key.nulls_first else col.isNotNull()
    return F.struct(last.alias("n"), (-col if key.reverse else col).alias("v"))


def early_terminated(hits: DataFrame, segment: str, n: int) -> DataFrame:
    """The first n hits of each segment in order of id, and whether it had more."""
    own = Window.partitionBy(segment)
    out = hits.withColumns({"__nth": F.row_number().over(own.orderBy("doc_id"))}).where(F.col("__nth") <= n + 1)
    return out.withColumn("terminated", F.count("*").over(own) > n).where(F.col("__nth") <= n).drop("__nth")


def min_score(hits: DataFrame, least: float) -> DataFrame:
    """Hits that score above a limit."""
    return hits.where(F.col("score") > least)


@contextmanager
def chained(hits: DataFrame, *collectors: Callable[[DataFrame], DataFrame]) -> Iterator[list[DataFrame]]:
    """Several collectors over one search, whose hits are kept while the context is open."""
    kept = hits.persist()
    try:
        yield [c(kept) for c in collectors]
    finally:
        kept.unpersist()


def timed(df: DataFrame, seconds: float) -> list:
    """The rows of a small result, or TimeoutError: its jobs are cancelled when the time is over, as Spark gives no
    partial results."""
    context, group = df.sparkSession.sparkContext, f"timed-{uuid.uuid4().hex}"
    over = threading.Event()

    def stop() -> None:
        over.set()
        context.cancelJobGroup(group)

    clock = threading.Timer(seconds, stop)
    context.setJobGroup(group, "a search with a time limit", interruptOnCancel=True)
    clock.start()
    try:
        rows = df.collect()
    except Exception as e:
        if over.is_set():
            raise TimeoutError(f"the search took more than {seconds} s") from e
        raise
    finally:
        clock.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
    if over.is_set():
        raise TimeoutError(f"the search took more than {seconds} s")
    return rows


class QueryCache:
    """Hits of the queries asked last, kept by the query's text; the one not asked for longest goes beyond `size`."""

    def __init__(self, searcher: Searcher, size: int = 100) -> None:
        self.searcher, self.size = searcher, size
        self.kept: OrderedDict[str, DataFrame] = OrderedDict()
        self.found = self.missed = 0

    def hits(self, query: Query) -> DataFrame:
        key = str(query)
        if key in self.kept:
            self.found += 1
            self.kept.move_to_end(key)
        else:
            self.missed += 1
            self.kept[key] = self.searcher.hits(query).persist()
            while len(self.kept) > self.size:
                self.kept.popitem(last=False)[1].unpersist()
        return self.kept[key]

    def clear(self) -> None:
        while self.kept:
            self.kept.popitem()[1].unpersist()


#: Ranked hits that may be rescored.
MOST = 100_000
MODES: dict[str, Callable[[Column, Column], Column]] = {
    "avg": lambda a, b: (a + b) / 2, "max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b), "total": lambda a, b: a + b, "multiply": lambda a, b: a * b,
}


def _few(top: DataFrame) -> DataFrame:
    """Ranked hits computed once, as a local table: they go to the driver and on to all tasks, so there may be MOST only."""
    rows = top.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"rescoring takes {MOST} ranked hits at most")
    return top.sparkSession.createDataFrame(rows, top.schema)


@dataclass(frozen=True)
class RescoreRequest:
    """One rescoring of ranked hits; see `rescore`."""

    query: Query
    window: int
    mode: str = "total"
    query_weight: float = 1.0
    rescore_weight: float = 1.0


def rescore_all(searcher: Searcher, top: DataFrame, requests: Sequence[RescoreRequest]) -> DataFrame:
    """Ranked hits after each request in turn."""
    for r in requests:
        top = rescore(searcher, top, r.query, r.window, r.mode, r.query_weight, r.rescore_weight)
    return top


def refreshed(sorted_hits: DataFrame, rescored: DataFrame, column: str) -> DataFrame:
    """Hits whose sort value `column` was their score, with the score that rescoring gave them."""
    new = rescored.select("doc_id", F.col("score").alias("__new"))
    return sorted_hits.join(F.broadcast(_few(new)), "doc_id", "left").withColumns({column: F.coalesce("__new", column), "score": F.coalesce("__new", "score")}).drop("__new")


def feature_map(searcher: Searcher, top: DataFrame, queries: Mapping[str, Query]) -> DataFrame:
    """doc_id, features (a map of name to score) of the hits that any of the queries matches, previous_score among them."""
    top = _few(top)
    out = top.select("doc_id", F.col("score").alias("previous_score"))
    for n, q in enumerate(queries.values()):
        out = out.join(F.broadcast(searcher.hits(q, within=top).select("doc_id", F.col("score").alias(f"__{n}"))), "doc_id", "left")
    pairs = [x for n, name in enumerate(["previous_score", *queries]) for x in (F.lit(name), F.col("previous_score") if not n else F.col(f"__{n - 1}"))]
    matched = F.coalesce(*[F.col(f"__{n}") for n in range(len(queries))]).isNotNull()
    return out.where(matched).select("doc_id", F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("features"))


def rescore(searcher: Searcher, top: DataFrame, query: Query, window: int, mode: str = "total", query_weight: float = 1.0, rescore_weight: float = 1.0) -> DataFrame:
    """rank, doc_id, score: the first `window` of ranked hits ordered anew with another query's scores; the rest keep
    their order below, their scores times the query weight. Ranked hits are few; they are sent to the documents."""
    top = _few(top)
    old, second = F.col("score") * query_weight, searcher.hits(query, within=top).select("doc_id", F.col("score").alias("__new"))
    joined = top.join(F.broadcast(second), "doc_id", "left")
    inside = F.col("rank") <= window
    score = F.when(inside & F.col("__new").isNotNull(), MODES[mode](old, F.col("__new") * rescore_weight)).otherwise(old)
    scored = joined.select("rank", "doc_id", score.alias("score"), inside.alias("__inside"))
    order = Window.orderBy(F.col("__inside").desc(), F.when(F.col("__inside"), -F.col("score")), F.when(~F.col("__inside"), F.col("rank")), "doc_id")
    return scored.select(F.row_number().over(order).alias("rank"), "doc_id", "score")


def rescore_with(top: DataFrame, features: DataFrame, window: int, model: Callable[..., Column], names: Sequence[str], mode: str = "total", query_weight: float = 1.0, rescore_weight: float = 1.0) -> DataFrame:
    """Second phase by a model: `model` maps the named feature columns to a score, a pandas UDF as a rule."""
    top = _few(top)
    old = F.col("score") * query_weight
    joined = top.join(features.join(F.broadcast(top.select("doc_id")), "doc_id", "left_semi"), "doc_id", "left").withColumn("__new", model(*[F.col(n) for n in names]))
    inside = F.col("rank") <= window
    scored = joined.select("rank", "doc_id", F.when(inside & F.col("__new").isNotNull(), MODES[mode](old, F.col("__new") * rescore_weight)).otherwise(old).alias("score"), inside.alias("__inside"))
    order = Window.orderBy(F.col("__inside").desc(), F.when(F.col("__inside"), -F.col("score")), F.when(~F.col("__inside"), F.col("rank")), "doc_id")
    return scored.select(F.row_number().over(order).alias("rank"), "doc_id", "score")


def rescore_features(searcher: Searcher, top: DataFrame, query: Query) -> DataFrame:
    """doc_id, previous_score, feature_score of the hits that the second query matches."""
    top = _few(top)
    second = searcher.hits(query, within=top).select("doc_id", F.col("score").alias("feature_score"))
    return second.join(F.broadcast(top.select("doc_id", F.col("score").alias("previous_score"))), "doc_id").select("doc_id", "previous_score", "feature_score")


@dataclass(frozen=True)
class Explanation:
    matched: bool
    value: float
    description: str
    details: tuple[Explanation, ...] = ()

    def __str__(self) -> str:
        return self.render(0)

    def render(self, depth: int) -> str:
        head = "  " * depth + f"{self.value:g} = {self.description}\n"
        return head + "".join(d.render(depth + 1) for d in self.details)


def _terms_of(q: Query) -> list:
    return q.span_terms() if hasattr(q, "span_terms") else [(q.field, w) for w in q.words] if isinstance(q, Phrase) else q.leaves()


def _parts(frame: Frame, nodes: Sequence[tuple[Query, float]], similarity: object) -> list[Column]:
    """For each scored term, its frequency and quantised length, of which a score is made."""
    out = []
    for n, (q, _) in enumerate(nodes):
        if isinstance(q, Term) and hasattr(similarity, "explain") and frame.scoring:
            length = F.lit(None).cast("double") if frame._specs[q.field].omit_norms else quantised_length(F.col(f"__l_{q.field}"))
            out += [F.coalesce(frame.tf((q.field, q.term)), F.lit(0)).cast("double").alias(f"f{n}"), length.alias(f"l{n}")]
    return out


def explanations(searcher: Searcher, query: Query) -> DataFrame:
    """doc_id, node, depth, part, value of every hit: each node of the tree in order with its score (0 where it does not
    match), and under a matching term its idf and tfNorm."""
    frame = searcher.index.frame(query, searcher.similarity, True, searcher.narrowed(query))
    nodes: list[tuple[Query, float, int]] = []

    def walk(q: Query, boost: float, depth: int) -> None:
        nodes.append((q, boost, depth))
        if not hasattr(q, "span_terms"):
            for c in q.children():
                walk(c, boost * (q.boost if isinstance(q, Boost) else 1.0), depth + 1)

    walk(query, 1.0, 0)
    made = {}
    for n, (q, boost, _) in enumerate(nodes):
        made[f"__m{n}"], made[f"__s{n}"] = q.compile(frame, boost)
    df = frame.df.withColumns(made).where("__m0")
    rows = []
    for n, (q, boost, depth) in enumerate(nodes):
        row = lambda part, value, at, show, n=n: F.when(show, F.struct(F.lit(n).alias("node"), F.lit(at).alias("depth"), F.lit(part).alias("part"), value.cast("double").alias("value")))
        rows.append(row(type(q).__name__, F.col(f"__s{n}"), depth, F.lit(True)))
        if isinstance(q, Term) and hasattr(searcher.similarity, "idf"):
            idf = searcher.similarity.idf(frame._fields[q.field], frame._terms[q.field, q.term])
            rows.append(row("idf", F.lit(idf), depth + 1, F.col(f"__m{n}")))
            rows.append(row("tfNorm", F.col(f"__s{n}") / (idf * q.boost * boost), depth + 1, F.col(f"__m{n}")))
    each = F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull()))
    return df.select(F.col(searcher.index.id_col).alias("doc_id"), each)


def explain(searcher: Searcher, query: Query, doc_id: int) -> Explanation:
    """How a document's score comes about: each node of the tree evaluated on that document's row alone."""
    frame = searcher.index.frame(query, searcher.similarity)
    nodes: list[tuple[Query, float]] = []

    def walk(q: Query, boost: float) -> None:
        nodes.append((q, boost))
        inner = boost * (getattr(q, "boost", 1.0) if type(q).__name__ == "Boost" else 1.0)
        if not hasattr(q, "span_terms"):
            for c in q.children():
                walk(c, inner)

    walk(query, 1.0)
    pairs = [q.compile(frame, b) for q, b in nodes]
    columns = [c.alias(f"{'ms'[k]}{n}") for n, pair in enumerate(pairs) for k, c in enumerate(pair)]
    columns += _parts(frame, nodes, searcher.similarity)
    boosts = [b * getattr(q, "boost", 1.0) if isinstance(q, Term) else b for q, b in nodes]
    row = frame.df.where(F.col(searcher.index.id_col) == doc_id).select(*columns).first()
    made = iter(range(len(nodes)))

    def build(q: Query) -> Explanation:
        n = next(made)
        below = () if hasattr(q, "span_terms") else tuple(build(c) for c in q.children())
        matched, value = (bool(row[f"m{n}"]), float(row[f"s{n}"])) if row else (False, 0.0)
        details = below
        if not below and matched and q.leaves() and frame.scoring and f"f{n}" in row:
            stats = [frame._terms[x] for x in _terms_of(q)]
            name = q.leaves()[0][0]
            _, parts = searcher.similarity.explain(row[f"f{n}"], None if searcher.index.specs[name].omit_norms else row[f"l{n}"], frame._fields[name], stats, boosts[n])
            details = tuple(Explanation(True, v, text) for v, text in parts)
        return Explanation(matched, value if matched else 0.0, f"{q}" if matched else f"no match: {q}", details)

    return build(query)
