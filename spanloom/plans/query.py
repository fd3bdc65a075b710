"""The query tree: what a document must hold and how it scores.

Every node compiles to a pair of column expressions on a frame with one row per document: `match` (boolean, never
null) and `score` (double; 0 where it does not match). Leaves ask the frame for positions or frequencies of
(field, term); everything above them is expressions, so a whole tree is one projection for Catalyst to generate.

Documented intent decides where implementations of such trees are known to differ: any prohibited clause excludes,
the least number of optional clauses counts wherever they alone decide, optional scores are always added, and terms
that no document has match nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.plans import spans

Leaf = tuple[str, str]


class Context(Protocol):
    """What a frame offers to the leaves."""

    scoring: bool

    def bind(self, value: Column) -> Column: ...
    def tf(self, leaf: Leaf) -> Column: ...
    def positions(self, leaf: Leaf) -> Column: ...
    def relevance(self, freq: Column, leaves: Sequence[Leaf], boost: float) -> Column: ...
    def column(self, name: str) -> Column: ...
    def kind(self, name: str) -> str: ...


Pair = tuple[Column, Column]


class Factor(float):
    """A boost that some query around states, be it 1."""


def _number(x: float) -> str:
    return f"{x:g}"


def _scored(match: Column, score: Column) -> Pair:
    match = F.coalesce(match, F.lit(False))
    return match, F.when(match, F.coalesce(score, F.lit(0.0))).otherwise(F.lit(0.0))


class Query:
    """A node. Subclass it and implement `compile` for a query of your own."""

    #: Whether leaves need positions, not only frequencies.
    positional = False

    def children(self) -> Sequence[Query]:
        return ()

    def leaves(self) -> list[Leaf]:
        return list(dict.fromkeys(x for c in self.children() for x in c.leaves()))

    def positional_leaves(self) -> list[Leaf]:
        own = self.leaves() if self.positional else []
        return list(dict.fromkeys([*own, *(x for c in self.children() for x in c.positional_leaves())]))

    def terms(self) -> list[Leaf]:
        """Leaves that a hit may be marked for: of required and optional clauses."""
        return self.leaves()

    def compile(self, context: Context, boost: float = 1.0) -> Pair:
        raise NotImplementedError

    def only_with_terms(self) -> bool:
        """Whether documents without any leaf's term cannot match."""
        return False

    def needed(self) -> Sequence[Query]:
        """Nodes that every match satisfies: what a scan may filter by before it looks at texts."""
        return (self,)


class Constant(Query):
    """Matches without relevance: the score is 0, or the boost around it."""

    def condition(self, context: Context) -> Column:
        raise NotImplementedError

    def compile(self, context: Context, boost: float = 1.0) -> Pair:
        return _scored(self.condition(context), F.lit(float(boost) if isinstance(boost, Factor) else 0.0))


@dataclass(frozen=True)
class Term(Query):
    field: str
    term: str
    boost: float = 1.0

    def leaves(self) -> list[Leaf]:
        return [(self.field, self.term)]

    def compile(self, context: Context, boost: float = 1.0) -> Pair:
        tf = context.tf((self.field, self.term))
        return _scored(tf > 0, context.relevance(tf, [(self.field, self.term)], self.boost * boost))

    def only_with_terms(self) -> bool:
        return True

    def __str__(self) -> str:
        return f"TermQuery(field: {self.field}, term: {self.term}, boost: {_number(self.boost)})"


@dataclass(frozen=True)
class MatchAll(Constant):
    def condition(self, context: Context) -> Column:
        return F.lit(True)

    def __str__(self) -> str:
        return "MatchAllDocsQuery()"


@dataclass(frozen=True)
class ConstantScore(Query):
    """Another query's matches with one score; 0 by default."""

    query: Query
    boost: float = 0.0

    def children(self) -> Sequence[Query]:
        return (self.query,)

    def compile(self, context: Context, boost: float = 1.0) -> Pair:
        return _scored(self.query.compile(context)[0], F.lit(float(self.boost * boost)))

    def only_with_terms(self) -> bool:
        return self.query.only_with_terms()

    def needed(self) -> Sequence[Query]:
        return self.query.needed()

    def __str__(self) -> str:
        return f"ConstantScoreQuery(sub_query: {self.query}, weight: {_number(self.boost)})"


@dataclass(frozen=True)
class Boolean(Query):
    """Made by `boolean`, which simplifies."""

    musts: tuple[Query, ...] = ()
    shoulds: tuple[Query, ...] = ()
    filters: tuple[Query, ...] = ()
    must_nots: tuple[Query, ...] = ()
    min_should_match: int = 0

    def children(self) -> Sequence[Query]:
        return (*self.musts, *self.shoulds, *self.filters, *self.must_nots)

    def terms(self) -> list[Leaf]:
        return list(dict.fromkeys(x for c in (*self.musts, *self.shoulds) for x in c.terms()))

    def compile(self, context: Context, boost: float = 1.0) -> Pair:
        musts, shoulds = ([q.compile(context, boost) for q in qs] for qs in (self.musts, self.shoulds))
        required = [m for m, _ in musts] + [q.compile(context)[0] for q in self.filters]
        if required:  # optional clauses only add to the score
            match = reduce(Column.__and__, required)
        else:
            match = reduce(Column.__add__, [m.cast("int") for m, _ in shoulds]) >= max(1, self.min_should_match)
        for q in self.must_nots:
            match = match & ~q.compile(context)[0]
        scores = [s for _, s in (*musts, *shoulds)]
        return _scored(match, reduce(Column.__add__, scores) if scores else F.lit(0.0))

    def only_with_terms(self) -> bool:
        required = (*self.musts, *self.filters)
        return any(q.only_with_terms() for q in required) if required else all(q.only_with_terms() for q in self.shoulds)

    def needed(self) -> Sequence[Query]:
        return [n for q in (*self.musts, *self.filters) for n in q.needed()]

    def __str__(self) -> str:
        parts = (", ".join(map(str, qs)) for qs in (self.musts, self.shoulds, self.filters, self.must_nots))
        return "BooleanQuery(must: [{}], should: [{}], filters: [{}], must_not: [{}], match: {})".format(*parts, self.min_should_match)


def boolean(musts: Sequence[Query] = (), shoulds: Sequence[Query] = (), filters: Sequence[Query] = (), must_nots: Sequence[Query] = (), min_should_match: int = 0) -> Query:
    """A Boolean query, or what it amounts to. Without required clauses at least one optional one must match."""
    least = min_should_match if min_should_match > 0 else int(not musts)
    positive = len(musts) + len(shoulds) + len(filters)
    if not positive and not must_nots:
        raise ValueError("a Boolean query needs a clause")
    if positive == 1 and not must_nots:
        return (*musts, *shoulds)[0] if not filters else ConstantScore(filters[0])
    if not positive:
        musts = (MatchAll(),)
    return Boolean(tuple(musts), tuple(shoulds), tuple(filters), tuple(must_nots), least)


@dataclass(frozen=True)
class Boost(Query):
    query: Query
    boost: float

    def children(self) -> Sequence[Query]:
        return (self.query,)

    def terms(self) -> list[Leaf]:
        return self.query.terms()

    def compile(self, context: Context, boost: float = 1.0) -> Pair:
        return self.query.compile(context, Factor(self.boost * boost))

    def only_with_terms(self) -> bool:
        return self.query.only_with_terms()

    def needed(self) -> Sequence[Query]:
        return self.query.needed()

    def __str__(self) -> str:
        return f"BoostQuery(query: {self.query}, boost: {_number(self.boost)})"


def boosted(query: Query, boost: float) -> Query:
    return query if abs(boost - 1) < 1e-7 else Boost(query, boost)


@dataclass(frozen=True)
class Boosting(Query):
    """Matches of one query; those that match another too are demoted by a factor."""

    positive: Query
    negative: Query
    negative_boost: float

    def __post_init__(self) -> None:
        if not 0 < self.negative_boost < 1:
            raise ValueError("the negative boost lies between 0 and 1")

    def children(self) -> Sequence[Query]:
        return (self.positive, self.negative)

    def terms(self) -> list[Leaf]:
        return self.positive.terms()

    def compile(self, context: Context, boost: float = 1.0) -> Pair:
        match, score = self.positive.compile(context, boost)
        return _scored(match, F.when(self.negative.compile(context)[0], score * self.negative_boost).otherwise(score))

    def only_with_terms(self) -> bool:
        return self.positive.only_with_terms()

    def needed(self) -> Sequence[Query]:
        return self.positive.needed()

    def __str__(self) -> str:
        return f"BoostingQuery(positive: {self.positive}, negative: {self.negative}, negative_boost: {_number(self.negative_boost)})"


@dataclass(frozen=True)
class DisjunctionMax(Query):
    """The best of its clauses' scores, and a share of the others'."""

    disjuncts: tuple[Query, ...]
    tie_breaker: float = 0.0

    def children(self) -> Sequence[Query]:
        return self.disjuncts

    def compile(self, context: Context, boost: float = 1.0) -> Pair:
        pairs = [q.compile(context, boost) for q in self.disjuncts]
        scores = [s for _, s in pairs]
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        return _scored(reduce(Column.__or__, [m for m, _ in pairs]), best + self.tie_breaker * (reduce(Column.__add__, scores) - best))

    def only_with_terms(self) -> bool:
        return all(q.only_with_terms() for q in self.disjuncts)

    def __str__(self) -> str:
        return f"DisjunctionMaxQuery(disjunctions: {', '.join(map(str, self.disjuncts))}, tie_breaker_multiplier: {_number(self.tie_breaker)})"


def disjunction_max(disjuncts: Sequence[Query], tie_breaker: float = 0.0) -> Query:
    if not disjuncts:
        raise ValueError("a disjunction needs a clause")
    return disjuncts[0] if len(disjuncts) == 1 else DisjunctionMax(tuple(disjuncts), tie_breaker)


@dataclass(frozen=True)
class Exists(Constant):
    """Documents with a value in a field; of arrays and binary values, one that is not empty."""

    field: str

    def condition(self, context: Context) -> Column:
        col, kind = context.column(self.field), context.kind(self.field)
        return F.size(col) > 0 if kind.startswith("array") else F.octet_length(col) > 0 if kind == "binary" else col.isNotNull()

    def __str__(self) -> str:
        return f"ExistsQuery(field={self.field})"


@dataclass(frozen=True)
class PointRange(Constant):
    """Every dimension within its bounds, inclusive; None is open. A multi-valued field needs one value within.

    Several dimensions are several columns, or the fields of a struct column, or of an array of structs.
    """

    fields: tuple[str, ...]
    lower: tuple[Any, ...]
    upper: tuple[Any, ...]

    def __post_init__(self) -> None:
        if not 1 <= len(self.lower) == len(self.upper) <= 8:
            raise ValueError("bounds have 1 to 8 dimensions, as many below as above")

    def condition(self, context: Context) -> Column:
        def within(values: Sequence[Column]) -> Column:
            out = F.lit(True)
            for x, low, high in zip(values, self.lower, self.upper):
                out = out & x.isNotNull() & (F.lit(True) if low is None else x >= low) & (F.lit(True) if high is None else x <= high)
            return out

        if len(self.fields) > 1:
            return within([context.column(f) for f in self.fields])
        col, kind = context.column(self.fields[0]), context.kind(self.fields[0])
        names = [p.split(":")[0] for p in kind[kind.find("struct<") + 7 :].rstrip(">").split(",")] if "struct<" in kind else None
        split = (lambda x: [x[n] for n in names]) if names else lambda x: [x]
        return F.exists(col, lambda x: within(split(x))) if kind.startswith("array") else within(split(col))

    def __str__(self) -> str:
        return f"PointRangeQuery(field: {','.join(self.fields)}, {list(self.lower)} TO {list(self.upper)})"


def point_range(field_: str, lower: Any, upper: Any) -> Query:
    return PointRange((field_,), (lower,), (upper,))


def point_exact(field_: str, value: Any) -> Query:
    return point_range(field_, value, value)


def point_box(fields: Sequence[str] | str, lower: Sequence, upper: Sequence) -> Query:
    """A range of several dimensions: over columns, or over the fields of one struct column."""
    return PointRange((fields,) if isinstance(fields, str) else tuple(fields), tuple(lower), tuple(upper))


@dataclass(frozen=True)
class Filter(Query):
    """A query's matches that pass every predicate: functions from column lookup to a boolean column, UDFs included."""

    query: Query
    predicates: tuple[Callable[[Callable[[str], Column]], Column], ...]

    def children(self) -> Sequence[Query]:
        return (self.query,)

    def terms(self) -> list[Leaf]:
        return self.query.terms()

    def compile(self, context: Context, boost: float = 1.0) -> Pair:
        match, score = self.query.compile(context, boost)
        for p in self.predicates:
            match = match & F.coalesce(p(context.column), F.lit(False))
        return _scored(match, score)

    def only_with_terms(self) -> bool:
        return self.query.only_with_terms()

    def needed(self) -> Sequence[Query]:
        return self.query.needed()

    def __str__(self) -> str:
        return f"FilterQuery(query: {self.query}, filter: {', '.join(getattr(p, '__name__', str(p)) for p in self.predicates)})"


@dataclass(frozen=True)
class Phrase(Query):
    """Terms at given places relative to each other, or within `slop` moves of them."""

    field: str
    words: tuple[str, ...]
    slop: int = 0
    places: tuple[int, ...] = ()
    positional = True

    def __post_init__(self) -> None:
        if len(self.words) < 2:
            raise ValueError("a phrase has two terms at least")
        if self.slop < 0:
            raise ValueError("slop is not negative")
        places = self.places or tuple(range(len(self.words)))
        if len(places) != len(self.words) or list(places) != sorted(places):
            raise ValueError("a phrase has an ascending place for each term")
        object.__setattr__(self, "places", tuple(p - places[0] for p in places))

    def leaves(self) -> list[Leaf]:
        return list(dict.fromkeys((self.field, w) for w in self.words))

    def compile(self, context: Context, boost: float = 1.0) -> Pair:
        positions = [context.positions((self.field, w)) for w in self.words]
        if self.slop:
            freq = spans.sloppy_freq(positions, list(self.places), list(self.words), self.slop)
        else:
            freq = spans.exact_freq(positions, list(self.places))
        freq = context.bind(freq)
        return _scored(freq > 0, context.relevance(freq, [(self.field, w) for w in self.words], boost))

    def only_with_terms(self) -> bool:
        return True

    def __str__(self) -> str:
        return f"PhraseQuery(field: {self.field}, terms: [{', '.join(self.words)}], positions: {list(self.places)}, slop: {self.slop})"


# Span queries.


class SpanQuery(Query):
    positional = True

    def field_name(self) -> str:
        raise NotImplementedError

    def span_terms(self) -> list[Leaf]:
        """Terms of the tree in order, repeats included."""
        return [x for c in self.children() for x in c.span_terms()]

    def leaves(self) -> list[Leaf]:
        return list(dict.fromkeys(self.span_terms()))

    def factor(self) -> float:
        return 1.0

    def spans(self, positions: dict[Leaf, Any]) -> spans.Spans:
        """The spans in a document, from its leaves' positions."""
        raise NotImplementedError

    def closed(self, context: Context) -> Column | None:
        """The frequency as a column expression, where there is one."""
        return None

    def compile(self, context: Context, boost: float = 1.0) -> Pair:
        leaves, closed = self.leaves(), self.closed(context)
        freq = context.bind(closed if closed is not None else spans.on_positions([context.positions(x) for x in leaves], lambda lists: spans.freq(self.spans(dict(zip(leaves, lists)))), False))
        return _scored(freq > 0, context.relevance(freq, self.span_terms(), boost * self.factor()))

    def only_with_terms(self) -> bool:
        return True


@dataclass(frozen=True)
class SpanTerm(SpanQuery):
    field: str
    term: str

    def field_name(self) -> str:
        return self.field

    def span_terms(self) -> list[Leaf]:
        return [(self.field, self.term)]

    def closed(self, context: Context) -> Column:
        return spans.count_of([context.positions(x) for x in self.span_terms()])

    def spans(self, positions: dict[Leaf, Any]) -> spans.Spans:
        return spans.of_positions(positions[self.field, self.term])

    def __str__(self) -> str:
        return f"SpanTermQuery(field: {self.field}, term: {self.term})"


@dataclass(frozen=True)
class SpanGap(SpanQuery):
    """So many positions of anything, between clauses of an ordered nearness."""

    field: str
    width: int

    def field_name(self) -> str:
        return self.field

    def span_terms(self) -> list[Leaf]:
        return []

    def spans(self, positions: dict[Leaf, Any]) -> spans.Spans:
        raise ValueError("a gap stands between clauses of an ordered nearness only")

    def __str__(self) -> str:
        return f"SpanGapQuery(field: {self.field}, width: {self.width})"


def _union(clause: SpanQuery) -> list[Leaf] | None:
    """The terms that a clause is a union of; None for other clauses."""
    if isinstance(clause, SpanTerm):
        return clause.span_terms()
    if isinstance(clause, SpanOr) and all(isinstance(c, SpanTerm) for c in clause.clauses):
        return clause.span_terms()
    return None


def _one_field(clauses: Sequence[SpanQuery]) -> str:
    names = {c.field_name() for c in clauses}
    if len(names) != 1:
        raise ValueError(f"span clauses are of one field, not of {sorted(names)}")
    return names.pop()


@dataclass(frozen=True)
class SpanNear(SpanQuery):
    clauses: tuple[SpanQuery, ...]
    slop: int
    in_order: bool

    def __post_init__(self) -> None:
        _one_field(self.clauses)
        gaps = [isinstance(c, SpanGap) for c in self.clauses]
        if len(gaps) - sum(gaps) < 2:
            raise ValueError("nearness needs two clauses")
        if any(gaps) and (not self.in_order or gaps[0]):
            raise ValueError("a gap follows a clause of an ordered nearness")

    def children(self) -> Sequence[Query]:
        return self.clauses

    def field_name(self) -> str:
        return _one_field(self.clauses)

    def closed(self, context: Context) -> Column | None:
        unions, gaps, free = [], [], 0
        for c in self.clauses:
            if isinstance(c, SpanGap):
                free += c.width
                continue
            if (terms := _union(c)) is None:
                return None
            unions.append(terms)
            gaps.append(free)
            free = 0
        places = [[context.positions(x) for x in u] for u in unions]
        if self.in_order:
            return None if free else spans.ordered_freq(places, gaps, self.slop)
        return spans.unordered_freq(places, self.slop) if len(unions) == 2 and not set(unions[0]) & set(unions[1]) else None

    def spans(self, positions: dict[Leaf, Any]) -> spans.Spans:
        if self.in_order:
            return spans.ordered([c.width if isinstance(c, SpanGap) else c.spans(positions) for c in self.clauses], self.slop)
        return spans.unordered([c.spans(positions) for c in self.clauses], self.slop)

    def __str__(self) -> str:
        return f"SpanNearQuery(clauses: [{', '.join(map(str, self.clauses))}], slop: {self.slop}, in_order: {str(self.in_order).lower()})"


@dataclass
class SpanNearBuilder:
    field: str
    in_order: bool
    clauses: list[SpanQuery] = field(default_factory=list)
    slop: int = 0

    def add_clause(self, clause: SpanQuery) -> SpanNearBuilder:
        if clause.field_name() != self.field:
            raise ValueError(f"span clauses are of one field, not of {self.field} and {clause.field_name()}")
        self.clauses.append(clause)
        return self

    def add_gap(self, width: int) -> SpanNearBuilder:
        return self.add_clause(SpanGap(self.field, width))

    def with_slop(self, slop: int) -> SpanNearBuilder:
        self.slop = slop
        return self

    def build(self) -> SpanNear:
        return SpanNear(tuple(self.clauses), self.slop, self.in_order)


@dataclass(frozen=True)
class SpanOr(SpanQuery):
    clauses: tuple[SpanQuery, ...]

    def __post_init__(self) -> None:
        if len(self.clauses) < 2:
            raise ValueError("a union of spans needs two clauses")
        _one_field(self.clauses)

    def children(self) -> Sequence[Query]:
        return self.clauses

    def field_name(self) -> str:
        return _one_field(self.clauses)

    def closed(self, context: Context) -> Column | None:
        terms = _union(self)
        return None if terms is None else spans.count_of([context.positions(x) for x in terms])

    def spans(self, positions: dict[Leaf, Any]) -> spans.Spans:
        return spans.either([c.spans(positions) for c in self.clauses])

    def __str__(self) -> str:
        return f"SpanOrQuery(clauses: [{', '.join(map(str, self.clauses))}])"


@dataclass(frozen=True)
class SpanBoost(SpanQuery):
    """A span query whose score counts `boost` times."""

    query: SpanQuery
    boost: float

    def children(self) -> Sequence[Query]:
        return (self.query,)

    def field_name(self) -> str:
        return self.query.field_name()

    def factor(self) -> float:
        return self.boost * self.query.factor()

    def closed(self, context: Context) -> Column | None:
        return self.query.closed(context)

    def spans(self, positions: dict[Leaf, Any]) -> spans.Spans:
        return self.query.spans(positions)

    def __str__(self) -> str:
        return f"SpanBoostQuery(query: {self.query}, boost: {_number(self.boost)})"
