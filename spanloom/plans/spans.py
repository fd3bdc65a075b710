"""Positions and spans of a document: phrases, ordered and unordered nearness, unions, gaps.

Exact phrases are column expressions, and so are terms, unions of terms, ordered nearness of any number of those, and
unordered nearness of two: one fold over the positions of all clauses, from the last to the first. Sloppy phrases and
other span trees run as functions on Arrow batches of the leaves' positions, and are marked so that the optimizer
evaluates them once a document.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def exact_freq(positions: list[Column], offsets: list[int]) -> Column:
    """Number of places where all terms stand at their offsets."""
    def moved_by(offset: int):
        return lambda x: x - offset  # a second parameter would be taken for the element's index

    moved = [F.transform(p, moved_by(o)) for p, o in zip(positions, offsets)]
    common = moved[0]
    for m in moved[1:]:
        common = F.array_intersect(common, m)
    return F.size(common)


def weight(length: int, slop: int) -> float:
    return 1 / (1 + length) if length <= slop else 0.0


def sloppy_turns(adjusted: list[list[int]], slop: int) -> float:
    """Sum of 1 / (1 + match length) over the sloppy matches of a phrase of different terms.

    adjusted: each term's places less its offset in the phrase, so that an exact match has all terms at one place. Terms
    stand at their first places. In a turn, the term that stands foremost goes to its last place not beyond any other
    term: what lies between it and the hindmost term is the turn's match length. It then goes on by one place; the
    phrase ends with a term that has none.
    """
    left, total = [sorted(x) for x in adjusted], 0.0
    if not all(left):
        return 0.0
    stand = [x[0] for x in left]
    while True:
        k = stand.index(min(stand))
        others = stand[:k] + stand[k + 1 :]
        beyond = bisect_right(left[k], min(others))
        total += weight(max(others) - left[k][beyond - 1], slop)
        if beyond == len(left[k]):
            return total
        stand[k] = left[k][beyond]


def sloppy_repeats(lists: list[list[int]], offsets: list[int], groups: list[list[int]], slop: int) -> float:
    """`sloppy_turns` of a phrase in which terms occur more than once; groups: the phrase's places of each such term, by
    offset. Two of a group never stand on one occurrence: the one further ahead in the phrase's order goes on. A turn
    goes place by place, as others of the group may have to move, and counts its least match length."""
    left = [iter(sorted(x)) for x in lists]
    stand: list[int] = []
    try:
        for k in range(len(lists)):
            nth = next((g.index(k) for g in groups if k in g), 0)
            stand.append(next(islice(left[k], nth, None)))
    except StopIteration:
        return 0.0
    order = lambda k: (stand[k] - offsets[k], offsets[k])
    place = lambda k: stand[k] - offsets[k]

    def on(k: int) -> bool:
        while k is not None:
            stand[k] = next(left[k], -1)
            if stand[k] < 0:
                return False
            group = next((g for g in groups if k in g), [])
            rival = next((j for j in group if j != k and stand[j] == stand[k]), None)
            k = None if rival is None else min(k, rival, key=order)
        return True

    total = 0.0
    while True:
        k = min(range(len(lists)), key=order)
        least, more = slop + 1, True
        while more and place(k) <= min(place(j) for j in range(len(lists)) if j != k):
            least = min(least, max(map(place, range(len(lists)))) - place(k))
            more = on(k)
        total += weight(least, slop)
        if not more:
            return total


def sloppy_freq(positions: list[Column], offsets: list[int], terms: list[str], slop: int) -> Column:
    """Sloppy frequency; null unless all terms occur."""
    groups = [g for t in dict.fromkeys(terms) if len(g := sorted((k for k, x in enumerate(terms) if x == t), key=lambda k: offsets[k])) > 1]

    def freq(lists: list[np.ndarray]) -> float:
        if groups:
            return sloppy_repeats([x.tolist() for x in lists], offsets, groups, slop)
        return sloppy_turns([(x - o).tolist() for x, o in zip(lists, offsets)], slop)

    return on_positions(positions, freq, True)


def on_positions(positions: list[Column], of: Callable[[list[np.ndarray]], float], all_needed: bool) -> Column:
    """A number from the leaves' positions of each document; null without any, or with `all_needed` without all."""

    def freq(lists: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        none = np.zeros(0, "int64")
        for series in lists:
            out = []
            for row in zip(*series):
                has = [p is not None for p in row]
                out.append(of([none if p is None else np.asarray(p, "int64") for p in row]) if (all(has) if all_needed else any(has)) else None)
            yield pd.Series(out, dtype="float64")

    def one(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return freq((x,) for x in lists)

    made = F.pandas_udf(freq if len(positions) > 1 else one, "double").asNondeterministic()
    return made(*positions)


def _events(clauses: Sequence[Sequence[Column]], shifts: Sequence[int], *phases: int) -> Column:
    """Places of all clauses, from the last to the first: (at, phase, clause), by falling place."""
    def made(clause: int, phase: int, shift: int):
        return lambda x: F.struct((F.lit(shift) - x).cast("long").alias("at"), F.lit(phase).alias("phase"), F.lit(clause).alias("clause"))

    none = F.array().cast("array<int>")
    parts = [F.transform(F.coalesce(p, none), made(k, phase, shift)) for k, (ps, shift) in enumerate(zip(clauses, shifts)) for p in ps for phase in phases]
    return F.array_sort(F.concat(*parts))


def _fold(events: Column, n: int, step: Callable[[Column, Column, Column], dict[str, Column]]) -> Column:
    """The sum that a step over events adds up; s0, g0, s1, g1... are what is known of each clause so far."""
    names = {"sum": "double", **{f"{c}{k}": "long" for k in range(n) for c in "sg"}}
    start = F.struct(*[F.lit(0.0 if k == "sum" else None).cast(t).alias(k) for k, t in names.items()])

    def next_state(state: Column, event: Column) -> Column:
        new = step(state, event, -event["at"])
        return F.struct(*[new.get(k, state[k]).cast(t).alias(k) for k, t in names.items()])

    return F.aggregate(events, start, next_state, lambda s: s["sum"])


def count_of(positions: Sequence[Column]) -> Column:
    """Frequency of a union of terms."""
    return sum((F.coalesce(F.size(p), F.lit(0)) for p in positions), F.lit(0)).cast("double")


def ordered_freq(clauses: Sequence[Sequence[Column]], gaps: Sequence[int], slop: int) -> Column:
    """Frequency of an ordered nearness of unions of terms; gaps: positions kept free before each clause.

    Places less the gaps before them turn a gap into adjacency. Of each clause's nearest place behind the current one,
    s is the place and g the gaps from there on (null if what has to follow is missing).
    """
    shifts = np.cumsum(gaps).tolist()
    n = len(clauses)

    def step(state: Column, event: Column, at: Column) -> dict[str, Column]:
        new: dict[str, Column] = {}
        for k in range(n):
            here = event["clause"] == k
            gap = F.lit(0).cast("long") if k == n - 1 else state[f"s{k + 1}"] - at - 1 + state[f"g{k + 1}"]
            if k:
                new |= {f"s{k}": F.when(here, at).otherwise(state[f"s{k}"]), f"g{k}": F.when(here, gap).otherwise(state[f"g{k}"])}
            else:
                new["sum"] = state["sum"] + F.when(here & (gap <= slop), 1.0 / (1 + gap)).otherwise(F.lit(0.0))
        return new

    return _fold(_events(clauses, shifts, 0), n, step)


def unordered_freq(clauses: Sequence[Sequence[Column]], slop: int) -> Column:
    """Frequency of an unordered nearness of two unions that share no term: each place of either with the nearest place
    of the other behind it."""

    def step(state: Column, event: Column, at: Column) -> dict[str, Column]:
        width = F.when(event["clause"] == 0, state["s1"]).otherwise(state["s0"]) - at
        new = {f"s{k}": F.when(event["clause"] == k, at).otherwise(state[f"s{k}"]) for k in range(2)}
        return new | {"sum": state["sum"] + F.when(width - 1 <= slop, 1.0 / (1 + width)).otherwise(F.lit(0.0))}

    return _fold(_events(clauses, [0, 0], 0), 2, step)


def rows_on_positions(positions: list[Column], of: Callable[[list[np.ndarray]], tuple]) -> Column:
    """Spans themselves, array of (start, end, width), from the leaves' positions of each document."""
    kind = "array<struct<start:int,end:int,width:int>>"

    def made(lists: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        none = np.zeros(0, "int64")
        for series in lists:
            yield pd.Series([[{"start": int(a), "end": int(b), "width": int(w)} for a, b, w in zip(*of([none if p is None else np.asarray(p, "int64") for p in row]))] for row in zip(*series)])

    def one(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return made((x,) for x in lists)

    return F.pandas_udf(made if len(positions) > 1 else one, kind).asNondeterministic()(*positions)


#: Starts, ends and widths of spans, sorted by start, then end.
Spans = tuple[np.ndarray, np.ndarray, np.ndarray]


def of_positions(positions: np.ndarray) -> Spans:
    return positions, positions + 1, np.zeros(len(positions), "int64")


def either(clauses: list[Spans]) -> Spans:
    """Union of spans in order; duplicates stay."""
    starts, ends, widths = (np.concatenate([c[k] for c in clauses]) for k in range(3))
    order = np.lexsort((ends, starts))
    return starts[order], ends[order], widths[order]


def ordered(clauses: list[Spans | int], slop: int) -> Spans:
    """Spans of clauses in order with gaps of at most slop in all; an int is a gap of that width. For each start of
    the first clause, every next one takes its first span from where the last ended."""
    starts, ends, _ = clauses[0]
    widths = np.zeros(len(starts), "int64")
    for clause in clauses[1:]:
        if isinstance(clause, int):
            ends = ends + clause
            continue
        at = np.searchsorted(clause[0], ends)
        found = at < len(clause[0])
        starts, ends, widths, at = starts[found], ends[found], widths[found], at[found]
        widths = widths + clause[0][at] - ends
        ends = clause[1][at]
    near = widths <= slop
    return starts[near], ends[near], widths[near]


def unordered(clauses: list[Spans], slop: int) -> Spans:
    """Windows that hold a span of each clause, as cursors meet them: the one with the least start moves on."""
    out: list[tuple[int, int, int]] = []
    lists = [list(zip(c[0].tolist(), c[1].tolist())) for c in clauses]
    at = [0] * len(lists)
    while all(a < len(x) for a, x in zip(at, lists)):
        now = [x[a] for a, x in zip(at, lists)]
        least = min(range(len(now)), key=lambda k: (now[k], k))
        last = max(now, key=lambda s: (s[1], s[0]))
        if last[1] - now[least][0] - sum(e - s for s, e in now) <= slop:
            out.append((now[least][0], last[1], last[0] - now[least][0]))
        at[least] += 1
    return tuple(np.array([s[k] for s in out], "int64") for k in range(3))


def freq(spans: Spans) -> float:
    """Sum of 1 / (1 + width)."""
    return float((1.0 / (1 + spans[2])).sum())
