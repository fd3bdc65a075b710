"""Highlighting: fragments of a field with a query's terms marked.

Occurrences come from the text itself, so no vectors are stored. The weight of a term needs its total frequency in
the field; it is sent along as literals. Fragments are made row by row, and given back a slice of a batch at a time.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.analysis import SLICE_BYTES
from spanloom.plans.query import Query
from spanloom.sources.index import TableIndex

MARGIN, PHRASE_LIMIT, MAX_SCAN = 6, 256, 50
BOUNDARIES = frozenset(" \t\n,，|!！?？;；.。:：")


def plain(text: str) -> str:
    return text


def html(text: str) -> str:
    for raw, safe in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#x27;"), ("/", "&#x2F;")):
        text = text.replace(raw, safe)
    return text


ENCODERS: dict[str, Callable[[str], str]] = {"plain": plain, "html": html}


@dataclass
class Match:
    """A marked stretch of text: places of its parts, its weight, and the number of its term in the query."""

    start: int
    end: int
    boost: float
    number: int
    parts: list[tuple[int, int]] = field(default_factory=list)


@dataclass
class Fragment:
    start: int
    end: int
    matches: list[Match]

    @property
    def boost(self) -> float:
        return sum(m.boost for m in self.matches)


def tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"\S+", text)]


def occurrences(text: str, numbers: dict[str, int], frequencies: dict[str, int], max_doc: int) -> list[Match]:
    """Occurrences of terms in order; those inside a longer one go. A term that is rare in the field and in the text
    weighs more."""
    found = sorted(((e, s, t) for t, s, e in tokens(text) if t in numbers), key=lambda x: (-x[0], x[1]))
    kept: list[tuple[int, int, str]] = []
    for end, start, term in found:
        if not (kept and start >= kept[-1][0] and end <= kept[-1][1]):
            kept.append((start, end, term))
    counts: dict[str, int] = {}
    for _, _, term in kept:
        counts[term] = counts.get(term, 1) + 1
    average = len(kept) / (len(counts) + 1)
    weight = {t: math.log10(max_doc / (frequencies.get(t, 0) + 1) + 1) * (1 + average / (n + 1)) for t, n in counts.items()}
    return [Match(s, e, weight[t], numbers[t], [(s, e)]) for s, e, t in reversed(kept)]


def phrases(found: Sequence[Match], limit: int = PHRASE_LIMIT) -> list[Match]:
    """Matches without overlap, `limit` at most; an overlapping one stretches what is there."""
    out: list[Match] = []
    for m in found:
        if len(out) >= limit:
            break
        clash = next((o for o in out if m.start < o.end and o.start < m.end), None)
        if clash is None:
            out.append(m)
        elif clash.end < m.end:
            clash.end = m.end
            clash.parts[-1] = (clash.parts[-1][0], m.end)
    return out


def merged(lists: Sequence[Sequence[Match]]) -> list[Match]:
    """Matches of several fields as one list; those that touch become one."""
    out: list[Match] = []
    for m in sorted((m for x in lists for m in x), key=lambda m: (m.start, m.end, m.boost)):
        if out and m.start <= out[-1].end:
            last = out[-1]
            parts: list[tuple[int, int]] = []
            for s, e in sorted([*last.parts, *m.parts]):
                if parts and s <= parts[-1][1]:
                    parts[-1] = (parts[-1][0], max(e, parts[-1][1]))
                else:
                    parts.append((s, e))
            out[-1] = Match(last.start, max(last.end, m.end), last.boost + m.boost, last.number, parts)
        else:
            out.append(Match(m.start, m.end, m.boost, m.number, list(m.parts)))
    return out


def _check(size: int, margin: int) -> int:
    least = max(1, 3 * margin)
    if size < least:
        raise ValueError(f"fragments have {least} characters at least, not {size}")
    return least


def best_window(found: Sequence[Match], size: int, margin: int = MARGIN) -> list[Fragment]:
    """One fragment: the run of matches of most weight that fits, centred."""
    least = _check(size, margin)
    if not found:
        return []
    # For each last match of a run, the longest run that fits weighs most. A run of one is taken at the start only.
    room, chosen = max(size - margin, least), (0, 0)
    upto = [0.0, *accumulate(m.boost for m in found)]
    first, best = 0, upto[1]
    for last in range(1, len(found)):
        while found[last].end - found[first].start > room and first < last:
            first += 1
        if first < last and (total := upto[last + 1] - upto[first]) > best + 1e-12 * abs(best):
            best, chosen = total, (first, last)
    own = list(found[chosen[0] : chosen[1] + 1])
    start, end = own[0].start, own[-1].end
    if end - start < size:
        start = max(0, start - (size - (end - start)) // 2)
        end = start + size
    return [Fragment(start, end, own)]


def windows(found: Sequence[Match], size: int, margin: int = MARGIN) -> list[Fragment]:
    """Fragments from left to right, without overlap, each centred on its matches."""
    _check(size, margin)
    out: list[Fragment] = []
    free, k = 0, 0
    while k < len(found):
        first = found[k]
        if first.start < free:
            k += 1
            continue
        limit = max(first.end, max(first.start - margin, free) + size)
        own, end = [], first.end
        while k < len(found) and (found[k] is first or found[k].end <= limit):
            end = found[k].end
            if len(found[k].parts) <= 1 or end - first.start <= size:
                own.append(found[k])
            k += 1
        if own:
            start = max(first.start - max(0, (size - (end - first.start)) // 2), free)
            free = start + max(end - first.start, size)
            out.append(Fragment(start, free, own))
    return out


def single(found: Sequence[Match], size: int = 0, margin: int = 0) -> list[Fragment]:
    """The whole field."""
    return [Fragment(0, 1 << 31, list(found))] if found else []


BUILDERS = {"best": best_window, "windows": windows, "single": single}


def boundary_before(text: str, at: int, scan: int = MAX_SCAN, chars: frozenset = BOUNDARIES) -> int:
    if not 1 <= at <= len(text):
        return at
    for k in range(at, max(0, at - scan), -1):
        if text[k - 1] in chars:
            return k
    return 0 if at - scan <= 0 else at


def boundary_after(text: str, at: int, scan: int = MAX_SCAN, chars: frozenset = BOUNDARIES) -> int:
    if not 0 <= at <= len(text):
        return at
    return next((k for k in range(at, min(len(text), at + scan)) if text[k] in chars), at)


def render(text: str, fragment: Fragment, pre: Sequence[str], post: Sequence[str], encode: Callable[[str], str]) -> str:
    """A fragment's text between boundaries, its matches in tags chosen by the number of their term."""
    if len(text) < fragment.end:
        begin, end = (0 if fragment.start - (fragment.end - len(text) - 1) <= 0 else fragment.start), len(text)
    else:
        begin, end = fragment.start, boundary_after(text, fragment.end)
    begin = boundary_before(text, begin)
    out, at = "", begin
    for m in fragment.matches:
        for s, e in m.parts:
            if s < at or s >= end:
                continue
            out += encode(text[at:s]) + pre[m.number % len(pre)] + encode(text[s : min(e, end)]) + post[m.number % len(post)]
            at = min(e, end)
    return out + encode(text[at:end])


def fragments(values: Sequence[str], matches: Sequence[Match], size: int, number: int = 1, builder: str = "best", margin: int = MARGIN, pre: Sequence[str] = ("<b>",), post: Sequence[str] = ("</b>",), encoder: str = "plain", by_score: bool = False, discrete: bool = False) -> list[str]:
    """Marked fragments of a field. Several values are one text, parted by a space; if discrete, none spans two."""
    text = " ".join(values)
    found = BUILDERS[builder](matches, size, margin)
    if discrete and len(values) > 1:
        parted, at = [], 0
        for v in values:
            for f in found:
                own = [Match(m.start, m.end, m.boost, m.number, p) for m in f.matches if (p := [(max(s, at), min(e, at + len(v))) for s, e in m.parts if s < at + len(v) and e > at])]
                if own:
                    parted.append(Fragment(max(f.start, at), min(f.end, at + len(v)), own))
            at += len(v) + 1
        found = parted
    if by_score:
        found = sorted(found, key=lambda f: (-f.boost, f.start))
    return [render(text, f, pre, post, ENCODERS[encoder]) for f in found[:number]]


def highlight(index: TableIndex, query: Query, hits: DataFrame, name: str, size: int = 100, matched: Sequence[str] = (), field_match: bool = True, **options) -> DataFrame:
    """doc_id, fragments: of the hits' field `name`, marked for the query's terms in it and in the fields `matched`;
    without `field_match`, for its terms in any field."""
    fields = [name, *matched]
    terms = [x for x in query.terms() if x[0] in fields] if field_match else [(f, t) for f in fields for t in dict.fromkeys(t for _, t in query.terms())]
    stats, totals = index.statistics(terms)
    max_doc = next(iter(stats.values())).max_doc if stats else 0
    numbers = {f: {t: k for k, t in enumerate(dict.fromkeys(t for g, t in terms if g == f))} for f in fields}
    frequencies = {f: {t: totals[g, t].ttf for g, t in terms if g == f} for f in fields}

    @F.arrow_udf("array<string>")
    def mark(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            step = max(1, len(rows) * SLICE_BYTES // max(1, rows.nbytes))
            for at in range(0, len(rows), step):
                out = []
                for row in rows.slice(at, step).to_pylist():
                    value, *others = row.values()
                    values = [] if value is None else [value] if isinstance(value, str) else [v for v in value if v is not None]
                    texts = [" ".join(values)] + [o if isinstance(o, str) else "" for o in others]
                    lists = [phrases(occurrences(t, numbers[f], frequencies[f], max_doc)) for f, t in zip(fields, texts)]
                    out.append(fragments(values, merged(lists) if len(lists) > 1 else lists[0], size, **options))
                yield pa.array(out, pa.list_(pa.string()))

    docs = index.docs.join(hits.select(F.col("doc_id").alias(index.id_col)), index.id_col, "left_semi")
    return docs.select(F.col(index.id_col).alias("doc_id"), mark(F.struct(*[F.col(f).alias(str(k)) for k, f in enumerate(fields)])).alias("fragments"))
