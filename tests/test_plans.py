"""Parsing, query texts, scoring constants and spans: no session needed."""

import math
import random

import numpy as np
import pytest

from spanloom.functions import scalars
from spanloom.functions.similarity import BM25, STEPS, FieldStats, TermStats, byte_of_norm, norm_of_byte
from spanloom.operators import highlight as H
from spanloom.operators.mutation import plan_merges
from spanloom.plans import query as Q
from spanloom.plans import spans
from spanloom.plans.parser import parse
from spanloom.schema import FieldSpec, IndexOptions, IndexSchema, keyword, numeric, text


def term(word, boost="1", field="title"):
    return f"TermQuery(field: {field}, term: {word}, boost: {boost})"


def tree(must=(), should=(), match=0):
    return f"BooleanQuery(must: [{', '.join(must)}], should: [{', '.join(should)}], filters: [], must_not: [], match: {match})"


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("test", term("test")),
        ("+test", term("test")),
        ("(test^0.2 | 测试^2)", tree(should=[term("test", "0.2"), term("测试", "2")], match=1)),
        ('test^0.2 "测试"^2', tree(should=[term("test", "0.2"), term("测试", "2")], match=1)),
        ("test search", tree(should=[term("test"), term("search")], match=1)),
        ("test +search", tree([term("search")], [term("test")])),
        ("test +(search 搜索)", tree([tree(should=[term("search"), term("搜索")], match=1)], [term("test")])),
    ],
)
def test_query_strings(query, want):
    assert str(parse(query, [("title", 1.0)])) == want


def test_query_string_of_two_fields_and_phrases():
    both = lambda w: tree(should=[term(w), term(w, field="content")], match=1)
    assert str(parse("test +search", [("title", 1.0), ("content", 1.0)])) == tree([both("search")], [both("test")])
    assert parse('"a b~2"', [("f", 3.0)]) == Q.Boost(Q.Phrase("f", ("a", "b"), 2), 3.0)
    for bad in ("", "a)", '"a~1"', "a^x"):
        with pytest.raises(ValueError):
            parse(bad, [("f", 1.0)])


def test_boolean_simplifies():
    a, b = Q.Term("f", "a"), Q.Term("f", "b")
    assert Q.boolean([a]) is a and Q.boolean(shoulds=[b]) is b
    assert Q.boolean(filters=[a]) == Q.ConstantScore(a, 0.0)
    assert Q.boolean(must_nots=[a]).musts == (Q.MatchAll(),)
    assert Q.boolean([a], [b]).min_should_match == 0 and Q.boolean(shoulds=[a, b]).min_should_match == 1
    assert Q.boosted(a, 1.0) is a and Q.disjunction_max([a]) is a
    with pytest.raises(ValueError):
        Q.boolean()
    with pytest.raises(ValueError):
        Q.Phrase("f", ("a",))
    assert Q.boolean([a], [b], [Q.Term("f", "c")], [Q.Term("f", "d")]).terms() == [("f", "a"), ("f", "b")]


def test_similarity_constants():
    assert math.isclose(BM25.idf(FieldStats(11, -1, 0), TermStats(1)), math.log(8))
    assert math.isclose(BM25.idf(FieldStats(35, 32, -1), TermStats(1)), math.log(22))
    assert [BM25.average_length(FieldStats(*x)) for x in ((11, 5, 0), (3, 2, 8), (3, -1, 9))] == [1, 4, 3]


def test_lengths_are_those_of_byte_norms():
    for n in [*range(1, 3000), 10_000, 123_456, 299_999]:
        want = 1 / norm_of_byte(byte_of_norm(1 / math.sqrt(n))) ** 2
        assert math.isclose(next(s for s in STEPS if n <= math.floor(s)), want, rel_tol=1e-6), n
    assert [byte_of_norm(norm_of_byte(b)) for b in range(256)] == list(range(256))


def test_sortable_numbers():
    values = [-math.inf, -1e300, -1.5, -0.0, 0.0, 1e-300, 2.0, math.inf]
    assert sorted(values[::-1], key=scalars.sortable_bits)[0] == -math.inf
    coded = [scalars.sortable_bytes(scalars.sortable_bits(v)) for v in values]
    assert coded == sorted(coded) and len(set(coded)) == len(values)
    assert scalars.next_down(scalars.next_up(1.0)) == 1.0 < scalars.next_up(1.0)


def test_sloppy_of_two_terms_follows_the_fold():
    draw = random.Random(1)
    for _ in range(3000):
        places = draw.sample(range(14), draw.randint(2, 9))
        cut = draw.randint(1, len(places) - 1)
        a, b = sorted(places[:cut]), sorted(p - 1 for p in places[cut:])
        slop, lists, offset = draw.randint(0, 5), [a, b], (0, 1)
        now = min((0, 1), key=lambda k: (lists[k][0], offset[k]))
        at, want = [0, 0], 0.0
        while True:
            other = lists[1 - now][at[1 - now]]
            while at[now] + 1 < len(lists[now]) and lists[now][at[now] + 1] <= other:
                at[now] += 1
            gap = other - lists[now][at[now]]
            want += 1 / (1 + gap) if gap <= slop else 0
            at[now] += 1
            if at[now] >= len(lists[now]):
                break
            now = 1 - now
        assert math.isclose(spans.sloppy_turns([a, b], slop), want), (a, b, slop)
        assert math.isclose(spans.sloppy_repeats([a, [p + 1 for p in b]], [0, 1], [], slop), want)


def test_sloppy_of_a_repeated_term():
    freq = lambda a, b, slop: spans.sloppy_repeats([a, b, a], [0, 1, 2], [[0, 2]], slop)
    assert freq([0, 2], [1], 0) == 1.0 and freq([0], [1], 9) == 0.0  # two occurrences are needed
    assert freq([0, 4], [1], 1) == 0.0 and math.isclose(freq([0, 4], [1], 2), 1 / 3)


def test_near_spans():
    of = lambda *p: spans.of_positions(np.array(p, "int64"))
    assert [x.tolist() for x in spans.ordered([of(0, 4), of(1, 6)], 1)] == [[0, 4], [2, 7], [0, 1]]
    assert [x.tolist() for x in spans.ordered([of(0), 2, of(3)], 0)] == [[0], [4], [0]]
    assert spans.freq(spans.unordered([of(0), of(1)], 0)) == 0.5 and spans.freq(spans.ordered([of(0), of(1)], 0)) == 1.0
    assert spans.unordered([of(5), of(1)], 3)[2].tolist() == [4] and not len(spans.unordered([of(5), of(1)], 2)[0])
    assert spans.either([of(3), of(1, 3)])[0].tolist() == [1, 3, 3]
    with pytest.raises(ValueError):
        Q.SpanNear((Q.SpanTerm("f", "a"), Q.SpanTerm("g", "b")), 0, True)
    with pytest.raises(ValueError):
        Q.SpanNear((Q.SpanTerm("f", "a"), Q.SpanGap("f", 1), Q.SpanTerm("f", "b")), 0, False)


def test_schema_rules():
    with pytest.raises(ValueError):
        FieldSpec("f", term_vectors=True)
    with pytest.raises(ValueError):
        numeric("f").merged(keyword("f"))
    assert text("f").merged(text("f", index_options=IndexOptions.DOCS)).index_options == IndexOptions.DOCS
    assert IndexSchema((text("f"),)).with_field(numeric("n"))["n"].doc_values == "numeric"


def marked(value, *words, **options):
    found = H.phrases(H.occurrences(value, {w: k for k, w in enumerate(words)}, {}, 10))
    return H.fragments([value], found, options.pop("size", 20), **options)


def test_highlights():
    assert marked("The quick brown fox", "fox", size=100) == ["The quick brown <b>fox</b>"]
    assert marked("fox and fox", "fox", "and", size=100, pre=("<i>", "<u>"), post=("</i>", "</u>")) == ["<i>fox</i> <u>and</u> <i>fox</i>"]
    assert marked("a <fox> & fox", "fox", size=100, encoder="html") == ["a &lt;fox&gt; &amp; <b>fox</b>"]
    assert marked("nothing here", "fox") == []
    text_ = "fox " + "word " * 30 + "fox " + "word " * 30
    assert len(marked(text_, "fox", builder="windows", number=5)) == 2 and len(marked(text_, "fox")) == 1
    assert marked(text_, "fox", builder="single")[0].count("<b>fox</b>") == 2
    with pytest.raises(ValueError):
        marked("fox", "fox", size=5)
    assert H.merged([[H.Match(0, 3, 1.0, 0, [(0, 3)])], [H.Match(2, 5, 2.0, 1, [(2, 5)])]])[0].parts == [(0, 5)]


def test_merges_are_planned_by_size():
    small = {f"s{k}": 1 << 20 for k in range(30)}
    groups = plan_merges(small)
    assert groups and all(2 <= len(g) <= 10 for g in groups)
    assert plan_merges({"a": 6 << 30, "b": 1 << 20}) == []
    halved = {f"s{k}": 100 << 20 for k in range(12)}
    first = plan_merges(halved, at_once=2, per_tier=1, live={"s7": 0.2, "s3": 0.2})[0]
    assert set(first) == {"s3", "s7"}  # what reclaims most
