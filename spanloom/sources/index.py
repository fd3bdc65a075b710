"""Indexes: documents searched in place, and stored postings.

`TableIndex` evaluates a query on each document's own tokens: one pass for statistics, one for scores, no shuffle.
`StoredIndex` keeps postings sorted by field and term, so that a query reads the row groups of its terms, groups them
by document once, and never tokenizes; it takes additions, deletions and merges. Both hand the query tree the same frame: one row per document, leaf columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions import analysis
from spanloom.functions.similarity import BM25, FieldStats, Similarity, TermStats
from spanloom.plans.query import ConstantScore, Exists, Leaf, MatchAll, PointRange, Query, SpanQuery, Term
from spanloom.plans.spans import rows_on_positions
from spanloom.sources import snapshots
from spanloom.schema import FieldSpec, IndexOptions, IndexSchema, text

#: Deleted ids that are sent to all tasks, of some 40 bytes each; more are joined by a shuffle.
SENT_IDS = 2_000_000


class Frame:
    """A query's context on a DataFrame with leaf columns: p<n> positions or f<n> frequencies, l<field> lengths."""

    def __init__(self, df: DataFrame, schema: T.StructType, leaves: list[Leaf], positional: set[Leaf], similarity: Similarity, field_stats: dict[str, FieldStats], term_stats: dict[Leaf, TermStats], specs: dict[str, FieldSpec]) -> None:
        self.df, self.scoring = df, bool(field_stats)
        self._schema, self._number, self._positional = schema, {x: n for n, x in enumerate(leaves)}, positional
        self._similarity, self._fields, self._terms, self._specs = similarity, field_stats, term_stats, specs

    def bind(self, value: Column) -> Column:
        """A column that holds the value, so that what refers to it several times computes it once."""
        name = f"__b{sum(c.startswith('__b') for c in self.df.columns)}"
        self.df = self.df.withColumn(name, value)
        return F.col(name)

    def tf(self, leaf: Leaf) -> Column:
        n = self._number[leaf]
        return F.size(f"__p{n}") if leaf in self._positional else F.col(f"__f{n}")

    def positions(self, leaf: Leaf) -> Column:
        return F.col(f"__p{self._number[leaf]}")

    def relevance(self, freq: Column, leaves: Sequence[Leaf], boost: float) -> Column:
        if not self.scoring or any(self._terms[x].df == 0 for x in leaves):
            return F.lit(0.0)  # nobody has such a term, so nothing is scored by it
        name = leaves[0][0]
        length = None if self._specs[name].omit_norms else F.col(f"__l_{name}")
        return self._similarity.score(freq, length, self._fields[name], [self._terms[x] for x in leaves], boost)

    def column(self, name: str) -> Column:
        return F.col(name)

    def kind(self, name: str) -> str:
        return self._schema[name].dataType.simpleString()


def once(df: DataFrame, **values: Column) -> DataFrame:
    """df with further columns, each computed once a row: conditions are not pushed below a generator, which would
    compute what they refer to a second time."""
    return df.select("*", F.inline(F.array(F.struct(*[v.alias(k) for k, v in values.items()])))) if values else df


def tokens(spec: FieldSpec, kind: T.DataType) -> Column:
    col = F.col(spec.name)
    if not spec.tokenized:
        return F.coalesce(F.filter(col, lambda v: v.isNotNull()), F.array().cast(kind)) if isinstance(kind, T.ArrayType) else analysis.whole(col)
    return analysis.whitespace_values(col) if isinstance(kind, T.ArrayType) else analysis.whitespace(col)


class TableIndex:
    """Documents of a DataFrame, searched as they are. Indexed fields default to all text columns named."""

    def __init__(self, docs: DataFrame, id_col: str, fields: Sequence[FieldSpec | str]) -> None:
        self.docs, self.id_col = docs, id_col
        self.schema = IndexSchema(tuple(text(f) if isinstance(f, str) else f for f in fields))
        self.schema.check(docs.schema)
        self.specs = {f.name: f for f in self.schema.fields}
        self._known_fields: dict[str, FieldStats] = {}
        self._known_terms: dict[Leaf, TermStats] = {}

    def _tokens(self, df: DataFrame, names: Sequence[str]) -> DataFrame:
        return once(df, **{f"__t_{n}": tokens(self.specs[n], self.docs.schema[n].dataType) for n in names})

    def _leaf_frame(self, leaves: list[Leaf], positional: set[Leaf], docs: DataFrame | None = None) -> DataFrame:
        for name, _ in positional:
            if self.specs[name].index_options < IndexOptions.POSITIONS:
                raise ValueError(f"field {name!r} has no positions")
        names = list(dict.fromkeys(f for f, _ in leaves))
        df, found_in = self._tokens(self.docs if docs is None else docs, names), {}
        for n in names:
            own = [t for f, t in leaves if f == n]
            if any(f == n for f, _ in positional):
                places = F.transform(f"__t_{n}", lambda t, i: F.struct(t.alias("t"), i.alias("i")))
                hits = F.filter(places, lambda x: x["t"].isin(own))  # noqa: B023
            else:
                hits = F.filter(f"__t_{n}", lambda t: t.isin(own))  # noqa: B023
            found_in |= {f"__h_{n}": hits, f"__l_{n}": F.size(f"__t_{n}")}
        df, made = once(df, **found_in).drop(*[f"__t_{n}" for n in names]), {}
        for k, (f, t) in enumerate(leaves):
            if any(f == g for g, _ in positional):
                found = F.transform(F.filter(f"__h_{f}", lambda x: x["t"] == t), lambda x: x["i"])  # noqa: B023
            else:
                found = F.filter(f"__h_{f}", lambda x: x == t)  # noqa: B023
            size = F.size(found)
            made |= {f"__p{k}": F.when(size > 0, found)} if (f, t) in positional else {f"__f{k}": F.when(size > 0, size)}
        return (df.withColumns(made) if made else df).drop(*[f"__h_{n}" for n in names])

    def statistics(self, leaves: Sequence[Leaf]) -> tuple[dict[str, FieldStats], dict[Leaf, TermStats]]:
        """Of the leaves' fields and of the leaves, over all documents: one row comes to the driver. What is known of a
        leaf is not asked again, as documents do not change."""
        new = [x for x in dict.fromkeys(leaves) if x not in self._known_terms]
        fields, terms = self._counted(new)
        self._known_fields |= fields
        self._known_terms |= terms
        return {f: self._known_fields[f] for f, _ in leaves}, {x: self._known_terms[x] for x in leaves}

    def _counted(self, leaves: list[Leaf]) -> tuple[dict[str, FieldStats], dict[Leaf, TermStats]]:
        names = list(dict.fromkeys(f for f, _ in leaves))
        if not leaves:
            return {}, {}
        df = self._leaf_frame(leaves, set())
        aggs = [F.count("*").alias("n")]
        for k, n in enumerate(names):
            aggs += [F.count(F.when(F.col(f"__l_{n}") > 0, 1)).alias(f"d{k}"), F.coalesce(F.sum(f"__l_{n}"), F.lit(0)).alias(f"s{k}")]
        for k in range(len(leaves)):
            aggs += [F.count(f"__f{k}").alias(f"df{k}"), F.coalesce(F.sum(f"__f{k}"), F.lit(0)).alias(f"tf{k}")]
        row = df.agg(*aggs).first()
        return {n: FieldStats(row["n"], row[f"d{k}"], row[f"s{k}"]) for k, n in enumerate(names)}, {x: TermStats(row[f"df{k}"], row[f"tf{k}"]) for k, x in enumerate(leaves)}

    def frame(self, query: Query, similarity: Similarity, scoring: bool = True, docs: DataFrame | None = None) -> Frame:
        """The query's context on the documents, or on some of them; statistics are those of all."""
        leaves, positional = query.leaves(), set(query.positional_leaves())
        fields, terms = self.statistics(leaves) if scoring else ({}, {})
        return Frame(self._leaf_frame(leaves, positional, docs), self.docs.schema, leaves, positional, similarity, fields, terms, self.specs)

    def term_counts(self, names: Sequence[str] | None = None) -> DataFrame:
        """field, term, df, ttf: summed by task before they are shuffled, a row per document and term."""
        return self.postings(names).groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))

    def postings(self, names: Sequence[str] | None = None) -> DataFrame:
        """field, term, doc_id, tf, positions, len: the inverted index of the named fields, made row by row."""
        names = list(names or [f.name for f in self.schema.fields if f.index_options])
        parts = []
        for n in names:
            kind = self.docs.schema[n].dataType
            if self.specs[n].tokenized and isinstance(kind, T.StringType):
                df, own = self.docs, analysis.inverted_text(F.col(n))
            else:
                whole = not self.specs[n].tokenized and not isinstance(kind, T.ArrayType)
                one = lambda t: F.struct(t.alias("term"), F.lit(1).alias("tf"), F.array(F.lit(0)).alias("positions"), F.lit(1).alias("len"))
                df, own = self._tokens(self.docs, [n]), F.transform(f"__t_{n}", one) if whole else analysis.inverted(f"__t_{n}")
            parts.append(df.select(F.col(self.id_col).alias("doc_id"), F.explode(own).alias("x")).select(F.lit(n).alias("field"), "x.term", "doc_id", "x.tf", "x.positions", "x.len"))
        return reduce(DataFrame.unionByName, parts)

    def lengths(self, name: str) -> DataFrame:
        """doc_id, len of the documents with the field."""
        return self._tokens(self.docs, [name]).select(F.col(self.id_col).alias("doc_id"), F.size(f"__t_{name}").alias("len")).where("len > 0")


class StoredIndex:
    """Segments of documents and postings as Parquet under one path, and the ids deleted from each.

    A segment has docs, postings (by field, sorted by term), lengths and terms. A version names the segments it consists
    of, and for each the folders of ids that are deleted from it: an addition writes a segment, a deletion writes ids,
    neither touches what is there, and merging makes one segment of the live rows of all, from their postings. Versions
    are published by a file each, so readers see all of a change or nothing. Ids are unique among live documents.
    """

    def __init__(self, spark: SparkSession, path: str, id_col: str, schema: IndexSchema, version: int | None = None) -> None:
        self.spark, self.path, self.id_col, self.schema = spark, path, id_col, schema
        self.specs = {f.name: f for f in schema.fields}
        self._counted: dict[tuple[str, ...], bool] = {}
        self.version = snapshots.current(spark, path) if version is None else version
        rows = spark.read.schema("segment string, deletes array<string>").parquet(f"{path}/version-{self.version}").collect()  # a row per segment
        self.segments: dict[str, list[str]] = {r["segment"]: list(r["deletes"]) for r in sorted(rows, key=lambda r: r["segment"])}

    @classmethod
    def write(cls, source: TableIndex, path: str, partitions: int | None = None) -> StoredIndex:
        """A new index at the path, of the source's documents."""
        spark = source.docs.sparkSession
        return cls._publish(spark, path, source.id_col, source.schema, {cls._segment(source, path, partitions): []})

    @classmethod
    def _publish(cls, spark: SparkSession, path: str, id_col: str, schema: IndexSchema, segments: dict[str, list[str]]) -> StoredIndex:
        version = snapshots.current(spark, path) + 1 if snapshots.exists(spark, path) else 1
        spark.createDataFrame(list(segments.items()), "segment string, deletes array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/version-{version}")
        snapshots.publish(spark, path, version)
        return cls(spark, path, id_col, schema, version)

    @staticmethod
    def _segment(source: TableIndex, path: str, partitions: int | None = None) -> str:
        """Writes documents and their postings: texts are inverted once to find ranges and once to fill them, which takes
        less than to keep postings in between; one shuffle."""
        name = f"segment-{uuid.uuid4().hex[:12]}"
        spark = source.docs.sparkSession
        source.docs.write.parquet(f"{path}/{name}/docs")
        kept = TableIndex(spark.read.schema(source.docs.schema).parquet(f"{path}/{name}/docs"), source.id_col, source.schema.fields)
        fields = [f.name for f in source.schema.fields if f.index_options]
        lengths = [kept.lengths(n).select(F.lit(n).alias("field"), "doc_id", "len") for n in fields]
        reduce(DataFrame.unionByName, lengths).write.parquet(f"{path}/{name}/lengths")
        StoredIndex._write_postings({n: kept.postings([n]) for n in fields}, f"{path}/{name}", partitions)
        return name

    @staticmethod
    def _write_postings(postings: dict[str, DataFrame], path: str, partitions: int | None) -> None:
        """Ranges of a field go by (term, id), so a common term spreads; sorting begins with the term, of which the first
        bytes are compared as a number. The dictionary is counted from what was written."""
        spark = next(iter(postings.values())).sparkSession
        n = [] if partitions is None else [partitions]
        for name, own in postings.items():
            folder = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("field", name)
            own.drop("field").repartitionByRange(*n, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.parquet(f"{path}/postings/{folder}")
        terms = spark.read.parquet(f"{path}/postings").groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))
        terms.repartitionByRange(*n, "field", "term").sortWithinPartitions("field", "term").write.parquet(f"{path}/terms")

    def append(self, docs: DataFrame, partitions: int | None = None) -> StoredIndex:
        """The index with more documents, in a segment of their own."""
        name = self._segment(TableIndex(docs.select(*self.docs.columns), self.id_col, self.schema.fields), self.path, partitions)
        return self._publish(self.spark, self.path, self.id_col, self.schema, self.segments | {name: []})

    def delete(self, *queries: Query) -> StoredIndex:
        """The index without the documents that match: their ids are written, no document is."""
        hits = [Searcher(self).hits(q, scoring=False).select("doc_id") for q in queries]
        name = f"deletes-{uuid.uuid4().hex[:12]}"
        reduce(DataFrame.unionByName, hits).distinct().write.parquet(f"{self.path}/{name}")
        return self._publish(self.spark, self.path, self.id_col, self.schema, {s: [*d, name] for s, d in self.segments.items()})

    def update(self, query: Query, docs: DataFrame) -> StoredIndex:
        """The index without the documents that match, and with new ones."""
        return self.delete(query).append(docs)

    def merge(self, partitions: int | None = None, only: Sequence[str] | None = None) -> StoredIndex:
        """The index with one segment in place of all, or of the named ones, of their live documents. Postings are merged
        as they are; no text is read again."""
        some = {s: d for s, d in self.segments.items() if only is None or s in only}
        part, name = StoredIndex._of(self, some), f"segment-{uuid.uuid4().hex[:12]}"
        part.docs.write.parquet(f"{self.path}/{name}/docs")
        part._live("lengths").write.parquet(f"{self.path}/{name}/lengths")
        self._write_postings({f.name: part.postings([f.name]) for f in self.schema.fields if f.index_options}, f"{self.path}/{name}", partitions)
        rest = {s: d for s, d in self.segments.items() if s not in some}
        return self._publish(self.spark, self.path, self.id_col, self.schema, rest | {name: []})

    @classmethod
    def _of(cls, index: StoredIndex, segments: dict[str, list[str]]) -> StoredIndex:
        """An index of some segments of another, for reading."""
        part = cls(index.spark, index.path, index.id_col, index.schema, index.version)
        part.segments = segments
        return part

    def sizes(self) -> dict[str, int]:
        """Bytes of each segment."""
        return {s: snapshots.size(self.spark, f"{self.path}/{s}") for s in self.segments}

    def live_shares(self) -> dict[str, float]:
        """The share of each segment's documents that are not deleted."""
        out = {}
        for s, deletes in self.segments.items():
            total = self.spark.read.parquet(f"{self.path}/{s}/docs").count()
            out[s] = StoredIndex._of(self, {s: deletes}).docs.count() / max(1, total) if deletes else 1.0
        return out

    def _few(self, deletes: tuple[str, ...]) -> bool:
        """Whether deleted ids are sent to all postings, so that those are not shuffled to meet them; asked once."""
        if deletes not in self._counted:
            self._counted[deletes] = self.spark.read.parquet(*[f"{self.path}/{d}" for d in deletes]).count() <= SENT_IDS
        return self._counted[deletes]

    def _live(self, part: str, id_col: str = "doc_id") -> DataFrame:
        """A part of all segments, without rows of deleted documents."""
        groups: dict[tuple[str, ...], list[str]] = {}
        for segment, deletes in self.segments.items():
            groups.setdefault(tuple(deletes), []).append(f"{self.path}/{segment}/{part}")
        parts = []
        for deletes, paths in groups.items():
            df = self.spark.read.parquet(*paths) if part != "postings" else reduce(DataFrame.unionByName, [self.spark.read.parquet(p) for p in paths])
            if deletes:
                gone = self.spark.read.parquet(*[f"{self.path}/{d}" for d in deletes]).select(F.col("doc_id").alias(id_col)).distinct()
                df = df.join(F.broadcast(gone) if self._few(deletes) else gone, id_col, "left_anti")
            parts.append(df)
        return reduce(DataFrame.unionByName, parts)

    @property
    def has_deletes(self) -> bool:
        return any(self.segments.values())

    @cached_property
    def docs(self) -> DataFrame:
        return self._live("docs", self.id_col)

    def postings(self, names: Sequence[str] | None = None) -> DataFrame:
        df = self._live("postings").select("field", "term", "doc_id", "tf", "positions", "len")
        return df.where(F.col("field").isin(list(names))) if names else df

    def lengths(self, name: str) -> DataFrame:
        return self._live("lengths").where(F.col("field") == name).select("doc_id", "len")

    def term_counts(self, names: Sequence[str] | None = None) -> DataFrame:
        """field, term, df, ttf: from the segments' dictionaries, or from postings where documents are deleted."""
        if self.has_deletes:
            return self.postings(names).groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))
        all_ = self.spark.read.parquet(*[f"{self.path}/{s}/terms" for s in self.segments])
        out = all_ if len(self.segments) == 1 else all_.groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("ttf").alias("ttf"))
        return out.where(F.col("field").isin(list(names))) if names else out

    def statistics(self, leaves: Sequence[Leaf]) -> tuple[dict[str, FieldStats], dict[Leaf, TermStats]]:
        """Read from lengths and dictionaries of the leaves' fields and terms alone."""
        if not leaves:
            return {}, {}
        names = list(dict.fromkeys(f for f, _ in leaves))
        sums = self._live("lengths").where(F.col("field").isin(names)).groupBy("field").agg(F.count("*").alias("n"), F.sum("len").alias("total")).collect()
        found = {r["field"]: (r["n"], r["total"]) for r in sums}
        most = self.docs.count()
        if self.has_deletes:
            rows = self.postings().where(_any_of(leaves)).groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))
        else:
            rows = self.term_counts().where(_any_of(leaves))
        terms = {(r["field"], r["term"]): TermStats(r["df"], r["ttf"]) for r in rows.collect()}
        return {f: FieldStats(most, *found.get(f, (0, 0))) for f in names}, {x: terms.get(x, TermStats(0, 0)) for x in leaves}

    def frame(self, query: Query, similarity: Similarity, scoring: bool = True, docs: DataFrame | None = None) -> Frame:
        leaves, positional = query.leaves(), set(query.positional_leaves())
        fields, terms = self.statistics(leaves) if scoring else ({}, {})
        df = self.docs if docs is None else docs
        if leaves:
            aggs = [F.max(F.when((F.col("field") == f) & (F.col("term") == t), F.col("positions" if (f, t) in positional else "tf"))).alias(f"__{'p' if (f, t) in positional else 'f'}{k}") for k, (f, t) in enumerate(leaves)]
            aggs += [F.max(F.when(F.col("field") == n, F.col("len"))).alias(f"__l_{n}") for n in dict.fromkeys(f for f, _ in leaves)]
            # Only the leaves' terms are read, and one row a document and leaf is shuffled.
            pivot = self.postings().where(_any_of(leaves)).groupBy(F.col("doc_id").alias(self.id_col)).agg(*aggs)
            # Documents are read for the columns that are asked of them; without, the join needs ids alone.
            df = df.join(pivot, self.id_col, "inner" if query.only_with_terms() else "left")
        return Frame(df, self.docs.schema, leaves, positional, similarity, fields, terms, self.specs)


def _any_of(leaves: Sequence[Leaf]) -> Column:
    """Rows of the leaves; terms and fields are pushed to the scan as lists of literals, then paired."""
    by_field: dict[str, list[str]] = {}
    for f, t in leaves:
        by_field.setdefault(f, []).append(t)
    pairs = reduce(Column.__or__, [(F.col("field") == f) & F.col("term").isin(ts) for f, ts in by_field.items()])
    return F.col("term").isin([t for _, t in leaves]) & F.col("field").isin(list(by_field)) & pairs


class Searcher:
    """Runs query trees on an index."""

    def __init__(self, index: TableIndex | StoredIndex, similarity: Similarity | None = None) -> None:
        self.index, self.similarity = index, similarity or BM25()

    def narrowed(self, query: Query, within: DataFrame | None = None) -> DataFrame:
        """Documents that may match: bare conditions on columns that every match meets go to the scan, before texts are
        looked at. within: (doc_id) of the only ones asked for; few, and sent to the documents."""
        index, docs = self.index, self.index.docs
        plain = Frame(docs, docs.schema, [], set(), self.similarity, {}, {}, index.specs)
        for node in query.needed():
            if isinstance(node, (PointRange, Exists)):
                docs = docs.where(node.condition(plain))
            elif isinstance(node, Term) and node.field in docs.columns and not index.specs[node.field].tokenized and plain.kind(node.field) == "string":
                docs = docs.where(F.col(node.field) == node.term)
        return docs if within is None else docs.join(F.broadcast(within.select(F.col("doc_id").alias(index.id_col))), index.id_col, "left_semi")

    def hits(self, query: Query, *columns: str, scoring: bool = True, having: Column | None = None, within: DataFrame | None = None) -> DataFrame:
        """doc_id, score of every match, and the named columns; `having` is a condition on the index's columns, `within`
        a table of few ids to look among."""
        frame = self.index.frame(query, self.similarity, scoring, self.narrowed(query, within))
        match, score = query.compile(frame)
        df = frame.df.withColumns({"__match": match, "__score": score}).where("__match")
        out = df if having is None else df.where(having)
        return out.select(F.col(self.index.id_col).alias("doc_id"), F.col("__score").alias("score"), *columns)

    def spans(self, query: SpanQuery) -> DataFrame:
        """doc_id, start, end, width: the spans of a span query, in order within a document."""
        frame, leaves = self.index.frame(query, self.similarity, scoring=False), query.leaves()
        found = rows_on_positions([frame.positions(x) for x in leaves], lambda lists: query.spans(dict(zip(leaves, lists))))
        return frame.df.select(F.col(self.index.id_col).alias("doc_id"), F.inline(found))

    def top(self, query: Query, k: int, *columns: str) -> DataFrame:
        """rank, doc_id, score of the k best: by score, then id."""
        return ranked(self.hits(query, *columns), k)

    def count(self, query: Query) -> int:
        """Number of matches; from the dictionary alone where that has it."""
        while isinstance(query, ConstantScore):
            query = query.query
        if isinstance(query, MatchAll):
            return self.index.docs.count()
        if isinstance(query, Term) and isinstance(self.index, StoredIndex):
            return self.index.statistics([(query.field, query.term)])[1][query.field, query.term].df
        return self.hits(query, scoring=False).count()


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits with their rank; sorted in tasks and merged, so only k rows a task are moved."""
    best = hits.orderBy(F.col("score").desc(), "doc_id").limit(k)
    rank = F.row_number().over(Window.orderBy(F.col("score").desc(), "doc_id"))
    return best.select(rank.alias("rank"), *hits.columns)
