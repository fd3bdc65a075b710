"""Field specifications of an index and their rules."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import IntEnum

from pyspark.sql import types as T


class IndexOptions(IntEnum):
    """What is kept of a field's terms; each level holds what the one before does."""

    NONE = 0
    DOCS = 1
    FREQS = 2
    POSITIONS = 3
    OFFSETS = 4


DOC_VALUES = ("none", "numeric", "binary", "sorted", "sorted_numeric", "sorted_set")
POINT_TYPES = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.ShortType, T.ByteType)


@dataclass(frozen=True)
class FieldSpec:
    """How a column of the documents is indexed. Defaults: not stored, tokenized, norms kept, nothing indexed."""

    name: str
    stored: bool = False
    tokenized: bool = True
    term_vectors: bool = False
    omit_norms: bool = False
    index_options: IndexOptions = IndexOptions.NONE
    doc_values: str = "none"
    point_dims: int = 0

    def __post_init__(self) -> None:
        if self.doc_values not in DOC_VALUES:
            raise ValueError(f"unknown doc values type {self.doc_values!r} of field {self.name!r}")
        if not 0 <= self.point_dims <= 8:
            raise ValueError(f"field {self.name!r}: points have 0 to 8 dimensions")
        if self.term_vectors and self.index_options == IndexOptions.NONE:
            raise ValueError(f"field {self.name!r}: term vectors need an indexed field")

    def merged(self, other: FieldSpec) -> FieldSpec:
        """The field after a document with another spec: kinds must agree, detail falls to the lesser."""
        if "none" not in (self.doc_values, other.doc_values) and self.doc_values != other.doc_values:
            raise ValueError(f"cannot change doc values of {self.name!r} from {self.doc_values} to {other.doc_values}")
        if self.point_dims and other.point_dims and self.point_dims != other.point_dims:
            raise ValueError(f"cannot change point dimensions of {self.name!r} from {self.point_dims} to {other.point_dims}")
        levels = [x.index_options for x in (self, other) if x.index_options]
        return replace(
            self, stored=self.stored or other.stored, term_vectors=self.term_vectors or other.term_vectors, omit_norms=self.omit_norms or other.omit_norms,
            index_options=min(levels, default=IndexOptions.NONE), doc_values=self.doc_values if self.doc_values != "none" else other.doc_values, point_dims=self.point_dims or other.point_dims,
        )


@dataclass(frozen=True)
class IndexSchema:
    fields: tuple[FieldSpec, ...]

    def __getitem__(self, name: str) -> FieldSpec:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(f"no field {name!r}")

    def with_field(self, spec: FieldSpec) -> IndexSchema:
        """The schema with a field added, or merged with the one of its name."""
        if any(f.name == spec.name for f in self.fields):
            return IndexSchema(tuple(f.merged(spec) if f.name == spec.name else f for f in self.fields))
        return IndexSchema((*self.fields, spec))

    def check(self, schema: T.StructType) -> None:
        """Raises ValueError where a DataFrame's columns cannot be indexed as specified."""
        for f in self.fields:
            if f.name not in schema.fieldNames():
                raise ValueError(f"no column for field {f.name!r}")
            kind = schema[f.name].dataType
            inner = kind.elementType if isinstance(kind, T.ArrayType) else kind
            if f.index_options and not isinstance(inner, T.StringType | T.BinaryType):
                raise ValueError(f"field {f.name!r}: only strings and binary values are indexed, not {kind.simpleString()}")
            if f.tokenized and f.index_options and isinstance(inner, T.BinaryType):
                raise ValueError(f"field {f.name!r}: binary values are not tokenized")
            if f.point_dims == 1 and not isinstance(inner, POINT_TYPES):
                raise ValueError(f"field {f.name!r}: points are numbers, not {kind.simpleString()}")


def text(name: str, **more) -> FieldSpec:
    return FieldSpec(name, **{"index_options": IndexOptions.OFFSETS} | more)


def keyword(name: str, **more) -> FieldSpec:
    return FieldSpec(name, **{"tokenized": False, "omit_norms": True, "index_options": IndexOptions.DOCS, "doc_values": "sorted"} | more)


def numeric(name: str, **more) -> FieldSpec:
    return FieldSpec(name, **{"doc_values": "numeric", "point_dims": 1} | more)
