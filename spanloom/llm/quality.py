"""Quality scores from pairwise preferences (Bradley-Terry).

A text becomes a vector of rates: byte classes, pairs of adjacent classes, and a few figures on words and lines. From
labelled rows, pairs of a good and a bad document are drawn; logistic loss on the difference of their vectors gives
weights, and so a score for every document. The decision threshold is the quantile of the learning rows' scores that
parts their labels best, and a document's score is the logistic of its distance from it.

At most 2 x SAMPLE labelled rows are brought to the driver, about, as vectors of some 220 numbers; pairs are drawn there.

Cases: null and empty texts have the zero vector's rates and get a score like any other. If the learning rows have
one label only, or there are none, every score is 0.5. Null labels and null ids are not learned from; a null id is
never held out. Repeated rows score alike. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import settle

SAMPLE, PAIRS, RIDGE, ROUNDS = 12_000, 24_000, 1e-2, 8
SEGMENT = 1 << 20


def _classes() -> np.ndarray:
    kinds = np.full(256, 12, "uint8")
    for k, chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",", b"!?", b"|", b"%*&$#@^~", b"\"'()[]{}:;<>=+`")):
        kinds[list(chars)] = k
    kinds[128:] = 11
    kinds[list(b"-_/\\")] = 13
    return kinds


CLASSES, N = _classes(), 14
WIDTH = N + N * N + 7


def features(text: str | None) -> np.ndarray:
    """Rates of a text; all of it is read, in segments."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    pairs, last = np.zeros(N * N), None
    single = np.zeros(N)
    for at in range(0, len(raw), SEGMENT):
        kinds = CLASSES[np.frombuffer(raw, "uint8", min(SEGMENT, len(raw) - at), at)].astype("int64")
        single += np.bincount(kinds, minlength=N)
        joined = kinds if last is None else np.r_[last, kinds]
        pairs += np.bincount(joined[:-1] * N + joined[1:], minlength=N * N)
        last = kinds[-1]
    words, lines = text.split(), [x for x in text.split("\n") if x]
    n, w = max(1, len(raw)), max(1, len(words))
    rest = [math.log1p(len(raw)) / 10, math.log1p(len(words)) / 10, len(raw) / w / 10, len(set(words)) / w, len(set(lines)) / max(1, len(lines)), math.log1p(len(lines)) / 10, min(5.0, len(words) / max(1, len(lines)) / 20)]
    return np.r_[np.sqrt(single / n), np.sqrt(pairs / n), rest]


def learns(id_: Column) -> Column:
    """Whether labels of this id may be learned."""
    return F.coalesce(F.crc32(id_.cast("string")) % 3 != 1, F.lit(False))


def _vectors(df: DataFrame, *more: str) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t.as_py()).astype("float32").tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in more), pa.array(made, pa.binary())], [*more, "vector"])

    kept = df.select("text", *more)
    return kept.mapInArrow(make, ", ".join([*(f"{c} {kept.schema[c].dataType.simpleString()}" for c in more), "vector binary"]))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, seed: int = 5) -> tuple[np.ndarray, float]:
    """Weights and threshold from vectors and labels."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    weights = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return weights, 0.0
    draw = np.random.default_rng(seed)
    difference = x[draw.choice(good, pairs)] - x[draw.choice(bad, pairs)]
    for _ in range(ROUNDS):  # Newton's method on the mean logistic loss with a ridge
        p = 1 / (1 + np.exp(np.clip(difference @ weights, -30, 30)))
        slope = -(difference.T @ p) / pairs + RIDGE * weights
        bend = (difference * (p * (1 - p))[:, None]).T @ difference / pairs + RIDGE * np.eye(len(weights))
        weights = weights - np.linalg.solve(bend, slope)
    scores = x @ weights
    order = np.argsort(scores, kind="stable")
    ranked = y[order]
    # Calling the lowest m rows bad is right for the bad among them and the good above; both kinds count alike.
    right = np.r_[0, np.cumsum(ranked == 0)] / len(bad) + (len(good) - np.r_[0, np.cumsum(ranked == 1)]) / len(good)
    m = int(np.median(np.flatnonzero(right >= right.max() - 1e-12)))
    edge = np.r_[scores[order[0]] - 1, scores[order], scores[order[-1]] + 1]
    return weights, float((edge[m] + edge[m + 1]) / 2)


def learn(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and threshold; learned from a hash sample of the labelled rows, the same in each run."""
    usable = labels.where(learns(F.col(id_col)) & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    n = usable.count()
    share = min(1.0, sample / max(1, n))
    some = settle(usable.where(F.shiftrightunsigned(F.xxhash64("id"), 1) <= F.lit(share * float(1 << 63))).groupBy("id").agg(F.min("label").alias("label")))
    # The sample's size is bounded, so it is sent to the documents rather than they to it.
    texts = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")
    # Ids may repeat: where the sample's ids have more rows than it should, a hash sample of these rows is taken.
    share = min(1.0, 2 * sample / max(1, documents.select(F.col(id_col).alias("id")).join(F.broadcast(some), "id").count()))
    texts = texts.where(F.shiftrightunsigned(F.xxhash64("id", "label", "text"), 1) <= F.lit(share * float(1 << 63))).dropDuplicates(["id", "label", "text"]) if share < 1 else texts
    rows = sorted(_vectors(texts, "id", "label").collect(), key=lambda r: (r["id"], r["label"], bytes(r["vector"])))
    x = np.array([np.frombuffer(bytes(r["vector"]), "float32") for r in rows], "float64").reshape(len(rows), WIDTH)
    return fit(x, np.array([r["label"] for r in rows], "int64"))


def score_quality(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    weights, edge = learn(documents, labels, id_col, text_col, label_col, sample)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [float(features(t.as_py()).astype("float32").astype("float64") @ weights) - edge for t in batch.column("text")]
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["id", "held_out", "score", "predicted"])

    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
    rows = documents.select(F.col(id_col).cast("long").alias("id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
