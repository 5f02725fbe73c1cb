"""Toxicity: a linear classifier of character n-grams, each scaled by its naive Bayes log-count ratio.

Features are which 4- to 6-grams of code points occur in the whole text (A-Z
lower-cased, other ASCII but digits and letters as a space), hashed to 2^18
buckets; no bucket is left out. From a bounded, seeded sample of labelled rows
(at most `rows_per_class` of each class, and `most_features` n-grams in all) come the number of toxic and other
texts with each bucket; the ratio of the smoothed logs scales the feature. An
L2-regularised squared-hinge classifier over all buckets is fitted to the
sample's sparse rows by dual coordinate descent, and a logistic curve turns its
margin into a score.

Scoring covers every row in one pass without a shuffle; a text is read in
segments, so that its length does not matter for memory.

Defined results: null and empty texts have no n-grams and get the score of the
bias alone; a repeated label row of an id counts as toxic if any of them is; of
rows that repeat an id the least text is learnt from; if a class has no
labelled row, the score is that class's smoothed share everywhere; ties of the
sample's hash go to the lesser id; repeated rows are scored alike. A null id is
never learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, append_columns, bounded_sample, checkpointed, pieces, small_batches, utf8, written
from .linear import balanced, l2_svm_sparse, logistic, platt

BITS, ORDERS = 18, (4, 5, 6)
#: Code points of a text that are hashed at once.
SEGMENT = 1 << 18
_BASE, _SPREAD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)

_folded = LOWER.astype(np.uint32)
_folded[[b for b in range(128) if not chr(LOWER[b]).isalnum()]] = 32


def code_points(column: pa.Array) -> Iterator[np.ndarray]:
    """The folded code points of each text."""
    data, off = utf8(column)
    point = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    point = np.where(point < 128, _folded[np.minimum(point, 127)], point)
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])  # continuation bytes start no code point
    edge = before[off]
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield point[a:b]


class Present:
    """The distinct buckets of one text at a time."""

    def __init__(self) -> None:
        self.mark = np.zeros(1 << BITS, bool)

    def __call__(self, point: np.ndarray) -> np.ndarray:
        for start in range(0, max(len(point) - ORDERS[0] + 1, 0), SEGMENT):
            x = point[start : start + SEGMENT + ORDERS[-1] - 1].astype(np.uint64)
            h = x
            for n in range(2, ORDERS[-1] + 1):
                if len(h) < 2:
                    break
                h = h[:-1] * _BASE + x[n - 1 :]
                if n >= ORDERS[0]:
                    self.mark[(((h + np.uint64(n)) * _SPREAD) >> np.uint64(64 - BITS)).view(np.int64)] = True
        found = np.flatnonzero(self.mark)
        self.mark[found] = False
        return found


#: N-grams (buckets) of all rows of the sample, 4 bytes each on the driver.
MOST_FEATURES = 1 << 26


@dataclass
class ToxicModel:
    weight: np.ndarray  # of each bucket
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        if not self.weight.any():
            return np.full(len(column), logistic(np.array([self.bias]))[0])
        present = Present()
        return logistic(np.array([self.bias + self.weight[present(p)].sum() for p in code_points(column)]))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows_per_class: int, seed: int) -> DataFrame:
    """(id, text, y) of at most rows_per_class labelled ids of each class, one row each, checkpointed."""
    y = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("y"))
    ids = bounded_sample(y.where("y = 1"), "id", rows_per_class, seed).unionByName(bounded_sample(y.where("y = 0"), "id", rows_per_class, seed))
    # ids has at most 2 * rows_per_class rows
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    return checkpointed(rows.groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")))


def within(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """The rows (id, y, n) of each class, in order of their seeded hash, while their n are at most half of `most` together; one at least."""
    sizes = rows.select("id", "y", "n").withColumn("k", F.xxhash64(F.lit(seed), "id")).toPandas()  # a row for each of the sample
    if sizes["n"].sum() <= most:
        return rows
    sizes = sizes.sort_values(["y", "k", "id"])
    kept = sizes[(sizes.groupby("y")["n"].cumsum() <= most // 2) | (sizes.groupby("y").cumcount() == 0)]
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame([(x,) for x in kept["id"].tolist()], rows.select("id").schema)), "id")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = 2500, alpha: float = 1.0, ridge: float = 0.1, seed: int = 22, most_features: int = MOST_FEATURES) -> ToxicModel:
    """Fits on at most rows_per_class labelled rows of each class that have at most most_features n-grams in all: the sample's bounds, the same at every input size."""
    small_batches(docs.sparkSession)
    rows = sample(docs, labels, id_col, text_col, label_col, rows_per_class, seed)

    def sparse(batches):
        present = Present()
        for batch in batches:
            for piece in pieces(batch, "text"):
                found = [present(p).astype(np.int32) for p in code_points(piece.column("text"))]
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("y"), pa.array([len(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], names=["id", "y", "n", "x"])

    table = written(rows.mapInArrow(sparse, f"id {rows.schema['id'].dataType.simpleString()}, y int, n long, x binary"))
    got = within(table, most_features, seed).select("id", "y", "x").toArrow()
    by_id = pc.sort_indices(got.column("id")).to_numpy()  # the rows themselves stay where they are
    y = np.where(got.column("y").to_numpy() == 1, 1.0, -1.0)[by_id]
    n1, n0 = int((y > 0).sum()), int((y < 0).sum())
    if not n1 or not n0:
        return ToxicModel(np.zeros(1 << BITS), float(np.log((n1 + 1) / (n0 + 1))))
    rows_of = [np.frombuffer(b.as_buffer(), np.int32) for chunk in got.column("x").chunks for b in chunk]
    x = [rows_of[i] for i in by_id]
    share = []
    for sign, n in ((1, n1), (-1, n0)):
        count = np.zeros(1 << BITS)
        for i in np.flatnonzero(y == sign):
            count[x[i]] += 1
        share.append(np.log((count + alpha) / (n + 2 * alpha)))
    ratio = share[0] - share[1]
    square = ratio**2
    square /= np.mean([square[i].sum() for i in x]) or 1.0  # rows have unit length on average
    # margins for the curve come from the other half of the sample, else they are too sure
    half = np.arange(len(y)) % 2 == 0
    margin = np.zeros(len(y))
    for a, b in ((half, ~half), (~half, half)):
        if len(set(y[a])) < 2:
            continue
        weight, bias = l2_svm_sparse([x[i] for i in np.flatnonzero(a)], square, y[a], balanced(y[a]), ridge)
        margin[b] = [weight[x[i]].sum() + bias for i in np.flatnonzero(b)]
    slope, shift = platt(margin, y)
    weight, bias = l2_svm_sparse(x, square, y, balanced(y), ridge)
    return ToxicModel(slope * weight, slope * bias + shift)


def score(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5)."""

    def make():
        def work(column):
            s = model.score(column)
            return {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

        return work

    return append_columns(docs, text_col, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make)
