"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Per text, numpy computes statistics of the whole text (FEATURES), each brought
near a normal shape by a log or square root. Class means and covariances come
from moment sums over all labelled rows, added up by Spark (one row per class
and moment, whatever the input). Each class covariance is shrunk towards the
pooled one and its diagonal; the Cholesky factors are computed once and cached
in the model. The score is the logistic of the prior log-odds plus the
difference of the Mahalanobis log-densities.

Defined results: null and empty texts have all statistics 0; repeated label
rows of an id count as good only if all of them are; if a class has no
labelled row, the score is the smoothed share of the other; repeated rows are
scored alike; columns of docs pass through, but for one named
quality_statistics, which holds the statistics until score() drops it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, row_sums, span_hash, utf8, words_of
from .linear import logistic

FEATURES = (
    "log_words", "mean_word", "sd_word", "upper_share", "digit_share", "symbol_share", "stop_share", "other_punct_share",
    "non_ascii_share", "distinct_words", "adjacent_repeats", "top_word_share", "log_lines", "mean_line", "symbol_words", "end_stops", "repeat_triples",
)

#: The column that holds the statistics between with_statistics() and score().
STATISTICS = "quality_statistics"

_CLASS = np.zeros((6, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, 48:58] = True
_CLASS[2, [ord(c) for c in "#*$%&|<>{}[]\\^~=_@"]] = True
_CLASS[3, [ord(c) for c in ".,;:"]] = True
_CLASS[4, [ord(c) for c in "!?\"'()-/+"]] = True
_CLASS[5, 128:] = True


def statistics(column: pa.Array) -> np.ndarray:
    """The transformed statistics, one row a text."""
    data, off = utf8(column)
    n = len(column)
    out = np.zeros((n, len(FEATURES)))
    size = (off[1:] - off[:-1]).astype(float)
    some = np.maximum(size, 1)
    starts, ends, row = words_of(data, off)
    words = np.bincount(row, minlength=n).astype(float)
    some_words = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    mean = np.bincount(row, length, n) / some_words
    square = np.bincount(row, length**2, n) / some_words
    out[:, 0] = np.log1p(words)
    out[:, 1] = np.log1p(mean)
    out[:, 2] = np.log1p(np.sqrt(np.maximum(square - mean**2, 0)))
    for k in range(6):
        out[:, 3 + k] = np.sqrt(row_sums(_CLASS[k][data], off) / some)
    if len(starts):
        h = span_hash(data, starts, ends)
        order = np.lexsort((h, row))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
        at = np.flatnonzero(fresh)
        count = np.diff(np.append(at, len(h)))
        who = row[order][at]
        top = np.zeros(n)
        np.maximum.at(top, who, count)
        out[:, 9] = np.bincount(who, minlength=n) / some_words
        same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        out[:, 10] = np.sqrt(np.bincount(row[1:][same], minlength=n) / some_words)
        out[:, 11] = np.sqrt(top / some_words)
        symbol = np.zeros(len(data) + 1, np.int64)
        np.cumsum(_CLASS[2][data], out=symbol[1:])
        out[:, 14] = np.sqrt(np.bincount(row[symbol[ends] > symbol[starts]], minlength=n) / some_words)
        last = data[ends - 1]
        out[:, 15] = np.sqrt(np.bincount(row[(last == 46) | (last == 63) | (last == 33)], minlength=n) / some_words)
        if len(h) > 2:
            inside = row[2:] == row[:-2]
            t = (h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(5) + h[2:] * np.uint64(7))[inside]
            of = row[2:][inside]
            order = np.lexsort((t, of))
            again = (t[order][1:] == t[order][:-1]) & (of[order][1:] == of[order][:-1])
            out[:, 16] = np.sqrt(np.bincount(of[order][1:][again], minlength=n) / some_words)
    lines = row_sums(data == 10, off) + (size > 0)
    out[:, 12] = np.log1p(lines)
    out[:, 13] = np.log1p(size / np.maximum(lines, 1))
    return out


def forward(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """z of factor z = right, for a lower triangular factor, by forward substitution."""
    z = np.empty_like(right)
    for i in range(len(factor)):
        z[i] = (right[i] - factor[i, :i] @ z[:i]) / factor[i, i]
    return z


@dataclass
class QualityModel:
    prior: float  # log-odds
    mean: tuple[np.ndarray, np.ndarray] | None = None
    factor: tuple[np.ndarray, np.ndarray] | None = None  # Cholesky factors of the shrunk covariances
    temperature: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), logistic(np.array([self.prior]))[0])
        density = []
        for mean, factor in zip(self.mean, self.factor):
            z = forward(factor, (x - mean).T)
            density.append(-0.5 * (z**2).sum(0) - np.log(np.diag(factor)).sum())
        return logistic(self.prior + self.temperature * (density[1] - density[0]))


def moments(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """n, sum and sum of squares and products of x for each y of rows (y int, x array<double>); one Spark aggregation."""
    k = len(FEATURES)

    def run(batches):
        n, s, q = np.zeros(2), np.zeros((2, k)), np.zeros((2, k, k))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                mine = x[y == c]
                n[c] += len(mine)
                s[c] += mine.sum(0)
                q[c] += mine.T @ mine
        flat = np.concatenate([np.concatenate([[n[c]], s[c], q[c].ravel()]) for c in (0, 1)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["i", "v"])

    got = dict(rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect())
    out, size = {}, 1 + k + k * k
    for c in (0, 1):
        v = np.array([got.get(c * size + i, 0.0) for i in range(size)])
        out[c] = (v[0], v[1 : 1 + k], v[1 + k :].reshape(k, k))
    return out


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with quality_statistics, an array."""

    def make():
        def work(column):
            x = statistics(column)
            return {STATISTICS: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))}

        return work

    return append_columns(docs, text_col, [_X], make)


_X = T.StructField(STATISTICS, T.ArrayType(T.DoubleType(), True))


def fit(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", own: float = 0.7, diagonal: float = 0.05) -> QualityModel:
    """Fits on all rows (id, quality_statistics) that labels name.

    own: weight of a class's own covariance against the pooled one;
    diagonal: weight of the diagonal in the result.
    """
    y = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min((F.col(label_col) == 1).cast("int")).alias("y"))
    m = moments(rows.select(F.col(id_col).alias("id"), F.col(STATISTICS).alias("x")).join(y, "id").select("y", "x"))
    (n0, s0, q0), (n1, s1, q1) = m[0], m[1]
    prior = float(np.log((n1 + 1) / (n0 + 1)))
    if n0 < 2 or n1 < 2:
        return QualityModel(prior)
    k = len(FEATURES)
    scatter = [q - np.outer(s, s) / n for n, s, q in (m[0], m[1])]
    pooled = (scatter[0] + scatter[1]) / (n0 + n1)
    floor = np.diag(np.maximum(np.diag(pooled), 1e-6)) * 1e-2 + 1e-5 * np.eye(k)
    factors = []
    for (n, _, _), c in zip((m[0], m[1]), scatter):
        trust = own * n / (n + k)  # small classes lean on the pooled covariance
        cov = trust * c / n + (1 - trust) * pooled
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + floor
        factors.append(np.linalg.cholesky(cov))
    return QualityModel(prior, (s0 / n0, s1 / n1), (factors[0], factors[1]))


def score(rows: DataFrame, model: QualityModel) -> DataFrame:
    """rows of with_statistics() with score (0 to 1, higher: better) and predicted, without quality_statistics."""
    kept = [c for c in rows.columns if c.lower() not in (STATISTICS, "score", "predicted")]
    out = T.StructType([f for f in rows.schema.fields if f.name in kept] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    k = len(FEATURES)

    def run(batches):
        for batch in batches:
            x = batch.column(STATISTICS).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    return rows.select(*[F.col(f"`{c}`") for c in kept], STATISTICS).mapInArrow(run, out)
