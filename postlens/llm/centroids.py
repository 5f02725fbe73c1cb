"""Centroid clustering of integer vectors: float32 screening with rounding-error intervals, exact integers where they overlap.

Vectors become integers, floor(scale * x) for each component, so that every
distance, sum and mean below has one right value whatever the order of the work.
A round assigns each vector to its nearest centroid and moves each centroid to
the floor of its vectors' mean; a round is one narrow pass over the table, in
which a task sends one sum for each centroid and dimension, however many vectors
it read, and the driver gets those of all tasks added up.

Assignment. A float32 matrix product gives all inner products of a batch with
the centroids. For n components, whatever the order of the sums and with fused
steps or none, it is off by at most g * |x| * |c|, g = (n+2)u / (1 - (n+2)u),
u = 2^-24: n rounded products and sums, two rounded inputs, and the
Cauchy-Schwarz bound of the sum of |x_i c_i|. So each squared distance (less the
vector's own square, which all its distances share) lies in an interval around
its float value. Centroids whose interval starts above the least end of all
intervals cannot be nearest. Where one is left, it is the nearest; where
several are, those alone are computed with 64-bit integers, and the least
distance wins, of equal ones the lowest number.

Defined results: a vector that is null, has not exactly `dims` components, or has
one that is null, infinite or not a number is left out. Integers end at
plus and minus LIMIT, which keeps squared distances within 64 bits; a larger component
counts as that. Sums of distances beyond 64 bits are told as MOST. A null id seeds no centroid unless others are too few; among
equal hashes the lesser vector seeds. With fewer vectors than centroids each is
one centroid; an empty table gives an empty result. Repeated rows count each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, written

#: Largest integer of a component: squared distances of 64 components stay under 2^62.
LIMIT = 1 << 27
#: Largest sum of distances that is told.
MOST = (1 << 63) - 1
#: (vector, centroid) pairs that are recomputed with integers at once.
PAIRS = 1 << 15
_AFTER_HEX = "g"
_UNIT = 2.0**-24


def integers(column: pa.Array, dims: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the rows kept, their vectors as int64)."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    off = column.offsets.to_numpy()
    rows = np.flatnonzero(valid & (off[1:] - off[:-1] == dims))
    if not len(rows):
        return rows, np.zeros((0, dims), np.int64)
    values = column.values.to_numpy(zero_copy_only=False)  # a null component becomes not a number
    x = values[off[rows][:, None] + np.arange(dims)].astype(np.float64)
    finite = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        return rows[finite], np.clip(np.floor(scale * x[finite]), -LIMIT, LIMIT).astype(np.int64)


def shortlist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each vector (row) and centroid (column) whether it may be the nearest; see the module's text for the bound."""
    dots = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    squares, own = (c * c).sum(axis=1).astype(np.float64), (x * x).sum(axis=1).astype(np.float64)
    n = x.shape[1] + 2
    off = n * _UNIT / (1 - n * _UNIT) * np.sqrt(own)[:, None] * np.sqrt(squares)
    # the float64 steps of this function are off by far less than 2^-50 of what they add up
    reach = 2 * off * (1 + 2.0**-40) + (squares + 2 * np.abs(dots)) * 2.0**-50
    middle = squares - 2 * dots
    return middle - reach <= (middle + reach).min(axis=1)[:, None]


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, whether several had to be recomputed) of each vector."""
    may = shortlist(x, c)
    number, several = may.argmax(axis=1), may.sum(axis=1) > 1
    todo = np.flatnonzero(several)
    step = max(1, PAIRS // len(c))
    for k in range(0, len(todo), step):
        rows = todo[k : k + step]
        r, j = np.nonzero(may[rows])
        d = ((x[rows[r]] - c[j]) ** 2).sum(axis=1)
        order = np.lexsort((j, d, r))
        number[rows] = j[order[np.searchsorted(r[order], np.arange(len(rows)))]]
    return number, several


def distances(x: np.ndarray, c: np.ndarray, number: np.ndarray) -> np.ndarray:
    return ((x - c[number]) ** 2).sum(axis=1)


def _read(embeddings: DataFrame, vec_col: str, *others) -> DataFrame:
    """(v, others): the vectors as an array of float or double."""
    small_batches(embeddings.sparkSession)
    kind = embeddings.select(F.col(f"`{vec_col}`")).schema[0].dataType
    plain = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    v = F.col(f"`{vec_col}`")
    return embeddings.select((v if plain else v.cast("array<double>")).alias("v"), *others)


def seeds(embeddings: DataFrame, id_col: str, vec_col: str, k: int, dims: int, scale: float, seed: int) -> np.ndarray:
    """The k vectors of least SHA-256 of "seed:id", in that order. A task sends its k least at most."""
    digest = F.coalesce(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_col}`").cast("string")).cast("binary"), 256), F.lit(_AFTER_HEX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: list[tuple[str, list[int]]] = []
        for b in batches:
            rows, x = integers(b.column("v"), dims, scale)
            names = b.column("h").take(pa.array(rows)).to_numpy(zero_copy_only=False)
            some = np.argsort(names, kind="stable")
            some = some[names[some] <= names[some[k - 1]]] if len(some) > k else some  # all that share the last hash, so that vectors decide ties
            least = sorted(least + [(names[i], x[i].tolist()) for i in some])[:k]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in least], pa.string()), pa.array([x for _, x in least], pa.list_(pa.int64()))], names=["h", "x"])

    got = _read(embeddings, vec_col, digest.alias("h")).mapInArrow(run, "h string, x array<long>").orderBy("h", "x").limit(k).collect()
    return np.array([r.x for r in got], np.int64).reshape(-1, dims)


def moved(embeddings: DataFrame, vec_col: str, c: np.ndarray, scale: float) -> np.ndarray:
    """The centroids after one round: exact floors of means; one without vectors stays."""
    k, dims = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for b in batches:
            _, x = integers(b.column("v"), dims, scale)
            if len(x):
                number, _ = nearest(x, c)
                order = np.argsort(number, kind="stable")
                there, first = np.unique(number[order], return_index=True)
                total[there] += np.add.reduceat(x[order], first)
                count += np.bincount(number, minlength=k)
        there = np.flatnonzero(count)
        cells = [np.repeat(there, dims), np.tile(np.arange(dims), len(there)), total[there].ravel(), np.repeat(count[there], dims)]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in cells], names=["cluster", "dim", "total", "n"])

    sums = _read(embeddings, vec_col).mapInArrow(run, "cluster long, dim long, total long, n long").groupBy("cluster", "dim")
    out = c.copy()
    for r in sums.agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"), F.sum("n").alias("n")).collect():  # k * dims rows at most
        out[r.cluster, r.dim] = int(r.total) // r.n
    return out


def fit(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64, seed: int = 1) -> np.ndarray:
    """The centroids (k, dims) after the rounds."""
    c = seeds(embeddings, id_col, vec_col, k, dims, scale, seed)
    for _ in range(rounds if len(c) else 0):
        c = moved(embeddings, vec_col, c, scale)
    return c


def assign(embeddings: DataFrame, c: np.ndarray, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64) -> DataFrame:
    """(id, cluster int, distance long) of each vector that is kept: its nearest centroid and the squared distance. One narrow pass."""
    dims = c.shape[1]
    out = T.StructType([T.StructField(id_col, embeddings.select(F.col(f"`{id_col}`")).schema[0].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = integers(b.column("v"), dims, scale)
            if len(rows) and len(c):
                number, _ = nearest(x, c)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), pa.array(number, pa.int32()), pa.array(distances(x, c, number))], names=[id_col, "cluster", "distance"])

    return _read(embeddings, vec_col, F.col(f"`{id_col}`").alias("id")).mapInArrow(run, out)


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(embeddings: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: float = 64, seed: int = 1) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each vector that is kept."""
    c = fit(embeddings, id_col, vec_col, k, rounds, dims, scale, seed)
    rows = written(assign(embeddings, c, id_col, vec_col, scale))
    inertia = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # k rows at most
    found = [(j, min(inertia[j], MOST), min(sum(inertia.values()), MOST), digest(x)) for j, x in enumerate(c) if j in inertia]
    per = embeddings.sparkSession.createDataFrame(found, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(per), "cluster").select(F.col(f"`{id_col}`"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
