"""What the training-data operators share: Arrow text buffers, chunking, checkpoints, samples.

Conventions of all operators here
---------------------------------
* A null text counts as an empty text. Empty tables give empty results.
* Repeated rows (equal or with a repeated id) each get their own result row
  where an operator scores rows; see each operator for the rest.
* Extra columns are passed through or ignored; a column of the input that has
  the name of an output column is replaced by the output.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a Python worker turns into numpy arrays at once. One longer text is taken alone.
CHUNK_BYTES = 2 << 20
#: Rows of an Arrow batch; with CHUNK_BYTES this bounds a worker's memory.
ARROW_ROWS = 2000

#: The bytes 9-13 and 32 separate words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches small, as one row may hold a text of 100 KB and more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder that all machines share, so that lost executors cost no recomputation.

    The folder is shared_folder(), unless one was set on the context.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder, read again: checkpointed(), but smaller."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder in local mode (tests) and an error on a cluster, whose machines share none."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "postlens-shared")


def remainder(id_col: str, n: int):
    """crc32 of the id's decimal text, modulo n; -1 for a null id, which no fold holds out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n), F.lit(-1))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and the n + 1 offsets of its rows. Nulls are empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(batch: pa.RecordBatch, text_col: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about limit bytes of text each, one row at least."""
    _, off = utf8(batch.column(text_col))
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(off, off[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def fresh(name: str, columns: list[str]) -> str:
    """name, with underscores added until no column has it in any letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def append_columns(df: DataFrame, text_col: str, fields: list[T.StructField], make: Callable[[], Callable[[pa.Array], dict]]) -> DataFrame:
    """df with columns computed from its text; columns of the same names are replaced.

    make() runs once a task and returns what maps a string array to one array
    or list for each field. No shuffle; rows stay where they are.
    """
    small_batches(df.sparkSession)
    names = {f.name.lower() for f in fields}
    kept = [c for c in df.columns if c.lower() not in names]
    aux = fresh("__text", kept)
    out = T.StructType([f for f in df.schema.fields if f.name in kept] + fields)
    types = [T_TO_ARROW[type(f.dataType)] for f in fields]

    def run(batches):
        work = make()
        for batch in batches:
            for piece in pieces(batch, aux):
                got = work(piece.column(aux))
                arrays = [piece.column(c) for c in kept] + [x if isinstance(x := got[f.name], pa.Array) else pa.array(x, t) for f, t in zip(fields, types)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(f.name for f in fields)])

    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias(aux)).mapInArrow(run, out)


T_TO_ARROW = {
    T.StringType: pa.string(), T.DoubleType: pa.float64(), T.LongType: pa.int64(),
    T.IntegerType: pa.int32(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary(), T.ArrayType: None,
}


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values (one per byte, or one row per byte) between offsets; 0 for empty rows."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each run of bytes other than 9-13 and 32; runs end with their row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True  # a row's first byte starts a new word even where no space is before it
    before = np.concatenate([[True], space[:-1]])
    starts = np.flatnonzero(~space & (before | first[:-1]))
    after = np.concatenate([space[1:], [True]])
    ends = np.flatnonzero(~space & (after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: What each byte value counts for in span_hash().
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))
_STEP = 1 << 12


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high): the powers of base modulo 2^64 below n are high[k // _STEP] * low[k % _STEP]."""
    low = np.full(_STEP, base, np.uint64)
    high = np.full(n // _STEP + 1, pow(base, _STEP, 1 << 64), np.uint64)
    low[0] = high[0] = 1
    return np.cumprod(low), np.cumprod(high)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each byte span (spans in order, not overlapping), by a polynomial in an odd base.

    Differences of one running sum over all bytes, brought to each span's start by powers of the base's inverse.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    first, size = int(starts[0]), int(ends[-1] - starts[0])
    low, high = _powers(base, size)
    terms = np.multiply.outer(high, low).ravel()[:size]
    terms *= _BYTES[data[first : first + size]]
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(terms, out=total[1:])
    at = starts - first
    low, high = _powers(pow(base, -1, 1 << 64), size)
    return mix64((total[ends - first] - total[at]) * (high[at // _STEP] * low[at % _STEP]) + (ends - starts).astype(np.uint64))


def bounded_sample(df: DataFrame, id_col: str, rows: int, seed: int) -> DataFrame:
    """At most `rows` rows, those of smallest seeded hash of the id: the same on each run and for any partitioning."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), id_col).limit(rows)
