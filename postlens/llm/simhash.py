"""SimHash near-duplicates: fingerprints of word shingles, linked within a Hamming distance through pivot distance tables.

1. A fingerprint bit is 1 where more than half of the shingles' XXH64 values
   (seed 42) have it set. One narrow pass with numpy inside the tasks.
2. Equal fingerprints become one node, so a group of copies of any size costs
   one row from there on (counted before the shuffle).
3. Candidates: fingerprints that differ in at most `distance` bits agree in
   some `blocks - distance` of `blocks` bit blocks. Each fingerprint goes to
   one bucket for each such choice of blocks. This is lossless and is what keeps
   the tables apart on a cluster; pivots alone would leave all pairs to look at.
4. Inside a bucket the pivot distance table decides: the Hamming distances to
   `pivots` reference fingerprints are precomputed; by the triangle inequality
   a pair whose largest coordinate difference exceeds `distance` is discarded.
   Rows are sorted by the first coordinate, so only a window of it is looked
   at. Survivors are verified by XOR and bit count.
5. A bucket yields a spanning forest of its links, never all pairs; stars over
   all buckets then give components (see components.py).

Defined results: null and wordless texts have fingerprint 0 and link like any
other; texts of fewer words than a shingle are one shingle; each row goes by its
own text, so rows that repeat an id may be of different components; rows of
null ids link like others, and give a component its id or its kept row only
where no row of it has an id.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, checkpointed, utf8
from .components import components

SEED, PIVOTS = 42, 16
#: A bucket with more rows than this is split by further bit blocks.
LARGE_BUCKET = 2048
#: Rows of buckets that a task holds, on average, at most.
PARTITION_ROWS = 500_000


def fingerprint(words: list[bytes], shingle: int) -> int:
    """The fingerprint of a text's words."""
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :])], np.uint64)
    total = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        total += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * total > len(h), bitorder="little")
    return int(bits.view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """docs with fingerprint, a long whose 64 bits are the fingerprint."""

    def make():
        def work(column):
            data, off = utf8(column)
            raw = data.tobytes()
            got = [fingerprint(raw[off[i] : off[i + 1]].lower().split(), shingle) for i in range(len(column))]
            return {"fingerprint": np.array(got, np.uint64).view(np.int64)}

        return work

    return append_columns(docs, text_col, [T.StructField("fingerprint", T.LongType())], make)


def as_hex(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def pivot_table(fp: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances of each fingerprint to the reference fingerprints, pivot by pivot."""
    reference = np.random.default_rng(64).integers(0, 1 << 63, pivots, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return np.stack([np.bitwise_count(fp ^ r).astype(np.int8) for r in reference])


def find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = int(parent[i])
    return i


def close_in_bucket(fp: np.ndarray, group: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within groups (equal, adjacent group numbers); indexes into fp."""
    table = pivot_table(fp)
    order = np.lexsort((table[0], group))
    fp, group, table = fp[order], group[order], table[:, order]
    first = table[0].astype(np.int16)
    parent = np.arange(len(fp))
    edges = []
    alive = np.arange(len(fp))
    lag = 0
    while len(alive):
        lag += 1
        alive = alive[alive + lag < len(fp)]
        other = alive + lag
        # sorted by the first pivot: once the window is left, larger lags are out of it too
        near = (group[alive] == group[other]) & (first[other] - first[alive] <= distance)
        alive = alive[near]
        a, b = alive, other[near]
        for coordinate in table[1:]:
            if not len(a):
                break
            ok = np.abs(coordinate[a] - coordinate[b]) <= distance
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= distance
        a, b = a[ok], b[ok]
        new = parent[a] != parent[b]
        for x, y in zip(a[new].tolist(), b[new].tolist()):
            rx, ry = find(parent, x), find(parent, y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                edges.append((int(order[x]), int(order[y])))
        if lag % 64 == 0:  # labels stay near their roots, so that linked pairs are skipped in numpy
            while (parent[parent] != parent).any():
                parent = parent[parent]
    return edges


def bucket_edges(fp: np.ndarray, key: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges within runs of equal keys (key sorted); large buckets are first split by further bit blocks, losslessly."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(starts, len(key)))
    edges = []
    group = np.repeat(np.arange(len(starts)), size)
    small = np.repeat((size > 1) & (size <= LARGE_BUCKET), size)
    rows = np.flatnonzero(small)
    if len(rows):
        edges += [(int(rows[a]), int(rows[b])) for a, b in close_in_bucket(fp[rows], group[rows], distance)]
    for k in np.flatnonzero(size > LARGE_BUCKET):
        rows = np.arange(starts[k], starts[k] + size[k])
        varying = np.flatnonzero([((fp[rows] >> np.uint64(i)) & np.uint64(1)).std() > 0 for i in range(64)])
        # the bits that vary are dealt over distance + 1 blocks: a close pair agrees in one of them
        for part in range(distance + 1):
            mask = sum(1 << int(i) for i in varying[part :: distance + 1])
            sub = fp[rows] & np.uint64(mask)
            order = np.argsort(sub, kind="stable")
            cut = np.flatnonzero(np.concatenate([[True], sub[order][1:] != sub[order][:-1]]))
            group = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(order))))
            edges += [(int(rows[order[a]]), int(rows[order[b]])) for a, b in close_in_bucket(fp[rows][order], group, distance)]
    return edges


def block_masks(distance: int, blocks: int) -> list[int]:
    """For each choice of blocks - distance blocks, the mask of their bits."""
    edge = [round(k * 64 / blocks) for k in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge, edge[1:])]
    return [sum(chosen) for chosen in combinations(block, blocks - distance)]


def links(nodes: DataFrame, distance: int = 3, blocks: int = 5) -> DataFrame:
    """(u, v): links whose components are those of all pairs of nodes (fingerprint, node) within the distance.

    nodes has each fingerprint once.
    """
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in block_masks(distance, blocks)]
    keyed = nodes.select("fingerprint", "node", F.posexplode(F.array(*[F.col("fingerprint").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "bits"))
    keyed = keyed.select("fingerprint", "node", F.xxhash64("t", "bits").alias("key"))
    # the number is given, so that partitions of the Python step are not coalesced; it grows with the nodes, as a task holds a partition
    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-nodes.count() * len(masks) // PARTITION_ROWS))
    dealt = keyed.repartition(parts, "key")

    def run(batches):
        got = [(b.column("key").to_numpy(), b.column("fingerprint").to_numpy(), b.column("node").to_numpy()) for b in batches]
        if not got:
            return
        key, fp, node = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((fp, key))
        key, fp, node = key[order], fp[order].view(np.uint64), node[order]
        edges = np.array(bucket_edges(fp, key, distance), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(node[edges[:, 0]]), pa.array(node[edges[:, 1]])], names=["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def clustered(prints: DataFrame, best, distance: int) -> DataFrame:
    """(fingerprint, cluster, best) of each distinct fingerprint: the least fingerprint reachable over links, and the least `best` of its rows."""
    nodes = prints.groupBy("fingerprint").agg(F.min(best).alias("best"))
    found = components(links(nodes.select("fingerprint", F.col("fingerprint").alias("node")), distance)).withColumnRenamed("node", "fingerprint")
    return nodes.join(found, "fingerprint", "left").select("fingerprint", F.coalesce("component", "fingerprint").alias("cluster"), "best")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """(id, fingerprint long, component_id) of each row; component_id is the least id reachable over links, null where no row reached has one."""
    prints = checkpointed(with_fingerprint(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), text_col, shingle).select(id_col, "fingerprint"))
    of = clustered(prints, F.col(id_col), distance)
    least = of.groupBy("cluster").agg(F.min("best").alias("component_id"))
    return prints.join(of.join(least, "cluster").select("fingerprint", "component_id"), "fingerprint").select(id_col, "fingerprint", "component_id")


def row_key(docs: DataFrame) -> list:
    """Two 64-bit hashes of a row, never null; columns that can't be hashed (maps, variants) have no part in them."""
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if not re.search("map<|variant", f.dataType.simpleString())]
    values = [x for c in hashed for x in (F.isnull(c), c)]
    return [F.xxhash64(F.lit(k), *values) for k in (1, 2)]


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """docs with one row of each component: that of its least id, null ids last, then that of least row key. Rows equal in all columns are one."""
    key = ["__row1", "__row2"]
    while {k.lower() for k in key} & {c.lower() for c in docs.columns}:
        key = [f"{k}_" for k in key]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(*columns, *[k.alias(n) for n, k in zip(key, row_key(docs))])
    prints = checkpointed(with_fingerprint(keyed.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), *key), "text", shingle).drop("text"))
    of = clustered(prints, F.struct(F.isnull("id").alias("no_id"), "id", *key), distance)
    kept = of.groupBy("cluster").agg(F.min("best").alias("best")).select(*[F.col(f"best.{k}").alias(k) for k in key])
    # repeated rows are combined before the shuffle
    return keyed.dropDuplicates(key).join(kept, key, "left_semi").select(*columns)
