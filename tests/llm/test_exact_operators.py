"""Operators 11 to 13 against brute force, and their defined results for nulls, ties, repeats, clashing names, empty tables and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlens.llm import centroids, periodic, radix_dedup
from postlens.llm.common import CHUNK_BYTES


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- 11: centroids


def integers(vector, dims):
    if vector is None or len(vector) != dims or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [min(max(math.floor(64 * x), -centroids.LIMIT), centroids.LIMIT) for x in vector]


def slow_clusters(rows, k, rounds, dims):
    """[(id, cluster, distance)] and centroids, with Python integers."""
    kept = [(i, x) for i, v in rows if (x := integers(v, dims)) is not None]
    c = [x for _, x in sorted(kept, key=lambda r: (sha(f"1:{r[0]}") if r[0] is not None else "g", r[1]))[:k]]
    square = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    near = lambda x: min((square(x, y), j) for j, y in enumerate(c))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, x in kept:
            of[near(x)[1]].append(x)
        c = [[sum(col) // len(of[j]) for col in zip(*of[j])] if j in of else y for j, y in enumerate(c)]
    return [(i, near(x)[1], near(x)[0]) for i, x in kept], c


@pytest.mark.parametrize("spread", [0.02, 1.0, 3e5, 1e20])
def test_clusters_are_those_of_integers(spark, spread):
    r = random.Random(int(spread * 100))
    rows = [(i, [r.choice([r.gauss(0, spread), 0.0, spread]) for _ in range(6)]) for i in range(300)]
    rows += [(300, None), (301, [1.0] * 5), (302, [1.0] * 5 + [None]), (303, [1.0] * 5 + [math.nan]), (304, [math.inf] * 6), (305, [1.0] * 7), (None, [0.0] * 6), (7, rows[7][1]), (7, rows[8][1])]
    d = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, distance string, Cluster int").repartition(5)
    expected, c = slow_clusters(rows, 5, 3, 6)
    got = centroids.cluster(d, k=5, rounds=3, dims=6).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((x.vec_id, x.cluster, x.distance) for x in got), key=key) == sorted(expected, key=key)
    assert {x.inertia for x in got} == {min(sum(e[2] for e in expected), centroids.MOST)}
    assert all(x.cluster_inertia == min(sum(e[2] for e in expected if e[1] == x.cluster), centroids.MOST) and x.centroid_sha256 == sha(",".join(map(str, c[x.cluster]))) for x in got)


def test_interval_holds_the_nearest_and_screens_the_rest():
    g = np.random.default_rng(3)
    for size in (2, 1 << 10, 1 << 20, 1 << 27):
        c = g.integers(-size, size + 1, (40, 64))
        x = np.concatenate([g.integers(-size, size + 1, (500, 64)), c, (c[:20] + c[20:]) // 2])
        exact = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x[:: 7 if size > 2 else 1]], object)
        number, _ = centroids.nearest(x, c)
        assert (number[:: 7 if size > 2 else 1] == [int(np.argmin(row)) for row in exact]).all()
        if size > 2:
            assert centroids.shortlist(x[:500], c).sum(axis=1).mean() < 1.5
    c = np.array([[5] * 64, [0] * 64, [0] * 64, [10] * 64])
    assert centroids.nearest(np.array([[0] * 64, [10] * 64]), c)[0].tolist() == [1, 3]  # of equal centroids the first
    far = np.full((1, 64), centroids.LIMIT)
    assert centroids.distances(far, -far, np.array([0]))[0] == 64 * (2 * centroids.LIMIT) ** 2


def test_clusters_of_few_or_no_vectors(spark):
    d = spark.createDataFrame([(1, [1.0] * 64), (2, [1.0] * 64)], "vec_id long, embedding array<float>")
    assert [(r.cluster, r.distance) for r in centroids.cluster(d).collect()] == [(0, 0), (0, 0)]  # the second centroid stays empty
    assert centroids.cluster(d.limit(0)).collect() == [] and centroids.cluster(d.where("vec_id < 0").select("vec_id", F.col("embedding").cast("array<int>").alias("embedding"))).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


# --- 12: periodic runs


def slow_runs(words, least, exponent):
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - s >= q:
                found.setdefault((s, i + q), q)
            i += i == s
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, exponent * q))


def slow_collapse(text, h, least=24, exponent=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if h >= 0 and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = slow_runs(w, least, exponent)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, " ".join(x for i, x in enumerate(w) if i not in gone)


def some_texts(seed, count):
    r = random.Random(seed)
    for _ in range(count):
        w = [str(r.randrange(r.choice([1, 2, 3, 60]))) for _ in range(r.choice([0, 1, 7, 24, 40, 150]))]
        for _ in range(r.choice([0, 1, 1, 2])):
            a = r.randint(0, len(w))
            w = w[:a] + (w[a : a + r.randint(1, 14)] or ["x"]) * r.randint(1, 14) + w[a:]
        yield r.choice([" ", " ", "\n", " \t", "\x0b"]).join(w), r.choice([-1, 10 * r.randrange(10**8), r.randrange(10**9)])


@pytest.mark.parametrize("seed", range(40))
def test_runs_against_brute_force(seed):
    least, exponent = [(24, 3), (24, 3), (9, 2), (6, 4)][seed % 4]
    texts = [*some_texts(seed, 25), (None, 10), ("", 20), (" \n", 30)]
    got = [c.to_pylist() for c in periodic.of_texts(pa.array([t for t, _ in texts], pa.string()), np.array([h for _, h in texts]), least, exponent)]
    for k, (text, h) in enumerate(texts):
        runs, collapsed = slow_collapse(text, h, least, exponent)
        assert [got[0][k], got[5][k], got[6][k]] == [len(runs), "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda x: (x[0], x[2]))), collapsed]
        if runs:
            s, n, q = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]))
            assert [c[k] for c in got[1:5]] == [s, n, q, 1000 * n // q]


def test_runs_of_a_table(spark):
    long = " ".join(["a", "b", "c"] * (CHUNK_BYTES // 4)) + " d"
    power = " ".join(["same"] * 50_000)  # one run, and all of its powers
    rows = [(i, t) for i, (t, _) in enumerate(some_texts(99, 60))] + [(None, "x " * 30), (60, None), (61, long), (62, power), (1, "x " * 30), (1, "x " * 30)]
    d = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n_runs int, Start string").repartition(3)
    got = periodic.find(d, rearrange=F.when(F.col("doc_id") < 60, F.crc32(F.col("doc_id").cast("string").cast("binary"))))
    key = lambda x: (x[0] is None, x)
    expected = []
    for i, t in rows:
        if i in (61, 62):
            continue
        runs, collapsed = slow_collapse(t, zlib.crc32(str(i).encode()) if i is not None and i < 60 else -1)
        expected.append((i, len(runs), collapsed))
    assert sorted(((r.doc_id, r.n_runs, r.collapsed) for r in got.collect() if r.doc_id not in (61, 62)), key=key) == sorted(expected, key=key)
    big = {r.doc_id: r for r in got.where("doc_id in (61, 62)").collect()}
    assert (big[61].n_runs, big[61].start, big[61].length, big[61].period, big[61].collapsed) == (1, 0, 3 * (CHUNK_BYTES // 4), 3, "a b c d")
    assert (big[62].n_runs, big[62].period, big[62].exponent_milli, big[62].collapsed) == (1, 1, 50_000_000, "same")
    assert periodic.find(d.limit(0)).collect() == [] and len(periodic.find(d).columns) == 8


def test_a_text_that_repeats_fewer_words_builds_no_tree(monkeypatch):
    monkeypatch.setattr(periodic, "nodes", lambda lcp: pytest.fail("built"))
    part = " ".join(map(str, range(15)))
    assert periodic.of_texts(pa.array([f"{part} x {part} y {part}"]), None, 24, 3)[0].to_pylist() == [0]


# --- 13: exact deduplication


def slow_groups(rows):
    of = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        of["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")].append((i is not None, i or 0, k))
    return sorted(((i, max(g)[1] if max(g)[0] else None, len(g), sha(t)) for t, g in of.items() for i in (rows[k][0] for *_, k in g)), key=repr)


@pytest.mark.parametrize("first", [1, 3, 64])
def test_exact_groups_against_brute_force(spark, first):
    r = random.Random(first)
    stem = "".join(r.choice("abcdeé ") for _ in range(5000))
    texts = ["", None, "A", "a", "Ä", "ä", "ab", "a\0", "a\0\0", stem, stem.upper(), stem[:64], stem[:65], stem[:1088], stem[:1089], stem + "!", stem + "?", *(stem[:k] for k in range(0, 60, 7))]
    rows = [(i, r.choice(texts)) for i in range(400)] + [(None, stem), (None, None), (None, "once"), (None, "twice"), (None, "twice"), (5, "same row"), (5, "same row")]
    d = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, KEEP_ID string, source long").repartition(7)
    got = radix_dedup.deduplicate(d, carry=("source", "KEEP_ID"), first=first).collect()
    assert sorted(((x.doc_id, x.keep_id, x.group_size, x.text_sha256) for x in got), key=repr) == slow_groups(rows)
    assert all(x.source == x.doc_id for x in got)
    of = defaultdict(list)
    for x in got:
        of[x.text_sha256].append(x)
    assert all([x.doc_id for x in g if x.kept] == [g[0].keep_id] for g in of.values())
    kept = radix_dedup.keep_one(d)
    assert kept.columns == d.columns and sorted(((x.doc_id, sha(radix(x.text))) for x in kept.collect()), key=repr) == sorted(((g[0].keep_id, k) for k, g in of.items()), key=repr)


def radix(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_exact_groups_of_empty_tables_and_long_texts(spark):
    long = "long text " * (CHUNK_BYTES // 5)
    d = spark.createDataFrame([(1, long), (2, long.upper()), (3, long + "x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in radix_dedup.deduplicate(d).collect()) == [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 1, True)]
    assert radix_dedup.deduplicate(d.limit(0)).collect() == []
