"""Runs of periodic word sequences in each text, by the branching tandem repeats of its suffix tree (Stoye and Gusfield).

A run is a stretch of consecutive words with smallest period q that holds at
least `exponent` periods and `least` words, and that no neighbouring word
extends. Words are numbers (of the distinct words of a chunk of texts), and the
texts of a chunk are worked on together, each with an end mark of its own, so
that no node of the tree spans two texts.

1. Suffixes are sorted by prefix doubling, which only touches suffixes whose
   first 2^k words occur again in the text, and gives the length of the prefix that
   neighbours in the order share. The intervals of that order are the tree's nodes.
2. A text none of whose sequences of `reach` words occurs twice holds no run: a
   run of period q holds max(least - q, (exponent - 1) q) >= reach words twice.
   The tree of such a text stays unbuilt.
3. Of each node of depth q the leaves outside its largest child are visited, n log n
   in all. A leaf i whose partner i + q or i - q is a leaf of the node too, under
   another child, is a branching tandem repeat: 2q words of period q that the
   next word ends. Every run has just one of its period, at its end.
4. Each is rotated to the left while the word before equals the one a period
   later, which gives the run's start; a repeat whose root is a power of a
   shorter one found at the same end is that run once more and is merged with it.

A word is dropped from the collapsed text if some run has it after its first q words.

Defined results: a null text is empty; a text without words has no runs and an
empty collapsed text. Repeated rows get a result each; an empty table gives none.
A text is held by its task, with 4 bytes a word for each doubling of its longest
repeat, and never split, as its longest run may be all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pieces, small_batches, utf8, words_of

#: Leaves that are looked at together.
LEAVES = 1 << 20
FIELDS = [T.StructField("n_runs", T.LongType()), *[T.StructField(n, T.LongType()) for n in ("start", "length", "period", "exponent_milli")], T.StructField("runs", T.StringType()), T.StructField("collapsed", T.StringType())]


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each word among the distinct ones, bytes of the words end to end, their n + 1 offsets)."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    letters = data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(letters)])
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), letters, offsets


def rearranged(n: int, h: int) -> np.ndarray:
    """Which word stands at each place of a text of n > 0 words that is made periodic from a word on, as h says."""
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def reach(least: int, exponent: int) -> int:
    """Words that each run holds twice, a period apart."""
    return min(max(least - q, (exponent - 1) * q) for q in range(1, least + 1))


def sorted_suffixes(symbols: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(the suffixes in order, row by row; for each k the ranks of the suffixes by their first 2^k symbols).

    symbols has an end mark after each row that is larger than all else, so no two suffixes of a row are equal.
    A rank is the place of the first suffix that shares the symbols.
    """
    key = row * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")
    first = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    place = np.arange(len(order), dtype=np.int32)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, place, 0))
    ranks, step = [rank], 1
    open_ = np.flatnonzero(~(first & np.append(first[1:], True)))  # places of suffixes that are not alone
    while len(open_):
        at = order[open_]
        key = rank[at].astype(np.int64) << 32 | rank[at + step]
        by = np.argsort(key)
        order[open_], key = at[by], key[by]
        first = np.concatenate([[True], key[1:] != key[:-1]])
        rank = rank.copy()
        rank[order[open_]] = np.maximum.accumulate(np.where(first, open_, 0))
        ranks.append(rank)
        open_ = open_[~(first & np.append(first[1:], True))]
        step *= 2
    return order, ranks


def shared(a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Length of the prefix that the suffixes a and b share, which are never the same."""
    n = np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        n += (ranks[k][a + n] == ranks[k][b + n]).astype(np.int64) << k
    return n


def nodes(lcp: list[int]) -> np.ndarray:
    """(depth, left, right, left and right of the largest child) of the inner nodes of depth 1 and more.

    lcp[t] is shared by the leaves t - 1 and t; lcp[0] and a last one are 0. Children are leaves or nodes.
    """
    out = []
    depth, left, big = [0], [0], [(0, -1)]
    for t in range(1, len(lcp)):
        here = lcp[t]
        a, b = t - 1, t - 1  # the subtree that ends at t - 1
        while depth[-1] > here:
            d, lo, (x, y) = depth.pop(), left.pop(), big.pop()
            if b - a > y - x:
                x, y = a, b
            out.append((d, lo, t - 1, x, y))
            a, b = lo, t - 1
        if depth[-1] < here:
            depth.append(here)
            left.append(a)
            big.append((a, b))
        elif here and b - a > big[-1][1] - big[-1][0]:
            big[-1] = (a, b)
    return np.array(out, np.int64).reshape(-1, 5)


def leaves(tree: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of nodes, places of leaves outside the node's largest child), about LEAVES of them at once."""
    sides = np.concatenate([tree[:, [1, 3]], tree[:, [4, 2]] + [1, 1]])  # from the node's left to the child's, from behind the child to the node's end
    owner = np.tile(np.arange(len(tree)), 2)
    size = sides[:, 1] - sides[:, 0]
    total = np.cumsum(size)
    start = 0
    while start < len(size):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + LEAVES, side="right")))
        n = size[start:end]
        yield np.repeat(owner[start:end], n), np.repeat(sides[start:end, 0] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        start = end


def branching_repeats(symbols: np.ndarray, order: np.ndarray, tree: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, root length) of the branching tandem repeats; order: the leaves that tree speaks of."""
    place = np.full(len(symbols), -1, np.int64)
    place[order] = np.arange(len(order))
    found = []
    for node, leaf in leaves(tree):
        depth, lo, hi = tree[node, 0], tree[node, 1], tree[node, 2]
        i = order[leaf]
        for first in (i, i - depth):
            other = place[np.where(first == i, i + depth, np.maximum(first, 0))]
            ok = (first >= 0) & (other >= lo) & (other <= hi)
            s, q = first[ok], depth[ok]
            branch = symbols[s + q] != symbols[s + 2 * q]
            found.append(np.stack([s[branch], q[branch]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(found, axis=1), axis=1)
    return both[0], both[1]


def start_of_run(symbols: np.ndarray, s: int, q: int) -> int:
    """Where the stretch of period q begins that holds the word s: rotated to the left, in steps that double."""
    size = 16
    while s:
        m = min(size, s)
        differs = np.flatnonzero(symbols[s - m : s] != symbols[s - m + q : s + q])
        if len(differs):
            return s - m + int(differs[-1]) + 1
        s, size = s - m, 2 * size
    return s


def maximal_runs(symbols: np.ndarray, row: np.ndarray, least: int, exponent: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, places within symbols. Rows end with a mark that differs from all other symbols."""
    order, ranks = sorted_suffixes(symbols, row)
    k = reach(least, exponent).bit_length() - 1
    if len(ranks) <= k:
        return []
    # places of each row that has a sequence of 2^k words twice
    again = np.zeros(int(row[-1]) + 1, bool)
    twice = np.bincount(ranks[k], minlength=len(order)) > 1
    again[row[twice[ranks[k]]]] = True
    order = order[again[row[order]]]
    if not len(order):
        return []
    own = row * (int(symbols.max()) + 1) + symbols  # words of different texts differ, end marks too
    lcp = shared(order[:-1], order[1:], ranks)
    del ranks
    tree = nodes([0, *lcp.tolist(), 0])
    s, q = branching_repeats(own, order, tree)
    more = np.maximum(least, exponent * q) - 2 * q  # words that a run has before its last two periods
    for t in range(1, int(more.min(initial=0)) + 1):
        same = own[s - t] == own[s - t + q]
        s, q, more = s[same], q[same], more[same]
    runs: dict[int, list[tuple[int, int]]] = {}
    for i, p in sorted(zip(s.tolist(), q.tolist()), key=lambda x: x[1]):
        known = runs.setdefault(i + 2 * p, [])
        if not any(p % period == 0 and begin <= i for begin, period in known):
            known.append((start_of_run(own, i, p), p))
    return sorted((a, end - a, p) for end, known in runs.items() for a, p in known if end - a >= max(least, exponent * p))


def of_texts(column: pa.Array, h: np.ndarray | None, least: int, exponent: int) -> list[pa.Array]:
    """The columns of FIELDS for the texts; h: for each text the number that rearranged() takes, -1 to leave it."""
    data, off = utf8(column)
    starts, ends, row = words_of(data, off)
    word, letters, at = numbered(data, starts, ends)
    edge = np.searchsorted(row, np.arange(len(column) + 1))
    shown = np.arange(len(word))  # the word at each place
    if h is not None:
        for r in np.flatnonzero((h >= 0) & (h % 10 == 0) & (edge[1:] > edge[:-1])).tolist():
            shown[edge[r] : edge[r + 1]] = edge[r] + rearranged(int(edge[r + 1] - edge[r]), int(h[r]))
    symbols = np.full(len(word) + len(column), int(word.max(initial=-1)) + 1, np.int64)
    symbols[np.arange(len(word)) + row] = word[shown]
    marked = np.concatenate([row, np.arange(len(column))])
    found = maximal_runs(symbols, np.sort(marked, kind="stable"), least, exponent) if len(word) else []
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    change = np.zeros(len(word) + 1, np.int64)
    mark = edge[1:] + np.arange(len(column))  # places of the end marks
    for s, n, q in found:
        r = int(np.searchsorted(mark, s))
        runs[r].append((s - r - int(edge[r]), n, q))
        change[s - r + q] += 1
        change[s - r + n] -= 1
    return [*_listed(runs), _joined(letters, at, shown, row, np.cumsum(change[:-1]) == 0, len(column))]


def _listed(runs: list[list[tuple[int, int, int]]]) -> list[pa.Array]:
    best = [min(r, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if r else (None, None, None) for r in runs]
    milli = [1000 * n // q if n else None for _, n, q in best]
    columns = [[len(r) for r in runs], *zip(*best), milli] if runs else [[]] * 5
    text = ["".join(f"{s},{n},{q}\n" for s, n, q in sorted(r, key=lambda x: (x[0], x[2]))) for r in runs]
    return [*[pa.array(c, pa.int64()) for c in columns], pa.array(text, pa.string())]


def _joined(letters: np.ndarray, at: np.ndarray, shown: np.ndarray, row: np.ndarray, kept: np.ndarray, rows: int) -> pa.Array:
    """The kept words of each row, joined by one space."""
    shown, row = shown[kept], row[kept]
    size = at[shown + 1] - at[shown]
    last = np.append(row[1:] != row[:-1], True)[: len(row)]
    width = size + ~last  # with the space after it
    end = np.cumsum(width)
    out = np.full(int(end[-1]) if len(end) else 0, 32, np.uint8)
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(end - width, size) + inside] = letters[np.repeat(at[shown], size) + inside]
    offsets = np.concatenate([[0], end])[np.searchsorted(row, np.arange(rows + 1))]
    return pa.StringArray.from_buffers(rows, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, exponent: int = 3, rearrange: Column | None = None) -> DataFrame:
    """(id, n_runs; start, length, period, exponent_milli of the run of greatest exponent; runs, collapsed) of each row. One narrow pass.

    runs has a line start,length,period for each run. rearrange: a column of
    numbers; texts whose number ends in 0 are made periodic first, see rearranged().
    """
    small_batches(docs.sparkSession)
    given = rearrange is not None
    number = F.coalesce(rearrange.cast("long"), F.lit(-1)) if given else F.lit(-1).cast("long")
    out = T.StructType([T.StructField(id_col, docs.select(F.col(f"`{id_col}`")).schema[0].dataType), *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                columns = of_texts(piece.column("text"), piece.column("h").to_numpy() if given else None, least, exponent)
                yield pa.RecordBatch.from_arrays([piece.column("id"), *columns], names=out.names)

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), number.alias("h")).mapInArrow(run, out)
