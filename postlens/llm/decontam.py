"""Benchmark decontamination: a generalised suffix automaton of the test items, through which documents stream.

Texts are normalised to words: A-Z lower-cased, everything in ASCII but digits
and letters separates. The automaton holds the words of all items; streaming a
document through it tracks the longest suffix read that occurs in some item. A
window is `window` consecutive words of an item, or a whole shorter item; where
the tracked length reaches a window's, its words count as hit and its items as
found.

Items reach the executors in blocks of about `block_words` words, dealt by a
hash of the item, so that neither an automaton nor what the driver holds grows
with the table of items. One block takes one narrow pass. For several, a pass
looks for texts that have the hash of a window of up to SCREEN_WINDOWS windows at
once and writes them, each distinct text once a block, to the shared folder; only
there do the blocks' automata walk, so a text without a window meets none, and what is
hit is decided by words, never by hashes. Hits are united by text and joined to the
documents at the end.

Only runs of words that occur in some item can hold a window, so the automaton
is walked over such runs that are long enough, and nowhere else; that loses
nothing, as any other word returns it to its root.

Defined results: a null or empty text, and one without words, has no hits and
is not contaminated; null and wordless items have no window; rows of one
item_id count as one item; items of null id count as one that is not listed;
repeated documents are each judged; with no items nothing is hit.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import T_TO_ARROW, append_columns, checkpointed, fresh, mix64, pieces, small_batches, span_hash, utf8, words_of, written

WINDOW = 13
BLOCK_WORDS = 100_000
#: Item windows whose hashes go with the tasks of one pass over the documents, 12 bytes each.
SCREEN_WINDOWS = 1 << 21

_FOLD = bytes(32 if b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def normal_words(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


_FOLDED = np.frombuffer(_FOLD, np.uint8)


def window_hashes(data: np.ndarray, off: np.ndarray, lengths: list[int]):
    """(n, rows, hashes) of all n-word windows of texts, for each n of lengths; none crosses from text to text."""
    folded = _FOLDED[data]
    starts, ends, row = words_of(folded, off)
    word = span_hash(folded, starts, ends)
    for n in lengths:
        if len(word) >= n:
            with np.errstate(over="ignore"):
                h = word[: len(word) - n + 1].copy()
                for k in range(1, n):
                    h = h * np.uint64(0x9E3779B97F4A7C15) + word[k : len(word) - n + 1 + k]
            inside = row[: len(word) - n + 1] == row[n - 1 :]
            yield n, row[: len(word) - n + 1][inside], mix64(h[inside] + np.uint64(n))


class Automaton:
    """Generalised suffix automaton over the word ids of several items."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = [(item, [self.ids.setdefault(w, len(self.ids) + 1) for w in words]) for item, words in items if words]
        for _, word_ids in coded:
            last = 0
            for w in word_ids:
                last = self._extend(last, w)
        #: Of the state that has the windows of full length: the items with that window.
        self.found: dict[int, set[str | None]] = {}
        #: Of a state: (length, item) of the short items it spells.
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        self.least = min((min(window, len(x)) for _, x in coded), default=window)
        for item, word_ids in coded:
            if len(word_ids) < window:
                state = 0
                for w in word_ids:
                    state = self.next[state][w]
                self.short.setdefault(state, []).append((len(word_ids), item))
            else:
                for end, state, size in self.walk(word_ids):
                    if size >= window:
                        self.found.setdefault(self.at_window(state), set()).add(item)

    def _extend(self, last: int, w: int) -> int:
        following, link, size = self.next, self.link, self.size
        if w in following[last]:
            q = following[last][w]
            return q if size[q] == size[last] + 1 else self._clone(last, w, q)
        state = len(size)
        following.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in following[p]:
            following[p][w] = state
            p = link[p]
        if p >= 0:
            q = following[p][w]
            link[state] = q if size[q] == size[p] + 1 else self._clone(p, w, q)
        return state

    def _clone(self, p: int, w: int, q: int) -> int:
        following, link, size = self.next, self.link, self.size
        copy = len(size)
        following.append(dict(following[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and following[p].get(w) == q:
            following[p][w] = copy
            p = link[p]
        return copy

    def walk(self, word_ids):
        """(position, state, longest matching length) after each word."""
        following, link, size = self.next, self.link, self.size
        state = length = 0
        for i, w in enumerate(word_ids):
            while state and w not in following[state]:
                state = link[state]
                length = size[state]
            if w in following[state]:
                state = following[state][w]
                length += 1
            yield i, state, length

    def at_window(self, state: int) -> int:
        """The state of the last `window` words read in state."""
        while self.size[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str | None]]:
        """Which words are hit, and the items found."""
        get = self.ids.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, len(words))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], ids > 0, [False]]).astype(np.int8)))
        hit, items = np.zeros(len(words) + 1, np.int64), set()
        for start, end in zip(edge[::2], edge[1::2]):
            if end - start < self.least:
                continue
            for i, state, length in self.walk(ids[start:end].tolist()):
                if length >= self.window:
                    hit[start + i - self.window + 1] += 1
                    hit[start + i + 1] -= 1
                    items |= self.found[self.at_window(state)]
                if self.short and length >= self.least:
                    s = state
                    while s > 0:
                        for n, item in self.short.get(s, ()):
                            if n <= length:
                                hit[start + i - n + 1] += 1
                                hit[start + i + 1] -= 1
                                items.add(item)
                        s = self.link[s]
        return np.cumsum(hit[:-1]) > 0, items


FIELDS = [T.StructField(c, T.LongType()) for c in ("n_words", "n_hit", "n_items")] + [T.StructField("items", T.StringType()), T.StructField("item_ids", T.ArrayType(T.StringType())), T.StructField("hit_words", T.BinaryType())]
_STRINGS = pa.list_(pa.string())


def described(n_words: int, hit: np.ndarray, found: set[str | None]) -> dict:
    """A row's values of FIELDS."""
    named = sorted(i for i in found if i is not None)
    return {"n_words": n_words, "n_hit": int(hit.sum()), "n_items": len(found), "items": ",".join(named), "item_ids": named + [None] * (None in found), "hit_words": np.packbits(hit).tobytes()}


def columns_of(rows: list[dict]) -> dict:
    out = {f.name: [r[f.name] for r in rows] for f in FIELDS}
    return out | {"item_ids": pa.array(out["item_ids"], _STRINGS)}


def _one_block(docs: DataFrame, block: list[tuple[str | None, list[bytes]]], text_col: str, window: int) -> DataFrame:
    def make():
        automaton = Automaton(block, window)

        def work(column):
            data, off = utf8(column)
            raw, rows = data.tobytes(), []
            for i in range(len(column)):
                words = normal_words(raw[off[i] : off[i + 1]])
                rows.append(described(len(words), *automaton.hits(words)))
            return columns_of(rows)

        return work

    return append_columns(docs, text_col, FIELDS, make)


def screened(texts: DataFrame, items: DataFrame, key: list[str], window: int) -> DataFrame:
    """(text, key, block): each distinct text that has a window's hash, once for each block of items with such a window. One pass; the automata decide.

    items: (text, block), whose windows are at most about SCREEN_WINDOWS.
    """
    def of_items(batches):
        for batch in batches:
            data, off = utf8(batch.column("text"))
            block = batch.column("block").to_numpy()
            n_words = np.bincount(words_of(_FOLDED[data], off)[2], minlength=len(block)) if len(data) else np.zeros(len(block), np.int64)
            length = np.minimum(n_words, window)
            for n, row, h in window_hashes(data, off, [int(x) for x in np.unique(length[length > 0])]):
                mine = length[row] == n
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(mine.sum()), n, np.int32)), pa.array(h[mine].view(np.int64)), pa.array(block[row[mine]].astype(np.int32))], names=["n", "h", "block"])

    small_batches(texts.sparkSession)
    got = items.select("text", F.col("block").cast("int").alias("block")).mapInArrow(of_items, "n int, h long, block int").distinct().toArrow()
    n, h, block = (got.column(c).to_numpy() for c in ("n", "h", "block"))
    order = np.argsort(h.view(np.uint64), kind="stable")
    lengths = np.unique(n).tolist()
    sent = texts.sparkSession.sparkContext.broadcast((h.view(np.uint64)[order], block[order].astype(np.int32)))
    out = T.StructType([T.StructField("text", T.StringType()), *[T.StructField(k, T.LongType()) for k in key], T.StructField("block", T.IntegerType())])

    def of_texts(batches):
        known, of = sent.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, off = utf8(piece.column("text"))
                pairs = [np.zeros(0, np.int64)]
                for _, row, h in window_hashes(data, off, lengths):
                    left, right = np.searchsorted(known, h, side="left"), np.searchsorted(known, h, side="right")
                    some = np.flatnonzero(right > left)
                    for i in range(int((right - left)[some].max(initial=0))):  # blocks that share a window
                        more = some[left[some] + i < right[some]]
                        pairs.append(np.unique(row[more].astype(np.int64) << 32 | of[left[more] + i]))
                found = np.unique(np.concatenate(pairs))
                rows = pa.array(found >> 32)
                yield pa.RecordBatch.from_arrays([*(piece.column(c).take(rows) for c in ("text", *key)), pa.array((found & 0xFFFFFFFF).astype(np.int32))], names=out.names)

    return written(texts.select("text", *key).mapInArrow(of_texts, out).dropDuplicates([*key, "block"]))


def measure(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, n_hit, n_items, items (comma-joined, sorted as strings), item_ids (array), hit_words (packed bits of the words)."""
    spark = docs.sparkSession
    known = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("text"))
    total = known.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    dealt = known.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    # a block has about block_words words, whatever the table of items holds
    block_of = lambda b: [(r["item"], normal_words(r["text"].encode())) for r in dealt.where(F.col("block") == b).collect()]
    if blocks == 1:
        return _one_block(docs, block_of(0), text_col, window)
    key = [fresh(f"__text{k}", docs.columns) for k in (1, 2)]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    hashes = [F.xxhash64(F.lit(k), text).alias(name) for k, name in enumerate(key)]
    alone = docs.select(text.alias("text"), *hashes)
    parts = []
    step = max(1, SCREEN_WINDOWS // block_words)
    for first in range(0, blocks, step):
        near = screened(alone, dealt.where(F.col("block").between(first, first + step - 1)), key, window)
        for b in sorted(r["block"] for r in near.select("block").distinct().collect()):  # at most `step` numbers
            parts.append(checkpointed(_one_block(near.where(F.col("block") == b).drop("block"), block_of(b), "text", window).where("n_hit > 0").select(*key, "hit_words", "item_ids")))
    if not parts:
        parts = [alone.limit(0).select(*key, F.lit(None).cast("binary").alias("hit_words"), F.lit(None).cast("array<string>").alias("item_ids"))]
    small_batches(spark)
    names = {f.name.lower() for f in FIELDS}
    kept = [f for f in docs.schema.fields if f.name.lower() not in names]
    bits, lists, body = (fresh(c, docs.columns) for c in ("__bits", "__lists", "__body"))
    united = reduce(DataFrame.unionByName, parts).groupBy(*key).agg(F.collect_list("hit_words").alias(bits), F.flatten(F.collect_list("item_ids")).alias(lists))
    joined = docs.select(*[F.col(f"`{f.name}`") for f in kept], text.alias(body), *hashes).join(united, key, "left").drop(*key)

    def unite(batches):
        for batch in batches:
            for piece in pieces(batch, body):
                data, off = utf8(piece.column(body))
                raw, rows = data.tobytes(), []
                for i, (packed, found) in enumerate(zip(piece.column(bits).to_pylist(), piece.column(lists).to_pylist())):
                    n = len(normal_words(raw[off[i] : off[i + 1]]))
                    hit = np.zeros(n, bool)
                    for b in packed or ():
                        hit |= np.unpackbits(np.frombuffer(b, np.uint8))[:n].astype(bool)
                    rows.append(described(n, hit, set(found or ())))
                got = columns_of(rows)
                yield pa.RecordBatch.from_arrays([piece.column(f.name) for f in kept] + [x if isinstance(x := got[f.name], pa.Array) else pa.array(x, T_TO_ARROW[type(f.dataType)]) for f in FIELDS], names=[f.name for f in [*kept, *FIELDS]])

    return joined.mapInArrow(unite, T.StructType([*kept, *FIELDS]))


def is_contaminated(coverage_percent: int = 5):
    """n_hit > 0 and at least coverage_percent of the words are hit."""
    return (F.col("n_hit") > 0) & (F.lit(100) * F.col("n_hit") >= F.lit(coverage_percent) * F.col("n_words"))


def remove_spans(measured: DataFrame, text_col: str = "text", max_words: int = WINDOW, coverage_percent: int = 5) -> DataFrame:
    """measured with hit spans cut out of the text: those of more than max_words words, and all of a text of which at least coverage_percent of the words are hit.

    A span reaches from the first byte of its first word to the last of its
    last; what separates words around it stays.
    """
    @F.pandas_udf("string")
    def cut(text: pd.Series, bits: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for t, b, k in zip(text, bits, n):
            hit = np.unpackbits(np.frombuffer(b, np.uint8))[:k].astype(bool)
            if t is None or not hit.any():
                out.append(t)
                continue
            least = 0 if 100 * hit.sum() >= coverage_percent * k else max_words
            raw = t.encode()
            folded = np.frombuffer(raw.translate(_FOLD), np.uint8)
            word = ~np.isin(folded, (32,))
            edge = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
            starts, ends = edge[::2], edge[1::2]
            runs = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            kept, at = [], 0
            for s, e in zip(runs[::2], runs[1::2]):
                if e - s > least:
                    kept.append(raw[at : starts[s]])
                    at = ends[e - 1]
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pd.Series(out, dtype=object)

    return measured.withColumn(text_col, cut(text_col, "hit_words", "n_words"))

