"""Repetition rules: how much of a text lies in duplicated n-grams and lines, by rolling hashes in numpy.

For each n of NGRAMS a rolling polynomial hash over the word hashes of the
whole text finds the word n-grams that occur twice or more; the share of word
characters (code points) inside any of them (each counted once, all
occurrences) is held against a limit, and so is the share inside lines that
equal an earlier one. Texts are cut into chunks between texts only.

Columns: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in
twice-found 5-word windows), base_failed, the shares, kept.

Defined results: null and empty texts have no words, so base_failed is true and
kept false; shares of a text without words are 0; repeated rows are each judged
on their own text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, mix64, row_sums, span_hash, utf8, words_of

#: Largest share of word characters in n-grams found twice or more, by n.
NGRAMS = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 10: 0.21}
DUP_LINE_SHARE = 0.30
MIN_WORDS, REPEAT_PERCENT = 10, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BASE = 0xD6E8FEB86659FD93


def covered_words(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-gram that occurs twice or more in their row."""
    cover = np.zeros(len(h), bool)
    if len(h) < n:
        return cover
    roll = np.zeros(len(h) - n + 1, np.uint64)
    for k in range(n):
        roll = roll * np.uint64(_BASE) + h[k : len(h) - n + 1 + k]
    own = mix64(roll + mix64(row[: len(roll)].astype(np.uint64) + np.uint64(1)))  # equal only within a row
    inside = np.flatnonzero(row[n - 1 :] == row[: len(roll)])
    if not len(inside):
        return cover
    key = own[inside]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, inside[twice], 1)
    np.add.at(edge, inside[twice] + n, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(column: pa.Array) -> dict:
    """All columns but kept, for a string array."""
    data, off = utf8(column)
    n = len(column)
    starts, ends, row = words_of(data, off)
    h = span_hash(data, starts, ends)
    words = np.bincount(row, minlength=n)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])  # continuation bytes are no code points
    chars = (points[ends] - points[starts]).astype(float)
    word_chars = np.bincount(row, chars, n)
    out = {"n_words": words.astype(np.int64), "word_chars": word_chars.astype(np.int64), "n_symbols": row_sums(_SYMBOL[data], off)}
    # lines: from a row's start or a \n to the next \n or the row's end
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([off[:-1], breaks + 1]))
    line_end = np.append(line_start[1:], len(data))
    line_row = np.searchsorted(off, line_start, side="right") - 1
    line_end = np.minimum(line_end, off[np.minimum(line_row + 1, n)])
    is_break = np.zeros(len(data) + 1, bool)
    is_break[breaks] = True
    line_end = line_end - ((line_end > line_start) & is_break[np.maximum(line_end - 1, 0)])
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    ls, le, lr = line_start[has_word], line_end[has_word], line_row[has_word]
    lh = span_hash(data, ls, le)
    order = np.lexsort((np.arange(len(lh)), lh, lr))
    again = np.zeros(len(lh), bool)
    if len(lh):
        again[order[1:]] = (lh[order][1:] == lh[order][:-1]) & (lr[order][1:] == lr[order][:-1])
    out["n_dup_lines"] = np.bincount(lr[again], minlength=n).astype(np.int64)
    line_chars = np.zeros(len(h))
    for s, e in zip(ls[again], le[again]):
        a, b = np.searchsorted(starts, (s, e))
        line_chars[a:b] = chars[a:b]
    some = np.maximum(word_chars, 1)
    out["dup_line_share"] = np.bincount(row, line_chars, n) / some
    for k in NGRAMS:
        cover = covered_words(h, row, k)
        out[f"share_{k}"] = np.bincount(row[cover], chars[cover], n) / some
        if k == 5:
            out["n_repeat_words"] = np.bincount(row[cover], minlength=n).astype(np.int64)
    out["base_failed"] = (words < MIN_WORDS) | (100 * out["n_repeat_words"] > REPEAT_PERCENT * words)
    return out


FIELDS = [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("base_failed", T.BooleanType()), T.StructField("dup_line_share", T.DoubleType())] + [T.StructField(f"share_{k}", T.DoubleType()) for k in NGRAMS] + [T.StructField("kept", T.BooleanType())]


def rules(docs: DataFrame, text_col: str = "text", limits: dict[int, float] | None = None, dup_line_share: float = DUP_LINE_SHARE) -> DataFrame:
    """docs with the measures and kept: not base_failed, and no share above its limit. One pass, no shuffle."""
    limits = {**NGRAMS, **(limits or {})}

    def make():
        def work(column):
            got = measure(column)
            bad = got["base_failed"] | (got["dup_line_share"] > dup_line_share)
            for k in NGRAMS:
                bad = bad | (got[f"share_{k}"] > limits[k])
            return got | {"kept": ~bad}

        return work

    return append_columns(docs, text_col, FIELDS, make)
