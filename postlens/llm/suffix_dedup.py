"""Substring deduplication by a distributed, common-prefix-aware merge sort of suffixes.

A byte is removed if a string of `window` bytes that covers it also starts
earlier: in a document of smaller id, or earlier in its own. Sorting a suffix
at every byte would move each text some hundred times over, so the sort is sparse, and
loses nothing:

1. Anchors. Of each window, the first K-gram of least hash is its anchor (a
   minimizer), which depends on the window's content alone: equal windows have
   their anchor at the same place. About one byte in 35 is an anchor.
2. Anchors whose K-gram occurs once in the corpus cannot lie in a repeated
   window. They are found by one shuffle on the K-gram's hash; a K-gram that
   repeats inside a task is sent once, however often it occurs there.
3. Units. Each surviving anchor becomes the suffix that starts at it, with the
   bytes before it that its windows reach. A task sorts its units, drops
   those equal to an earlier one (all their windows are repeated), and sends for
   each partition of anchors a sorted run: front-coded (length of the prefix
   shared with the suffix before, then the rest) and compressed.
4. A partition merges its runs by a loser tree that carries for each run the
   prefix it is known to share with the last winner. The longer such prefix wins
   at once; only equal ones are compared, from there on.
5. Neighbours in that order that share less than K bytes share no window. The
   windows of the others are told apart by 64-bit hashes of their bytes; all but
   the first of equal windows are removed.
6. Removed intervals go back to their documents, which are cut.

An anchor that occurs very often (a common 32-byte passage in differing
surroundings) is no single group: its units are cut in PIECES and dealt by the 77
bytes or more that all windows of a piece hold. A piece whose bytes are still
common (a passage of 80 or 95 bytes, as license lines and templates have) is cut
into its windows, each dealt by all of its WINDOW bytes. What then meets at one place
are equal windows alone, of which a task sends one. The merge has a partition for
each PARTITION_BYTES of text.

Windows, and rows by id and text, are told apart by 64-bit hashes; a text may
have 256 MB at most, a longer one is an error.

Defined results: null and empty texts have no bytes; texts shorter than the
window lose nothing; rows with equal id and equal text are one place, so
neither removes the other, and each gets a result row; a null id sorts last.
Any bytes may occur; cuts may split UTF-8 sequences, so what is kept is bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, pieces, small_batches, utf8, written

WINDOW, K = 100, 32
SPAN = WINDOW - K  # an anchor is at most so far from its window's start
#: Anchors or units that a task holds before it gives out what it has.
HELD_ANCHORS, HELD_UNITS = 1 << 19, 60_000
#: Units whose windows are told apart at once.
BLOCK_UNITS = 8192
#: Text bytes for each partition of the merge, and so the most that a task merges of anchors that are not hot.
PARTITION_BYTES = 64 << 20
#: An anchor is hot from HOT_LEAST occurrences, or more where a corpus would else have over HOT_MOST hot ones; a task reports counts from HOT_LOCAL.
HOT_LEAST, HOT_MOST, HOT_LOCAL = 10_000, 20_000, 32
#: Largest distances from an anchor to the starts of the windows of each piece of a hot unit; a piece is hot from the count of a hot anchor.
PIECES = (22, 45, SPAN)
_BASE = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1


def rolling(data: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of all n-byte strings, by doubling."""
    power, width = np.uint64(_BASE), 1
    block = mix64(data.astype(np.uint64) + np.uint64(1))
    out, have, bits = None, 0, n
    with np.errstate(over="ignore"):
        while True:
            if bits & 1:
                if out is None:
                    out, have = block, width
                else:
                    m = len(data) - have - width + 1
                    out = out[:m] * power + block[have : have + m]
                    have += width
            bits >>= 1
            if not bits:
                return mix64(out)
            m = len(data) - 2 * width + 1
            block = block[:m] * power + block[width : width + m]
            power, width = power * power, 2 * width


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n values in a row."""
    width = 1
    while 2 * width <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    rest = n - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, K-gram hash, anchor, first window, last window), positions within data, in order of the windows."""
    none = np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none, none.view(np.uint64), none, none, none
    if len(data) >= 1 << 28:
        raise ValueError("a text has 256 MB or more")
    grams = rolling(data, K)
    where = np.arange(len(grams), dtype=np.uint64)
    at = (least_of((grams & ~np.uint64((1 << 28) - 1)) | where, SPAN + 1) & np.uint64((1 << 28) - 1)).astype(np.int64)
    size = off[1:] - off[:-1]
    rows = np.flatnonzero(size >= WINDOW)
    if not len(rows):
        return none, none.view(np.uint64), none, none, none
    counts = size[rows] - WINDOW + 1
    row = np.repeat(rows, counts)
    window = np.repeat(off[rows] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))
    anchor = at[window]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])])) if len(anchor) else none
    last = np.append(first[1:], len(anchor)) - 1
    return row[first], grams[anchor[first]], anchor[first], window[first], window[last]


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rk, id, text): rk stands for the id and the text of a row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)), F.xxhash64(text), F.octet_length(text)).alias("rk"), F.col(id_col).cast("long").alias("id"), text.alias("text"))


def repeated_anchors(rows: DataFrame, parts: int) -> DataFrame:
    """(rk, pos, null) of the anchors whose K-gram occurs elsewhere too, and (null, count, hash) of K-grams that a task met often."""

    def find(batches):
        held, n = [], 0

        def give():
            h, rk, pos = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(h, kind="stable")
            h, rk, pos = h[order], rk[order], pos[order]
            same = np.concatenate([[False], h[1:] == h[:-1]])
            flag = np.where(same, 2, np.where(np.append(same[1:], False), 1, 0)).astype(np.int32)
            key = h.copy()
            # known to repeat: goes to any partition
            key[same] = mix64(rk[same].view(np.uint64) + pos[same].astype(np.uint64))
            first = np.flatnonzero(~same)
            count = np.diff(np.append(first, len(h)))
            often = count >= HOT_LOCAL
            # a hot anchor's count goes as a row without a text
            null = np.concatenate([np.zeros(len(h), bool), np.ones(int(often.sum()), bool)])
            both = lambda a, b: np.concatenate([a, b])
            columns = [
                pa.array(both(key, h[first[often]]).view(np.int64)), pa.array(both(rk, np.zeros(int(often.sum()), np.int64)), mask=null),
                pa.array(both(pos, count[often].astype(np.int32))), pa.array(both(flag, np.full(int(often.sum()), 1, np.int32))),
            ]
            return pa.RecordBatch.from_arrays(columns, names=["h", "rk", "pos", "flag"])

        for batch in batches:
            for piece in pieces(batch, "text"):
                data, off = utf8(piece.column("text"))
                row, h, anchor, _, _ = anchors(data, off)
                if len(row):
                    held.append((h, piece.column("rk").to_numpy()[row], (anchor - off[row]).astype(np.int32)))
                    n += len(row)
                if n >= HELD_ANCHORS:
                    yield give()
                    held, n = [], 0
        if held:
            yield give()

    def choose(batches):
        # sorted by h; the last group of a batch may go on, so its first row waits
        last, waiting = None, None
        for batch in batches:
            h, pos, flag = (batch.column(c).to_numpy() for c in ("h", "pos", "flag"))
            if not len(h):
                continue
            nulls = batch.column("rk").is_null().to_numpy(zero_copy_only=False)
            rk = batch.column("rk").fill_null(0).to_numpy()
            start = np.concatenate([[True], h[1:] != h[:-1]])
            group = np.cumsum(start) - 1
            size = np.bincount(group)
            good = (size > 1) | (np.bincount(group, flag) > 0)
            goes_on = last is not None and h[0] == last
            if goes_on:
                good[0] = True
            keep = good[group]
            out_rk, out_pos, out_h, out_null = rk[keep], pos[keep], h[keep], nulls[keep]
            if waiting is not None and goes_on:
                out_rk, out_pos, out_h, out_null = np.append(out_rk, waiting[0]), np.append(out_pos, waiting[1]), np.append(out_h, last), np.append(out_null, False)
            end_alone = not good[-1]
            waiting = (rk[-1], pos[-1]) if end_alone else None
            last = h[-1]
            yield pa.RecordBatch.from_arrays([pa.array(out_rk, mask=out_null), pa.array(out_pos.astype(np.int32)), pa.array(out_h, mask=~out_null)], names=["rk", "pos", "h"])

    found = rows.select("rk", "text").mapInArrow(find, "h long, rk long, pos int, flag int")
    return found.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(choose, "rk long, pos int, h long")


def ragged_index(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All indexes from start to start + size, span after span."""
    total = np.cumsum(size)
    return np.repeat(start - total + size, size) + np.arange(int(total[-1]))


def ragged(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes data[start : start + size] of all spans, end to end."""
    if not len(size) or not size.any():
        return np.zeros(0, np.uint8)
    return data[ragged_index(start, size)]


def united(rk: np.ndarray, begin: np.ndarray, end: np.ndarray, part: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Intervals of each rk with those that touch joined, in order of a partition of theirs, and those partitions."""
    by = np.lexsort((begin, rk))
    rk, begin, end, part = rk[by], begin[by], end[by], part[by]
    first = np.flatnonzero(np.concatenate([[True], (rk[1:] != rk[:-1]) | (begin[1:] > end[:-1])])) if len(rk) else np.zeros(0, np.int64)
    end = np.maximum.reduceat(end, first) if len(first) else end
    rk, begin, part = rk[first], begin[first], part[first]
    by = np.argsort(part, kind="stable")
    return {"rk": rk[by], "from": begin[by], "to": end[by]}, part[by]


class Units:
    """Units as columns: suffix x (from the anchor) and left (bytes before it) as padded matrices."""

    FIXED = (("x_size", np.uint8), ("left_size", np.uint8), ("windows", np.uint8), ("start", np.int32), ("order", np.int64), ("rk", np.int64))

    def __init__(self) -> None:
        self.parts: list[dict[str, np.ndarray]] = []
        self.n = 0

    def add(self, data: np.ndarray, off: np.ndarray, row, h, anchor, first, last, rk: np.ndarray, order: np.ndarray) -> None:
        """h decides the partition: equal windows must have equal h."""
        left_size, x_size = anchor - first, last + WINDOW - anchor
        n = len(row)
        x, left = np.zeros((n, WINDOW), np.uint8), np.zeros((n, SPAN), np.uint8)
        column = np.arange(WINDOW)
        inside = column < x_size[:, None]
        x[inside] = ragged(data, anchor, x_size)
        inside = column[:SPAN] < left_size[:, None]
        left[inside] = ragged(data, first, left_size)
        self.parts.append({"x": x, "left": left, "h": h, "x_size": x_size.astype(np.uint8), "left_size": left_size.astype(np.uint8), "windows": (last - first + 1).astype(np.uint8), "start": (first - off[row]).astype(np.int32), "order": order[row], "rk": rk[row]})
        self.n += n

    def runs(self, partitions: int):
        """(partition, block) of each sorted run; equal units are sent once, as intervals otherwise."""
        c = {k: np.concatenate([p[k] for p in self.parts]) for k in self.parts[0]}
        part = (c["h"] >> np.uint64(33)).astype(np.int64) % partitions
        by_place = np.lexsort((c["start"], c["order"]))
        c, part = {k: v[by_place] for k, v in c.items()}, part[by_place]
        text = np.concatenate([c["x"], c["left"], c["x_size"][:, None], c["left_size"][:, None], np.ones((self.n, 1), np.uint8)], axis=1)
        text_order = np.argsort(np.ascontiguousarray(text).view(f"S{text.shape[1]}").ravel(), kind="stable")
        order = text_order[np.argsort(part[text_order], kind="stable")]
        c, part, text = {k: v[order] for k, v in c.items()}, part[order], text[order]
        same = np.concatenate([[False], (text[1:] == text[:-1]).all(1) & (part[1:] == part[:-1])])
        # of equal units the first place stands first (stable sorts); one at the same place (equal rows) is no later
        head = np.maximum.accumulate(np.where(same, 0, np.arange(self.n)))
        later = same & ((c["order"] != c["order"][head]) | (c["start"] != c["start"][head]))
        cover, cover_part = united(c["rk"][later], c["start"][later], c["start"][later] + c["windows"][later].astype(np.int32) + np.int32(WINDOW - 1), part[later])
        kept = np.flatnonzero(~same)
        c, part = {k: v[kept] for k, v in c.items()}, part[kept]
        lcp = np.zeros(len(kept), np.int64)
        if len(kept) > 1:
            differ = c["x"][1:] != c["x"][:-1]
            lcp[1:] = np.where(differ.any(1), differ.argmax(1), WINDOW)
            lcp[1:] = np.minimum(lcp[1:], np.minimum(c["x_size"][1:], c["x_size"][:-1]))
            lcp[1:][part[1:] != part[:-1]] = 0
        edges = np.searchsorted(part, np.arange(partitions + 1))
        cover_edges = np.searchsorted(cover_part, np.arange(partitions + 1))
        squeeze = zstandard.ZstdCompressor(level=1)
        for p in range(partitions):
            a, b, ca, cb = edges[p], edges[p + 1], cover_edges[p], cover_edges[p + 1]
            if a == b and ca == cb:
                continue
            column = np.arange(WINDOW)
            x_size = c["x_size"][a:b].astype(np.int64)
            tails = c["x"][a:b][(column >= lcp[a:b, None]) & (column < x_size[:, None])]
            left = c["left"][a:b][column[:SPAN] < c["left_size"][a:b, None]]
            fields = [np.array([b - a, cb - ca, len(tails), len(left)], np.int64), lcp[a:b].astype(np.uint8), *(c[k][a:b].astype(t) for k, t in self.FIXED), tails, left, cover["rk"][ca:cb], cover["from"][ca:cb], cover["to"][ca:cb]]
            yield p, squeeze.compress(b"".join(np.ascontiguousarray(f).tobytes() for f in fields))


def unpacked(block: bytes) -> dict[str, np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(block), 32, {}
    n, n_cover, n_tails, n_left = np.frombuffer(raw, np.int64, 4)
    for name, kind, size in (("lcp", np.uint8, n), *((k, t, n) for k, t in Units.FIXED), ("tails", np.uint8, n_tails), ("left", np.uint8, n_left), ("cover_rk", np.int64, n_cover), ("cover_from", np.int32, n_cover), ("cover_to", np.int32, n_cover)):
        out[name] = np.frombuffer(raw, kind, int(size), at)
        at += out[name].nbytes
    return out


def suffixes(run: dict[str, np.ndarray]) -> list[bytes]:
    """The front-coded suffixes of a run, whole."""
    raw, at, out, before = run["tails"].tobytes(), 0, [], b""
    for shared, size in zip(run["lcp"].tolist(), run["x_size"].tolist()):
        end = at + size - shared
        before = before[:shared] + raw[at:end]
        out.append(before)
        at = end
    return out


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of a and b, of which known bytes are known to agree."""
    end = min(len(a), len(b))
    if a[known:end] == b[known:end]:
        return end
    low, high = known, end  # agree up to low, differ before high
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def merged(strings: list[list[bytes]], lcps: list[list[int]]):
    """(run, index, prefix shared with the string before) in sorted order, by a loser tree over sorted runs.

    lcps[r][i]: prefix that strings[r][i] shares with strings[r][i - 1].
    """
    runs = len(strings)
    leaves = 1
    while leaves < max(runs, 1):
        leaves *= 2
    at = [0] * leaves
    shared = [0] * leaves  # with the last winner, or with the one it lost to
    head = [strings[r][0] if r < runs and strings[r] else None for r in range(leaves)]
    loser = [0] * leaves

    def beats(a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; the loser learns what it shares with the winner."""
        x, y = head[a], head[b]
        if y is None:
            return True
        if x is None:
            return False
        if shared[a] != shared[b]:
            return shared[a] > shared[b]
        n = common_prefix(x, y, shared[a])
        first = x[n : n + 1] <= y[n : n + 1] if x[n : n + 1] != y[n : n + 1] else (a < b)
        shared[b if first else a] = n
        return first

    def play(node: int) -> int:
        if node >= leaves:
            return node - leaves
        a, b = play(2 * node), play(2 * node + 1)
        if beats(a, b):
            loser[node] = b
            return a
        loser[node] = a
        return b

    winner = play(1)
    while head[winner] is not None:
        i = at[winner]
        yield winner, i, shared[winner]
        at[winner] = i = i + 1
        if i < len(strings[winner]):
            head[winner], shared[winner] = strings[winner][i], lcps[winner][i]
        else:
            head[winner] = None
        node = (winner + leaves) // 2
        current = winner
        while node:
            other = loser[node]
            y = head[other]
            if y is not None:
                x = head[current]
                if x is None or shared[other] > shared[current] or (shared[other] == shared[current] and not beats(current, other)):
                    loser[node] = current
                    current = other
            node //= 2
        winner = current


def removed_by(runs: list[dict[str, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rk, from, to) of the removed intervals of a partition's runs."""
    out = [(r["cover_rk"], r["cover_from"].astype(np.int64), r["cover_to"].astype(np.int64)) for r in runs if len(r["cover_rk"])]
    runs = [r for r in runs if len(r["lcp"])]
    if runs:
        base = np.cumsum([0, *(len(r["lcp"]) for r in runs)])
        strings = [suffixes(r) for r in runs]
        rows, shared = [], []
        starts = base.tolist()
        for r, i, n in merged(strings, [r["lcp"].tolist() for r in runs]):
            rows.append(starts[r] + i)
            shared.append(n)
        rows, shared = np.array(rows), np.array(shared)
        c = {k: np.concatenate([r[k] for r in runs]) for k, _ in Units.FIXED}
        x = np.frombuffer(b"".join(s for one in strings for s in one), np.uint8)
        left = np.concatenate([r["left"] for r in runs])
        del strings
        x_size, left_size = c["x_size"].astype(np.int64), c["left_size"].astype(np.int64)
        x_at, left_at = np.cumsum(x_size) - x_size, np.cumsum(left_size) - left_size
        # units that share K bytes with a neighbour form groups; whole groups make blocks of bounded size
        start = np.flatnonzero(np.concatenate([[True], shared[1:] < K]))
        size = np.diff(np.append(start, len(rows)))
        start, size = start[size > 1], size[size > 1]
        total = np.cumsum(size)
        for g in np.split(np.arange(len(size)), np.flatnonzero(np.diff(total // BLOCK_UNITS)) + 1):
            if len(g):
                pick = rows[ragged_index(start[g], size[g])]
                pick = pick[np.lexsort((c["start"][pick], c["order"][pick]))]
                out += window_intervals(pick, c, x, x_at, x_size, left, left_at, left_size)
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    rk, a, b = (np.concatenate(v) for v in zip(*out))
    return rk, a, b


def window_intervals(pick, c, x, x_at, x_size, left, left_at, left_size):
    """Intervals of the windows that also start earlier, of the units pick (in order of place)."""
    if not len(pick):
        return []
    size = left_size[pick] + x_size[pick]
    ends = np.cumsum(size)
    begin = ends - size
    both = np.empty(int(ends[-1]), np.uint8)
    inside = np.arange(len(both)) - np.repeat(begin, size)
    is_left = inside < np.repeat(left_size[pick], size)
    both[is_left] = ragged(left, left_at[pick], left_size[pick])
    both[~is_left] = ragged(x, x_at[pick], x_size[pick])
    hashes = rolling(both, WINDOW)
    windows = c["windows"][pick].astype(np.int64)
    unit = np.repeat(np.arange(len(pick)), windows)
    inside = np.arange(len(unit)) - np.repeat(np.cumsum(windows) - windows, windows)
    h = hashes[begin[unit] + inside]
    place, order = c["start"][pick][unit] + inside, c["order"][pick][unit]
    by = np.argsort(h, kind="stable")  # within equal ones, by place
    same = np.concatenate([[False], h[by][1:] == h[by][:-1]])
    head = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]
    later = np.zeros(len(h), bool)
    later[by] = same & ((order[by] != order[head]) | (place[by] != place[head]))
    at = np.flatnonzero(later)
    if not len(at):
        return []
    rk = c["rk"][pick][unit]
    fresh = np.concatenate([[True], (rk[at][1:] != rk[at][:-1]) | (place[at][1:] > place[at][:-1] + WINDOW)])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1
    return [(rk[at[first]], place[at[first]].astype(np.int64), place[at[last]].astype(np.int64) + WINDOW)]


def cut_pieces(data: np.ndarray, row, anchor, first, last):
    """(row, key, anchor, first, last) of the pieces of units; the key is a hash of the bytes that all windows of a piece hold.

    A piece has the windows that start between two of PIECES before the anchor,
    so equal windows are in pieces of one kind and hold the same bytes there.
    """
    out, nearest = [], 0
    for farthest in PIECES:
        a, b = np.maximum(first, anchor - farthest), np.minimum(last, anchor - nearest)
        some = a <= b
        out.append((row[some], spans_hashed(data, anchor[some] - nearest, WINDOW - (farthest - nearest), farthest), anchor[some], a[some], b[some]))
        nearest = farthest + 1
    return tuple(np.concatenate(c) for c in zip(*out))


def spans_hashed(data: np.ndarray, begin: np.ndarray, size: int, salt: int) -> np.ndarray:
    value = np.zeros(len(begin), np.uint64)
    for k in range(size):
        value = value * np.uint64(_BASE) + (data[begin + k].astype(np.uint64) + np.uint64(1))
    return mix64(value + np.uint64(salt))


def pieces_of_hot(data: np.ndarray, hot: np.ndarray, hot_pieces: np.ndarray, row, h, anchor, first, last):
    """The units with those of hot anchors cut in pieces, and hot pieces cut in windows; each dealt by a hash of what its windows share."""
    is_hot = np.isin(h, hot)
    if not is_hot.any():
        return row, h, anchor, first, last
    out = [tuple(c[~is_hot] for c in (row, h, anchor, first, last))]
    cut = cut_pieces(data, *(c[is_hot] for c in (row, anchor, first, last)))
    again = np.isin(cut[1], hot_pieces)
    out.append(tuple(c[~again] for c in cut))
    row, _, anchor, first, last = (c[again] for c in cut)
    if len(row):
        count = last - first + 1
        each = np.repeat(np.arange(len(row)), count)
        window = ragged_index(first, count)
        out.append((row[each], spans_hashed(data, window, WINDOW, 0), anchor[each], window, window))
    return tuple(np.concatenate(c) for c in zip(*out))


def common_pieces(rows: DataFrame, hot: np.ndarray, least: int) -> np.ndarray:
    """Keys of the pieces of hot anchors that occur `least` times; as pieces are at most len(PIECES) times the anchors, no more than that many times HOT_MOST."""
    if not len(hot):
        return np.zeros(0, np.uint64)

    def count(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            for piece in pieces(batch, "text"):
                row, h, anchor, first, last = anchors(*utf8(piece.column("text")))
                mine = np.isin(h, hot)
                if mine.any():
                    held.append(cut_pieces(utf8(piece.column("text"))[0], *(c[mine] for c in (row, anchor, first, last)))[1])
                if sum(map(len, held)) >= HELD_ANCHORS:
                    yield told(held)
                    held = []
        if held:
            yield told(held)

    def told(held):
        key, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= HOT_LOCAL
        return pa.RecordBatch.from_arrays([pa.array(key[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["h", "n"])

    found = rows.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return np.array([r["h"] for r in found.select("h").collect()], np.int64).view(np.uint64)


def removed_intervals(rows: DataFrame) -> DataFrame:
    """(rk, from, to), intervals of bytes to remove; they may overlap."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-size // PARTITION_BYTES))
    repeated = written(repeated_anchors(rows, parts))
    # at most HOT_MOST rows, as about one byte in 35 is an anchor
    least = max(HOT_LEAST, size // 32 // HOT_MOST)
    hot = np.array([r["h"] for r in repeated.where("rk is null").groupBy("h").agg(F.sum("pos").alias("n")).where(F.col("n") >= least).select("h").collect()], np.int64).view(np.uint64)
    hot_pieces = common_pieces(rows, hot, least)
    chosen = repeated.where("rk is not null").groupBy("rk").agg(F.collect_set("pos").alias("pos"))  # a text's anchors, at most its length

    def sort(batches):
        units = Units()
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, off = utf8(piece.column("text"))
                row, h, anchor, first, last = anchors(data, off)
                pos = piece.column("pos")
                flat = pos.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.diff(pos.offsets.to_numpy()) if len(pos) else np.zeros(0, np.int64)
                want = np.repeat(off[:-1], sizes) + flat
                good = np.isin(anchor, want)
                order = piece.column("id").fill_null(_LAST).to_numpy()
                if good.any():
                    units.add(data, off, *pieces_of_hot(data, hot, hot_pieces, row[good], h[good], anchor[good], first[good], last[good]), piece.column("rk").to_numpy(), order)
                if units.n >= HELD_UNITS:
                    yield from packed(units)
                    units = Units()
        if units.n:
            yield from packed(units)

    def packed(units: Units):
        got = list(units.runs(parts))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int32()), pa.array([b for _, b in got], pa.binary())], names=["part", "block"])

    def merge(batches):
        runs: dict[int, list] = {}
        for batch in batches:
            for p, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist()):
                runs.setdefault(p, []).append(block)
        for blocks in runs.values():
            rk, a, b = removed_by([unpacked(x) for x in blocks])
            yield pa.RecordBatch.from_arrays([pa.array(rk), pa.array(a), pa.array(b)], names=["rk", "from", "to"])

    blocks = rows.join(chosen, "rk").select("rk", "id", "text", "pos").mapInArrow(sort, "part int, block binary")
    return blocks.repartition(parts, "part").mapInArrow(merge, "rk long, from long, to long")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept binary) of each row."""
    small_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    spans = removed_intervals(rows).groupBy("rk").agg(F.collect_list(F.struct("from", "to")).alias("spans"))  # bounded by the text
    out = T.StructType([T.StructField(id_col, T.LongType())] + [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.BinaryType())])

    def cut(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                data, off = utf8(piece.column("text"))
                raw, columns = data.tobytes(), ([], [], [], [])
                for i, spans_of in enumerate(piece.column("spans").to_pylist()):
                    text = raw[off[i] : off[i + 1]]
                    kept, at, removed, count, end = [], 0, 0, 0, -1
                    for a, b in sorted((s["from"], s["to"]) for s in spans_of or ()):
                        if a > end:
                            kept.append(text[at:a])
                            count += 1
                            at = a
                        end = max(end, b)
                        removed += max(0, b - at)
                        at = max(at, b)
                    kept.append(text[at:])
                    for column, value in zip(columns, (len(text), removed, count, b"".join(kept))):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([piece.column("id"), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary())], names=out.names)

    return rows.join(spans, "rk", "left").select("id", "text", "spans").mapInArrow(cut, out)
