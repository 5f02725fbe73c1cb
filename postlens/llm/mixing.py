"""Mixing sources to target weights: subset-sum budget fitting over exact token lengths.

1. Documents are counted by source and exact size (words); everything after
   that works on these counts until documents are chosen.
2. Targets: the sources' weights share the total of all sizes; a target above
   `max_repeats` times its source's size stops there and the excess is shared
   again by weight, until none is above.
3. A source's target is met by whole repeats of all its documents and a
   remaining budget below its size. The budget takes the same share of each
   length's documents (rounded down), and bounded-knapsack dynamic programming
   over the documents left fits what then remains, to the word where the
   lengths allow it.
4. Of each (source, length) group the documents of smallest seeded hash are
   chosen. Groups are cut into hash ranges of about `group_rows` rows; whole
   ranges are decided by their counts, and only the range in which the limit
   falls is ranked. What is taken of each group is broadcast, for the hot groups
   at least, so a length shared by any number of documents never meets in one
   task.

Defined results: null and empty texts have size 0 and take 0 words; a null
source is a source of its own, last in order; a source of size 0 has target 0;
rows that repeat an id count each, equal ones are interchangeable; empty tables
give empty results; of `keep`, columns that have the name of an output column
are replaced. The number of sources is a driver-side list, bounded by
`max_sources`.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh

#: Words of remaining budget up to which the dynamic programme runs; wider budgets were narrowed by shares before.
MAX_BUDGET = 1 << 16
#: Most (source, length) groups that go to each executor; more are joined by a shuffle, but for the hot ones.
BROADCAST_ROWS = 100_000


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep, source, size): size counts the words of the text, 0 for null."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(id_col, *keep, F.col(source_col).cast("string").alias("source"), size.alias("size"))


def by_code_point(sources: list[str | None]) -> list[str | None]:
    return sorted((s for s in sources if s is not None)) + [None] * (None in sources)


def default_weights(sources: list[str | None]) -> dict[str | None, float]:
    """1, 2, 3, repeating, by code point, null last."""
    return {s: float(k % 3 + 1) for k, s in enumerate(by_code_point(sources))}


def targets(size: dict[str | None, int], weight: dict[str | None, float], max_repeats: float = 3.0) -> dict[str | None, float]:
    """What each source gives to a mix as large as all sources together."""
    total = float(sum(size.values()))
    fixed: dict[str | None, float] = {}
    free = [s for s in by_code_point(list(size))]
    while free:
        rest, shares = total - sum(fixed.values()), sum(weight[s] for s in free)
        given = {s: rest * weight[s] / shares for s in free}
        above = [s for s in free if given[s] > max_repeats * size[s]]
        if not above:
            return fixed | given
        fixed |= {s: float(max_repeats * size[s]) for s in above}
        free = [s for s in free if s not in above]
    return fixed


def fit_budget(length: np.ndarray, count: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to budget, not above it.

    Shares first: the same part of each length, rounded down, and bounded
    knapsack over the documents left. Where few documents are left and the
    budget is not met to the word, the shares are halved and then left out, and
    the nearest sum stays; without shares it is the nearest of all, for a budget
    of up to MAX_BUDGET words.
    """
    total = int((length * count).sum())
    if budget <= 0 or not total:
        return np.zeros(len(length), np.int64)
    if budget >= total:
        return np.where(length > 0, count, 0)
    best, got = None, -1
    for part in (1.0, 0.5, 0.0):
        take = (count * (part * budget / total)).astype(np.int64)
        take[length == 0] = 0
        take = fill(length, count, take, budget - int((length * take).sum()))
        if (words := int((length * take).sum())) > got:
            best, got = take, words
        if got == budget:
            break
    return best


def fill(length: np.ndarray, count: np.ndarray, take: np.ndarray, rest: int) -> np.ndarray:
    """take with documents added whose words come nearest to rest.

    Where rest exceeds MAX_BUDGET, longest lengths first take what fits until it
    doesn't. Then bounded knapsack, counts split in powers of two.
    """
    take = take.copy()
    for k in np.argsort(-length, kind="stable"):
        if rest <= MAX_BUDGET or length[k] == 0:
            break
        more = min(int(count[k] - take[k]), (rest - MAX_BUDGET // 2) // int(length[k]))
        if more > 0:
            take[k] += more
            rest -= more * int(length[k])
    # from the shortest up: few short documents fill what is left to the word
    parts: list[tuple[int, int, int]] = []  # (index, documents, words)
    for k in np.argsort(length, kind="stable"):
        free, size = int(count[k] - take[k]), int(length[k])
        if not size or size > rest:
            continue
        free = min(free, rest // size)
        step = 1
        while free > 0:
            n = min(step, free)
            parts.append((int(k), n, n * size))
            free -= n
            step *= 2
    reached = np.full(rest + 1, -1, np.int64)  # the part that first reached a sum
    reached[0] = -2
    for number, (_, _, words) in enumerate(parts):
        if words > rest or reached[rest] != -1:
            continue
        fresh = np.flatnonzero((reached[:-words] != -1) & (reached[words:] == -1)) + words
        reached[fresh] = number
    at = int(np.flatnonzero(reached != -1)[-1])
    while at:
        k, n, words = parts[reached[at]]
        take[k] += n
        at -= words
    return take


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = (), weight: dict[str | None, float] | None = None, max_repeats: int = 3, seed: int = 8, max_sources: int = 100_000, group_rows: int = 2000, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(id, keep, source, size, source_size, target, copies, taken) of each document; taken = size * copies. keep: further columns to pass on."""
    keep = tuple(c for c in keep if c not in (id_col, "source", "size", "source_size", "target", "copies", "taken"))
    h = fresh("_h", docs.columns)
    hashed = docs.withColumn(h, F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), *keep))
    sized = sizes(hashed, id_col, text_col, source_col, (h, *keep))
    # nulls as '' beside a flag, so that sources join by plain equality
    rows = checkpointed(sized.select(id_col, *keep, F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("src"), "size", F.col(h).alias("h")))
    group = ["none", "src", "size"]
    counts = rows.groupBy(*group).agg(F.count("*").alias("n"))
    by_source = counts.groupBy("none", "src").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n"), F.count("*").alias("lengths")).limit(max_sources + 1).collect()
    if len(by_source) > max_sources:
        raise ValueError(f"more than max_sources = {max_sources} sources")
    size = {None if r["none"] else r["src"]: int(r["words"]) for r in by_source}
    target = targets(size, weight or default_weights(list(size)), max_repeats)
    plan = [(s is None, s or "", size[s], float(target[s]), int(min(max_repeats, target[s] // size[s] if size[s] else 0))) for s in size]
    plan_df = docs.sparkSession.createDataFrame(plan, "none boolean, src string, source_size long, target double, full int")

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # one row for each length of the source: at most as many as its longest document has words
        size, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        budget = float(pdf["target"].iloc[0]) - int(pdf["full"].iloc[0]) * int((size * n).sum())
        return pdf.assign(take=fit_budget(size, n, int(round(budget))))

    # plan_df has at most max_sources rows
    planned = counts.join(F.broadcast(plan_df), ["none", "src"]).select(*group, "n", "source_size", "target", "full")
    quota = planned.groupBy("none", "src").applyInPandas(choose, "none boolean, src string, size long, n long, source_size long, target double, full int, take long")
    quota = checkpointed(quota.withColumn("ranges", F.ceil(F.col("n") / F.lit(group_rows)).cast("long")))
    # groups above this size are at most broadcast_rows, and so broadcast; smaller ones are no hot keys
    total, lengths = sum(r["n"] for r in by_source), sum(r["lengths"] for r in by_source)
    hot = 0 if lengths <= broadcast_rows else -(-total // broadcast_rows)
    joined = rows.join(F.broadcast(quota.where(F.col("n") > hot)), group, "left")
    if hot:
        others = joined.where("n is null").select(*rows.columns).join(quota.where(F.col("n") <= hot), group)
        joined = joined.where("n is not null").unionByName(others)
    part = joined.withColumn("part", F.pmod("h", F.col("ranges")))
    out = [id_col, *keep, *group, "source_size", "target", "full"]
    whole = part.where("take = 0 or take = n").select(*out, (F.col("take") > 0).cast("int").alias("more"))
    # rows equal in all that counts are one from here on, with how often they occur
    cut = part.where("take > 0 and take < n").groupBy(*out, "take", "part", "h").agg(F.count("*").alias("m"))
    before = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = part.where("take > 0 and take < n").groupBy(*group, "part").agg(F.count("*").alias("here")).withColumn("before", F.coalesce(F.sum("here").over(before), F.lit(0)))
    above = Window.partitionBy(*group, "part").orderBy("h", id_col).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.join(ranges, [*group, "part"]).withColumn("left", F.col("take") - F.col("before") - F.coalesce(F.sum("m").over(above), F.lit(0)))
    chosen = ranked.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), "m"))).select(*out, (F.col("k") <= F.col("left")).cast("int").alias("more"))
    copies = F.when(F.col("size") > 0, F.least(F.col("full") + F.col("more"), F.lit(max_repeats))).otherwise(0).cast("long")
    return whole.unionByName(chosen).withColumn("copies", copies).select(id_col, *keep, F.when(~F.col("none"), F.col("src")).alias("source"), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
