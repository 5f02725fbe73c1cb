"""Exact deduplication by distributed most-significant-digit radix partitioning of whole texts.

Texts are compared as the bytes of their normal form (A-Z lower-cased). A round
splits every open group by its next digit, `width` successive bytes: rows of one
group that also agree in this digit are a group of the next round. A group closes

* as a singleton, once no other row shares all digits so far, or
* as ended, once its digit is shorter than the width: then its rows have no more
  bytes and are equal.

Digits get GROWTH times wider each round, so that even a text of a gigabyte is
through after six rounds, while most texts are singletons after the first, which
looks at FIRST bytes. Bytes meet as bytes: equality needs no digest. Groups get a
number from the table of the round's groups, which is written and so never
renumbered when executors are lost.

A round counts (group, digit) pairs with a partial count in each task, so a
group of a third of all rows arrives as one row a task, and keeps only the pairs
of several rows. They are joined back by sorting and merging, where adaptive
execution can deal out the rows of a large group, as its other side is a written
table. Open rows carry only the bytes that no round has looked at, so a text is
shuffled once, and again only as far as it agrees with another. The SHA-256 of
the text is for the output.

Defined results: a null text is an empty one; a null id is smaller than any
other; of rows equal in text and id one is kept. Every row gets a result row;
an empty table gives none.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_folder, written

#: Bytes of the first digit, and how much wider each further one is.
FIRST, GROWTH = 64, 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CLOSED = ("rid", "id", "sha", "carried", "keep_id", "group_size", "kept")


def normalised(text_col: str):
    """The bytes of a text, A-Z lower-cased and nothing else; none for null."""
    return F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), _UPPER, _LOWER).cast("binary")


def digit(data, width: int) -> tuple:
    """The first `width` bytes of data, and the bytes after them."""
    return F.substring(data, F.lit(1), F.lit(width)), F.substring(data, F.lit(width + 1), F.greatest(F.octet_length(data) - width, F.lit(0)))


def split(rows: DataFrame, width: int, first: bool) -> tuple[DataFrame, DataFrame]:
    """(open, closed) after splitting the groups of rows by their digits of `width` bytes; open rows have their next digit.

    The first round reads the rows twice and only its result has fixed row
    numbers, so there ended rows stay open: in the next one their digit is empty.
    """
    spark = rows.sparkSession
    top = F.max(F.struct("id", (F.lit(None).cast("long") if first else F.col("rid")).alias("rid")))
    groups = written(rows.groupBy("gid", "block").agg(F.count("*").alias("n"), top.alias("top")).where("n > 1").withColumn("next", F.monotonically_increasing_id()))
    block, rest = digit(F.col("rest"), width * GROWTH)
    alone = F.col("n").isNull()
    # Closed rows are done with their bytes, open ones without a result: each keeps only its own columns.
    still = ~alone & (F.lit(first) | (F.octet_length("block") == width))
    # One plan at every size: sorted and merged, so that adaptive execution can deal out the rows of a large group.
    out = rows.join(groups.hint("merge"), ["gid", "block"], "left").select(
        "rid", "id", "sha", "carried", F.when(still, F.col("next")).alias("gid"), F.when(still, block).alias("block"), F.when(still, rest).alias("rest"),
        F.when(alone, F.col("id")).otherwise(F.col("top.id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"), (alone | (F.col("top.rid") == F.col("rid"))).alias("kept"), still.cast("int").alias("open"),
    )
    path = f"{shared_folder(spark)}/radix-{uuid.uuid4()}"
    out.write.partitionBy("open").parquet(path, compression="zstd")
    done = spark.read.schema(out.schema).parquet(path)  # the schema is given, as an empty table leaves no file
    return done.where("open = 1").select("rid", "id", "sha", "carried", "gid", "block", "rest"), done.where("open = 0").select(*_CLOSED)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), first: int = FIRST) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) and the columns in carry, a row for each of docs; one row of each group of equal texts is kept, that of the largest id.

    A carried column that has the name of an output column is replaced by the output.
    """
    out = {id_col.lower(), "keep_id", "group_size", "kept", "text_sha256"}
    carry = tuple(c for c in carry if c.lower() not in out)
    data = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("long").alias("id"), normalised(text_col).alias("data"),
        (F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("boolean")).alias("carried"),
    )
    block, rest = digit(F.col("data"), first)
    # all rows are one group, with their first digit
    rows = data.select("rid", "id", F.unhex(F.sha2("data", 256)).alias("sha"), "carried", F.lit(0).cast("long").alias("gid"), block.alias("block"), rest.alias("rest"))
    width, closed = first, []
    while not closed or not rows.isEmpty():
        rows, done = split(rows, width, first=not closed)
        closed.append(done)
        width *= GROWTH
    every = reduce(DataFrame.unionByName, closed)
    return every.select(F.col("id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"), *[F.col(f"carried.`{c}`").alias(c) for c in carry])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns; a column with the name of one of the operator's outputs is kept too."""
    packed = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return deduplicate(packed, "id", "text", ("row",)).where("kept").select("row.*")
