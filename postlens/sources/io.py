"""Readers and writers: cases in JSON, strict and lenient JSONL, image bytes, predictions and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.provenance import MAX_BYTES
from ..operators.validation import case_violations, read_cases


def cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cases, faults) of one case a file: rows of CASE_SCHEMA that break no rule, named by their file, and (case_id, ord, path, rule) of the others; a file that is no JSON is a fault too."""
    read = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("case_id"), F.col("value").alias("json"))
    return read_cases(read), case_violations(read, "json")


def _object(line: str):
    """Whether a line is a JSON object; one with a key twice is none."""
    return F.rlike(line, F.lit(r"^\s*\{")) & F.try_parse_json(line).isNotNull()


def numbered_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(lines, starts) of text files, however they are split: lines have file, block and nth; starts (file, block, before) tells how many lines stand before nth 0 of a block.

    A split of a file is read by one task in order, so a line's place in it needs no
    exchange: the task's own numbering, less that of the block's first line. What
    is exchanged is one row for each block; its lines are counted without reading a column.
    """
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select("value", *meta, F.monotonically_increasing_id().alias("nth"))
    blocks = lines.groupBy("file", "block").agg(F.min("nth").alias("first"), F.count("*").alias("lines"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block of a file
    return lines, blocks.select("file", "block", (F.coalesce(F.sum("lines").over(earlier), F.lit(0)) - F.col("first")).alias("before"))


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, faults): parsed objects of non-blank lines, and (file, line_number, rule, line) of the lines that are no JSON object.

    Numbers count from 1 over the whole file, blank lines included. rule: json or
    object; a file without a non-blank line is a fault (empty) without number and line.
    """
    lines, starts = numbered_lines(spark, path)
    told = lines.where(F.trim("value") != "")
    rows = told.where(_object("value")).select(F.from_json("value", schema).alias("r")).select("r.*")
    name = F.element_at(F.split("file", "/"), -1).alias("file")
    wrong = told.where(~_object("value")).join(starts, ["file", "block"])  # faults only: a few rows meet a row for each block
    rule = F.when(F.try_parse_json("value").isNull(), "json").otherwise("object").alias("rule")
    faults = wrong.select(name, (F.col("nth") + F.col("before") + 1).alias("line_number"), rule, F.col("value").alias("line"))
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    none = F.lit(None).cast("string")
    empty = files.join(told.select("file").distinct(), "file", "left_anti").select(name, F.lit(None).cast("long").alias("line_number"), F.lit("empty").alias("rule"), none.alias("line"))
    return rows, faults.unionByName(empty)


def lenient_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all non-blank lines, whatever their fields; a line that is no JSON object (an array of objects is none) stops the query, so none is lost unseen."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    sound = lines.where(F.when(_object("value"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("malformed line, no JSON object: "), F.left("value", F.lit(200)))).cast("boolean")))
    return sound.select(F.from_json("value", schema).alias("r")).select("r.*")


def media(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(file_name, content, size_bytes) of image files up to max_bytes (pushed to the listing), and one row without content for each larger; directories are dropped."""
    files = spark.read.format("binaryFile").load(path)
    fits = files.where(F.col("length") <= max_bytes).select(F.col("_metadata.file_name").alias("file_name"), "content", F.col("length").alias("size_bytes"))
    large = files.where(F.col("length") > max_bytes).select(F.col("_metadata.file_name").alias("file_name"), F.lit(None).cast("binary").alias("content"), F.col("length").alias("size_bytes"))
    return fits.unionByName(large)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_markdown(df: DataFrame, path: str, column: str = "markdown") -> None:
    df.select(column).write.text(path, lineSep="\n\n")
