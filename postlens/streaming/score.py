"""Stateless scoring of a stream of documents: style and coverage need one row at a time, so there is no state or watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import detector, style


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id bigint, text string, language string", files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score(docs: DataFrame, text_col: str = "text", language_col: str = "language") -> DataFrame:
    """Works on streams and tables alike: all of it is projection."""
    return detector.coverage(style.scan(docs, text_col, language_col), text_col, language_col)


def start(docs: DataFrame, out: str, checkpoint: str):
    """Scores to Parquet, exactly once; available data only."""
    scored = score(docs).select("doc_id", "language", "han", "coverage", "style_patterns", "style_occurrences", "style_assessment")
    return scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
