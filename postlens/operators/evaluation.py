"""Benchmark evaluation: manifest checks, leakage, joined metrics, slices, mixed sentences and release gates.

All of it is relational. Slices, sentences and gates come from one cube of the joined
rows (the slice fields by both labels, counted in the tasks before its one
exchange); what is grouped further are its few cells.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..functions.typed import canonical

GOLD = ("human", "ai", "mixed")
PREDICTED = ("human", "ai", "mixed", "abstain")
SPLITS = ("calibration", "blind")
SLICES = {"language": "language", "platform": "platform", "genre": "genre", "length": "length_bucket", "model_family": "model_family", "editorial_state": "editorial_state"}
REQUIRED = ("id", "gold_label", *SLICES.values(), "group_id", "split")

#: Release gates.
GATES = {
    "max_ai_assisted_fpr": 0.10, "min_ai_assisted_precision": 0.80, "min_ai_assisted_recall": 0.50, "max_abstention_rate": 0.60,
    "min_mixed_sentence_f1": 0.60, "min_mixed_sentence_coverage": 1.0, "min_human_per_language": 100, "min_ai_assisted_per_language": 100,
}


def _violations(rows: DataFrame, checks: list[tuple[str, Column]]) -> DataFrame:
    """(id, rule) for each check that holds."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks]))
    return rows.select(F.col("id"), F.explode(broken).alias("rule"))


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """(id, rule) of each rule that a row breaks, duplicates and leaking groups included."""
    blank = [(f"blank:{c}", F.col(c).isNull() | (F.trim(c) == "")) for c in REQUIRED]
    labels = F.col("sentence_labels")
    other = [
        ("gold_label", ~F.col("gold_label").isin(*GOLD)),
        ("split", ~F.col("split").isin(*SPLITS)),
        ("locked_blind_missing", F.col("locked_blind").isNull()),
        ("blind_not_locked", (F.col("split") == "blind") & ~F.col("locked_blind")),
        ("sentence_labels_empty", F.size(labels) == 0),
        ("sentence_label_value", F.exists(labels, lambda x: ~x.isin("human", "ai"))),
        ("mixed_without_sentences", (F.col("gold_label") == "mixed") & labels.isNull()),
        ("mixed_needs_both", (F.col("gold_label") == "mixed") & labels.isNotNull() & ~(F.array_contains(labels, "human") & F.array_contains(labels, "ai"))),
        ("pure_sentences_differ", F.col("gold_label").isin("human", "ai") & F.exists(labels, lambda x: x != F.col("gold_label"))),
    ]
    twice = manifest.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("rule"))
    leaking = manifest.join(leaking_groups(manifest), "group_id", "left_semi").select("id", F.lit("group_leakage").alias("rule"))
    return _violations(manifest, blank + other).unionByName(twice).unionByName(leaking)


def leaking_groups(manifest: DataFrame) -> DataFrame:
    """(group_id, splits) of groups in more than one split."""
    return manifest.groupBy("group_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def prediction_violations(manifest: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, rule): unknown ids, duplicates, labels outside the contract."""
    unknown = predictions.join(manifest, "id", "left_anti").select("id", F.lit("unknown_id").alias("rule"))
    twice = predictions.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("rule"))
    s = F.col("sentence_predictions")
    values = _violations(predictions, [("predicted_label", F.col("predicted_label").isNull() | ~F.col("predicted_label").isin(*PREDICTED)), ("sentence_prediction_value", F.exists(s, lambda x: ~x.isin("human", "ai", "abstain"))), ("sentence_predictions_empty", F.size(s) == 0)])
    lengths = joined(manifest, predictions).where(F.col("gold_label") == "mixed").where(F.size("sentence_labels") != F.size("sentence_predictions")).select("id", F.lit("sentence_length").alias("rule"))
    return unknown.unionByName(twice).unionByName(values).unionByName(lengths)


def missing_predictions(manifest: DataFrame, predictions: DataFrame, split: str) -> DataFrame:
    return manifest.where(F.col("split") == split).join(predictions, "id", "left_anti").select("id")


def joined(manifest: DataFrame, predictions: DataFrame) -> DataFrame:
    """Manifest rows with their prediction; other columns of the predictions never override the manifest."""
    return manifest.join(predictions.select("id", "predicted_label", "sentence_predictions"), "id")


def confusion(rows: DataFrame) -> DataFrame:
    """(gold_label, predicted_label, n), all 12 cells."""
    cells = rows.sparkSession.createDataFrame([(g, p) for g in GOLD for p in PREDICTED], "gold_label string, predicted_label string")
    counted = rows.groupBy("gold_label", "predicted_label").agg(F.count("*").alias("n"))
    return cells.join(counted, ["gold_label", "predicted_label"], "left").fillna(0, ["n"])


def binary(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """precision, recall, fpr, f1; null where undefined."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "fpr": ratio(fp, fp + tn), "f1": ratio(2 * p * r, p + r)}


def _quadrants(positive: Column, predicted: Column) -> list[Column]:
    return [F.count_if(positive & predicted).alias("tp"), F.count_if(~positive & predicted).alias("fp"), F.count_if(positive & ~predicted).alias("fn"), F.count_if(~positive & ~predicted).alias("tn")]


def _with_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns(binary(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def per_class(rows: DataFrame) -> DataFrame:
    """One row a gold label, one against the rest."""
    label = F.col("label")
    spread = rows.select("gold_label", "predicted_label", F.explode(F.array(*[F.lit(g) for g in GOLD])).alias("label"))
    return _with_metrics(spread.groupBy("label").agg(*_quadrants(F.col("gold_label") == label, F.col("predicted_label") == label)))


_LABELS = "array<string>"
#: What a cell has beside n: rows that are no locked blind ones, mixed rows with sentence predictions, and their sentences.
_COUNTS = ("unlocked", "evaluated", "sentence_count", "sentence_abstentions", "s_tp", "s_fp", "s_fn", "s_tn")


def cells(rows: DataFrame) -> DataFrame:
    """The cube: (slice fields, gold_label, predicted_label) with n and _COUNTS. Columns that rows lack count as null."""
    have = lambda name, kind="string": (F.col(name) if name in rows.columns else F.lit(None).cast(kind)).alias(name)
    read = rows.select(*[have(f) for f in SLICES.values()], "gold_label", "predicted_label", have("split"), have("locked_blind", "boolean"), have("sentence_labels", _LABELS), have("sentence_predictions", _LABELS))
    told = (F.col("gold_label") == "mixed") & F.col("sentence_predictions").isNotNull()
    pairs = F.when(told, F.arrays_zip(F.col("sentence_labels").alias("gold"), F.col("sentence_predictions").alias("predicted")))
    many = lambda found: F.coalesce(F.size(found), F.lit(0))
    those = lambda gold, predicted: many(F.when(F.col("pairs").isNotNull(), F.filter("pairs", lambda x: (x["gold"] == "ai" if gold else x["gold"] != "ai") & (x["predicted"] == "ai" if predicted else x["predicted"] != "ai"))))
    sized = read.withColumn("pairs", pairs).withColumns({
        "unlocked": (~F.coalesce((F.col("split") == "blind") & F.col("locked_blind"), F.lit(False))).cast("int"), "evaluated": F.coalesce(told, F.lit(False)).cast("int"),
        "sentence_count": F.when(F.col("pairs").isNotNull(), F.size("pairs")).otherwise(0), "sentence_abstentions": F.when(F.col("pairs").isNotNull(), F.size(F.filter("pairs", lambda x: x["predicted"] == "abstain"))).otherwise(0),
        "s_tp": those(True, True), "s_fp": those(False, True), "s_fn": those(True, False), "s_tn": those(False, False),
    })
    return sized.groupBy(*SLICES.values(), "gold_label", "predicted_label").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in _COUNTS])


def _sum(when: Column, name: str) -> Column:
    """How many rows of cells hold a condition."""
    return F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias(name)


def _assisted() -> list[Column]:
    gold, predicted = F.col("gold_label").isin("ai", "mixed"), F.col("predicted_label").isin("ai", "mixed")
    four = [_sum(gold & predicted, "tp"), _sum(~gold & predicted, "fp"), _sum(gold & ~predicted, "fn"), _sum(~gold & ~predicted, "tn")]
    return [F.coalesce(F.sum("n"), F.lit(0)).alias("sample_count"), *four, _sum(F.col("predicted_label") == "abstain", "abstentions"), _sum(~gold, "n_human"), _sum(gold, "n_assisted")]


def _sentences() -> list[Column]:
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return [_sum(F.col("gold_label") == "mixed", "mixed_document_count"), total("evaluated", "evaluated_document_count"), total("sentence_count", "sentence_count"), total("sentence_abstentions", "sentence_abstentions"), *[total(f"s_{x}", f"s_{x}") for x in ("tp", "fp", "fn", "tn")]]


def assisted(rows: DataFrame) -> DataFrame:
    """The binary view: ai and mixed are positive, abstaining predicts negative."""
    return _with_metrics(cells(rows).agg(*_assisted())).withColumn("abstention_rate", ratio(F.col("abstentions"), F.col("sample_count")))


def _by_slice(cube: DataFrame, aggregates: list[Column]) -> DataFrame:
    """(slice, value) and aggregates of the cells of each value of each slice field: grouping sets over the cube."""
    fields = list(SLICES.values())
    grouped = cube.groupingSets([[F.col(f)] for f in fields], *[F.col(f) for f in fields]).agg(*aggregates, *[F.grouping(f).alias(f"_{f}") for f in fields])
    of = lambda then: F.coalesce(*[F.when(F.col(f"_{f}") == 0, then(name, f)) for name, f in SLICES.items()])
    return grouped.withColumns({"slice": of(lambda name, f: F.lit(name)), "value": of(lambda name, f: F.col(f))}).drop(*fields, *[f"_{f}" for f in fields])


def slices(rows: DataFrame) -> DataFrame:
    """(slice, value) and the binary view's metrics for each value of each slice field."""
    return _with_metrics(_by_slice(cells(rows), _assisted())).withColumn("abstention_rate", ratio(F.col("abstentions"), F.col("sample_count")))


def slice_confusion(rows: DataFrame) -> DataFrame:
    """(slice, value, gold_label, predicted_label, n), all 12 cells of each value."""
    counted = _by_slice(cells(rows), [_sum((F.col("gold_label") == g) & (F.col("predicted_label") == p), f"{g}:{p}") for g in GOLD for p in PREDICTED])
    each = F.array(*[F.struct(F.lit(g).alias("gold_label"), F.lit(p).alias("predicted_label"), F.col(f"{g}:{p}").alias("n")) for g in GOLD for p in PREDICTED])
    return counted.select("slice", "value", F.explode(each).alias("c")).select("slice", "value", "c.*")


def slice_per_class(rows: DataFrame) -> DataFrame:
    """(slice, value, label) with one-against-the-rest metrics."""
    gold, predicted = F.col("gold_label"), F.col("predicted_label")
    four = {"tp": lambda x: (gold == x) & (predicted == x), "fp": lambda x: (gold != x) & (predicted == x), "fn": lambda x: (gold == x) & (predicted != x), "tn": lambda x: (gold != x) & (predicted != x)}
    counted = _by_slice(cells(rows), [_sum(when(x), f"{x}:{name}") for x in GOLD for name, when in four.items()])
    each = F.array(*[F.struct(F.lit(x).alias("label"), *[F.col(f"{x}:{name}").alias(name) for name in four]) for x in GOLD])
    return _with_metrics(counted.select("slice", "value", F.explode(each).alias("c")).select("slice", "value", "c.*"))


def _with_sentence_metrics(df: DataFrame) -> DataFrame:
    got = _with_metrics(df.withColumns({x: F.col(f"s_{x}") for x in ("tp", "fp", "fn", "tn")}))
    return got.withColumns({"document_coverage": ratio(F.col("evaluated_document_count"), F.col("mixed_document_count")), "sentence_abstention_rate": ratio(F.col("sentence_abstentions"), F.col("sentence_count"))}).drop("s_tp", "s_fp", "s_fn", "s_tn")


def mixed_sentences(rows: DataFrame) -> DataFrame:
    """One row: sentence metrics of mixed documents; without predictions a document only lowers coverage."""
    return _with_sentence_metrics(cells(rows).agg(*_sentences()))


def release_gates(rows: DataFrame, split: str, gates: dict[str, float] | None = None) -> DataFrame:
    """(scope, gate, value, operator, threshold, passed); scope is overall or a language. A null value fails. One cube and one grouping of it."""
    g = {**GATES, **(gates or {})}
    spark = rows.sparkSession
    cube = cells(rows)
    # A cell of no rows, so that the overall gates are there (and fail) when nothing was evaluated.
    nothing = spark.range(1).select(*[F.lit(0).cast(f.dataType).alias(f.name) if f.name in ("n", *_COUNTS) else F.lit(None).cast(f.dataType).alias(f.name) for f in cube.schema.fields])
    told = cube.unionByName(nothing).groupingSets([[], [F.col("language")]], F.col("language")).agg(*_assisted(), *_sentences(), F.coalesce(F.sum("unlocked"), F.lit(0)).alias("unlocked"), F.grouping("language").alias("all_of_it"))
    b = binary(*[F.col(x) for x in ("tp", "fp", "fn", "tn")])
    s = binary(*[F.col(f"s_{x}") for x in ("tp", "fp", "fn", "tn")])
    cell = lambda name, value, op, limit: F.struct(F.lit(name).alias("gate"), value.cast("double").alias("value"), F.lit(op).alias("operator"), F.lit(float(limit)).alias("threshold"))
    overall = F.array(
        cell("locked_blind_only", (F.lit(split == "blind") & (F.col("sample_count") > 0) & (F.col("unlocked") == 0)).cast("int"), ">=", 1), cell("ai_assisted_fpr", b["fpr"], "<=", g["max_ai_assisted_fpr"]), cell("ai_assisted_precision", b["precision"], ">=", g["min_ai_assisted_precision"]),
        cell("ai_assisted_recall", b["recall"], ">=", g["min_ai_assisted_recall"]), cell("abstention_rate", ratio(F.col("abstentions"), F.col("sample_count")), "<=", g["max_abstention_rate"]),
        cell("mixed_sentence_f1", s["f1"], ">=", g["min_mixed_sentence_f1"]), cell("mixed_sentence_coverage", ratio(F.col("evaluated_document_count"), F.col("mixed_document_count")), ">=", g["min_mixed_sentence_coverage"]),
    )
    each = F.array(
        cell("human_sample_count", F.col("n_human"), ">=", g["min_human_per_language"]), cell("ai_assisted_sample_count", F.col("n_assisted"), ">=", g["min_ai_assisted_per_language"]),
        cell("fpr", b["fpr"], "<=", g["max_ai_assisted_fpr"]), cell("recall", b["recall"], ">=", g["min_ai_assisted_recall"]),
    )
    whole = F.col("all_of_it") == 1
    every = told.where(whole | (F.col("sample_count") > 0)).select(F.when(whole, "overall").otherwise(F.col("language")).alias("scope"), F.explode(F.when(whole, overall).otherwise(each)).alias("c")).select("scope", "c.*")
    held = F.when(F.col("operator") == "<=", F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return every.withColumn("passed", F.coalesce(held, F.lit(False)))


def release_status(gates: DataFrame) -> DataFrame:
    """(status, release_eligible): pass if all gates pass; eligible if the evaluation is of locked blind rows only."""
    return gates.agg(F.when(F.bool_and("passed"), "pass").otherwise("fail").alias("status"), F.bool_or((F.col("gate") == "locked_blind_only") & F.col("passed")).alias("release_eligible"))


def canonical_rows(rows: DataFrame, json_col: str | None = None) -> DataFrame:
    """(id, json): each row's canonical JSON. With json_col it is that of the JSON text as it came, explicit nulls kept; else that of the columns, null ones left out."""
    return rows.select("id", canonical(F.col(json_col) if json_col else F.to_json(F.struct(*rows.columns))).alias("json"))


def row_digests(manifest: DataFrame, json_col: str | None = None) -> DataFrame:
    """(id, sha256) of each row's canonical JSON."""
    return canonical_rows(manifest, json_col).select("id", F.sha2("json", 256).alias("sha256"))


def ordered_digest(lines: DataFrame, name: str, separator: str, start: str = "", end: str = "") -> DataFrame:
    """One row: sha256 of the JSON of lines (id, json) in order of id, joined. The digest of a sequence is one task's work; it sorts with spilling and holds one batch."""

    def run(batches):
        digest, first = hashlib.sha256(start.encode()), True
        for batch in batches:
            for line in batch.column("json").to_pylist():
                digest.update((line if first else separator + line).encode())
                first = False
        digest.update(end.encode())
        yield pa.RecordBatch.from_arrays([pa.array([digest.hexdigest()])], names=[name])

    return lines.repartition(1).sortWithinPartitions("id", "json").mapInArrow(run, f"{name} string")


def manifest_digest(manifest: DataFrame, json_col: str | None = None) -> DataFrame:
    """One row: manifest_sha256 of the canonical rows, one a line, in order of id."""
    return ordered_digest(canonical_rows(manifest, json_col), "manifest_sha256", "\n")


def split_counts(manifest: DataFrame) -> DataFrame:
    """(split, records, groups)."""
    return manifest.groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("group_id").alias("groups"))
