"""Queries of the benchmark evaluator."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from .views import MANIFEST_SQL, documents, manifest, predictions, rated

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {MANIFEST_SQL}{sql}"
        return f

    return register


@query("SELECT group_id, count(DISTINCT split) AS splits FROM manifest GROUP BY group_id HAVING count(DISTINCT split) > 1")
def group_leakage(spark, sf_dir):
    return E.leaking_groups(manifest(spark, sf_dir))


@query("""SELECT id, 'blind_not_locked' AS rule FROM manifest WHERE split = 'blind' AND NOT locked_blind
UNION ALL SELECT id, 'pure_sentences_differ' FROM manifest WHERE gold_label IN ('human', 'ai') AND len(list_filter(sentence_labels, lambda x: x <> gold_label)) > 0
UNION ALL SELECT id, 'group_leakage' FROM manifest WHERE group_id IN (SELECT group_id FROM manifest GROUP BY group_id HAVING count(DISTINCT split) > 1)""")
def manifest_violations(spark, sf_dir):
    return E.manifest_violations(manifest(spark, sf_dir))


@query("""SELECT id, 'predicted_label' AS rule FROM predictions WHERE predicted_label = 'bot'
UNION ALL SELECT id, 'sentence_length' FROM manifest JOIN predictions USING (id) WHERE gold_label = 'mixed' AND len(sentence_labels) <> len(sentence_predictions)
UNION ALL SELECT id, 'unknown_id' FROM (SELECT CAST(doc_id + 5000000000 AS VARCHAR) AS id FROM documents WHERE doc_id % 100 = 1)
UNION ALL SELECT id, 'duplicate_id' FROM (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE doc_id % 100 = 3 AND doc_id % 29 <> 0)""")
def prediction_violations(spark, sf_dir):
    p = predictions(spark, sf_dir)
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    none = F.lit(None).cast("array<string>").alias("sentence_predictions")
    strange = d.where("doc_id % 100 = 1").select((F.col("doc_id") + 5000000000).cast("string").alias("id"), F.lit("ai").alias("predicted_label"), none)
    again = d.where("doc_id % 100 = 3 and doc_id % 29 <> 0").select(F.col("doc_id").cast("string").alias("id"), F.lit("ai").alias("predicted_label"), none)
    return E.prediction_violations(manifest(spark, sf_dir), p.unionByName(strange).unionByName(again))


@query("SELECT id FROM manifest m WHERE split = 'blind' AND id NOT IN (SELECT id FROM predictions)")
def missing_predictions(spark, sf_dir):
    return E.missing_predictions(manifest(spark, sf_dir), predictions(spark, sf_dir), "blind")


@query("""SELECT gold_label, predicted_label, coalesce(n, 0) AS n FROM (SELECT * FROM (SELECT unnest(['human', 'ai', 'mixed']) AS gold_label), (SELECT unnest(['human', 'ai', 'mixed', 'abstain']) AS predicted_label)) AS cells
LEFT JOIN (SELECT gold_label, predicted_label, count(*) AS n FROM rated GROUP BY ALL) AS counted USING (gold_label, predicted_label)""")
def confusion_matrix(spark, sf_dir):
    return E.confusion(rated(spark, sf_dir))


def _metrics(source: str, keys: str) -> str:
    return f"""SELECT {keys}, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr,
round(2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), 6) AS f1 FROM {source}"""


_ROUNDED = ("precision", "recall", "fpr", "f1")


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in _ROUNDED})


@query(", x AS (SELECT label, count(*) FILTER (gold_label = label AND predicted_label = label) AS tp, count(*) FILTER (gold_label <> label AND predicted_label = label) AS fp, count(*) FILTER (gold_label = label AND predicted_label <> label) AS fn, count(*) FILTER (gold_label <> label AND predicted_label <> label) AS tn FROM rated, (SELECT unnest(['human', 'ai', 'mixed']) AS label) GROUP BY label) " + _metrics("x", "label"))
def per_class_metrics(spark, sf_dir):
    return rounded(E.per_class(rated(spark, sf_dir)))


_BINARY = """count(*) AS sample_count, count(*) FILTER (gold_label <> 'human' AND predicted_label IN ('ai', 'mixed')) AS tp, count(*) FILTER (gold_label = 'human' AND predicted_label IN ('ai', 'mixed')) AS fp,
count(*) FILTER (gold_label <> 'human' AND predicted_label NOT IN ('ai', 'mixed')) AS fn, count(*) FILTER (gold_label = 'human' AND predicted_label NOT IN ('ai', 'mixed')) AS tn, count(*) FILTER (predicted_label = 'abstain') AS abstentions,
count(*) FILTER (gold_label = 'human') AS n_human, count(*) FILTER (gold_label <> 'human') AS n_assisted"""
_KEYS = "sample_count, abstentions, n_human, n_assisted, round(abstentions / sample_count, 6) AS abstention_rate"


@query(f", x AS (SELECT {_BINARY} FROM rated) " + _metrics("x", _KEYS))
def ai_assisted_metrics(spark, sf_dir):
    return rounded(E.assisted(rated(spark, sf_dir))).withColumn("abstention_rate", F.round("abstention_rate", 6))


_SLICES = ", x AS (" + " UNION ALL ".join(f"SELECT '{name}' AS slice, {field} AS value, {_BINARY} FROM rated GROUP BY {field}" for name, field in E.SLICES.items()) + ") "


@query(_SLICES + _metrics("x", "slice, value, " + _KEYS))
def slice_metrics(spark, sf_dir):
    return rounded(E.slices(rated(spark, sf_dir))).withColumn("abstention_rate", F.round("abstention_rate", 6))


_FLAT = ", flat AS (" + " UNION ALL ".join(f"SELECT '{name}' AS slice, {field} AS value, gold_label, predicted_label FROM rated" for name, field in E.SLICES.items()) + ")"


@query(_FLAT + """ SELECT slice, value, g AS gold_label, p AS predicted_label, count(*) FILTER (gold_label = g AND predicted_label = p) AS n
FROM flat, (SELECT unnest(['human', 'ai', 'mixed']) AS g), (SELECT unnest(['human', 'ai', 'mixed', 'abstain']) AS p) GROUP BY ALL""")
def slice_confusion(spark, sf_dir):
    return E.slice_confusion(rated(spark, sf_dir))


@query(_FLAT + """, x AS (SELECT slice, value, label, count(*) FILTER (gold_label = label AND predicted_label = label) AS tp, count(*) FILTER (gold_label <> label AND predicted_label = label) AS fp, count(*) FILTER (gold_label = label AND predicted_label <> label) AS fn, count(*) FILTER (gold_label <> label AND predicted_label <> label) AS tn
FROM flat, (SELECT unnest(['human', 'ai', 'mixed']) AS label) GROUP BY slice, value, label) """ + _metrics("x", "slice, value, label"))
def slice_class_metrics(spark, sf_dir):
    return rounded(E.slice_per_class(rated(spark, sf_dir)))


_MIXED = """, d AS (SELECT count(*) AS mixed_document_count, count(sentence_predictions) AS evaluated_document_count FROM rated WHERE gold_label = 'mixed'),
z AS (SELECT unnest(sentence_labels) AS g, unnest(sentence_predictions) AS p FROM rated WHERE gold_label = 'mixed' AND sentence_predictions IS NOT NULL),
x AS (SELECT d.*, count(*) AS sentence_count, count(*) FILTER (p = 'abstain') AS sentence_abstentions, count(*) FILTER (g = 'ai' AND p = 'ai') AS tp, count(*) FILTER (g = 'human' AND p = 'ai') AS fp, count(*) FILTER (g = 'ai' AND p <> 'ai') AS fn, count(*) FILTER (g = 'human' AND p <> 'ai') AS tn FROM d, z GROUP BY ALL) """


@query(_MIXED + _metrics("x", "mixed_document_count, evaluated_document_count, sentence_count, sentence_abstentions, round(evaluated_document_count / mixed_document_count, 6) AS document_coverage, round(sentence_abstentions / sentence_count, 6) AS sentence_abstention_rate"))
def mixed_sentence_metrics(spark, sf_dir):
    return rounded(E.mixed_sentences(rated(spark, sf_dir))).withColumns({c: F.round(c, 6) for c in ("document_coverage", "sentence_abstention_rate")})


@query(f"""{_MIXED.replace(', x AS', ', mx AS').replace(chr(10) + 'x AS', chr(10) + 'mx AS')}, al AS (SELECT {_BINARY} FROM rated WHERE split = 'blind'), lg AS (SELECT language, {_BINARY} FROM rated WHERE split = 'blind' GROUP BY language),
g AS (SELECT 'overall' AS scope, 'locked_blind_only' AS gate, CAST(CASE WHEN count(*) > 0 AND bool_and(locked_blind) THEN 1 ELSE 0 END AS DOUBLE) AS value, '>=' AS operator, CAST(1 AS DOUBLE) AS threshold FROM rated WHERE split = 'blind'
UNION ALL SELECT 'overall', 'ai_assisted_fpr', fp / nullif(fp + tn, 0), '<=', 0.1 FROM al UNION ALL SELECT 'overall', 'ai_assisted_precision', tp / nullif(tp + fp, 0), '>=', 0.8 FROM al
UNION ALL SELECT 'overall', 'ai_assisted_recall', tp / nullif(tp + fn, 0), '>=', 0.5 FROM al UNION ALL SELECT 'overall', 'abstention_rate', abstentions / sample_count, '<=', 0.6 FROM al
UNION ALL SELECT 'overall', 'mixed_sentence_f1', 2 * (tp / nullif(tp + fp, 0)) * (tp / nullif(tp + fn, 0)) / nullif(tp / nullif(tp + fp, 0) + tp / nullif(tp + fn, 0), 0), '>=', 0.6 FROM mx
UNION ALL SELECT 'overall', 'mixed_sentence_coverage', evaluated_document_count / nullif(mixed_document_count, 0), '>=', 1.0 FROM mx
UNION ALL SELECT language, 'human_sample_count', n_human, '>=', 100 FROM lg UNION ALL SELECT language, 'ai_assisted_sample_count', n_assisted, '>=', 100 FROM lg
UNION ALL SELECT language, 'fpr', fp / nullif(fp + tn, 0), '<=', 0.1 FROM lg UNION ALL SELECT language, 'recall', tp / nullif(tp + fn, 0), '>=', 0.5 FROM lg)
SELECT scope, gate, round(value, 6) AS value, operator, threshold, coalesce(CASE operator WHEN '<=' THEN value <= threshold ELSE value >= threshold END, false) AS passed FROM g""".replace("FROM rated WHERE gold_label = 'mixed'", "FROM rated WHERE split = 'blind' AND gold_label = 'mixed'"))
def release_gates(spark, sf_dir):
    return E.release_gates(rated(spark, sf_dir).where("split = 'blind'"), "blind").withColumn("value", F.round("value", 6))


SQL["release_status"] = f"SELECT CASE WHEN bool_and(passed) THEN 'pass' ELSE 'fail' END AS status, bool_or(gate = 'locked_blind_only' AND passed) AS release_eligible FROM ({SQL['release_gates']})"


@query()
def release_status(spark, sf_dir):
    return E.release_status(E.release_gates(rated(spark, sf_dir).where("split = 'blind'"), "blind"))


def _field(name: str) -> str:
    return f"""coalesce('"{name}":' || CAST(to_json({name}) AS VARCHAR), '')"""


_CANONICAL = "'{' || " + " || ',' || ".join(_field(c) for c in ("editorial_state", "genre", "gold_label", "group_id", "id", "language", "length_bucket", "locked_blind", "model_family", "platform")) + """ || CASE WHEN sentence_labels IS NULL THEN '' ELSE ',"sentence_labels":' || CAST(to_json(sentence_labels) AS VARCHAR) END || ',' || """ + _field("split") + " || '}'"


@query(f" SELECT sha256(string_agg({_CANONICAL}, chr(10) ORDER BY id)) AS manifest_sha256 FROM manifest")
def manifest_digest(spark, sf_dir):
    return E.manifest_digest(manifest(spark, sf_dir))


@query(""", j AS (SELECT CAST(doc_id AS VARCHAR) AS id, replace(CAST(to_json(chr(1) || chr(31) || '"/' || text) AS VARCHAR), '\\u001F', '\\u001f') AS t, doc_id AS k FROM documents)
SELECT id, sha256('{"a":{"b":null,"c":[1,1.5,100.0,-0.0,{"x":"é","y":true}],"d":{}},"id":"' || id || '","text":' || t || ',"z":' || k || '}') AS sha256 FROM j""")
def canonical_json(spark, sf_dir):
    """Digests of nested rows as they came: keys in any order at every depth, explicit nulls, numbers and escapes in other forms."""
    text = F.to_json(F.struct(F.concat(F.lit("\x01\x1f\"/"), F.col("text")).alias("text")))
    rows = documents(spark, sf_dir, "doc_id", "text").select(F.col("doc_id").cast("string").alias("id"), F.concat(F.lit('{"z" : '), F.col("doc_id").cast("string"), F.lit(', "a":{"d":{ },"c":[1, 1.50,1e2,-0.0, {"y":true,"x":"\\u00E9"}],"b":null},"id":"'), F.col("doc_id").cast("string"), F.lit('",'), F.substring(text, F.lit(2), F.length(text) - 1)).alias("json"))
    return E.row_digests(rows, "json")


@query("SELECT split, count(*) AS records, count(DISTINCT group_id) AS groups FROM manifest GROUP BY split")
def split_counts(spark, sf_dir):
    return E.split_counts(manifest(spark, sf_dir))
