"""Auditable character n-gram naive Bayes: training counts, vocabulary, prediction with abstention, admission.

The model is two tables: parameters by class, and (token, label, n). N-grams
are counted inside the tasks, over code points in numpy, so that one row for
each distinct n-gram of some megabytes of text is shuffled. Prediction scores
each row where it is: the vocabulary is bounded by max_features and goes with
the tasks as a prefix table.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import model_text
from .evaluation import canonical_rows, ordered_digest

CLASSES = ("human", "ai", "mixed")
#: Training defaults.
NGRAM_MIN, NGRAM_MAX, ALPHA, MAX_FEATURES, MARGIN = 3, 5, 1.0, 50_000, 0.15
#: Fixed value: the longest n-gram that training accepts.
NGRAM_LIMIT = 8
#: Code points that a task turns into numpy arrays at once; one longer text is taken alone.
CHUNK = 1 << 20


def chunks(texts: list[str]) -> Iterator[tuple[int, str, np.ndarray]]:
    """(first row, texts end to end, their offsets) of about CHUNK code points each."""
    size = np.cumsum([0, *(len(t) for t in texts)])
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(size, size[start] + CHUNK, side="right")) - 1)
        yield start, "".join(texts[start:end]), size[start : end + 1] - size[start]
        start = end


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def placed_grams(text: str, off: np.ndarray, low: int, high: int) -> Iterator[tuple[str, int, int]]:
    """The distinct n-grams of all texts, each with how often it occurs and where first; none crosses from text to text."""
    alphabet, code = np.unique(code_points(text), return_inverse=True)
    size = len(alphabet)
    row_end = np.repeat(off[1:], np.diff(off))
    value, bound = code.astype(np.int64), size
    for n in range(1, high + 1):
        if n > 1:
            if bound * size >= 1 << 62:  # numbered anew, so that the next code point fits
                value = np.unique(value, return_inverse=True)[1]
                bound = len(value)
            value, bound = value[:-1] * size + code[n - 1 :], bound * size
        if not len(value):
            return
        if n >= low:
            inside = np.flatnonzero(np.arange(len(value)) + n <= row_end[: len(value)])
            _, first, count = np.unique(value[inside], return_index=True, return_counts=True)
            for i, k in zip(inside[first].tolist(), count.tolist()):
                yield text[i : i + n], k, i


def counted_grams(text: str, off: np.ndarray, low: int, high: int) -> Iterator[tuple[str, int]]:
    """The distinct n-grams of all texts, each with how often it occurs."""
    return ((token, k) for token, k, _ in placed_grams(text, off, low, high))


def training_violations(rows: DataFrame) -> DataFrame:
    """(id, rule) of rows that training must refuse, and of classes without rows (id null)."""
    checks = {
        "not_calibration": F.col("split") != "calibration", "gold_label": ~F.col("gold_label").isin(*CLASSES), "blank_id": F.col("id").isNull() | (F.trim("id") == ""),
        "blank_text": F.col("text").isNull() | (F.trim("text") == ""), "blank_group": F.col("group_id").isNull() | (F.trim("group_id") == ""), "blank_language": F.col("language").isNull() | (F.trim("language") == ""),
    }
    broken = rows.select("id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in checks.items()]))).alias("rule"))
    twice = rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit("duplicate_id").alias("rule"))
    wanted = rows.sparkSession.createDataFrame([(c,) for c in CLASSES], "gold_label string")
    absent = wanted.join(rows.select("gold_label").distinct(), "gold_label", "left_anti").select(F.lit(None).cast("string").alias("id"), F.concat(F.lit("class_absent:"), "gold_label").alias("rule"))
    return broken.unionByName(twice).unionByName(absent)


def token_counts(rows: DataFrame, low: int = NGRAM_MIN, high: int = NGRAM_MAX, order_col: str | None = None) -> DataFrame:
    """(label, token, n), and with order_col (a number for each row) `place`: (row, size, offset) where the token is met first when rows are read in that order.

    Places are minima, so any partitioning gives the same; within a row n-grams are met size by size.
    """

    def run(batches):
        for batch in batches:
            label, text = batch.column("label").to_pylist(), batch.column("text").to_pylist()
            order = batch.column("row").to_pylist() if order_col else range(len(text))
            for one in sorted(set(label), key=str):
                mine = sorted((r, t or "") for r, t, x in zip(order, text, label) if x == one)
                for start, joined, off in chunks([t for _, t in mine]):
                    got = list(placed_grams(joined, off, low, high))
                    columns = [pa.array([one] * len(got), pa.string()), pa.array([t for t, *_ in got], pa.string()), pa.array([k for _, k, _ in got], pa.int64())]
                    if order_col:
                        at = np.array([i for *_, i in got], np.int64)
                        of = np.searchsorted(off, at, side="right") - 1
                        row = np.array([r for r, _ in mine], np.int64)
                        columns += [pa.array(row[start + of]), pa.array(at - off[of])]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["label", "token", "n"] + (["row", "at"] if order_col else [])
    read = [F.col("gold_label").alias("label"), model_text("text").alias("text"), *([F.col(f"`{order_col}`").cast("long").alias("row")] if order_col else [])]
    counted = rows.select(*read).mapInArrow(run, ", ".join(f"{x} {'string' if x in ('label', 'token') else 'long'}" for x in names))
    first = [F.min(F.struct(F.col("row"), F.length("token").alias("size"), F.col("at"))).alias("place")] if order_col else []
    return counted.groupBy("label", "token").agg(F.sum("n").alias("n"), *first)


def _most(tokens: DataFrame, max_features: int) -> DataFrame:
    """The rows of largest total; of equal ones those that were met first where that is known, else by token."""
    return tokens.orderBy(F.desc("total"), *(["place"] if "place" in tokens.columns else []), "token").limit(max_features)


def _first_place(counts: DataFrame) -> list[Column]:
    return [F.min("place").alias("place")] if "place" in counts.columns else []


def vocabulary(counts: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """(token, total) of the most frequent tokens; ties by token, ascending, or by first place where counts have it."""
    return _most(counts.groupBy("token").agg(F.sum("n").alias("total"), *_first_place(counts)), max_features).select("token", "total")


@dataclass
class Bayes:
    classes: DataFrame  # label, documents, tokens
    counts: DataFrame  # token, and n of each class
    low: int
    high: int
    alpha: float


def train(rows: DataFrame, low: int = NGRAM_MIN, high: int = NGRAM_MAX, max_features: int = MAX_FEATURES, alpha: float = ALPHA, order_col: str | None = None) -> Bayes:
    """rows: id, gold_label, text, split, group_id, language; ValueError for settings out of bounds, and with the rule and id of a row that training_violations finds.

    order_col: a number for each row. With it, tokens of equal counts at the limit of max_features enter in the
    order in which they are met when rows are read by that number; without it, by token.
    """
    if not 1 <= low <= high <= NGRAM_LIMIT:
        raise ValueError(f"n-gram bounds must satisfy 1 <= low <= high <= {NGRAM_LIMIT}")
    if max_features < 100 or alpha <= 0:
        raise ValueError("max_features must be 100 or more, alpha positive")
    wrong = training_violations(rows).orderBy("rule", "id").limit(1).collect()
    if wrong:
        raise ValueError(f"training refuses a row: {wrong[0]['rule']} ({wrong[0]['id']})")
    n = lambda c: F.coalesce(F.sum(F.when(F.col("label") == c, F.col("n"))), F.lit(0))
    counts = token_counts(rows, low, high, order_col)
    wide = _most(counts.groupBy("token").agg(*[n(c).alias(c) for c in CLASSES], F.sum("n").alias("total"), *_first_place(counts)), max_features)
    spark = rows.sparkSession
    # at most max_features rows: counted once, then a small table
    kept = spark.createDataFrame(wide.select("token", *CLASSES).collect(), "token string, human long, ai long, mixed long")
    docs = spark.createDataFrame(rows.groupBy(F.col("gold_label").alias("label")).agg(F.count("*").alias("documents")).collect(), "label string, documents long")
    return Bayes(docs, kept, low, high, alpha)


def parameters(model: Bayes) -> dict[str, tuple[float, float]]:
    """(log prior, log denominator) of each class; a few numbers on the driver."""
    documents = {r["label"]: r["documents"] for r in model.classes.collect()}
    if set(documents) != set(CLASSES):
        raise ValueError(f"the model's classes must be {', '.join(CLASSES)}, not {', '.join(sorted(map(str, documents)))}")
    sums = model.counts.agg(F.count("*").alias("v"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in CLASSES]).first()
    total = sum(documents.values())
    return {c: (math.log(documents[c] / total), math.log(sums[c] + model.alpha * max(sums["v"], 1))) for c in CLASSES}


class Prefixes:
    """The vocabulary as a table for each length: sorted (prefix, next code point) pairs. A look-up of all n-grams at once is a bisection a length."""

    def __init__(self, tokens: list[str], weights: np.ndarray) -> None:
        self.weights = weights
        self.alphabet = np.unique(code_points("".join(tokens)))
        size = len(self.alphabet) + 1
        coded = [np.searchsorted(self.alphabet, code_points(t)).tolist() for t in tokens]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        number: dict[int, int] = {}
        prefix = [0] * len(tokens)
        for n in range(max(map(len, tokens), default=0)):
            pair = {i: prefix[i] * size + c[n] for i, c in enumerate(coded) if len(c) > n}
            keys = np.array(sorted(set(pair.values())), np.int64)
            number = {k: j for j, k in enumerate(keys.tolist())}
            token = np.full(len(keys), -1, np.int64)
            for i, k in pair.items():
                prefix[i] = number[k]
                if len(coded[i]) == n + 1:
                    token[number[k]] = i
            self.levels.append((keys, token))

    def sums(self, text: str, off: np.ndarray) -> np.ndarray:
        """Summed weights of the tokens that occur in each text, one column a class."""
        out = np.zeros((len(off) - 1, self.weights.shape[1]))
        if not len(self.alphabet) or not text:
            return out
        point = code_points(text)
        code = np.searchsorted(self.alphabet, point)
        code[code == len(self.alphabet)] = 0
        code[self.alphabet[code] != point] = len(self.alphabet)  # the number that no token has
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        at, prefix = np.arange(len(point)), np.zeros(len(point), np.int64)
        for n, (keys, token) in enumerate(self.levels):
            fits = at + n < off[row[at] + 1]
            at, prefix = at[fits], prefix[fits]
            key = prefix * (len(self.alphabet) + 1) + code[at + n]
            found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            same = keys[found] == key
            at, prefix = at[same], found[same]
            hit = token[prefix] >= 0
            for c in range(out.shape[1]):
                out[:, c] += np.bincount(row[at[hit]], self.weights[token[prefix[hit]], c], len(out))
        return out


def scorer(model: Bayes):
    """A function of texts to their unnormalised log posteriors, one column a class."""
    priors = parameters(model)
    got = model.counts.select("token", *CLASSES).toPandas()  # at most max_features rows
    weights = np.log(got[list(CLASSES)].to_numpy(float) + model.alpha) - np.array([priors[c][1] for c in CLASSES])
    table, prior = Prefixes(got["token"].tolist(), weights), np.array([priors[c][0] for c in CLASSES])

    def score(texts: list[str]) -> np.ndarray:
        parts = [table.sums(joined, off) for _, joined, off in chunks(texts)]
        return prior + np.concatenate([np.zeros((0, len(CLASSES))), *parts])

    return score


def log_scores(docs: DataFrame, model: Bayes, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, human, ai, mixed) of each row: unnormalised log posteriors; tokens outside the vocabulary are ignored, blank texts get nulls."""
    score = scorer(model)

    @F.pandas_udf("human double, ai double, mixed double")
    def scored(text: pd.Series) -> pd.DataFrame:
        texts = text.fillna("").tolist()
        got = score(texts)
        got[[not t for t in texts]] = np.nan
        return pd.DataFrame(got, columns=list(CLASSES))

    return docs.select(id_col, model_text(text_col).alias("_t")).select(id_col, scored("_t").alias("_s")).select(id_col, *[F.nanvl(F.col(f"_s.{c}"), F.lit(None)).alias(c) for c in CLASSES])


def decide(scores: DataFrame, margin: float = MARGIN) -> DataFrame:
    """scores as probabilities (sum 1, not calibrated), decision_margin, predicted_label (abstain below the margin)."""
    peak = F.greatest(*CLASSES)
    shares = scores.withColumns({c: F.exp(F.col(c) - peak) for c in CLASSES})
    total = sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0]))
    shares = shares.withColumns({c: F.col(c) / total for c in CLASSES})
    ranked = F.sort_array(F.array(*CLASSES), asc=False)
    best = F.greatest(*CLASSES)
    first = F.when(F.col("human") == best, "human").when(F.col("ai") == best, "ai").otherwise("mixed")
    gap = ranked[0] - ranked[1]
    return shares.withColumns({"decision_margin": gap, "predicted_label": F.when(gap >= margin, first).otherwise("abstain")})


def predict(docs: DataFrame, model: Bayes, id_col: str = "id", text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """decide() of each row; blank texts abstain with null scores."""
    return decide(log_scores(docs, model, id_col, text_col), margin)


def predict_sentences(rows: DataFrame, model: Bayes, id_col: str = "id", margin: float = MARGIN) -> DataFrame:
    """(id, sentence_predictions) of rows (id, sentences array): mixed counts as abstain; order kept, each row by itself."""
    score = scorer(model)

    @F.pandas_udf("array<string>")
    def labels(sentences: pd.Series) -> pd.Series:
        listed = [[] if x is None else ["" if t is None else t for t in x] for x in sentences]
        flat = [t for x in listed for t in x]
        share = np.exp((z := score(flat)) - z.max(1, initial=-np.inf, keepdims=True))
        share /= share.sum(1, keepdims=True)
        ranked = np.sort(share, 1)
        sure = (ranked[:, -1] - ranked[:, -2] >= margin) & (np.array([t != "" for t in flat], bool))
        name = np.array(["human", "ai", "abstain"], object)[share.argmax(1)]
        name[~sure] = "abstain"
        edge = np.cumsum([0, *map(len, listed)])
        return pd.Series([name[a:b].tolist() for a, b in zip(edge, edge[1:])], dtype=object)

    folded = rows.select(id_col, F.transform("sentences", lambda s: model_text(s)).alias("_s"))
    return folded.select(id_col, labels("_s").alias("sentence_predictions"))


def provenance_rows(rows: DataFrame) -> DataFrame:
    """(id, group_id, label, language, text_sha256) of training rows; the digest is of the text as the model reads it."""
    return rows.select("id", "group_id", F.col("gold_label").alias("label"), "language", F.sha2(model_text("text"), 256).alias("text_sha256"))


def corpus_digest(rows: DataFrame) -> DataFrame:
    """One row: training_corpus_sha256 of the provenance rows as a canonical JSON list, in order of id."""
    return ordered_digest(canonical_rows(provenance_rows(rows)), "training_corpus_sha256", ",", "[", "]")


def fingerprint(core: dict) -> str:
    """sha256 of canonical JSON: keys sorted, compact."""
    return hashlib.sha256(json.dumps(core, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def artifact(model: Bayes, rows: DataFrame) -> dict:
    """The model as one JSON object with its model_id; at most max_features tokens."""
    counts = model.counts.toPandas()
    core = {
        "schema_version": "1.0", "method": "char_ngram_multinomial_nb_v1", "ngram_min": model.low, "ngram_max": model.high, "alpha": model.alpha,
        "class_document_counts": {r["label"]: r["documents"] for r in model.classes.collect()},
        "class_token_counts": {c: {t: int(n) for t, n in zip(counts["token"], counts[c]) if n} for c in CLASSES},
        "languages": sorted(r[0] for r in rows.select("language").distinct().collect()), "training_corpus_sha256": corpus_digest(rows).first()[0],
    }
    return core | {"model_id": fingerprint(core)}


def is_untouched(model: dict) -> bool:
    """Whether an artifact has the schema and method, and the model_id of what it holds."""
    core = {k: v for k, v in model.items() if k != "model_id"}
    return model.get("schema_version") == "1.0" and model.get("method") == "char_ngram_multinomial_nb_v1" and model.get("model_id") == fingerprint(core)


def model_id(model: Bayes, rows: DataFrame) -> DataFrame:
    """One row: the artifact's model_id."""
    return rows.sparkSession.createDataFrame([(artifact(model, rows)["model_id"],)], "model_id string")


#: The checks that a release assessment must hold, no more and no less.
OVERALL_CHECKS = ("locked_blind_only", "ai_assisted_fpr", "ai_assisted_precision", "ai_assisted_recall", "abstention_rate", "mixed_sentence_f1", "mixed_sentence_coverage")
LANGUAGE_CHECKS = ("human_sample_count", "ai_assisted_sample_count", "fpr", "recall")


def admission_violations(reports: DataFrame) -> DataFrame:
    """(language, rule) of evaluation reports that do not admit a model for a language.

    reports: language, languages array, schema_version, selected_split, locked, manifest_sha256, record_count,
    release_eligible, status, evaluated_model_id, model_id, checks map<string, boolean>, language_checks map<string, boolean>.
    """
    complete = lambda c, names: (F.array_sort(F.map_keys(c)) == F.array(*[F.lit(n) for n in sorted(names)])) & F.forall(F.map_values(c), lambda v: F.coalesce(v, F.lit(False)))
    held = {
        "language_not_declared": F.array_contains("languages", F.col("language")), "schema": F.col("schema_version") == "1.0", "not_locked_blind": (F.col("selected_split") == "blind") & F.col("locked"),
        "digest": F.rlike("manifest_sha256", F.lit("^[0-9a-f]{64}$")), "record_count": F.col("record_count") >= 1, "release_not_passed": F.col("release_eligible") & (F.col("status") == "pass"),
        "model_mismatch": F.col("evaluated_model_id") == F.col("model_id"), "overall_checks": complete("checks", OVERALL_CHECKS), "language_checks": complete("language_checks", LANGUAGE_CHECKS),
    }
    return reports.select("language", F.explode(F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in held.items()]))).alias("rule"))
