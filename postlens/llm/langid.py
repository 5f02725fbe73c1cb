"""Language ID: the family first, then one-versus-one linear SVMs between the languages of the family.

Features are the mean counts of hashed byte 1- to 4-grams of the whole text,
lower-cased, with everything that is neither a letter nor beyond ASCII as a
space. A linear model of mean counts adds up over the text, so scoring is one
table look-up per byte, n-gram length and hyperplane; texts of any length take
constant memory per chunk.

Fitting uses a bounded, seeded sample: at most `rows_per_lang` labelled rows of
each language and `max_rows` in all, so that the driver's memory does not grow
with the number of languages. Scoring covers every row in one pass without a
shuffle.

Defined results: a text without a letter (null, empty, digits only) is `und`
with score 0; ties go to the language first in code point order; rows equal in
id, text and language are learnt from once; repeated rows are scored alike;
with no labelled row everything is `und`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, append_columns, checkpointed, fresh, pieces, small_batches, utf8
from .linear import balanced, l2_svm, logistic

#: Languages by family, or by writing where unrelated ones share it (east_asian). A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fo", "lb", "fy", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "gd", "cy", "br"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "uz", "tk", "kk", "ky", "tt", "ug"),
    "iranian": ("fa", "tg", "ku", "ps"),
    "indo_aryan": ("hi", "mr", "ne", "sa", "bn", "as", "gu", "pa", "or", "ur", "sd", "si"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "austronesian": ("id", "ms", "jv", "su", "tl", "fil", "ceb", "mg", "mi"),
    "semitic": ("ar", "he", "am", "ti", "mt"),
    "bantu": ("sw", "zu", "xh", "rw", "sn", "ny", "lg"),
    "east_asian": ("zh", "yue", "ja", "ko"),
}
BITS, ORDERS = 13, (1, 2, 3, 4)
#: When a language's sample is drawn, 2^SLICE_BITS ranges of its hashes are counted first.
SLICE_BITS = 12
#: Buckets of the sample that are widened to single precision at once.
COLUMNS = 512
SALTS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)

_letters = LOWER.copy()
_letters[[b for b in range(128) if not chr(LOWER[b]).isalpha()]] = 32


def family_of(lang: str) -> str:
    return next((k for k, langs in FAMILIES.items() if lang in langs), f"={lang}")


def gram_buckets(data: np.ndarray, order: int) -> np.ndarray:
    """The bucket of the n-gram that starts at each byte."""
    x = _letters[data].astype(np.uint32)
    v = x[: len(x) - order + 1].copy()
    for k in range(1, order):
        v = (v << np.uint32(8)) | x[k : len(x) - order + 1 + k]
    return ((v + np.uint32(1)) * np.uint32(SALTS[order - 1])) >> np.uint32(32 - BITS)


def feature_rows(column: pa.Array) -> np.ndarray:
    """Mean counts by bucket, one row a text."""
    data, off = utf8(column)
    out = np.zeros((len(column), 1 << BITS), np.float32)
    for order in ORDERS:
        if len(data) < order:
            continue
        b = gram_buckets(data, order)
        for i in range(len(column)):
            if (n := off[i + 1] - off[i] - order + 1) > 0:
                out[i] += np.bincount(b[off[i] : off[i] + n], minlength=1 << BITS).astype(np.float32) / n
    return out


@dataclass
class LangModel:
    langs: list[str] = field(default_factory=list)
    families: list[str] = field(default_factory=list)
    #: Hyperplanes: one a family (against the rest), then one a pair of languages of a family.
    planes: np.ndarray | None = None
    bias: np.ndarray | None = None
    pairs: list[tuple[int, int]] = field(default_factory=list)

    def margins(self, column: pa.Array) -> np.ndarray:
        data, off = utf8(column)
        out = np.tile(self.bias, (len(column), 1)).astype(np.float64)
        for order in ORDERS:
            if len(data) < order:
                continue
            b = gram_buckets(data, order)
            n = np.maximum(off[1:] - off[:-1] - order + 1, 0)
            ends = np.minimum(off[:-1] + n, len(b))
            starts = np.minimum(off[:-1], len(b))
            for k, plane in enumerate(self.planes):
                total = np.concatenate([[0.0], np.cumsum(plane[b], dtype=np.float64)])
                out[:, k] += (total[ends] - total[starts]) / np.maximum(n, 1)
        return out

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Indexes into langs, and scores."""
        m, n_fam = self.margins(column), len(self.families)
        p_fam = logistic(2 * m[:, :n_fam])
        p_fam /= np.maximum(p_fam.sum(1, keepdims=True), 1e-300)
        fam = p_fam.argmax(1) if n_fam > 1 else np.zeros(len(m), int)
        best = np.zeros(len(m), int)
        score = np.zeros(len(m))
        for f, name in enumerate(self.families):
            rows = np.flatnonzero(fam == f)
            mine = [i for i, lang in enumerate(self.langs) if family_of(lang) == name]
            votes = np.zeros((len(rows), len(mine)))
            sure = np.ones((len(rows), len(mine)))
            for k, (i, j) in enumerate(self.pairs):
                if i in mine:
                    p = logistic(2 * m[rows, n_fam + k])
                    a, b = mine.index(i), mine.index(j)
                    votes[:, a] += (p >= 0.5) + 1e-3 * p
                    votes[:, b] += (p < 0.5) + 1e-3 * (1 - p)
                    sure[:, a] = np.minimum(sure[:, a], p)
                    sure[:, b] = np.minimum(sure[:, b], 1 - p)
            top = votes.argmax(1)
            best[rows] = np.array(mine)[top]
            score[rows] = sure[np.arange(len(rows)), top] * p_fam[rows, f]
        return best, score


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = 450, max_rows: int = 4000, seed: int = 11) -> LangModel:
    """Fits on at most rows_per_lang rows of each language, those of smallest seeded hash of the row, and max_rows in all."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.col(lang_col)).alias("h"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    labelled = checkpointed(rows.select("lang", "h", F.shiftright("h", 64 - SLICE_BITS).alias("slice")))
    counts = labelled.groupBy("lang", "slice").agg(F.count("*").alias("n"))
    each = min(rows_per_lang, max(1, max_rows // max(1, counts.select("lang").distinct().count())))
    # the slices of least hashes that hold enough rows, by counts alone; only their rows are ranked
    before = Window.partitionBy("lang").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    last = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < each).groupBy("lang").agg(F.max("slice").alias("last"))
    # last has one row for each language, as the model has planes for each
    few = labelled.join(F.broadcast(last), "lang").where(F.col("slice") <= F.col("last"))
    chosen = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each).select("h").distinct()
    # chosen has at most `each` rows for each language, so it is small enough to broadcast
    sample = rows.join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                x = feature_rows(piece.column("text")).astype(np.float16)
                yield pa.RecordBatch.from_arrays([piece.column("lang"), piece.column("h"), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "h", "x"])

    got = sample.select("lang", "h", "text").mapInArrow(run, "lang string, h long, x binary").toArrow()
    names, h = got.column("lang").to_pylist(), got.column("h").to_pylist()
    order = sorted(range(len(names)), key=lambda i: (names[i], h[i]))
    at = np.empty(len(names), np.int64)
    at[order] = np.arange(len(names))
    x = np.empty((len(names), 1 << BITS), np.float16)  # the one copy of the sample beside the table
    for k, row in enumerate(b for chunk in got.column("x").chunks for b in chunk):
        x[at[k]] = np.frombuffer(row.as_buffer(), np.float16)
        del row
    del got
    return train(x, [names[i] for i in order])


def train(x: np.ndarray, names: list[str]) -> LangModel:
    """The model of feature rows (float16) and their languages. Only COLUMNS of them are widened at once, and their products are single precision."""
    if not len(x):
        return LangModel()
    cuts = [slice(c, c + COLUMNS) for c in range(0, x.shape[1], COLUMNS)]
    scale = np.concatenate([1 / (x[:, c].astype(np.float32).std(0) + 1e-3) for c in cuts])  # rare buckets count for more, but not without bound
    gram = np.zeros((len(x), len(x)), np.float32)
    for c in cuts:
        part = x[:, c] * scale[c]
        gram += part @ part.T
    ratio = float(np.sqrt(gram.diagonal().mean()))
    gram /= ratio**2
    langs = sorted(set(names))
    of = np.array([langs.index(name) for name in names])
    fams = sorted({family_of(lang) for lang in langs})
    fam_of = np.array([fams.index(family_of(lang)) for lang in langs])[of]
    betas, bias, pairs = [], [], []

    def plane(rows: np.ndarray, y: np.ndarray) -> None:
        beta, b = l2_svm(gram if len(rows) == len(gram) else gram[np.ix_(rows, rows)], y, balanced(y))
        whole = np.zeros(len(x), np.float32)
        whole[rows] = beta
        betas.append(whole)
        bias.append(b)

    for f in range(len(fams)):
        plane(np.arange(len(of)), np.where(fam_of == f, 1.0, -1.0))
    for i in range(len(langs)):
        for j in range(i + 1, len(langs)):
            if family_of(langs[i]) == family_of(langs[j]):
                rows = np.flatnonzero((of == i) | (of == j))
                plane(rows, np.where(of[rows] == i, 1.0, -1.0))
                pairs.append((i, j))
    del gram
    whole = np.stack(betas)
    planes = np.concatenate([(whole @ (x[:, c] * (scale[c] / ratio))) * scale[c] / ratio for c in cuts], axis=1).astype(np.float32)
    return LangModel(langs, fams, planes, np.array(bias), pairs)


def predict(docs: DataFrame, model: LangModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1); such columns of docs are replaced."""
    letter = fresh("__letter", docs.columns)
    flagged = docs.withColumn(letter, F.coalesce(F.col(f"`{text_col}`").cast("string").rlike(r"\p{L}"), F.lit(False)))

    def make():
        names = np.array(model.langs, dtype=object)

        def work(column):
            if model.planes is None:
                return {"lang_pred": ["und"] * len(column), "score": np.zeros(len(column))}
            best, score = model.predict(column)
            return {"lang_pred": names[best].tolist(), "score": np.clip(score, 0, 1)}

        return work

    out = append_columns(flagged, text_col, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)
    return out.withColumns({"lang_pred": F.when(F.col(letter), F.col("lang_pred")).otherwise(F.lit("und")), "score": F.when(F.col(letter), F.col("score")).otherwise(F.lit(0.0))}).drop(letter)
