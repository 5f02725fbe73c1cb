import random
import re

from pyspark.sql import functions as F

from postlens.functions import text as X
from postlens.operators import detector

STOPS = "。！？!?；;"


def quadratic_sentences(t):
    t = re.sub(r"[ \t\f\v]+", " ", t.replace("\r\n", "\n").replace("\r", "\n")).strip()
    found = re.findall(rf"[^{STOPS}\n]+(?:[{STOPS}]+|$)", t)
    return [s for s in (" ".join(x.split()) for x in found) if s]


def test_sentences_match_the_direct_regex(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("ab天。！?;\n 。") for _ in range(r.randint(0, 25))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", X.sentences(X.keep_lines("t")).alias("s")).collect()
    for row in rows:
        assert row.s == quadratic_sentences(texts[row.i]), texts[row.i]


def test_sufficiency_boundaries(spark):
    rows = [("zh", "天" * 499, False), ("zh", "天" * 500, True), ("en", "a" * 999, False), ("en", "a" * 1000, True), ("en", None, False)]
    got = spark.createDataFrame(rows, "l string, t string, want boolean").select("want", X.sufficient(X.squeeze("t"), "l").alias("got")).collect()
    assert all(r.want == r.got for r in got)


def test_units_and_repetition(spark):
    r = spark.createDataFrame([("It's 3.5 天Straße", "a b c d a b c d"), (None, "a b")], "a string, b string").select(X.units("a").alias("u"), X.repeated_ratio(X.units("b")).alias("r")).collect()
    assert r[0].u == ["it's", "3.5", "天", "strasse"] and abs(r[0].r - 0.2) < 1e-12 and r[1].r == 0.0


def test_redaction_urls_and_times(spark):
    r = spark.range(1).select(
        X.redact(F.lit("Authorization: Bearer abc, x-api-key=k1; api_key=zz s3cret"), ("s3cret",)).alias("a"), X.is_public_url(F.lit("https://a.b/c")).alias("u1"), X.is_public_url(F.lit("ftp://a")).alias("u2"), X.is_public_url(F.lit(None).cast("string")).alias("u3"),
        X.is_zoned_time(F.lit("2024-05-01T10:00:00Z")).alias("t1"), X.is_zoned_time(F.lit("2024-05-01T10:00:00")).alias("t2"), X.is_zoned_time(F.lit("2024-13-01T10:00:00Z")).alias("t3"), X.redact_paths(F.lit("cannot open /home/me/x.png")).alias("p"),
    ).first()
    assert "abc" not in r.a and "k1" not in r.a and "zz" not in r.a and "s3cret" not in r.a
    assert (r.u1, r.u2, r.u3, r.t1, r.t2, r.t3) == (True, False, True, True, False, False)
    assert r.p == "cannot open [PATH]"


def test_entropy_of_even_units_is_one(spark):
    d = spark.createDataFrame([(1, "a b c d"), (2, "a a a"), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.entropy for r in detector.unit_statistics(d).collect()}
    assert abs(got[1] - 1) < 1e-12 and got[2] == 0.0 and 3 not in got


def test_compression_ratio(spark):
    r = spark.createDataFrame([("a" * 1000,), ("",), (None,)], "t string").select(detector.compression_ratio("t").alias("c")).collect()
    assert 0 < r[0].c < 0.05 and r[1].c == 0.0 and r[2].c == 0.0
