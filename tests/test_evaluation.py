import hashlib
import json
import random
from collections import Counter

from postlens.operators import bayes, evaluation as E

MANIFEST = "id string, gold_label string, language string, platform string, genre string, length_bucket string, model_family string, editorial_state string, group_id string, split string, locked_blind boolean, sentence_labels array<string>"


def _row(i, gold, lang, labels=None, split="blind", locked=True, group=None):
    return (i, gold, lang, "web", "post", "short", "none", "raw", group or f"g{i}", split, locked, labels)


def _case(spark):
    m = spark.createDataFrame([_row("h1", "human", "zh"), _row("h2", "human", "en"), _row("a1", "ai", "zh"), _row("a2", "ai", "en"), _row("m1", "mixed", "zh", ["human", "ai", "ai"])], MANIFEST)
    p = spark.createDataFrame([("h1", "human", None), ("h2", "ai", None), ("a1", "ai", None), ("a2", "abstain", None), ("m1", "mixed", ["human", "ai", "abstain"])], "id string, predicted_label string, sentence_predictions array<string>")
    return m, p


def test_five_rows(spark):
    m, p = _case(spark)
    rows = E.joined(m, p)
    c = {(r.gold_label, r.predicted_label): r.n for r in E.confusion(rows).collect()}
    assert len(c) == 12 and c["human", "ai"] == 1 and c["ai", "abstain"] == 1
    a = E.assisted(rows).first()
    assert (a.fpr, round(a.precision, 9), round(a.recall, 9), a.abstention_rate) == (0.5, round(2 / 3, 9), round(2 / 3, 9), 0.2)
    s = E.mixed_sentences(rows).first()
    assert (s.tp, s.fn, round(s.f1, 9), s.document_coverage) == (1, 1, round(2 / 3, 9), 1.0)
    status = E.release_status(E.release_gates(rows, "blind")).first()
    assert status.status == "fail" and status.release_eligible
    assert not E.release_status(E.release_gates(rows, "calibration")).first().release_eligible


def test_violations(spark):
    m, p = _case(spark)
    assert E.manifest_violations(m).count() == 0 and E.prediction_violations(m, p).count() == 0
    more = m.unionByName(spark.createDataFrame([_row("h1", "human", "zh", split="calibration", locked=False, group="gh2"), _row("x", "robot", " ", split="blind", locked=False), _row("y", "mixed", "en", ["ai"])], MANIFEST))
    got = {(r.id, r.rule) for r in E.manifest_violations(more).collect()}
    assert {("h1", "duplicate_id"), ("h1", "group_leakage"), ("h2", "group_leakage"), ("x", "gold_label"), ("x", "blank:language"), ("x", "blind_not_locked"), ("y", "mixed_needs_both")} <= got
    assert [r.group_id for r in E.leaking_groups(more).collect()] == ["gh2"]
    assert [r.id for r in E.missing_predictions(m, p.where("id <> 'a1'"), "blind").collect()] == ["a1"]


def test_digest_ignores_row_order(spark):
    m, _ = _case(spark)
    assert E.manifest_digest(m).first() == E.manifest_digest(m.orderBy("id", ascending=False)).first()


def _training(spark):
    texts = {"human": "the cat sat on the mat and purred", "ai": "furthermore it is crucial to leverage synergies", "mixed": "0123 4567 8901 2345"}
    return spark.createDataFrame([(f"{k}{i}", k, v, f"g{k}{i}", "en", "calibration") for k, v in texts.items() for i in range(2)], "id string, gold_label string, text string, group_id string, language string, split string")


def test_bayes(spark):
    rows = _training(spark)
    assert bayes.training_violations(rows).count() == 0
    model = bayes.train(rows, max_features=200)
    got = {r.id: r.predicted_label for r in bayes.predict(spark.createDataFrame([("1", "the cat purred"), ("2", "crucial synergies"), ("3", " "), ("4", "ß∂ƒ")], "id string, text string"), model).collect()}
    assert got["1"] == "human" and got["2"] == "ai" and got["3"] == "abstain" and got["4"] == "abstain"
    made = bayes.artifact(model, rows)
    assert bayes.is_untouched(made) and not bayes.is_untouched(made | {"alpha": 2.0}) and bayes.model_id(bayes.train(rows, max_features=200), rows).first()[0] == made["model_id"]
    kept = sorted(({"id": r.id, "label": r.gold_label, "group_id": r.group_id, "language": r.language, "text_sha256": hashlib.sha256(r.text.encode()).hexdigest()} for r in rows.collect()), key=lambda r: r["id"])
    assert made["training_corpus_sha256"] == hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    twice = spark.createDataFrame([("1", "the cat purred"), ("1", "crucial synergies")], "id string, text string")
    assert sorted(r.predicted_label for r in bayes.predict(twice, model).collect()) == ["ai", "human"]
    s = bayes.predict_sentences(spark.createDataFrame([("d", ["the cat sat", "0123 4567"])], "id string, sentences array<string>"), model).first()
    assert s.sentence_predictions == ["human", "abstain"]


def test_admission(spark):
    schema = "language string, languages array<string>, schema_version string, selected_split string, locked boolean, manifest_sha256 string, record_count long, release_eligible boolean, status string, evaluated_model_id string, model_id string, checks map<string,boolean>, language_checks map<string,boolean>"
    good = ("en", ["en"], "1.0", "blind", True, "a" * 64, 5, True, "pass", "m", "m", dict.fromkeys(bayes.OVERALL_CHECKS, True), dict.fromkeys(bayes.LANGUAGE_CHECKS, True))
    forged = ("en", ["en"], "1.0", "blind", True, "a" * 64, 5, True, "pass", "m", "m", {"fpr": True}, dict.fromkeys(bayes.LANGUAGE_CHECKS, True))
    assert bayes.admission_violations(spark.createDataFrame([good], schema)).count() == 0
    assert [r.rule for r in bayes.admission_violations(spark.createDataFrame([forged], schema)).collect()] == ["overall_checks"]


def test_grams_and_prefixes_against_slices(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("abß天𝄞 ") for _ in range(r.randint(0, 30))) for _ in range(60)]
    grams = lambda t: [t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)]
    got = Counter()
    for _, joined, off in bayes.chunks(texts):
        for token, n in bayes.counted_grams(joined, off, 3, 5):
            got[token] += n
    assert got == Counter(g for t in texts for g in grams(t))
    tokens = sorted(got)[::3]
    import numpy as np

    weights = np.random.default_rng(1).random((len(tokens), 3))
    table = bayes.Prefixes(tokens, weights)
    _, joined, off = next(bayes.chunks(texts))
    at = {t: w for t, w in zip(tokens, weights)}
    assert np.allclose(table.sums(joined, off), [sum((at[g] for g in grams(t) if g in at), np.zeros(3)) for t in texts])
