"""Typed reading of JSON, walks, canonical text, grounding by automata, first-seen ties and refusals of training, the cube of the evaluator."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from postlens.functions import typed
from postlens.operators import bayes, evaluation, validation
from postlens.plans import policy_queries as Q


def test_every_literal_case_and_record_breaks_its_rules(spark):
    d = spark.createDataFrame([(str(i), j) for i, (j, _) in enumerate(Q.TYPED_CASES)], "case_id string, json string")
    got = {}
    for r in validation.case_violations(d, "json").orderBy("case_id", "ord").collect():
        got.setdefault(int(r.case_id), []).append((r.path, r.rule))
    assert got == {i: list(broken) for i, (_, broken) in enumerate(Q.TYPED_CASES) if broken}
    case = spark.createDataFrame([(str(i), Q.case_json()) for i in range(len(Q.JUDGED))], "case_id string, json string")
    records = spark.createDataFrame([(str(i), j) for i, (j, _) in enumerate(Q.JUDGED)], "case_id string, json string")
    found = validation.reception_violations(records, validation.read_cases(case)).collect()
    assert sorted((int(r.case_id), r.path, r.rule) for r in found) == sorted((i, *x) for i, (_, broken) in enumerate(Q.JUDGED) for x in broken)


def test_one_bad_element_hides_no_fault_of_the_others(spark):
    """Each list of a valid record gets an element of the wrong type, and a faulty one beside it that must still be found."""
    case = spark.createDataFrame([("c", Q.case_json())], "case_id string, json string")
    for bad in ("bare", 5, None, [], True):
        views = Q.view_json()
        views[0]["friction_points"] = [bad, {"dimension": "specificity", "excerpt": "not there", "reason": "x"}]
        views[1]["positive_signals"] = [bad, {"statement": "You should add a joke.", "excerpt": "wall", "reason": "x"}]
        crossed = [bad, {"statement": "x", "excerpt": "gone", "reason": "y", "personas": ["neutral", "skeptic"]}]
        j = Q.record(reader_views=views, cross_reader_patterns=crossed, audience_assumptions=[bad, "The writer is depressed."])
        got = {(r.path, r.rule) for r in validation.reception_violations(spark.createDataFrame([("c", j)], "case_id string, json string"), validation.read_cases(case)).collect()}
        assert {("reader_views[0].friction_points[0]", "object"), ("reader_views[0].friction_points[1].excerpt", "not_grounded"), ("reader_views[1].positive_signals[0]", "object"), ("reader_views[1].positive_signals[1].statement", "rewrite_advice"), ("cross_reader_patterns[0]", "object"), ("cross_reader_patterns[1].excerpt", "not_grounded"), ("audience_assumptions[1]", "diagnosis")} <= got, bad
        assert bad == "bare" or ("audience_assumptions[0]", "string") in got


def test_walk_and_canonical_text(spark):
    values = [{"b": [{"c2": None}, [{"d": []}]], "a": {"x": ""}}, [], {}, 5, "text", {"é": 1.50, "a": {"z": None, "b": "\x01 /\""}}, {"k": [1e300, 0.1, 10**20, -0.0]}]
    texts = [json.dumps(v) for v in values] + [None, "", "{", "[" * 200_000 + "]" * 200_000]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, j string")
    got = {r.i: r for r in d.select("i", typed.members("j").alias("m"), typed.canonical("j").alias("c")).collect()}
    assert [(m.path, m.key, m.empty) for m in got[0].m] == [("b", "b", False), ("b[0].c2", "c2", True), ("b[1][0].d", "d", True), ("a", "a", False), ("a.x", "x", True)]
    assert [got[i].c for i in range(len(values))] == [json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for v in values]
    assert all(got[i].c is None and got[i].m == [] for i in range(len(values), len(texts)))


def test_grounding_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(validation, "BLOCK_EXCERPTS", 50)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abßİ天") for _ in range(r.randint(1, 3)))
    items = [(c, p, f"l{p}", " ".join(word() for _ in range(r.choice([0, 3, 40])))) for c in ("hot", "b", "c") for p in range(6)]
    quotes = [("hot", f"q{i}", r.choice(["", word(), word().upper(), f"{word()} {word()}"])) for i in range(400)] + [("b", "q", "天"), ("nothing", "q", "a"), ("b", "n", None)]
    i = spark.createDataFrame(items, "case_id string, pos int, locator string, text string")
    q = spark.createDataFrame(quotes, "case_id string, path string, excerpt string")
    first = lambda c, x: next((loc for cc, _, loc, t in sorted(items) if cc == c and x.casefold() in t.casefold()), None)
    got = sorted((x.case_id, x.path, x.excerpt, x.locator or "") for x in validation.ground(q, i).collect())
    assert got == sorted((c, p, x, first(c, x) or "") for c, p, x in quotes if x is not None)


def _rows(spark, texts):
    return spark.createDataFrame([(f"i{k}", c, t, f"g{k}", "en", "calibration", k) for k, (c, t) in enumerate(texts)], "id string, gold_label string, text string, group_id string, language string, split string, line long")


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_first_seen_tokens_enter_at_the_limit(spark, parts):
    r = random.Random(2)
    texts = [(bayes.CLASSES[k % 3], " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(6))) for k in range(40)]
    seen: Counter = Counter()
    for _, t in texts:
        mine: Counter = Counter()
        for n in (3, 4, 5):
            mine.update(t[i : i + n] for i in range(len(t) - n + 1))
        seen.update(mine)
    wanted = [t for t, _ in seen.most_common(150)]
    assert seen[wanted[-1]] == sorted(seen.values(), reverse=True)[150]  # a tie at the limit
    rows = _rows(spark, texts).repartition(parts, "id")
    assert {x.token for x in bayes.train(rows, max_features=150, order_col="line").counts.collect()} == set(wanted)
    plain = [t for t, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:150]]
    assert {x.token for x in bayes.train(rows, max_features=150).counts.collect()} == set(plain)


def test_training_refuses(spark):
    good = [("human", "the cat sat"), ("ai", "of course"), ("mixed", "some of each")]
    rows = _rows(spark, good)
    for wrong, rule in ((rows.withColumn("split", F.lit("blind")), "not_calibration"), (_rows(spark, good[:2]), "class_absent:mixed"), (rows.limit(0), "class_absent"), (_rows(spark, [*good, ("human", " ")]), "blank_text"), (rows.unionByName(rows), "duplicate_id"), (_rows(spark, [*good, ("robot", "x")]), "gold_label")):
        with pytest.raises(ValueError, match=rule):
            bayes.train(wrong)
    for setting in ({"high": 9}, {"low": 0}, {"low": 4, "high": 3}, {"max_features": 99}, {"alpha": 0}):
        with pytest.raises(ValueError):
            bayes.train(rows, **setting)
    model = bayes.train(rows)
    model.classes = model.classes.where("label <> 'ai'")
    with pytest.raises(ValueError, match="classes must be"):
        bayes.parameters(model)


def test_slices_have_one_exchange_of_rows(spark):
    fields = ", ".join(f"{f} string" for f in evaluation.SLICES.values())
    rows = spark.createDataFrame([("human", "ai", *"abcdef"), ("mixed", "mixed", *"abcxyz"), ("ai", None, "a", None, *"cdef")], f"gold_label string, predicted_label string, {fields}")
    got = {(r.slice, r.value): (r.tp, r.fp, r.fn, r.tn, r.sample_count) for r in evaluation.slices(rows).collect()}
    assert got["language", "a"] == (1, 1, 0, 0, 3) and got["platform", None] == (0, 0, 0, 0, 1) and len(got) == 10
    plan = evaluation.slices(rows)._jdf.queryExecution().executedPlan().toString()
    lines = [x for x in plan.split("\n") if "Exchange" in x or "Expand" in x]
    assert ["Expand" if "Expand" in x else "cells" if "gold_label" in x else "groups" for x in lines] == ["groups", "Expand", "cells"]  # rows are spread to six only after the cube
    assert sum(r.n for r in evaluation.slice_confusion(rows).where("slice = 'language'").collect()) == 2
    empty = evaluation.release_gates(rows.limit(0), "blind").collect()
    assert len(empty) == 7 and not any(g.passed for g in empty)
