import json

import pytest
from pyspark.sql import functions as F

from postlens.operators import origin, provenance, report, validation
from postlens.plans import policy_queries as Q
from postlens.sources import io
from postlens.streaming import score


def test_disclosures(spark):
    rows = spark.createDataFrame([(t, v, a, x) for t, v, a, x in Q.OBSERVATIONS], "t string, v string, a string, x boolean").select("v", "x", origin.is_disclosure(F.col("t"), F.col("v"), F.col("a")).alias("got")).collect()
    assert all(r.x == r.got for r in rows), [r for r in rows if r.x != r.got]


def test_signal_boundaries_and_verdicts(spark):
    cases = spark.createDataFrame([(k, True, k != 5, ["img1"]) for k in range(7)], "case_id long, has_text boolean, text_sufficient boolean, image_ids array<string>")
    obs = spark.createDataFrame([(0, "author_disclosure", "I made this image with AI", None, "img1"), (6, "author_disclosure", "I made this image with AI", None, "img7")], "case_id long, type string, value string, assertion string, scope string")
    s = [(1, "hive", "image", "img1", 0.9, 0.0, None, None), (2, "hive", "image", "img1", 0.899, 0.0, None, None), (3, "hive", "image", "img1", 0.0, 0.95, None, None), (4, "hive", "image", "img1", 0.95, 0.0, None, None), (4, "other", "image", "img1", None, None, "negative", "strong"), (5, "other", "text", "text", None, None, "positive", "strong")]
    signals = spark.createDataFrame(s, "case_id long, provider string, modality string, scope string, ai_generated_score double, not_ai_generated_score double, declared_direction string, declared_strength string")
    proof = spark.createDataFrame([], "case_id long, scope string, valid boolean, ai_generated boolean, generative_involvement boolean, status string")
    got = {r.case_id: r for r in origin.verdicts(cases, obs, signals, proof).collect()}
    assert [got[k].verdict for k in range(7)] == ["verified_ai_provenance", "strong_ai_indicators", "insufficient_evidence", "no_reliable_ai_evidence", "conflicting_evidence", "insufficient_evidence", "insufficient_evidence"]
    assert got[6].unknown_scopes == 1 and "positive_below_strong" in got[2].limitations


def test_manifests_and_responses(spark):
    m = spark.createDataFrame([(i, s[0]) for i, s in enumerate(Q.STORES)], "i long, store string")
    for r in provenance.manifest_results(m).collect():
        assert (r.status, r.ai_generated, r.generative_involvement) == Q.STORES[r.i][1:], Q.STORES[r.i][0]
    p = spark.createDataFrame([(i, s[0]) for i, s in enumerate(Q.RESPONSES)], "id long, response string")
    for r in provenance.provider_results(p).collect():
        assert (r.error, r.ai_generated_score, r.source_class) == Q.RESPONSES[r.id][1:], Q.RESPONSES[r.id][0]


def test_media(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + b"x" * 10)
    (tmp_path / "b.txt").write_bytes(b"hello")
    (tmp_path / "c.bin").write_bytes(b"\xff\xd8\xff" + b"x" * 100)
    got = provenance.asset_summaries(io.media(spark, str(tmp_path), 50).withColumn("asset_id", F.lit(None).cast("string"))).collect()
    assert sorted(str(r.media_type) for r in got) == ["None", "None", "image/png"] and "path" not in got[0].asDict()
    named = provenance.asset_summaries(io.media(spark, str(tmp_path), 50), id_col="file_name").collect()
    assert {r.asset_id: r.error for r in named} == {"a.png": None, "b.txt": "signature", "c.bin": "signature"}


def test_cases_and_records(spark):
    case = json.dumps({"case_id": "c", "schema_version": "1.0", "source": {"url": None, "platform": "web", "author": None, "published_at": None, "captured_at": "2024-05-01T10:00:00+02:00", "public": True}, "content": {"text": "Seen on a wall today", "language": "en", "images": []}, "observations": [{"type": "other", "value": "Seen on a wall", "assertion": None, "scope": "post", "source_url": None}], "declared_purpose": "inform"})
    cases = spark.createDataFrame([(case,)], "j string").select(F.from_json("j", validation.CASE_SCHEMA).alias("c")).select("c.*")
    assert validation.case_violations(cases).count() == 0
    rec = lambda j: spark.createDataFrame([("c", j)], "case_id string, json string")
    rules = lambda j: {r.rule for r in validation.reception_violations(rec(j), cases).collect()}
    assert rules(Q.record()) == set()
    assert rules(Q.record(rewrite="x")) == {"banned_key", "unknown_key"}
    assert "evasion_advice" in rules(Q.record(uncertainties=["Try to fool the AI detector."]))
    assert {"not_grounded", "personas"} <= rules(Q.RECORDS[6])
    view = json.loads(Q.record())["reader_views"]
    view[0]["aversion_risk"] = "high"
    assert rules(Q.record(reader_views=view)) == {"high_needs_two"}
    assert [v["persona"] for v in validation.ordered_views(rec(Q.record())).first().reader_views] == ["supporter", "neutral", "skeptic"]


def test_values_at_any_depth(spark):
    deep = {"a": [{"validation_status": [{"code": "c1", "explanation": "e ] " + "x" * 400}, "text", {"validation_status": [{"code": "hidden"}]}]}], "validation_status": {"validation_status": [{"code": None}]}}
    d = spark.createDataFrame([(0, json.dumps(deep)), (1, None), (2, "no json"), (3, "")], "i long, j string")
    got = {r.i: r.s for r in d.select("i", provenance.statuses("j").alias("s")).collect()}
    assert [(x.code, len(x.explanation)) for x in got[0]] == [("c1", 300), ("", 0), ("", 0)] and got[1] == got[2] == got[3] == []
    flat = [{"class": "A", "score": 0.2}, {"class": "B", "score": True}, {"x": [{"class": "a", "score": 0.7}, {"class": "C", "score": -1}]}]
    got = spark.createDataFrame([(json.dumps(flat),)], "j string").select(provenance.class_scores("j").alias("s")).first().s
    assert [(x.name, x.score) for x in got] == [("a", 0.7), ("c", 0.0)]


def test_report_sections(spark, tmp_path):
    spark.createDataFrame([(k, "Some text of it.", "en", "s", 16) for k in range(40)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, 3), (900, 3)], "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    found = Q.report_inputs(spark, str(tmp_path)).cache()
    assert found.count() == 40
    text = {r.doc_id: r.markdown for r in report.to_markdown(report.nested(found)).collect()}
    whole = {r.doc_id: json.loads(r.json) for r in report.to_json(report.nested(found)).collect()}
    for k, t in text.items():
        heads = [line for line in t.split("\n") if line.startswith("#")]
        assert heads == ["# Content evidence report", "## Assessment", "## Origin", "## Text", "## Style", "## Readers", "### supporter", "### neutral", "### skeptic", "## Coverage and limits", "## Sources", "## Reproducibility"], k
        style = whole[k]["style_pattern_assessment"]
        assert len(style["matches"]) == style["patterns"] and all(1 <= len(m["excerpts"]) <= 2 for m in style["matches"])
        sentences = whole[k]["local_text_assessment"]["sentences"]
        assert len(sentences) <= 6 and all(s["points"] >= 4 and len(s["cues"]) <= 4 for s in sentences) and [s["points"] for s in sentences] == sorted((s["points"] for s in sentences), reverse=True)
    assert len(whole[3]["origin_assessment"]["evidence"]) == 2 and whole[3]["reproducibility"]["local_text_method"] == report.TEXT_METHOD and len(whole[3]["reproducibility"]["content_sha256"]) == 64
    assets = whole[3]["origin_assessment"]["asset_findings"]
    assert [a["id"] for a in assets] == ["img1"] and len(assets[0]["sha256"]) == 64 and sum(len(a["provider_signals"]) for a in assets) == 1
    assert whole[3]["local_model_research_assessment"]["failed_checks"] and not whole[3]["local_model_research_assessment"]["trusted_for_origin"]
    assert "detectors_err_both_ways" in text[5]
    bare = found.drop("evidence", "assets", "reception", "sources", "content_sha256", "provider_status", "model_status", "failed_checks", "part")
    assert "## Readers" not in report.to_markdown(report.nested(bare)).first().markdown


def test_reports_of_hot_cases_come_in_parts_and_lose_nothing(spark):
    signal = "case_id long, provider string, modality string, scope string, ai_generated_score double, not_ai_generated_score double, declared_direction string, declared_strength string"
    rows = [(1, "hive", "image", "img1", k / 5000, 0.0, None, None) for k in range(3000)] + [(1, "other", "image", "img1", None, None, "positive", "strong")] * 2000 + [(2, "hive", "image", "img1", 0.95, 0.0, None, None)]
    signals = spark.createDataFrame(rows, signal).repartition(8)
    cases = spark.createDataFrame([(k, True, True, ["img1", "img2"]) for k in (1, 2, 3)], "case_id long, has_text boolean, text_sufficient boolean, image_ids array<string>")
    none = spark.createDataFrame([], "case_id long, type string, value string, assertion string, scope string")
    proof = spark.createDataFrame([(2, "img1", True, True, False, "verified")], "case_id long, scope string, valid boolean, ai_generated boolean, generative_involvement boolean, status string")
    parts = report.evidence_parts(origin.evidence(cases, none, signals, proof), most=500).collect()
    size = {(p.case_id, p.part): len(p.evidence) for p in parts}
    assert sum(n for (c, _), n in size.items() if c == 1) == 5000 and max(size.values()) < 1000 and sum(c == 1 for c, _ in size) > 5
    assert [e.strength for p in parts if p.case_id == 2 for e in p.evidence] == ["verified", "strong"]
    images, _ = Q.case_images(cases)
    found = report.asset_parts(images, proof, signals, most=500).collect()
    assert sum(len(a.provider_signals) for p in found if p.case_id == 1 for a in p.assets) == 5000 and all(len(a.provider_signals) < 1000 for p in found for a in p.assets)
    assert [(p.part, [(a.id, a.c2pa and a.c2pa.status, len(a.provider_signals)) for a in p.assets]) for p in found if p.case_id == 2] == [(0, [("img1", "verified", 1), ("img2", None, 0)])]
    assert [len(p.assets) for p in found if p.case_id == 3] == [2]


def test_jsonl_and_stream(spark, tmp_path):
    f = tmp_path / "rows.jsonl"
    f.write_text('{"id": "a"}\n\n[1]\nnope\n')
    rows, faults = io.strict_jsonl(spark, str(f), "id string")
    assert [r.id for r in rows.collect()] == ["a"] and faults.count() == 2
    (tmp_path / "none.jsonl").write_text("\n \n")
    assert [(r.file, r.line) for r in io.strict_jsonl(spark, str(tmp_path / "none.jsonl"), "id string")[1].collect()] == [("none.jsonl", None)]
    with pytest.raises(Exception, match="malformed"):
        io.lenient_jsonl(spark, str(f), "id string").collect()
    spark.createDataFrame([(1, "天气很好。", "zh")], "doc_id bigint, text string, language string").write.parquet(str(tmp_path / "in"))
    score.start(score.read_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first().style_assessment == "few_ai_style_patterns"


def test_excerpts_from_anywhere_in_a_long_text(spark, monkeypatch):
    text = "".join(f"sentence {k} of it. " for k in range(500)) + "The very end."
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    monkeypatch.setattr(Q, "documents", lambda spark, sf_dir, *columns: d.select(*columns))
    quotes = spark.createDataFrame([("1", "friction", x) for x in ("sentence 0 of", "Sentence 250 of it", "the very end.", "sentence 500")], "case_id string, path string, excerpt string")
    got = {r.excerpt: r.locator for r in validation.ground(quotes, validation.evidence_items(Q.cases(spark, ""))).collect()}
    assert got == {"sentence 0 of": "content.text", "Sentence 250 of it": "content.text", "the very end.": "content.text", "sentence 500": None}


def test_reports_count_compressibility(spark, monkeypatch):
    zh = spark.createDataFrame([(1, "今天天气很好。" * 60, "zh")], "doc_id long, text string, language string")
    verdict = spark.createDataFrame([(1, "insufficient_evidence", "low")], "case_id long, verdict string, confidence string")
    monkeypatch.setattr(Q, "zh_corpus", lambda *_: zh)
    monkeypatch.setattr(Q, "policy_inputs", lambda *_: ())
    monkeypatch.setattr(Q.origin, "verdicts", lambda *_: verdict)
    assert "high_compressibility:+1" in Q.full_findings(spark, "").select("drivers").first().drivers


def _blank_documents(spark, tmp_path):
    """80 documents with words in one folder, and with blank texts for some in another."""
    blanks = ["", " \n", "　\x1c", None]
    rows = [(k, "Some text of it.") for k in range(80)]
    for name, told in (("words", rows), ("blank", [(k, t if k % 3 else blanks[k % 4]) for k, t in rows])):
        spark.createDataFrame(told, "doc_id long, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
    return str(tmp_path / "words"), str(tmp_path / "blank")


def test_blank_documents_make_no_empty_cases(spark, tmp_path):
    words, blank = _blank_documents(spark, tmp_path)
    got = sorted(tuple(r) for r in Q.case_violations(spark, blank).collect())
    assert got == sorted(tuple(r) for r in Q.case_violations(spark, words).collect())
    assert [r[0] for r in got if r[1:] == ("content", "empty")] == ["37"]


def test_blank_documents_and_first_violations(spark, tmp_path):
    words, blank = _blank_documents(spark, tmp_path)
    assert sorted(tuple(r) for r in Q.first_case_violation(spark, blank).collect()) == sorted(tuple(r) for r in Q.first_case_violation(spark, words).collect())
