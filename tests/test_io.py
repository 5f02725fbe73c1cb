"""Readers: line numbers over splits, faults of lines and files, cases from files; writers."""

import json
import random

import pytest

from postlens.plans import policy_queries as Q
from postlens.sources import io


def _lines(path):
    """(number, line) of the lines that are no JSON object, read plainly."""
    for k, line in enumerate(path.read_text().split("\n"), 1):
        if line.strip():
            try:
                if not isinstance(json.loads(line), dict):
                    yield k, "object", line
            except ValueError:
                yield k, "json", line


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_line_numbers_over_splits(spark, tmp_path, split):
    r = random.Random(split)
    for name in ("a.jsonl", "b.jsonl", "long.jsonl"):
        lines = [r.choice(['{"id": "x"}', '{"id": "x"}', "", "  ", '{"id": "' + "y" * r.choice([3, 300]) + '"}', "[1]", "nope", '"text"', '[{"id": "a"}, {"id": "b"}]', "{"]) for _ in range(400 if name == "long.jsonl" else 40)]
        (tmp_path / name).write_text("\n".join(lines))
    (tmp_path / "none.jsonl").write_text("\n \n\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows, faults = io.strict_jsonl(spark, str(tmp_path), "id string")
        if split == 64:
            assert rows.rdd.getNumPartitions() > 20
        got = sorted(((f.file, f.line_number or 0, f.rule, f.line) for f in faults.collect()))
        assert got == sorted([(p.name, *x) for p in tmp_path.glob("*.jsonl") for x in _lines(p)] + [("none.jsonl", 0, "empty", None)])
        assert rows.count() == sum(line.startswith('{"id"') for p in tmp_path.glob("*.jsonl") for line in p.read_text().split("\n"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("line", ['[{"id": "a"}, {"id": "b"}]', "7", '{"id": ', '"a"'])
def test_lenient_lines_must_be_objects(spark, tmp_path, line):
    f = tmp_path / "rows.jsonl"
    f.write_text('{"id": "a", "more": 1}\n\n{"other": 2}\n')
    assert [r.id for r in io.lenient_jsonl(spark, str(f), "id string").collect()] == ["a", None]
    f.write_text('{"id": "a"}\n' + line + "\n")
    for action in (lambda d: d.collect(), lambda d: d.count()):
        with pytest.raises(Exception, match="no JSON object"):
            action(io.lenient_jsonl(spark, str(f), "id string"))


def test_cases_from_files(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps(json.loads(Q.case_json()), indent=2))
    (tmp_path / "typed.json").write_text(Q.case_json(schema_version=1.0, observations=None))
    (tmp_path / "broken.json").write_text("{")
    cases, faults = io.cases(spark, str(tmp_path))
    assert [(r.case_id, r.content.text, r.content.images[0].id) for r in cases.collect()] == [("good.json", "Seen", "img1")]
    assert sorted((r.case_id, r.path, r.rule) for r in faults.collect()) == [("broken.json", "case", "object"), ("typed.json", "observations", "list"), ("typed.json", "schema_version", "version")]


def test_written_reports_are_read_again(spark, tmp_path):
    d = spark.createDataFrame([(1, "# Head\n\n- a"), (2, "# Other")], "doc_id long, markdown string")
    io.write_json(d, str(tmp_path / "json"))
    assert sorted(map(tuple, io.lenient_jsonl(spark, str(tmp_path / "json"), d.schema.simpleString()[7:-1].replace(":", " ")).collect())) == sorted(map(tuple, d.collect()))
    io.write_markdown(d, str(tmp_path / "md"))
    assert sorted("".join(p.read_text() for p in (tmp_path / "md").glob("part-*")).split("\n\n")) == sorted("# Head\n\n- a\n\n# Other\n\n".split("\n\n"))
