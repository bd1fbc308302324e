import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import semantic
from tessera.options import Options
from tessera.plans import evaluate, report
from tessera.sources import readers, sinks


@pytest.mark.parametrize("detected, expected, want", [(["A", "A", "B"], ["A", "C"], (2, 1, 1, 2 / 3, 2 / 3)), ([], ["A"], (0, 0, 1, 0.0, 0.0)), (["A"], [], None)])
def test_accuracy(spark, detected, expected, want):
    d = spark.createDataFrame([(detected, expected)], "d array<string>, e array<string>")
    got = d.select(evaluate.accuracy(F.col("d"), F.col("e"))).first()[0]
    assert (got and (got["tp"], got["fp"], got["fn"], got["precision"], got["recall"])) == want


def test_results_and_summary(spark):
    c = report.complete(spark.createDataFrame([("a", "Dear {{x}}", ["MISSING_PLACEHOLDER"]), ("b", "fine", [])], "case_id string, prompt string, expected_issue_codes array<string>"))
    r = evaluate.results(c, {"baseline": Options(), "none": Options(disabled_rules=("MISSING_PLACEHOLDER",))})
    s = {x["parameter_set"]: x for x in evaluate.summary_by_set(r).collect()}
    assert s["baseline"]["avg_f1"] == 1.0 and s["none"]["avg_f1"] == 0.0 and s["baseline"]["total_runs"] == 2
    assert evaluate.metric_table(evaluate.summary_by_set(r)).where("parameter_set = 'baseline'").first()["f1"] == "1.000"
    assert "<td>baseline</td>" in sinks.html_report(evaluate.summary_by_set(r))


def test_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id,category,prompt,messages_json,schema_json,expected_issue_codes,notes\n1,x,"Hi, you","[{""role"":""user"",""content"":""q""}]",,"[""A""]",n\n2,y,p,not json,{bad,,\n')
    rows = {r["id"]: r for r in readers.load_cases(spark, str(tmp_path / "c.csv")).collect()}
    assert rows["1"]["messages"][0]["content"] == "q" and rows["1"]["expected_issue_codes"] == ["A"] and rows["2"]["messages"] is None and rows["2"]["schema_json"] is None
    d = tmp_path / "set"
    d.mkdir()
    (d / "one.json").write_text(json.dumps({"id": "one", "prompt": "p", "messages": [], "expectedIssueCodes": []}))
    (d / "two.json").write_text(json.dumps({"prompt": "p"}))
    (d / "index.json").write_text(json.dumps({"testCases": ["one", "gone"]}))
    assert [r["id"] for r in readers.load_cases(spark, str(d)).collect()] == ["one"]
    assert sorted(r["id"] for r in readers.json_cases(spark, str(d)).collect()) == ["one", "two"]
    t = tmp_path / "texts"
    t.mkdir()
    for n in ("a.txt", "b_annotated.txt", "c_stats.txt"):
        (t / n).write_text("two\nlines")
    assert [(r["id"], r["prompt"]) for r in readers.load_cases(spark, str(t)).collect()] == [("a", "two\nlines")]
    s = tmp_path / "dirs" / "Law"
    for k, files in (("test_0001", ("prompt.txt", "history.json")), ("test_0002", ("expected_output.json",))):
        (s / k).mkdir(parents=True)
        for f in files:
            (s / k / f).write_text({"prompt.txt": "p", "history.json": '[{"role":"user","content":"h"}]', "expected_output.json": '{"expected_issue_codes":["X"],"missing_references":[]}'}[f])
    got = {r["test"]: r for r in readers.directory_cases(spark, str(tmp_path / "dirs")).collect()}
    assert got["test_0001"]["history"][0]["content"] == "h" and got["test_0002"]["prompt"] is None and got["test_0002"]["expected_issue_codes"] == ["X"]


def test_sinks(spark, tmp_path):
    old, new = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int"), spark.createDataFrame([("b", 3)], "id string, v int")
    assert sorted(map(tuple, sinks.upsert_cases(old, new).collect())) == [("a", 1), ("b", 3)]
    d = spark.createDataFrame([("the a and the b", [(0, 5), (10, 15)])], "t string, s array<struct<start:int,end:int>>")
    assert d.select(sinks.annotate(F.col("t"), F.col("s"), "[X]")).first()[0] == "the a[X] and the b[X]"
    sinks.write_patches(spark.createDataFrame([(1, "a\nb", "a\nc")], "id long, original string, proposed string"), f"{tmp_path}/patches")
    assert spark.read.json(f"{tmp_path}/patches").first()["diff"].split("\n") == [" a", "-b", "+c"]


def _embed(texts):
    return [[1.0, 0.0] if "report" in t or "summary" in t else [0.0, 1.0] for t in texts]


def _entail(a, b):
    return [0.9 if "contradicts" in y and "short" in x else 0.1 for x, y in zip(a, b, strict=True)]


def test_models_plug_in(spark):
    from tessera.operators import reference

    c = report.complete(spark.createDataFrame([("a", "x", "We have a summary of sales. Read the report.")], "case_id string, y string, prompt string").drop("y"))
    found = reference.candidates(c)
    assert found.first()["method"] is None
    o, v = Options(use_semantic=True), reference.views(c)
    assert semantic.resolve(found, v, semantic.Models(embed=_embed), o).first()["method"] == "semantic-similarity"
    assert semantic.resolve(found, v, semantic.Models(), o).first()["method"] is None
    k = report.complete(spark.createDataFrame([("a", "Keep it short. Be thorough please.")], "case_id string, prompt string"))
    m = semantic.Models(embed=lambda ts: [[1.0, 0.0] if "short" in t else [0.0, 1.0] for t in ts], entail=_entail)
    assert sorted(r["bucket"] for r in semantic.semantic_conflicts(k, m).collect()) in (["logical", "verbosity"], ["logical", "semantic"])
