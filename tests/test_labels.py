"""Labels, extraction mode, matching levels, timings, datasets."""

import json
import re

import pytest
from pyspark.sql import functions as F

from tessera import lexicon as L
from tessera.functions import text as T
from tessera.operators import labels, reference, semantic
from tessera.options import Options
from tessera.plans import evaluate, report
from tessera.sources import readers, sinks


def col(spark, text, made):
    return spark.createDataFrame([(text,)], "t string").select(made(F.col("t"))).first()[0]


@pytest.mark.parametrize("text", ["As shown below, the table below and these rows; continue the list above.", "", "the following data as discussed earlier", "THE the report that"])
def test_label_references(spark, text):
    want, seen = [], set()
    found = [(m.start(), i, m.end(), m.group(0), t) for i, (p, t) in enumerate(L.LABEL_REFERENCES) for m in re.finditer(p, text)]
    for start, _, end, span, t in sorted(found, key=lambda x: x[:2]):
        if (start, end) not in seen:
            seen.add((start, end))
            want.append((start, end, span, t))
    assert [tuple(r) for r in col(spark, text, labels.references)] == want


def test_tags(spark):
    assert col(spark, "Hi {{a}}, as discussed earlier.", labels.tagged) == "Hi {{a}}[MISSING_PLACEHOLDER], as discussed earlier[MISSING_REFERENCE]."
    assert col(spark, None, labels.tagged) is None


def test_valid_messages(spark):
    d = spark.createDataFrame([([("user", "a"), ("tool", "b"), ("system", None)],), ([("x", "y")],), (None,)], "m array<struct<role:string,content:string>>")
    got = [[tuple(x) for x in r[0]] for r in d.select(labels.valid_messages(F.col("m"))).collect()]
    assert got[0] == [("user", "a")] and got[1] == got[2] and len(got[1]) == 2


def test_allocation_and_units(spark):
    rows = labels.allocation(spark, 23, ["a", "b", "c"], ["p", "q"]).collect()
    assert sum(r["cases"] for r in rows) == 23 and [r["cases"] for r in rows] == [4, 4, 4, 4, 4, 3]
    u = spark.createDataFrame([(0,), (7,)], "s long").select(T.seeded_units(F.col("s"), 20)).collect()
    assert u[0][0] != u[1][0] and all(0 <= x <= 1 for r in u for x in r[0]) and len(set(u[0][0])) == 20


def test_context(spark):
    assert [tuple(r) for r in col(spark, "abcXdefX", lambda t: T.occurrences(t, "X", 2))] == [("X", 3, 4, "bcXde"), ("X", 7, 8, "efX")]


def test_extraction_mode(spark):
    c = report.complete(spark.createDataFrame([("a", "Check the gizmo. The widgets below matter for Acme.")], "case_id string, prompt string"))
    assert reference.candidates(c).count() == 0
    found = {(r["head"], r["forward"], r["start"]) for r in reference.candidates(c, Options(use_nlp=True)).collect()}
    assert found == {("gizmo", False, 6), ("widget", False, 17), ("widget", True, 17)}
    m = semantic.Models(entities=lambda ts: [[("Acme", "B-ORG"), ("it", "ORG"), ("Paris", "DATE")] for _ in ts])
    named = reference.candidates(c, Options(use_nlp=True), semantic.entity_udf(m.entities))
    assert [(r["span"], r["start"]) for r in named.where("head = 'acme'").collect()] == [("Acme", 46)]
    assert m.available() == {"embed": False, "entail": False, "entities": True}
    assert report.issue_table(c, Options(use_nlp=True), m).where("code = 'MISSING_REFERENCE'").count() == 1


@pytest.mark.parametrize("options, n", [(Options(), 1), (Options(use_chunks=True, chunk_size=20, chunk_overlap=10), 5), (Options(use_sentences=True), 2), (Options(use_phrases=True), 1)])
def test_pieces(spark, options, n):
    assert len(col(spark, "Here stands the report. Another sentence here. No", lambda t: semantic.pieces(t, options))) == n


def test_switches():
    o = Options(disabled_rules=("A",)).without("B", "A").switched({"C": False, "D": True})
    assert o.disabled_rules == ("A", "B", "C")


def test_timings_methods_modes(spark):
    c = report.complete(spark.createDataFrame([("a", "Dear {{x}}, read the report."), ("b", "fine")], "case_id string, prompt string"))
    t = report.rule_timings(c, Options(disabled_rules=("TOKEN_OVERAGE", "INVALID_SCHEMA", "SCHEMA_RISK")))
    assert set(t) == {"MISSING_PLACEHOLDER", "MISSING_REFERENCE", "CONFLICTING_INSTRUCTION"} and min(t.values()) > 0
    assert [tuple(r) for r in report.methods_used(report.issue_table(c)).collect()] == [("a", ["pattern"])]
    assert [(o.use_semantic, o.use_nli) for o in evaluate.modes().values()] == [(False, False), (True, False), (False, True), (True, True)]
    a = {r["case_id"]: r["report"] for r in report.attach(c).collect()}
    assert len(a["a"]["issues"]) == 2 and not a["b"]["issues"]


def test_datasets_and_writers(spark, tmp_path):
    root = tmp_path / "data.sets"
    assert readers.find_dataset(spark, str(root)) is None
    (root / "generator" / "g1").mkdir(parents=True)
    (root / "generator" / "g1" / "index.json").write_text("{}")
    assert readers.find_dataset(spark, str(root)).endswith("generator/g1")
    (root / "b").mkdir()
    (root / "b" / "index.json").write_text("{}")
    assert readers.find_dataset(spark, str(root)).endswith("data.sets/b")
    texts = tmp_path / "v1.2"
    texts.mkdir()
    (texts / "a.txt").write_text("hello")
    assert [r["prompt"] for r in readers.load_cases(spark, str(texts)).collect()] == ["hello"]
    with pytest.raises(ValueError):
        readers.load_cases(spark, str(tmp_path / "gone.bin"))
    (tmp_path / "p.json").write_text(json.dumps([{"name": "x", "description": "d", "options": {"useNLIEntailment": True}}]))
    p = readers.parameter_sets(spark, str(tmp_path / "p.json")).first()
    assert p["useNLIEntailment"] and p["usePatternMatching"] and not p["useCombinedScoring"]
    case = spark.createDataFrame([("law", "test_0001", "see the a", [("user", "h")], ["X"], [(4, 9)])], "sector string, test string, prompt string, history array<struct<role:string,content:string>>, expected_issue_codes array<string>, missing_references array<struct<start:long,end:long>>")
    sinks.write_case_files(case, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "annotated")).first()["value"] == "see the a[MISSING_REFERENCE]"
    sinks.write_prompts(case.select("prompt"), str(tmp_path / "prompts"))
    assert spark.read.json(str(tmp_path / "prompts" / "stats")).first()["chars"] == 9


def test_console_summary(spark):
    c = report.complete(spark.createDataFrame([("a", "Dear {{x}}", ["MISSING_PLACEHOLDER"])], "case_id string, prompt string, expected_issue_codes array<string>"))
    r = evaluate.results(c, {"baseline": Options()})
    assert r.first()["latency"] > 0
    lines = sinks.console_summary(evaluate.summary_by_set(r)).split("\n")
    assert lines[0] == "Total runs: 1" and lines[2] == "Success rate: 100.0%" and lines[3].startswith("baseline: runs 1") and lines[3].endswith("F1 1.000")
