"""The index of words against patterns made of the terms, on random cases."""

import random

import pytest
from pyspark.sql import functions as F

from tessera import lexicon as L
from tessera.functions import text as T
from tessera.operators import antecedents, reference
from tessera.options import Options
from tessera.plans import report

_BITS = [
    "the report", "a report", "report", "reports", "the  report", "the\nreport", "lathe report", "data report", "this memo", "memo", "every document", "documents", "the document", "Papers", "papers_x",
    "follow-up", "the follow-up", "re-report", "é report", "ételist", "list", "the list", "items", "the items below", "the following results", "as shown below", "these files", "findings", "output:", "(output)",
    "results", "the dataset", "table,", "csv", "the table", "see below", "the chat", "conversation", "that thread", "so", "and", "then", "boxes.", "\n", "\t", "x" * 7, "S", "the snippet", "script's", "the code",
]


def _case(r, i):
    say = lambda n: "".join(r.choice(_BITS) + r.choice([" ", " ", "  ", ". ", "\n", ", "]) for _ in range(n))
    far = "filler words here " * 300 if i % 5 == 0 else ""
    messages = [("user", say(r.choice([0, 3, 8, 40]))) for _ in range(r.randrange(0, 3))]
    last = say(r.randrange(0, 6)) + far + say(r.randrange(1, 14))
    files = [("file", r.choice(["memo_v2.pdf", "Sales-Report.docx", "", "x.csv"]))] if r.random() < 0.3 else []
    return (f"c{i}", None if messages else last, [*messages, ("user", last)] if messages else [], files)


def _cases(spark, n=45):
    r = random.Random(11)
    kind = "case_id string, prompt string, messages array<struct<role:string,content:string>>, attachments array<struct<type:string,name:string>>"
    far = ("far", "Our memo is here. " + "filler words here " * 300 + "Read the report.", [], [])
    return report.complete(spark.createDataFrame([far, *(_case(r, i) for i in range(n))], kind).repartition(3))


@pytest.mark.parametrize("options", [
    Options(), Options(strict_forward_refs=True, use_nlp=True), Options(reference_heads=("follow-up", "thing"), synonyms={"report": ["follow-up"], "thing": ["so"]}), Options(window_messages=1, window_chars=60),
])
def test_index_against_patterns(spark, options):
    cases = _cases(spark)
    got = reference.candidates(cases, options)
    d = antecedents.terms(_found(cases, options), options).withColumn("long_hist", T.count_words(F.col("hist")) > 40)
    d = d.withColumn("held", F.contains("attached", F.col("head")) | F.exists("syns", lambda s: F.contains(F.col("attached"), s)))
    want = d.withColumn("told", antecedents.by_patterns(options)).select("*", "told.*")
    want = want.withColumn("penalty", F.coalesce(F.col("start") - F.col("place") > antecedents.FAR, F.lit(False)))
    cols = ["case_id", "forward", "start", "end", "head", "span", "method", "matched", "penalty"]
    key = lambda x: tuple((y is None, str(y)) for y in x)
    a, b = (sorted((tuple(r) for r in x.select(*cols).collect()), key=key) for x in (got, want))
    assert a == b and len(a) > 80
    seen = {r[6] for r in a}
    assert {None, "pattern"} < seen and len(seen) > 2
    if options == Options():
        assert any(r[8] for r in a)


def _found(cases, options):
    """The candidates before they are judged."""
    kept = []
    old = antecedents.judge
    antecedents.judge = lambda v, found, o: kept.append(found) or found
    try:
        reference.candidates(cases, options)
    finally:
        antecedents.judge = old
    return kept[0]


def test_index_rows(spark):
    d = spark.createDataFrame([("a", "c", "The reports. A report the\nreport lathe report")], "case_id string, part string, text string")
    got = {r["word"]: tuple(r)[3:] for r in antecedents.word_index(d).collect()}
    assert got["report"] == (1, 7, 3, None, 1, 3) and got["reports"] == (1, 1, None, None, 1, None) and got["lathe"] == (6, 6, 6, 6, 6, 6)


def test_scores_count_resolved_references(spark):
    c = report.complete(spark.createDataFrame([("a", "We have a memo here. The memo is long. Read the list. Continue.", None), ("b", "no such thing", None)], "case_id string, prompt string, model string"))
    got = {r["case_id"]: r.asDict() for r in report.resolved_by(c).collect()}
    assert got["a"]["n"] == 2 and got["a"]["uncovered"] == 1 and got["a"]["flagged"] and got["a"]["methods"] == ["exact"] and got["a"]["score"] == 0
    assert got["b"] == {"case_id": "b", "n": 0, "uncovered": 0, "score": 0, "flagged": False, "methods": []}


def test_nothing_to_judge(spark):
    empty = _cases(spark, 3).limit(0)
    assert reference.candidates(empty).collect() == [] and reference.rule(empty).collect() == []
    assert L.nouns()[0] == "report"
