"""One rule at a time: small prompts and what must be found in them."""

import json

import pytest

from tessera.operators import conflicts, placeholders, reference, schema, tokens
from tessera.options import Options
from tessera.plans import report


def make(spark, rows):
    return report.complete(spark.createDataFrame([{**dict.fromkeys([f.strip().split(" ")[0] for f in report._fields(report.CASES)]), **r} for r in rows], report.CASES))


def one(spark, rule, options=Options(), **case):
    got = rule(make(spark, [{"case_id": "x", **case}]), options).collect()
    return got[0] if got else None


def user(*texts):
    return [{"role": "user", "content": t} for t in texts]


LONG = " ".join(f"word{i}" for i in range(30)) + "."


@pytest.mark.parametrize(
    "text, dialect, parts",
    [("Hello {{customer_name}}, welcome!", "handlebars", ["customer_name"]), ("Hello John, welcome!", None, []), ("Process {{user_id}} and {{order_id}}", None, ["user_id", "order_id"]), ("<% user %>", None, ["user"]), ("", None, []), (None, None, [])],
)
def test_placeholders(spark, text, dialect, parts):
    got = one(spark, placeholders.rule, prompt=text, template_dialect=dialect)
    assert (got is not None) == bool(parts)
    for p in parts:
        assert p in got["detail"]


def test_placeholder_counts_and_offsets(spark):
    got = one(spark, placeholders.rule, prompt="{{a}} {{b}} {{a}} {{a}} {{a}}")
    assert got["detail"] == "Unresolved placeholders: a (×4), b" and got["first_char"] == 0
    assert [(o["text"], o["start"]) for o in got["occurrences"]] == [("{{a}}", 0), ("{{a}}", 12), ("{{a}}", 18), ("{{b}}", 6)]


@pytest.mark.parametrize("text, n", [("Be concise and give a detailed step by step explanation.", 1), ("Output JSON only. Add commentary after the JSON.", 1), ("Be concise and brief.", 0)])
def test_conflicts(spark, text, n):
    assert (one(spark, conflicts.rule, prompt=text) is not None) == bool(n)


def test_conflict_pair(spark):
    got = one(spark, conflicts.rule, prompt="Be concise and give a detailed step by step explanation.")
    o = got["occurrences"][0]
    assert (o["bucket"], o["text"], o["start"], o["paired_text"], o["paired_start"], got["confidence"]) == ("verbosity", "detailed", 22, "concise", 3, "high")


def test_schema_risk(spark):
    text = "Output JSON only. Add commentary after the JSON."
    got = one(spark, schema.risk_rule, prompt=text, schema_json='{"type":"object"}')
    assert got and got["suggestions"][0]["type"] == "ENFORCE_JSON"
    assert one(spark, schema.risk_rule, prompt=text) is None


@pytest.mark.parametrize(
    "doc, n",
    [
        ({"properties": {"a": {"type": "string"}}}, 1), ({"type": "objekt"}, 1), ({"type": "object", "properties": {"a": {"type": "strng"}}}, 1),
        ({"type": "object", "properties": {"a": {"type": "strng"}, "b": {"type": "bool"}}}, 2), ({"type": "object", "properties": {"a": {"type": "string"}}}, 0), (None, 0),
        ({"items": {}}, 1), ({"type": ["string", "nul"]}, 1), ({"type": "object", "required": "a"}, 1), ({"type": "string", "minLength": -1}, 1), ({"type": "array", "items": {"minimum": "1"}}, 1),
    ],
)
def test_schema_validation(spark, doc, n):
    got = one(spark, schema.validation_rule, schema_json=json.dumps(doc) if doc else None)
    assert (len(got["occurrences"]) if got else 0) == n
    if n:
        assert got["code"] == "INVALID_SCHEMA" and got["suggestions"][0]["type"] == "TIGHTEN_INSTRUCTION"
    if n == 2:
        assert "with 2 errors" in got["detail"]


def test_tokens(spark):
    c = tokens.costs(make(spark, [{"case_id": "a", "prompt": "Hello world", "model": "gpt-4o"}])).first()
    assert c["tokens"] == 3 and c["method"] == "cheap" and c["usd"] > 0
    got = one(spark, tokens.rule, Options(max_input_tokens=1000), prompt="word " * 10000, model="gpt-3.5-turbo")
    assert got["code"] == "TOKEN_OVERAGE" and "1,000 token limit" in got["detail"]
    huge = one(spark, tokens.rule, Options(max_chars=10), prompt="word " * 10, model="gpt-4")
    assert "character limit (10)" in huge["detail"]
    assert one(spark, tokens.rule, prompt="word " * 10000) is None
    off = tokens.costs(make(spark, [{"case_id": "a", "prompt": "Hello", "model": "gpt-4o"}]), Options(token_estimation="off")).first()
    assert off["tokens"] == 0 and off["method"] == "off" and off["usd"] is None


@pytest.mark.parametrize(
    "prompt, messages, extra, options, flagged",
    [
        ("Summarize the paper.", None, {}, Options(), True), ("Summarize the reports.", None, {}, Options(), True),
        (None, user("Here is a document about cats.", "Summarize the paper."), {}, Options(), False), (None, user("Here is a document about cats.", "Summarize the report."), {}, Options(), False),
        (None, user("Here is the report.", "Summarize the reports."), {}, Options(), False),
        (None, user("Here is the report.", "thanks", "ok", "Summarize the report."), {}, Options(window_messages=1), True), (None, user("Here is the report.", "ok", "Summarize the report."), {}, Options(window_messages=2), False),
        ("Check the widget.", None, {}, Options(reference_heads=("widget",)), True), ("Check the widget.", None, {}, Options(), False),
        (None, user("I sent a gadget.", "Check the widget."), {}, Options(reference_heads=("widget",), synonyms={"widget": ["gadget"]}), False),
        ("Continue as discussed above.", None, {}, Options(), True), ("Summarize the report.", None, {"attachments": [{"type": "file", "name": "sales_report.pdf"}]}, Options(), False),
        ("I wrote a report. Summarize the report.", None, {}, Options(), False), ("Do as shown below.", None, {}, Options(), False), ("Do as shown below.", None, {}, Options(strict_forward_refs=True), True),
        ("Review the following report.", None, {}, Options(), True), ("Hello there.", None, {}, Options(), False),
    ],
)
def test_reference(spark, prompt, messages, extra, options, flagged):
    got = one(spark, reference.rule, options, prompt=prompt, messages=messages, **extra)
    assert (got is not None) == flagged


def test_reference_confidence(spark):
    assert one(spark, reference.rule, prompt="Summarize the report.")["confidence"] == "low"
    assert one(spark, reference.rule, messages=user(LONG + LONG, "Summarize the report."))["confidence"] == "high"


def test_issue_ids_are_stable_and_reports_nest(spark):
    c = make(spark, [{"case_id": "a", "prompt": "Dear {{x}}, be concise but detailed.", "model": "gpt-4"}, {"case_id": "b", "prompt": "fine", "model": "gpt-4"}])
    a, b = (sorted(report.analyze(c).collect(), key=lambda r: r["case_id"]) for _ in range(2))
    assert a == b and [i["code"] for i in a[0]["issues"]] == ["MISSING_PLACEHOLDER", "CONFLICTING_INSTRUCTION"]
    assert a[0]["summary"]["issue_counts"] == {"MISSING_PLACEHOLDER": 1, "CONFLICTING_INSTRUCTION": 1} and a[1]["summary"] is None and a[1]["issues"] == []
    off = report.issue_table(c, Options(disabled_rules=tuple(report.RULES)))
    assert off.count() == 0
