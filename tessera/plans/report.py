"""Reports: all rules over a table of cases, as a flat issue table and as one nested row a case."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import antecedents, conflicts, issues, placeholders, reference, schema, semantic, tokens
from tessera.options import Options
from tessera.store import cut

CASES = (
    "case_id string, prompt string, messages array<struct<role:string,content:string>>, schema_json string, model string, template_dialect string, "
    "attachments array<struct<type:string,name:string>>"
)
RULES = {
    "MISSING_PLACEHOLDER": placeholders.rule, "MISSING_REFERENCE": reference.rule, "CONFLICTING_INSTRUCTION": conflicts.rule,
    "SCHEMA_RISK": schema.risk_rule, "INVALID_SCHEMA": schema.validation_rule, "TOKEN_OVERAGE": tokens.rule,
}


def complete(cases: DataFrame) -> DataFrame:
    """The cases with every input column, null where the table has none."""
    for name, kind in (f.strip().split(" ", 1) for f in _fields(CASES)):
        if name not in cases.columns:
            cases = cases.withColumn(name, F.lit(None).cast(kind))
    return cases


def _fields(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i])
            start = i + 1
    return [*out, ddl[start:]]


def issue_table(cases: DataFrame, options: Options = Options(), models: semantic.Models | None = None, costs: DataFrame | None = None) -> DataFrame:
    """One row an issue. Rules that are switched off are not planned; with models, references and conflicts use them. ``costs``: those of the cases, if known."""
    cases = complete(cases)
    parts = []
    for code, rule in RULES.items():
        if code in options.disabled_rules:
            continue
        if models and code == "MISSING_REFERENCE" and (options.use_semantic or options.use_nli or options.use_nlp):
            found = reference.candidates(cases, options, semantic.entity_udf(models.entities))
            v = reference.views(cases, options)
            if options.use_semantic or options.use_nli:
                found = semantic.resolve(found, v, models, options)
            parts.append(reference.report(v, found))
        elif models and code == "CONFLICTING_INSTRUCTION" and (models.embed or models.entail):
            parts.append(semantic.conflict_rule(cases, models, options))
        elif costs is not None and code == "TOKEN_OVERAGE":
            parts.append(tokens.overages(costs, options))
        else:
            parts.append(rule(cases, options))
    return reduce(DataFrame.unionByName, parts) if parts else placeholders.rule(cases.limit(0), options)


def issue_counts(found: DataFrame) -> DataFrame:
    """(case_id, issue_counts map) of the cases that have issues."""
    per = found.groupBy("case_id", "code").agg(F.count("*").alias("n"))
    return per.groupBy("case_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("code", "n")))).alias("issue_counts"))


def analyze(cases: DataFrame, options: Options = Options(), models: semantic.Models | None = None) -> DataFrame:
    """One nested report a case: issues in rule order, suggestions, cost, summary (null without issues).

    All rules read the cases, most of them several times; so cases and costs are written once, and not put together again in each branch.
    """
    cases = cut(complete(cases), "cases")
    costs = tokens.costs(cases, options) if "TOKEN_OVERAGE" not in options.disabled_rules else tokens.costs(cases.limit(0), options)
    costs = cut(costs, "costs")
    found = issue_table(cases, options, models, costs)
    body = F.struct("rule_ord", "id", "code", "severity", "detail", "confidence", "summary", "occurrences", "first_char", "message_index", "suggestions")
    per = found.groupBy("case_id").agg(F.sort_array(F.collect_list(body)).alias("issues"))
    count = lambda code: F.size(F.filter("issues", lambda i: i["code"] == code)).cast("long")
    counted = F.filter(F.array(*[F.struct(F.lit(c).alias("code"), count(c).alias("n")) for c in sorted(RULES)]), lambda x: x["n"] > 0)
    cost = costs.select("case_id", F.struct(F.col("tokens").alias("est_input_tokens"), F.col("usd").alias("est_usd"), "char_count", "method").alias("cost"))
    d = cases.select("case_id").join(per, "case_id", "left").join(cost, "case_id", "left")
    summary = F.when(F.col("issues").isNotNull(), F.struct(F.map_from_entries(counted).alias("issue_counts"), F.lit("high").alias("confidence")))
    d = d.withColumn("summary_of", summary).withColumn("issues", F.coalesce("issues", F.array()))
    advice = F.flatten(F.transform("issues", lambda i: F.transform(i["suggestions"], lambda s: F.struct(s["type"].alias("type"), s["text"].alias("text"), i["id"].alias("for")))))
    return d.select("case_id", "issues", advice.alias("suggestions"), "cost", F.col("summary_of").alias("summary"))


def methods_used(found: DataFrame) -> DataFrame:
    """(case_id, methods): the distinct methods that judged the references an issue lists, sorted."""
    refs = found.where("code = 'MISSING_REFERENCE'")
    return refs.select("case_id", F.array_sort(F.array_distinct(F.filter(F.transform("occurrences", lambda o: o["fulfillment_method"]), lambda m: m.isNotNull()))).alias("methods"))


def resolved_by(cases: DataFrame, options: Options = Options()) -> DataFrame:
    """(case_id, candidates, uncovered, score, flagged, methods) of every case, with the methods that resolved its references."""
    v = reference.views(complete(cases), options)
    return antecedents.scores(v, reference.candidates(complete(cases), options)).select("case_id", "n", "uncovered", "score", "flagged", "methods")


def rule_timings(cases: DataFrame, options: Options = Options(), models: semantic.Models | None = None) -> dict[str, float]:
    """Milliseconds of each rule that is switched on, run by itself over all cases."""
    out = {}
    for code in RULES:
        if code not in options.disabled_rules:
            began = time.perf_counter()
            issue_table(cases, options.without(*[c for c in RULES if c != code]), models).write.format("noop").mode("overwrite").save()
            out[code] = (time.perf_counter() - began) * 1000
    return out


def attach(cases: DataFrame, options: Options = Options(), models: semantic.Models | None = None) -> DataFrame:
    """The cases with their reports in a column, for ``cases.transform(attach)`` ahead of a model call."""
    r = analyze(cases, options, models)
    return cases.join(r.select("case_id", F.struct(*r.columns).alias("report")), "case_id", "left")
