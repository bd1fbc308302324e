"""Writers of reports, metric tables, configurations and cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import labels, linediff
from tessera.plans import evaluate


def write_reports(reports: DataFrame, path: str) -> None:
    reports.write.mode("overwrite").json(path)


def write_metrics(summary: DataFrame, path: str) -> None:
    evaluate.metric_table(summary).write.mode("overwrite").option("header", True).csv(path)


def write_impact(impact: DataFrame, path: str) -> None:
    impact.write.mode("overwrite").option("header", True).csv(path)


def write_history(trend: DataFrame, path: str) -> None:
    trend.write.mode("overwrite").json(path)


def write_config(sets: DataFrame, path: str) -> None:
    sets.write.mode("overwrite").json(path)


def html_report(summary: DataFrame) -> str:
    """A table of the summary with F1 bands; a summary has a row a parameter set."""
    rows = evaluate.metric_table(summary).withColumn("f", F.expr("try_cast(f1 as double)")).withColumn("band", evaluate.band(F.col("f"))).orderBy("parameter_set").collect()
    cells = "".join(f"<tr class='{r['band']}'><td>{r['parameter_set']}</td><td>{r['total_runs']}</td><td>{r['avg_latency']}</td><td>{r['f1']}</td></tr>" for r in rows)
    return f"<!DOCTYPE html><meta charset='utf-8'><table><tr><th>set</th><th>runs</th><th>latency</th><th>F1</th></tr>{cells}</table>"


def upsert_cases(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Old cases, replaced by new ones of the same id."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)


def write_cases(cases: DataFrame, path: str, by: str = "category") -> None:
    cases.write.mode("overwrite").partitionBy(by).json(path)


def write_case_files(cases: DataFrame, path: str) -> None:
    """The four parts of each case under <part>/sector=<sector>/test=<test>: prompt, history, expected output, annotated prompt."""
    spans = F.coalesce("missing_references", F.array())
    parts = {
        "prompt": F.col("prompt"), "history": F.to_json("history"), "annotated": annotate(F.col("prompt"), spans, "[MISSING_REFERENCE]"),
        "expected_output": F.to_json(F.struct("expected_issue_codes", "missing_references")),
    }
    for name, value in parts.items():
        cases.select("sector", "test", F.coalesce(value, F.lit("")).alias("value")).write.mode("overwrite").partitionBy("sector", "test").option("lineSep", "\n").text(f"{path}/{name}")


def console_summary(summary: DataFrame) -> str:
    """Totals and each set's figures as lines of text; a summary has a row a parameter set."""
    rows = evaluate.metric_table(summary).join(summary.select("parameter_set", "total_issues"), "parameter_set").orderBy("parameter_set").collect()
    total = summary.agg(F.sum("total_runs").alias("n"), (F.sum(F.col("avg_latency") * F.col("total_runs")) / F.sum("total_runs")).alias("ms"), (F.sum(F.col("success_rate") * F.col("total_runs")) / F.sum("total_runs") * 100).alias("ok")).first()
    lines = [f"Total runs: {total['n'] or 0}", f"Avg latency: {total['ms'] or 0:.2f}ms", f"Success rate: {total['ok'] or 0:.1f}%"]
    for r in rows:
        lines.append(f"{r['parameter_set']}: runs {r['total_runs']}, latency {r['avg_latency']}ms, success {r['success_rate']}%, issues {r['total_issues']}, precision {r['precision']}, recall {r['recall']}, F1 {r['f1']}")
    return "\n".join(lines)


def write_prompts(prompts: DataFrame, path: str, text: str = "prompt") -> None:
    """Generated prompts by kind under <path>/raw, annotated and stats, one file set each."""
    prompts.write.mode("overwrite").parquet(f"{path}/raw")
    prompts.withColumn(text, labels.tagged(F.col(text))).write.mode("overwrite").parquet(f"{path}/annotated")
    n = F.length(text)
    prompts.agg(F.count("*").alias("prompts"), F.sum(n).alias("chars"), F.sum(F.ceil(n / 4)).alias("tokens")).write.mode("overwrite").json(f"{path}/stats")


def annotate(text, spans, tag: str = " [MISSING_REFERENCE]"):
    """The text with a tag behind each span (0-based start and end), right to left."""
    order = F.reverse(F.sort_array(spans))
    return F.aggregate(order, text, lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["end"].cast("int")), F.lit(tag), F.substring(acc, (s["end"] + 1).cast("int"), F.length(acc))))


def write_patches(pairs: DataFrame, path: str, id_col: str = "id", before: str = "original", after: str = "proposed") -> None:
    """One JSON row a pair of texts: its id, line diff and counts of kept, removed and added lines."""
    linediff.patches(pairs, id_col, before, after).write.mode("overwrite").json(path)
