"""Evaluation: cases under parameter sets, accuracy, and summaries of the runs."""

from __future__ import annotations

import time
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.options import Options
from tessera.plans import report

FLAGS = ["useSemanticSimilarity", "useNLIEntailment", "useNLPExtraction", "usePatternMatching", "useSemanticConflictDetection", "useNLIConflictDetection", "useCombinedScoring"]
#: The default parameter sets and the flags that each switches on.
DEFAULT_SETS = [
    ("baseline", []), ("semantic-similarity", FLAGS[:1]), ("nli-entailment", FLAGS[1:2]), ("semantic-nli-combined", [FLAGS[0], FLAGS[1], FLAGS[6]]),
    ("nlp-extraction", FLAGS[2:3]), ("conflict-semantic", FLAGS[4:5]), ("conflict-nli", FLAGS[5:6]), ("all-features", FLAGS),
]


def parameter_sets(spark) -> DataFrame:
    rows = [(name, i, *[f in on or (f == "usePatternMatching") for f in FLAGS]) for i, (name, on) in enumerate(DEFAULT_SETS)]
    return spark.createDataFrame(rows, "parameter_set string, ord int, " + ", ".join(f"{f} boolean" for f in FLAGS))


def runs(cases: DataFrame, sets: DataFrame, iterations: int = 1) -> DataFrame:
    """Every case under every set, ``iterations`` times: an expansion of each case row by a handful of sets."""
    each = F.broadcast(sets.agg(F.sort_array(F.collect_list("parameter_set")).alias("sets")))  # a row; sets are a user's short list
    return cases.join(each, F.lit(True)).withColumn("parameter_set", F.explode("sets")).drop("sets").withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(iterations))))


def accuracy(detected: Column, expected: Column) -> Column:
    """tp, fp, fn, precision, recall, f1 over lists; null if nothing is expected. A code detected twice counts twice."""
    tp = F.size(F.filter(detected, lambda c: F.array_contains(expected, c))).cast("long")
    fp = F.size(F.filter(detected, lambda c: ~F.array_contains(expected, c))).cast("long")
    fn = F.size(F.filter(expected, lambda c: ~F.array_contains(detected, c))).cast("long")
    p = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    r = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return F.when(F.size(expected) > 0, F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), p.alias("precision"), r.alias("recall"), f1.alias("f1")))


def results(cases: DataFrame, options_by_set: dict[str, Options], expected: str = "expected_issue_codes", iterations: int = 1, models=None) -> DataFrame:
    """Result rows of real runs: each set is run over all cases and timed; latency is its wall time, in milliseconds a case."""
    out, n = [], max(cases.count(), 1)
    for name, options in options_by_set.items():
        found = report.issue_table(cases, options, models).groupBy("case_id").agg(F.sort_array(F.collect_list("code")).alias("detected"), F.count("*").alias("issues_total"))
        d = cases.join(found, "case_id", "left").withColumn("detected", F.coalesce("detected", F.array())).withColumn("issues_total", F.coalesce("issues_total", F.lit(0)))
        d = d.withColumn("accuracy", accuracy(F.col("detected"), F.coalesce(F.col(expected), F.array().cast("array<string>"))))
        for i in range(iterations):
            began = time.perf_counter()
            found.write.format("noop").mode("overwrite").save()
            each = (time.perf_counter() - began) * 1000 / n
            out.append(d.select("case_id", F.lit(name).alias("parameter_set"), F.lit(i + 1).alias("iteration"), F.lit(each).alias("latency"), "issues_total", "detected", "accuracy", F.lit(None).cast("string").alias("error")))
    return reduce(DataFrame.unionByName, out)


def modes(options: Options = Options()) -> dict[str, Options]:
    """The options of the four-mode comparison: patterns alone, with embeddings, with entailment, with both."""
    return {name: replace(options, use_semantic=s, use_nli=e) for name, s, e in (("baseline", False, False), ("semantic", True, False), ("nli", False, True), ("both", True, True))}


def summary_by_set(rows: DataFrame) -> DataFrame:
    """Per set: runs, mean latency over all runs, issues, share without error, and means of accuracy where there is any."""
    return rows.groupBy("parameter_set").agg(
        F.count("*").alias("total_runs"), F.avg("latency").alias("avg_latency"), F.sum("issues_total").alias("total_issues"), F.avg(F.col("error").isNull().cast("double")).alias("success_rate"),
        *[F.avg(f"accuracy.{m}").alias(f"avg_{m}") for m in ("precision", "recall", "f1", "tp", "fp", "fn")],
    )


def summary_by_case(rows: DataFrame) -> DataFrame:
    return rows.groupBy("case_id").agg(F.count("*").alias("runs"), F.avg("latency").alias("avg_latency"), F.sum("issues_total").alias("total_issues"))


def issues_by_code(rows: DataFrame, keys: list[str], detected: str = "detected") -> DataFrame:
    return rows.select(*keys, F.explode(detected).alias("code")).groupBy(*keys, "code").agg(F.count("*").alias("n"))


def feature_impact(summary: DataFrame, sets: DataFrame) -> DataFrame:
    """Per flag: mean latency and F1 of the sets with and without it, and the change in per cent; only where both kinds exist."""
    d = summary.join(sets, "parameter_set")
    flat = d.unpivot(["avg_latency", "avg_f1"], FLAGS, "feature", "is_on") if set(FLAGS) <= set(d.columns) else d
    on, off = F.col("is_on"), ~F.col("is_on")
    g = flat.groupBy("feature").agg(
        *[F.avg(F.when(c, F.col(v))).alias(f"{n}_{w}") for v, n in (("avg_latency", "latency"), ("avg_f1", "f1")) for c, w in ((on, "on"), (off, "off"))], F.count_if(on).alias("n_on"), F.count_if(off).alias("n_off")
    )
    pct = lambda n: F.when(F.col(f"{n}_off") != 0, (F.col(f"{n}_on") - F.col(f"{n}_off")) / F.col(f"{n}_off") * 100)
    return g.where((F.col("n_on") > 0) & (F.col("n_off") > 0)).select("feature", "latency_on", "latency_off", "f1_on", "f1_off", pct("latency").alias("latency_change"), pct("f1").alias("f1_change"))


def history_trend(reports: DataFrame, most: int = 10) -> DataFrame:
    """reports: (file, parameter_set, avg_latency, avg_f1). Of the latest ``most`` files, per set: latest value, mean, first minus last."""
    files = reports.select("file").distinct().orderBy(F.desc("file")).limit(most)
    d = reports.join(files, "file", "left_semi")
    at = lambda c, f: f(c, "file")
    return d.groupBy("parameter_set").agg(
        *[x for c in ("avg_latency", "avg_f1") for x in (at(c, F.max_by).alias(f"{c}_current"), F.avg(c).alias(f"{c}_mean"), (at(c, F.max_by) - at(c, F.min_by)).alias(f"{c}_trend"))], F.count("*").alias("reports")
    )


def metric_table(summary: DataFrame) -> DataFrame:
    """Summary as text with fixed decimals, N/A where no accuracy exists."""
    num = lambda c, n: F.coalesce(F.format_string(f"%.{n}f", F.col(c)), F.lit("N/A"))
    txt = lambda c, n: F.when(F.col(c).isNull(), F.lit("N/A")).otherwise(num(c, n))
    return summary.select("parameter_set", "total_runs", num("avg_latency", 2).alias("avg_latency"), F.format_string("%.1f", F.col("success_rate") * 100).alias("success_rate"), *[txt(f"avg_{m}", 3).alias(m) for m in ("precision", "recall", "f1")])


def band(f1: Column) -> Column:
    return F.when(f1 >= 0.8, "high").when(f1 >= 0.6, "medium").otherwise("low")


def dataset_stats(cases: DataFrame, group: str = "category") -> DataFrame:
    """Per group: cases, tokens and mean tokens at four characters each."""
    t = F.floor(F.length(F.coalesce("prompt", F.lit(""))) / 4)
    return cases.groupBy(group).agg(F.count("*").alias("cases"), F.sum(t).alias("tokens"), F.avg(t).alias("avg_tokens"))
