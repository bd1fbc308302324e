"""Unresolved template placeholders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import lexicon as L
from tessera.functions import text as T
from tessera.operators import issues
from tessera.options import Options


def detect_dialect(text: Column) -> Column:
    """handlebars for a plain variable in double braces, else ejs for ``<%``, else null."""
    return F.when(F.regexp_like(text, F.lit(r"\{\{\s*[a-zA-Z0-9_.]+\s*\}\}")), "handlebars").when(F.contains(text, F.lit("<%")), "ejs")


def scan(df: DataFrame, text: str = "text", dialect: Column | None = None) -> DataFrame:
    """One row a placeholder: the columns of ``df``, dialect, variable, pos and end (the true end in the text)."""
    d = df.withColumn("dialect", F.coalesce(dialect, detect_dialect(F.col(text))) if dialect is not None else detect_dialect(F.col(text)))
    kinds = sorted(L.PLACEHOLDER)
    found = reduce(lambda acc, k: F.when(F.col("dialect") == k, T.find_all(F.col(text), L.PLACEHOLDER[k], L.PLACEHOLDER_GROUP[k])).otherwise(acc), kinds, F.array().cast("array<struct<text:string,value:string,start:bigint,end:bigint>>"))
    return d.where(F.col("dialect").isNotNull()).withColumn("m", F.explode(found)).select(*df.columns, "dialect", F.col("m.value").alias("variable"), F.col("m.start").alias("pos"), F.col("m.end").alias("end"))


def summarize(found: DataFrame, keys: list[str]) -> DataFrame:
    """Count, first and all positions of each variable."""
    return found.groupBy(*keys, "variable").agg(F.count("*").alias("count"), F.min("pos").alias("first_pos"), F.sort_array(F.collect_list("pos")).alias("positions"))


def top_positions(found: DataFrame, keys: list[str], per_variable: int = 3, overall: int = 50) -> DataFrame:
    """The first places of each variable, variables by first sight, and not more than ``overall`` of them."""
    w = Window.partitionBy(*keys, "variable")
    ranked = found.withColumn("rank", F.row_number().over(w.orderBy("pos"))).withColumn("seen", F.min("pos").over(w)).where(F.col("rank") <= per_variable)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("seen", "pos"))).where(F.col("place") <= overall).drop("seen")


def rule(cases: DataFrame, options: Options = Options()) -> DataFrame:
    d = cases.select("case_id", T.full_text(F.col("prompt"), F.col("messages")).alias("text"), issues.scope_index(F.col("messages")).alias("message_index"), *([F.col("template_dialect")] if "template_dialect" in cases.columns else []))
    wanted = F.lit(options.template_dialect) if options.template_dialect else F.col("template_dialect") if "template_dialect" in d.columns else None
    found = scan(d.where(F.coalesce("text", F.lit("")) != ""), dialect=wanted)
    best = top_positions(found, ["case_id"])
    name = F.concat(F.lit("{{"), F.col("variable"), F.lit("}}"))
    occ = best.withColumn("o", issues.occurrence(text=name, start=F.col("pos"), end=F.col("pos") + F.length("variable") + 4, preview=T.preview(F.col("text"), F.col("pos"), F.col("pos") + F.length("variable") + 4)))
    occ = occ.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "o"))), lambda x: x["o"]).alias("occurrences"))
    per = summarize(found, ["case_id", "message_index"]).groupBy("case_id", "message_index").agg(F.sort_array(F.collect_list(F.struct("first_pos", "variable", "count"))).alias("vars"))
    d = per.join(occ, "case_id")
    each = F.transform("vars", lambda v: F.concat(v["variable"], F.when(v["count"] > 1, F.concat(F.lit(" (×"), v["count"].cast("string"), F.lit(")"))).otherwise(F.lit(""))))
    detail = F.concat(F.lit("Unresolved placeholder"), F.when(F.size("vars") > 1, F.lit("s")).otherwise(F.lit("")), F.lit(": "), F.array_join(each, ", "))
    summary = F.transform("vars", lambda v: F.struct(v["variable"].alias("text"), v["count"].alias("count")))
    return issues.issue(d, 1, "MISSING_PLACEHOLDER", "high", detail, F.lit("high"), summary, F.col("occurrences"), F.col("vars")[0]["first_pos"], F.col("message_index"), issues.suggestions())
