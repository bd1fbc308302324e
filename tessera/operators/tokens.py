"""Token estimates, overage and cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import lexicon as L
from tessera.functions import text as T
from tessera.operators import bpe, issues
from tessera.options import Options

#: Methods from least to most conservative.
METHODS = ["off", "cheap", "cheap_over", "exact", "exact_boundary"]


def cheap_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def fallback_tokens(text: Column) -> Column:
    """What exact counts fall back to without a tokenizer: three quarters of the white-space words."""
    return F.ceil(T.real_words(text) * 0.75).cast("long")


def band(cheap: Column, window: Column, mode: str = "auto") -> Column:
    """The method that a text's cheap estimate asks for."""
    if mode != "auto":
        return F.lit(mode)
    return F.when(cheap < 0.6 * window, "cheap").when(cheap > 1.1 * window, "cheap_over").otherwise("exact_boundary")


def estimate(df: DataFrame, text: str, window: Column, mode: str = "auto", ranks: bpe.RankFiles | None = None, model: str | None = None) -> DataFrame:
    """Adds tokens and method. Only rows that need exact counts are cut into pieces, as a branch of their own; without rank files they fall back to words."""
    d = df.withColumn("cheap_", cheap_tokens(F.col(text))).withColumn("method", band(F.col("cheap_"), window, mode))
    exact = F.col("method").isin("exact", "exact_boundary")
    plain = d.withColumn("tokens", F.when(F.col("method") == "off", F.lit(0).cast("long")).when(exact, fallback_tokens(F.col(text))).otherwise(F.col("cheap_")))
    if ranks:
        plain = plain.where(~exact).unionByName(bpe.count_tokens(d.where(exact), text, ranks, model))
    return plain.drop("cheap_")


def with_model(df: DataFrame, model_col: str = "model") -> DataFrame:
    """Adds window, in_usd and out_usd of the row's model; six models, so the lookup is an expression and not a join."""
    pick = lambda i: reduce(lambda acc, m: F.when(F.col(model_col) == m[0], F.lit(m[i])).otherwise(acc), L.MODELS, F.lit(None))
    return df.withColumn("window", F.coalesce(pick(1).cast("long"), F.lit(L.DEFAULT_WINDOW).cast("long"))).withColumn("in_usd", pick(2).cast("double")).withColumn("out_usd", pick(3).cast("double"))


def cost(tokens: Column, in_usd: Column, out_usd: Column) -> Column:
    """Dollars for the input and half as many output tokens."""
    return tokens / 1000 * in_usd + F.ceil(tokens * 0.5) / 1000 * out_usd


def costs(cases: DataFrame, options: Options = Options(), ranks: bpe.RankFiles | None = None) -> DataFrame:
    """One row a case with a model: text length, tokens, method, window, cost."""
    d = cases.where(F.col("model").isNotNull() & (F.col("model") != "")).select("case_id", "model", F.col("prompt").isNotNull().alias("has_prompt"), "messages", T.full_text(F.col("prompt"), F.col("messages")).alias("text"))
    d = with_model(d.where(F.coalesce("text", F.lit("")) != "")).withColumn("char_count", F.length("text").cast("long"))
    huge = d.where(F.col("char_count") > options.max_chars).select("case_id", "model", "has_prompt", "char_count", "window", F.ceil(F.col("char_count") / 4).cast("long").alias("tokens"), F.lit("char_estimate").alias("method"), F.lit(None).cast("double").alias("usd"))
    rest = d.where(F.col("char_count") <= options.max_chars)
    parts = F.when(F.size("messages") > 0, F.transform("messages", lambda m: F.coalesce(m["content"], F.lit("")))).otherwise(F.array("text"))
    each = estimate(rest.select("case_id", "model", "window", F.posexplode(parts).alias("ord", "part")), "part", F.col("window"), options.token_estimation, ranks, "model")
    rank = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method"))
    total = each.groupBy("case_id").agg(F.sum("tokens").alias("tokens"), F.max_by("method", F.struct(rank, -F.col("ord"))).alias("method"))
    rest = rest.join(total, "case_id")
    usd = F.lit(None).cast("double") if options.token_estimation == "off" else F.nullif(cost(F.col("tokens"), F.col("in_usd"), F.col("out_usd")), F.lit(0.0))
    return huge.unionByName(rest.select("case_id", "model", "has_prompt", "char_count", "window", "tokens", "method", usd.alias("usd")))


def rule(cases: DataFrame, options: Options = Options(), ranks: bpe.RankFiles | None = None) -> DataFrame:
    return overages(costs(cases, options, ranks), options)


def overages(c: DataFrame, options: Options = Options()) -> DataFrame:
    """Issues of the cases' costs."""
    num = lambda x: F.format_number(x, 0)
    one = lambda t: F.array(F.struct(F.lit(t).alias("text"), F.lit(1).cast("long").alias("count")))
    occ = lambda t: F.array(issues.occurrence(text=t, start=F.lit(0), end=F.lit(0)))
    trim = "Context exceeds soft limit. Summarize older turns or drop large traces before sending."
    spend = "Reduce prompt size or lower completion length to stay within budget."
    advice = lambda t: issues.suggestions((F.lit(True), "TRIM_CONTEXT", t))
    none = F.lit(None)

    def made(d, order, detail, summary, shown, first, text):
        return issues.issue(d, order, "TOKEN_OVERAGE", "medium", detail, F.lit("medium"), one(summary), occ(shown), first, none, advice(text))

    chars = c.where(F.col("method") == "char_estimate")
    out = made(chars, 6, F.concat(F.lit("Input text ("), num("char_count"), F.lit(" chars) exceeds character limit ("), num(F.lit(options.max_chars)), F.lit("). Skipping exact tokenization.")), "char-limit", F.concat(F.lit("charCount="), num("char_count")), none, trim)
    most = F.lit(options.max_input_tokens).cast("long") if options.max_input_tokens else F.col("window")
    over = c.where((F.col("method") != "char_estimate") & ((F.col("tokens") > most) | (F.col("tokens") > F.col("window"))))
    detail = F.concat(F.lit("Estimated "), num("tokens"), F.lit(" input tokens (method: "), F.col("method"), F.lit(") exceeds "), num(F.least(most, F.col("window"))), F.lit(" token limit for "), F.col("model"), F.lit("."))
    out = out.unionByName(made(over, 7, detail, "token-limit", F.concat(F.lit("est="), num("tokens")), F.col("tokens"), trim))
    if options.max_cost_usd:
        dear = c.where(F.col("usd") > options.max_cost_usd)
        told = F.concat(F.lit("Estimated cost $"), F.format_string("%.4f", F.col("usd")), F.lit(f" exceeds max cost ${options.max_cost_usd:g}."))
        out = out.unionByName(made(dear, 8, told, "cost-limit", F.concat(F.lit("estUSD=$"), F.format_string("%.4f", F.col("usd"))), none, spend))
    return out
