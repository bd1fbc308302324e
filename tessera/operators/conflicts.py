"""Conflicting instructions: opposite cue words, and pairs that models call opposite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import lexicon as L
from tessera.functions import text as T
from tessera.operators import issues
from tessera.options import Options

# The wording of details and suggestions below.

PAIRS = [("verbosity", L.VERBOSE, L.CONCISE), ("format", L.JSON_ONLY, L.EXPLANATORY)]


def first_pairs(text: Column) -> Column:
    """The first cue of each side of each bucket, where both sides are there: array<struct<bucket, a, b, confidence, method>>."""
    each = []
    for bucket, left, right in PAIRS:
        a, b = T.find_all(text, left), T.find_all(text, right)
        both = F.regexp_like(text, F.lit(left)) & F.regexp_like(text, F.lit(right))
        each.append(F.when(both, F.struct(F.lit(bucket).alias("bucket"), F.get(a, 0).alias("a"), F.get(b, 0).alias("b"), F.lit(1.0).alias("confidence"), F.lit("pattern").alias("method"))))
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def phrases(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each sentence and opposite keyword in it: keys of ``df``, bucket, side, keyword, phrase, start, end, sentence.

    A sentence that stands several times counts at its first place.
    """
    words = [(b, s, w) for b, xs, ys in L.OPPOSITES for s, ws in (("a", xs), ("b", ys)) for w in ws]
    keys = F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(s).alias("side"), F.lit(w).alias("keyword")) for b, s, w in words])
    rows = df.withColumn("sentence", F.explode(F.split(text, r"[.!?]\s+"))).withColumn("k", F.explode(keys))
    rows = rows.withColumn("pattern", F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])\Q"), F.col("k.keyword"), F.lit(r"\E(?![A-Za-z0-9_])")))
    hit = rows.where(F.contains(F.lower("sentence"), F.col("k.keyword")) & F.regexp_like(F.col("sentence"), F.col("pattern")))
    at = F.length(F.split(F.col("sentence"), F.col("pattern"), 2)[0])
    start = (F.instr(F.col(text), F.col("sentence")) - 1 + at).cast("long")
    return hit.select(*df.columns, "k.bucket", "k.side", "k.keyword", F.substring("sentence", at + 1, F.length("k.keyword")).alias("phrase"), start.alias("start"), (start + F.length("k.keyword")).alias("end"), F.trim("sentence").alias("sentence"))


def opposite_pairs(found: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs of opposite phrases of a case, an equi-join on case and bucket."""
    side = lambda s: found.where(F.col("side") == s).select(*keys, "bucket", F.struct("phrase", "start", "end", "sentence").alias(s))
    return side("a").join(side("b"), [*keys, "bucket"])


def phrase_pairs(found: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of a case's phrases in order (first before second)."""
    ranked = found.withColumn("ord", F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end", "keyword", "bucket")))
    side = lambda s: ranked.select(*keys, F.col("ord").alias(f"{s}_ord"), F.struct("phrase", "start", "end", "sentence").alias(s))
    return side("a").join(side("b"), keys).where(F.col("a_ord") < F.col("b_ord"))


def dedupe(conflicts: DataFrame, keys: list[str]) -> DataFrame:
    """Of conflicts over the same range and bucket the most confident; ties go to the first."""
    span = [F.least("a.start", "b.start").alias("lo"), F.greatest("a.end", "b.end").alias("hi")]
    d = conflicts.select("*", *span)
    w = Window.partitionBy(*keys, "bucket", "lo", "hi").orderBy(F.desc("confidence"), "a.start", "b.start", "method")
    return d.withColumn("k_", F.row_number().over(w)).where("k_ = 1").drop("k_", "lo", "hi")


def report(d: DataFrame) -> DataFrame:
    """Issues from rows (case_id, text, message_index, conflicts)."""
    has = lambda b: F.exists("conflicts", lambda c: c["bucket"] == b)
    parts = [("verbosity", "concise vs step by step"), ("format", "JSON only vs commentary"), ("semantic", "semantically conflicting instructions"), ("logical", "logically contradictory instructions")]
    detail = F.concat(F.lit("Conflicting directives: "), F.concat_ws("; ", *[F.when(has(b), F.lit(t)) for b, t in parts]), F.lit("."))
    buckets = F.array_distinct(F.transform("conflicts", lambda c: c["bucket"]))
    summary = F.transform(buckets, lambda b: F.struct(b.alias("text"), F.size(F.filter("conflicts", lambda c: c["bucket"] == b)).cast("long").alias("count")))
    occ = F.transform(
        "conflicts",
        lambda c: issues.occurrence(text=c["a"]["text"], start=c["a"]["start"], end=c["a"]["end"], bucket=c["bucket"], preview=T.preview(F.col("text"), c["a"]["start"], c["a"]["end"]), paired_text=c["b"]["text"], paired_start=c["b"]["start"], paired_end=c["b"]["end"]),
    )
    mean = F.aggregate("conflicts", F.lit(0.0), lambda s, c: s + c["confidence"]) / F.size("conflicts")
    advice = issues.suggestions(
        (has("verbosity"), "TIGHTEN_INSTRUCTION", 'Remove either the "concise" or "step-by-step" directive to avoid contradictions.'),
        (has("format"), "ENFORCE_JSON", "If strict JSON is required, drop commentary instructions or move them into schema metadata."),
        (has("semantic") | has("logical"), "TIGHTEN_INSTRUCTION", "Review and align conflicting instructions detected by semantic analysis."),
    )
    return issues.issue(d, 3, "CONFLICTING_INSTRUCTION", "medium", detail, F.when(mean > 0.7, "high").otherwise("medium"), summary, occ, F.lit(None), F.col("message_index"), advice)


def rule(cases: DataFrame, options: Options = Options()) -> DataFrame:
    d = cases.select("case_id", T.full_text(F.col("prompt"), F.col("messages")).alias("text"), issues.scope_index(F.col("messages")).alias("message_index"))
    return report(d.withColumn("conflicts", first_pairs(F.col("text"))).where(F.size("conflicts") > 0))
