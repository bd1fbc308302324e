"""Mixing sources to target weights by entropy balancing.

Each source has a target of tokens. Among all rates of a source's documents with 0 <= r <= ``max_copies`` whose tokens (rate times size) add up to
the target, entropy balancing takes those closest to 1 in relative entropy, sum(r log r - r + 1). The convex dual has one multiplier a
source, and the rates are tilted exponentially by a document's size: r = min(max_copies, exp(lambda * size / mean size)). A source that must grow
takes its long documents more often, one that must shrink its short ones. Newton steps, kept in a bracket by bisection, solve the
dual; their sums are Spark aggregates over all (source, size) classes. A source whose target is ``max_copies`` times its size has that rate throughout.

Rates become whole copies by size class, large to small, by rounding the running sum of copies, so each class gets its rate's copies
rounded down or up. What is left of a source's target then, at most half of its largest document, goes by single copies of the
document sizes nearest to it, ``REPAIRS`` times. No document is taken more often than ``max_copies`` times.

DataFrame functions only; nothing that grows with the documents reaches the driver, and no
task gets a whole source: classes are (source, size), as many as a source has different sizes, and members of a class are told apart by
ranks inside hash buckets of about ``BUCKET_ROWS`` rows.

Null texts have size 0; documents of size 0 are never needed and get no copies. The null source is a source of its own, last in order. Repeated
rows and null ids count as further documents; of rows alike in id, size and source any may get the odd copy. Very long texts count whole; ties in size make one class. An empty
table gives an empty result. A source without words has target 0. Other columns are not read, so they may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import cut, drop

BUCKET_ROWS = 2_000
MAX_STEPS, REPAIRS = 200, 3
TOLERANCE = 1e-10


def count_words(text: Column) -> Column:
    """Number of runs of characters other than space and 0x09 to 0x0D: word ends, counted from what is left when all else goes."""
    ends = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]++", "w")
    return F.length(F.regexp_replace(ends, r"[\x20\x09-\x0D]++", "")).cast("long")


def fill_targets(sources: DataFrame, weights: Sequence[float], share: float, max_copies: float) -> DataFrame:
    """sources: (source, source_size). Adds target: ``share`` of all tokens dealt by weight, none above its cap.

    Repeatedly resharing the excess by weight ends at the water level tau with target = min(weight * tau, cap):
    with sources in order of cap / weight, it is the first level that the next source's cap does not undercut.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    n = len(weights)
    ranked = sources.withColumn("place", F.row_number().over(order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % n + 1).cast("int"))
    )
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_copies)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    levels = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("tau", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
        .withColumn("fits", F.col("tau") <= F.col("cap") / F.col("weight"))
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "place", "tau"))).over(everything)["tau"])
    )
    return levels.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("level"))).alias("target"))


def rate_of(size: Column, max_copies: int) -> Column:
    """A document's rate, from its source's lam, unit and full."""
    return F.when(F.col("full"), F.lit(float(max_copies))).otherwise(F.least(F.lit(float(max_copies)), F.exp(F.col("lam") * size / F.col("unit"))))


def newton_rates(classes: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """classes: (source, size, n); targets: (source, source_size, target). Adds unit (mean size of documents with words), full (all rates at the bound) and lam.

    Each step sums the tokens of the current rates and their derivative over all classes. A step that would leave the bracket of the
    multipliers found too small or too large so far goes to its middle, or beyond its end while it has none.
    """
    real = classes.where(F.col("size") > 0)
    units = real.groupBy(F.col("source").alias("s")).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("unit"))
    state = targets.join(units, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    full = F.col("target") >= F.col("source_size") * F.lit(max_copies * (1 - 1e-12))
    none = F.lit(None).cast("double")
    state = state.select("source", "source_size", "target", F.coalesce("unit", F.lit(1.0)).alias("unit"), full.alias("full"), F.lit(0.0).alias("lam"), none.alias("low"), none.alias("high"), full.alias("done"))
    state = cut(state, "newton")
    for _ in range(MAX_STEPS):
        if state.where(~F.col("done")).isEmpty():
            return state.select("source", "source_size", "target", "unit", "full", F.round("lam", 9).alias("lam"))
        rate = rate_of(F.col("size"), max_copies)
        joined = real.join(state.where(~F.col("done")).select(F.col("source").alias("s"), "lam", "unit", "full"), F.col("source").eqNullSafe(F.col("s")))
        slope = F.when(rate < max_copies, F.col("n") * F.col("size") * F.col("size") / F.col("unit") * rate).otherwise(F.lit(0.0))
        sums = joined.groupBy("s").agg(F.sum(F.col("n") * F.col("size") * rate).alias("mass"), F.sum(slope).alias("slope"))
        open_ = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        gap = F.col("mass") - F.col("target")
        low = F.when(gap < 0, F.col("lam")).otherwise(F.col("low"))
        high = F.when(gap >= 0, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - gap / F.nullif(F.col("slope"), F.lit(0.0))
        inside = newton.isNotNull() & (newton > F.coalesce(low, newton - 1)) & (newton < F.coalesce(high, newton + 1)) & (F.abs(newton - F.col("lam")) <= 4 * (1 + F.abs("lam")))
        middle = F.when(low.isNotNull() & high.isNotNull(), (low + high) / 2).when(gap < 0, F.col("lam") + 1 + F.abs("lam")).otherwise(F.col("lam") - 1 - F.abs("lam"))
        close = F.abs(gap) <= TOLERANCE * F.greatest(F.col("target"), F.lit(1.0))
        tight = F.coalesce(high - low <= TOLERANCE * F.greatest(F.lit(1.0), F.abs("lam")), F.lit(False))
        ended = F.col("done") | F.coalesce(close | tight, F.lit(True))
        new = open_.select(
            "source", "source_size", "target", "unit", "full",
            F.when(ended, F.col("lam")).when(inside, newton).otherwise(middle).alias("lam"), low.alias("low"), high.alias("high"), ended.alias("done"),
        )
        state, old = cut(new, "newton"), state
        drop(old)
    raise RuntimeError(f"entropy balancing did not settle in {MAX_STEPS} steps")


def round_copies(classes: DataFrame, rates: DataFrame, max_copies: int) -> DataFrame:
    """Copies for each class with words: (source, size, n, copies), the class's members taken together."""
    real = classes.where(F.col("size") > 0).join(rates.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    so_far = F.sum(rate_of(F.col("size"), max_copies) * F.col("n")).over(Window.partitionBy("source").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))
    whole = real.withColumn("so_far", F.floor(F.round(so_far, 6) + 0.5).cast("long"))
    before = F.lag("so_far", 1, 0).over(Window.partitionBy("source").orderBy(F.desc("size")))
    out = cut(whole.withColumn("copies", F.col("so_far") - before).select("source", "size", "n", "copies", "target"), "copies")
    for _ in range(REPAIRS):
        left = out.groupBy(F.col("source").alias("s")).agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("left"))
        asked = out.join(left, F.col("source").eqNullSafe(F.col("s"))).drop("s")
        can = F.when(F.col("left") > 0, F.col("copies") < F.col("n") * max_copies).otherwise(F.col("copies") > 0)
        after = F.abs(F.abs("left") - F.col("size"))
        best = asked.where(can & (after < F.abs("left"))).groupBy(F.col("source").alias("s")).agg(F.min(F.struct(after.alias("after"), F.col("size"))).alias("best"))
        best = best.select("s", F.col("best.size").alias("z"))
        fixed = asked.join(best, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left")
        more = F.when(F.col("z").isNull(), F.lit(0)).otherwise(F.signum("left").cast("long"))
        new = cut(fixed.select("source", "size", "n", (F.col("copies") + more).alias("copies"), "target"), "copies")
        drop(out)
        out = new
    return out.drop("target")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    max_copies: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row for each document: id, size, source_size, target, taken (= copies * size), copies, rate, source."""
    # Null ids share one hash; the number of their row in the written table tells them apart.
    rows = docs.select(F.col(id_col).alias("row_id"), F.col(source_col).alias("source"), count_words(F.col(text_col)).alias("size"))
    sized = cut(rows.withColumn("salt", F.when(F.col("row_id").isNull(), F.monotonically_increasing_id())), "sizes")
    classes = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "classes")
    sources = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    rates = newton_rates(classes, cut(fill_targets(sources, weights, share, max_copies), "targets"), max_copies)
    copies = round_copies(classes, rates, max_copies)

    # Which members of a class get the odd copies: the first by (bucket, hash, id), ranked bucket by bucket.
    plan = classes.join(copies.select(F.col("source").alias("s"), F.col("size").alias("z"), "copies"), F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left").drop("s", "z")
    plan = plan.join(rates.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    k, n = F.coalesce(F.col("copies"), F.lit(0)), F.col("n")
    plan = plan.select(
        F.col("source").alias("p_source"), F.col("size").alias("p_size"), "source_size", "target", F.round(rate_of(F.col("size"), max_copies), 6).alias("rate"),
        F.floor(k / n).alias("all_get"), (k - F.floor(k / n) * n).alias("odd"), F.ceil(n / F.lit(BUCKET_ROWS)).alias("buckets"),
    )
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("size") == F.col("p_size"))).drop("p_source", "p_size")
    placed = placed.withColumn("h", F.xxhash64(F.col("row_id"), F.lit("mix"), F.col("salt"))).withColumn("bucket", F.pmod(F.col("h"), F.col("buckets")))
    counts = placed.where(F.col("odd") > 0).groupBy("source", "size", "bucket").agg(F.count("*").alias("in_bucket"))
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("source").alias("b_source"), F.col("size").alias("b_size"), F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("in_bucket").over(earlier), F.lit(0)).alias("start"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("h", "row_id")))
    ranked = ranked.join(
        starts, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("size") == F.col("b_size")) & (F.col("bucket") == F.col("b_bucket")), "left"
    )
    got = (F.col("all_get") + ((F.coalesce("start", F.lit(0)) + F.col("rank")) <= F.col("odd")).cast("long")).cast("long")
    return ranked.withColumn("copies", got).select(
        F.col("row_id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"),
        (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate", "source",
    )
