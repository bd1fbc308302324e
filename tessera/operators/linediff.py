"""Line diffs of pairs of texts: a patience diff whose steps are windows and groups over the lines of all pairs.

A row stands for a line of one side of a pair; ``m`` is the place of its partner on the other side, null while it has none. Matched lines cut a pair into gaps,
and each round works on all gaps of all pairs at once:

1. ``ends``: equal lines at the start of a gap meet, then equal lines at its end;
2. ``anchors``: lines that stand once on both sides of a gap meet by a group on gap and line; of these, a longest run whose places increase on both sides
   stays (a helper over the places of one gap). They cut the gap into smaller ones.

Pairs in which a round finds no anchor are done and leave; the others go on. All keys of windows and groups begin with the pair, so the lines of a pair
meet once a round, and neither lines nor gaps meet those of other pairs. Lines go by number within their pair (``dense_rank``), so rounds move
five numbers a line, not the text, and no two lines are taken for equal by a hash. What no round matches is removed or added.

A null text counts as an empty one, which has one empty line. Rows that repeat an id and both texts are one pair; pairs that share an id are told apart
by their texts, and a null id is an id like others. No pairs give no rows. Only the three columns named are read. Of two equally long runs of anchors
the one whose last lines come first on the second side stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tessera.store import cut, drop

SAME, REMOVED, ADDED = " ", "-", "+"


def _free() -> Column:
    return F.col("m").isNull()


def longest_run(places: list[int]) -> list[int]:
    """Indices of a longest increasing run of the places, by piles."""
    tails: list[int] = []
    top: list[int] = []
    back = [-1] * len(places)
    for i, x in enumerate(places):
        k = bisect_left(tails, x)
        back[i] = top[k - 1] if k else -1
        tails[k : k + 1] = [x]
        top[k : k + 1] = [i]
    out = []
    i = top[-1] if top else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


@F.pandas_udf(ArrayType(IntegerType()))
def _longest_runs(places: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for some in places:
        yield some.map(lambda x: longest_run(x.tolist()))


def _lines(pairs: DataFrame) -> DataFrame:
    """(p, side, pos, line) of both texts; side 0 is the text before."""
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("t")), F.struct(F.lit(1).alias("side"), F.col("b").alias("t")))).alias("s")
    return pairs.select("p", side).select("p", "s.side", F.posexplode(F.split("s.t", "\n")).alias("pos", "line"))


def _gaps(rows: DataFrame) -> DataFrame:
    """With ``g``: the place, in the text before, of the last matched line up to this row; -1 before the first."""
    so_far = Window.partitionBy("p", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    anchor = F.when(~_free(), F.when(F.col("side") == 0, F.col("pos")).otherwise(F.col("m")))
    return rows.withColumn("g", F.coalesce(F.last(anchor, ignorenulls=True).over(so_far), F.lit(-1)))


def ends(rows: DataFrame, last: bool) -> DataFrame:
    """Match equal lines from the start of each gap on, or back from its end."""
    rows = _gaps(rows).withColumn("free", _free())
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("p", "side", "g", "free").orderBy(F.desc("pos") if last else "pos")))
    both = Window.partitionBy("p", "g", "free", "k")
    rows = rows.withColumn("alike", (F.count("*").over(both) == 2) & (F.min("n").over(both) == F.max("n").over(both))).withColumn("other", F.sum("pos").over(both) - F.col("pos"))
    broken = F.sum(F.when(F.col("alike"), 0).otherwise(1)).over(Window.partitionBy("p", "g", "free").orderBy("k"))
    rows = rows.withColumn("broken", broken)
    return rows.select("p", "side", "pos", "n", F.when(F.col("free") & (F.col("broken") == 0), F.col("other").cast("int")).otherwise(F.col("m")).alias("m"))


def anchors(rows: DataFrame) -> DataFrame:
    """(p, side, pos, m): both rows of each line that stands once on both sides of a gap and lies on its gap's longest run."""
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("pos")))
    once = lambda side: F.count_if(F.col("side") == side) == 1
    unique = _gaps(rows).where(_free()).groupBy("p", "g", "n").agg(at(0).alias("a"), at(1).alias("b"), (once(0) & once(1)).alias("ok")).where("ok")
    found = unique.groupBy("p", "g").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("places"))
    kept = found.select("p", "places", F.explode(_longest_runs(F.col("places.b"))).alias("i")).select("p", F.col("places")[F.col("i")].alias("x"))
    two = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("x.a").alias("pos"), F.col("x.b").alias("m")), F.struct(F.lit(1).alias("side"), F.col("x.b").alias("pos"), F.col("x.a").alias("m"))))
    return kept.select("p", two.alias("y")).select("p", "y.side", "y.pos", "y.m")


def _matched(lines: DataFrame) -> DataFrame:
    """(p, side, pos, m) of all lines."""
    rows = lines.select("p", "side", "pos", F.dense_rank().over(Window.partitionBy("p").orderBy("line")).alias("n"), F.lit(None).cast("int").alias("m"))
    done: list[DataFrame] = []
    while True:
        rows = cut(ends(ends(rows.repartition("p"), last=False), last=True), "lines")
        fresh = anchors(rows).withColumnRenamed("m", "found")
        met = rows.join(fresh, ["p", "side", "pos"], "left")
        met = met.withColumn("goes_on", F.max(F.col("found").isNotNull()).over(Window.partitionBy("p")))
        met = cut(met.select("p", "side", "pos", "n", F.coalesce("m", "found").alias("m"), "goes_on"), "round")
        drop(rows)
        done.append(met.where(~F.col("goes_on")).select("p", "side", "pos", "m"))
        rows = met.where("goes_on").drop("goes_on")
        if rows.isEmpty():
            return reduce(DataFrame.union, done)


def patches(pairs: DataFrame, id_col: str, before_col: str, after_col: str) -> DataFrame:
    """(id, diff, n_same, n_removed, n_added) of each pair; ``diff`` has each line of both texts behind a blank, ``-`` or ``+``, removed lines first."""
    given = pairs.select(F.col(id_col).alias("id"), F.coalesce(F.col(before_col), F.lit("")).alias("a"), F.coalesce(F.col(after_col), F.lit("")).alias("b"))
    key = F.unhex(F.md5(F.to_json(F.struct("id", "a", "b"), {"ignoreNullFields": "false"})))
    named = cut(given.withColumn("p", key).dropDuplicates(["p"]), "line-pairs")
    lines = _lines(named)
    rows = _gaps(_matched(lines)).join(lines, ["p", "side", "pos"]).where((F.col("side") == 0) | _free())
    kind = F.when(~_free(), 0).when(F.col("side") == 0, 1).otherwise(2).alias("kind")
    count = lambda k: F.count_if(F.col("kind") == k)
    by_pair = rows.select("p", "g", kind, "pos", "line").groupBy("p").agg(
        F.sort_array(F.collect_list(F.struct("g", "kind", "pos", "line"))).alias("all"), count(0).alias("n_same"), count(1).alias("n_removed"), count(2).alias("n_added")
    )
    tag = lambda x: F.when(x["kind"] == 0, SAME).when(x["kind"] == 1, REMOVED).otherwise(ADDED)
    diff = F.array_join(F.transform("all", lambda x: F.concat(tag(x), x["line"])), "\n")
    out = by_pair.select("p", diff.alias("diff"), "n_same", "n_removed", "n_added")
    return out.join(named.select("p", "id"), "p").select(F.col("id").alias(id_col), "diff", "n_same", "n_removed", "n_added")


def side_of(diff: Column, gone: str) -> Column:
    """One of the two texts again, from a diff: ``ADDED`` gone gives the text before, ``REMOVED`` gone the text after."""
    kept = F.filter(F.split(diff, "\n"), lambda x: ~x.startswith(gone))
    return F.array_join(F.transform(kept, lambda x: F.substr(x, F.lit(2))), "\n")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(first_id, doc_id, before, after): each text with that of the smallest id which has the same longest line; the first itself has no row.

    Null texts have no line. Of equally long lines the greatest one counts. A text is in one pair, so there are fewer pairs than texts, however large a group of copies."""
    line = F.array_max(F.transform(F.split(text_col, "\n"), lambda x: F.struct(F.length(x).alias("size"), x.alias("line"))))["line"]
    own = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.sha2(line, 256).alias("longest"))
    first = own.groupBy("longest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("texts")).where("texts > 1").select("longest", "first_id")
    after = own.withColumnRenamed("text", "after").join(first, "longest").where("doc_id <> first_id")
    before = own.select(F.col("doc_id").alias("first_id"), F.col("text").alias("before"), "longest")
    return after.join(before, ["first_id", "longest"]).select("first_id", "doc_id", "before", "after")
