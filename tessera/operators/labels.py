"""Labelled test data: references to mark, tags behind phrases, checked messages, shares of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import lexicon as L
from tessera.functions import text as T

_DEFAULT = "array(struct('system' AS role, 'You are a helpful assistant.' AS content), struct('user' AS role, 'Hello' AS content))"


def references(text: Column) -> Column:
    """References that labels may mark: array<struct<start, end, text, type>> by start; of a range found twice the first pattern's type."""
    one = lambda i, p, t: F.transform(T.find_all(text, p), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(i).alias("ord"), m["text"].alias("text"), F.lit(t).alias("type")))
    found = F.sort_array(F.concat(*[one(i, p, t) for i, (p, t) in enumerate(L.LABEL_REFERENCES)]))
    before = lambda i: F.try_element_at(found, F.greatest(i, F.lit(1)))
    first = F.filter(found, lambda m, i: (i == 0) | (before(i)["start"] != m["start"]) | (before(i)["end"] != m["end"]))
    ordered = F.sort_array(F.transform(first, lambda m: F.struct(m["start"].alias("start"), m["ord"].alias("ord"), m["end"].alias("end"), m["text"].alias("text"), m["type"].alias("type"))))
    return F.transform(ordered, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), m["type"].alias("type")))


def tagged(text: Column) -> Column:
    """The text with a rule's tag behind each phrase of generated prompts."""
    for code, pattern in L.TAGGED:
        text = F.regexp_replace(text, pattern, f"$0[{code}]")
    return text


def valid_messages(messages: Column, default: Column | None = None) -> Column:
    """Messages of a known role with content; ``default`` (a greeting) if none is left."""
    good = F.filter(messages, lambda m: m["role"].isin(*L.ROLES) & m["content"].isNotNull())
    return F.when(F.size(good) > 0, good).otherwise(F.expr(_DEFAULT) if default is None else default)


def allocation(spark: SparkSession, total: int, sectors: list[str], patterns: list[str]) -> DataFrame:
    """(sector, pattern, cases): the total dealt evenly, what is left over to the first sectors and, in a sector, to the first patterns."""
    names = lambda xs: F.array(*[F.lit(x) for x in xs])
    share = lambda n, parts, i: (F.floor(n / parts) + (i < n % parts).cast("int")).cast("long")
    d = spark.range(1).select(F.posexplode(names(sectors)).alias("i", "sector"))
    d = d.select("sector", share(F.lit(total), len(sectors), F.col("i")).alias("n"))
    d = d.select("sector", "n", F.posexplode(names(patterns)).alias("j", "pattern"))
    return d.select("sector", "pattern", share(F.col("n"), len(patterns), F.col("j")).alias("cases"))
