"""The issue table that all rules share, one row an issue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OCCURRENCE = (
    "struct<text:string,start:bigint,end:bigint,preview:string,message_index:int,bucket:string,resolution:string,fulfillment_status:string,"
    "fulfillment_method:string,fulfillment_confidence:double,term:string,paired_text:string,paired_start:bigint,paired_end:bigint>"
)
SUMMARY = "array<struct<text:string,count:bigint>>"
SUGGESTION = "array<struct<type:string,text:string>>"
_FIELDS = [f.split(":")[0] for f in OCCURRENCE[7:-1].split(",")]


def occurrence(**parts: Column) -> Column:
    types = dict(f.split(":") for f in OCCURRENCE[7:-1].split(","))
    return F.struct(*[(parts[n] if n in parts else F.lit(None)).cast(types[n]).alias(n) for n in _FIELDS])


def suggestions(*given: tuple[Column, str, str]) -> Column:
    """Suggestions (type, text) whose condition holds."""
    each = [F.when(c, F.struct(F.lit(t).alias("type"), F.lit(x).alias("text"))) for c, t, x in given]
    return F.filter(F.array(*each), lambda s: s.isNotNull()) if each else F.array().cast(SUGGESTION)


def scope_index(messages: Column) -> Column:
    """Number of the last message; null for a prompt alone."""
    return F.when(F.size(messages) > 0, F.size(messages) - 1)


def issue(df: DataFrame, order: int, code: str, severity: str, detail: Column, confidence: Column, summary: Column, occurrences: Column, first_char: Column, message_index: Column, advice: Column) -> DataFrame:
    """Rows (case_id, rule_ord, id, code, ...) of one rule; the id is a hash of case, code and rule."""
    return df.select(
        "case_id", F.lit(order).alias("rule_ord"), F.lower(F.hex(F.xxhash64(F.col("case_id"), F.lit(code), F.lit(order)))).alias("id"), F.lit(code).alias("code"), F.lit(severity).alias("severity"),
        detail.alias("detail"), confidence.alias("confidence"), summary.cast(SUMMARY).alias("summary"), occurrences.cast(f"array<{OCCURRENCE}>").alias("occurrences"),
        first_char.cast("long").alias("first_char"), message_index.cast("int").alias("message_index"), advice.cast(SUGGESTION).alias("suggestions"),
    )
