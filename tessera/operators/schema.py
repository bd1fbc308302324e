"""Structured-output risks and invalid JSON schemas."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import lexicon as L
from tessera.functions import text as T
from tessera.operators import issues
from tessera.options import Options

# The wording of details and suggestions below.

ERROR = "array<struct<path:string,keyword:string,message:string>>"


def has_json_cue(text: Column) -> Column:
    return F.contains(F.lower(text), F.lit("json")) | F.contains(text, F.lit("{")) | F.contains(text, F.lit("[")) | F.contains(text, F.lit('"'))


def has_prose_after_json(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.regexp_like(text, F.lit(p)) for p in L.PROSE_AFTER_JSON])


def risk_rule(cases: DataFrame, options: Options = Options()) -> DataFrame:
    d = cases.where(F.col("schema_json").isNotNull()).select("case_id", T.full_text(F.col("prompt"), F.col("messages")).alias("text"), issues.scope_index(F.col("messages")).alias("message_index"))
    d = d.where(has_json_cue(F.col("text")) & has_prose_after_json(F.col("text")))
    first = lambda p: F.get(T.find_all(F.col("text"), p), 0)
    d = d.withColumn("a", first(r"(?i)json[^.\n]{0,120}")).withColumn("b", first(r"(?i)(notes|commentary|explanation|discussion)[^.\n]{0,120}"))
    occ = lambda c: F.when(F.col(c).isNotNull(), issues.occurrence(text=F.col(c)["text"], start=F.col(c)["start"], end=F.col(c)["end"], preview=T.preview(F.col("text"), F.col(c)["start"], F.col(c)["end"])))
    summary = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(1).cast("long").alias("count")) for t in ("json keywords", "prose after json request")])
    advice = issues.suggestions((F.lit(True), "ENFORCE_JSON", "Move commentary into structured fields or drop it when requesting strict JSON."))
    return issues.issue(
        d, 4, "SCHEMA_RISK", "medium", F.lit("Prompt mixes strict JSON instructions with additional prose after the schema."), F.lit("medium"), summary,
        F.filter(F.array(occ("a"), occ("b")), lambda o: o.isNotNull()), F.lit(None), F.col("message_index"), advice,
    )


def _types(doc: Column, path: str) -> Column:
    """The type or types at a path: a string alone, or the strings of an array."""
    got = F.get_json_object(doc, path)
    return F.when(got.isNull() | (got == ""), F.array().cast("array<string>")).when(F.startswith(got, F.lit("[")), F.coalesce(F.from_json(got, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(got))


def schema_errors(doc: Column) -> Column:
    """Errors of a schema that its top two levels show: array<struct<path, keyword, message>>."""
    props, items, kind = F.get_json_object(doc, "$.properties"), F.get_json_object(doc, "$.items"), F.coalesce(F.get_json_object(doc, "$.type"), F.lit(""))
    error = lambda c, path, keyword, message: F.when(c, F.struct(path.alias("path"), F.lit(keyword).alias("keyword"), message.alias("message")))
    bad = lambda ts: F.filter(ts, lambda t: ~t.isin(*L.SCHEMA_TYPES))
    top = F.array(
        error(props.isNotNull() & (kind == ""), F.lit(""), "strictTypes", F.lit('missing type "object" for keyword "properties"')),
        error(items.isNotNull() & (kind == ""), F.lit(""), "strictTypes", F.lit('missing type "array" for keyword "items"')),
    )
    own = F.transform(bad(_types(doc, "$.type")), lambda t: F.struct(F.lit("").alias("path"), F.lit("type").alias("keyword"), F.concat(F.lit('invalid type "'), t, F.lit('"')).alias("message")))
    names = F.coalesce(F.json_object_keys(props), F.array().cast("array<string>"))
    bodies = F.coalesce(F.from_json(props, "map<string,string>"), F.create_map().cast("map<string,string>"))
    inner = F.flatten(
        F.transform(
            names,
            lambda n: F.transform(
                bad(F.when(F.startswith(F.coalesce(F.try_element_at(bodies, n), F.lit("")), F.lit("{")), _types(F.try_element_at(bodies, n), "$.type")).otherwise(F.array().cast("array<string>"))),
                lambda t: F.struct(F.concat(F.lit("/"), n).alias("path"), F.lit("type").alias("keyword"), F.concat(F.lit('invalid type "'), t, F.lit('" for property "'), n, F.lit('"')).alias("message")),
            ),
        )
    )
    return F.concat(F.filter(top, lambda e: e.isNotNull()), own, inner).cast(ERROR)


def meta_errors(schema: object, path: str = "") -> list[tuple[str, str, str]]:
    """Errors of a draft-07 schema against its meta-schema, hand-written: (path, keyword, message)."""
    if isinstance(schema, bool):
        return []
    if not isinstance(schema, dict):
        return [(path, "type", "must be object,boolean")]
    out: list[tuple[str, str, str]] = []

    def need(key: str, ok, what: str, keyword: str = "type") -> None:
        if key in schema and not ok(schema[key]):
            out.append((f"{path}/{key}", keyword, f"must be {what}"))

    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    count = lambda x: isinstance(x, int) and not isinstance(x, bool) and x >= 0
    strings = lambda x: isinstance(x, list) and all(isinstance(s, str) for s in x) and len(set(x)) == len(x)
    for k in ("$id", "$schema", "$ref", "$comment", "title", "description", "pattern", "format", "contentMediaType", "contentEncoding"):
        need(k, lambda x: isinstance(x, str), "string")
    for k in ("maximum", "minimum", "exclusiveMaximum", "exclusiveMinimum"):
        need(k, number, "number")
    need("multipleOf", lambda x: number(x) and x > 0, "> 0", "exclusiveMinimum")
    for k in ("maxLength", "minLength", "maxItems", "minItems", "maxProperties", "minProperties"):
        need(k, count, "integer >= 0")
    for k in ("uniqueItems", "readOnly"):
        need(k, lambda x: isinstance(x, bool), "boolean")
    need("required", strings, "array of distinct strings")
    need("enum", lambda x: isinstance(x, list), "array")
    need("type", lambda x: x in L.SCHEMA_TYPES if isinstance(x, str) else strings(x) and x and all(t in L.SCHEMA_TYPES for t in x), "equal to one of the allowed values", "enum")
    for k in ("additionalItems", "contains", "additionalProperties", "propertyNames", "if", "then", "else", "not"):
        if k in schema:
            out += meta_errors(schema[k], f"{path}/{k}")
    for k in ("definitions", "properties", "patternProperties", "dependencies"):
        if k in schema:
            if not isinstance(schema[k], dict):
                out.append((f"{path}/{k}", "type", "must be object"))
                continue
            for name, sub in schema[k].items():
                if not (k == "dependencies" and strings(sub)):
                    out += meta_errors(sub, f"{path}/{k}/{name}")
    for k in ("allOf", "anyOf", "oneOf"):
        if k in schema:
            if not (isinstance(schema[k], list) and schema[k]):
                out.append((f"{path}/{k}", "minItems", "must be a non-empty array"))
                continue
            for i, sub in enumerate(schema[k]):
                out += meta_errors(sub, f"{path}/{k}/{i}")
    if "items" in schema:
        for i, sub in enumerate(schema["items"] if isinstance(schema["items"], list) else [schema["items"]]):
            out += meta_errors(sub, f"{path}/items/{i}" if isinstance(schema["items"], list) else f"{path}/items")
    return out


def _meta_udf():
    @F.pandas_udf(ERROR)
    def check(s: pd.Series) -> pd.Series:
        def one(x):
            try:
                return meta_errors(json.loads(x)) if x is not None else []
            except ValueError:
                return [("", "unknown", "schema is not JSON")]

        return s.map(lambda x: [dict(zip(("path", "keyword", "message"), e, strict=True)) for e in one(x)])

    return check


def validation_rule(cases: DataFrame, options: Options = Options(), deep: bool = True) -> DataFrame:
    """Invalid schemas. Schemas that pass the shallow checks are, if ``deep``, held against the meta-schema."""
    d = cases.where(F.coalesce("schema_json", F.lit("")) != "").select("case_id", "schema_json").withColumn("errors", schema_errors(F.col("schema_json")))
    found = d.where(F.size("errors") > 0)
    if deep:
        found = found.unionByName(d.where(F.size("errors") == 0).withColumn("errors", _meta_udf()("schema_json")).where(F.size("errors") > 0))
    n = F.size("errors")
    keywords = F.array_distinct(F.transform("errors", lambda e: e["keyword"]))
    summary = F.transform(keywords, lambda k: F.struct(k.alias("text"), F.size(F.filter("errors", lambda e: e["keyword"] == k)).cast("long").alias("count")))
    occ = F.transform(
        F.slice("errors", 1, 10),
        lambda e: issues.occurrence(text=e["message"], start=F.lit(0), end=F.lit(0), preview=F.when(e["path"] != "", F.concat(F.lit("Path: "), e["path"], F.lit(" - "), e["message"])).otherwise(e["message"])),
    )
    told = F.array_join(F.transform(F.slice("errors", 1, 5), lambda e: F.concat(F.when(e["path"] != "", e["path"]).otherwise(F.lit("root")), F.lit(": "), e["message"])), "; ")
    detail = F.when(n == 1, F.concat(F.lit("Invalid JSON schema: "), told)).otherwise(F.concat(F.lit("Invalid JSON schema with "), n.cast("string"), F.lit(" errors: "), told, F.when(n > 5, F.lit("...")).otherwise(F.lit(""))))
    advice = issues.suggestions((F.lit(True), "TIGHTEN_INSTRUCTION", "Fix the JSON schema validation errors. Ensure the schema follows JSON Schema 7 specification."))
    return issues.issue(found, 5, "INVALID_SCHEMA", "high", detail, F.lit("high"), summary, occ, F.lit(None), F.lit(None), advice)
