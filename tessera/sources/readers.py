"""Readers of test cases: CSV, text, JSON directories, per-case directories, parameter sets, earlier reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import evaluate

MESSAGES = "array<struct<role:string,content:string>>"
CASE = f"id string, category string, prompt string, messages {MESSAGES}, schema string, expectedIssueCodes array<string>, notes string"


def _stem(col):
    return F.regexp_extract(col, r"([^/]+?)(\.[^./]*)?$", 1)


def csv_cases(spark: SparkSession, path: str) -> DataFrame:
    """id, category, prompt, messages, schema_json, expected_issue_codes, notes; malformed JSON is null, a missing id is made from the row."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').schema("id string, category string, prompt string, messages_json string, schema_json string, expected_issue_codes string, notes string").csv(path)
    return raw.select(
        F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("case-"), F.hex(F.xxhash64("category", "prompt", "messages_json")))).alias("id"), "category", "prompt", F.from_json("messages_json", MESSAGES).alias("messages"),
        F.when(F.from_json("schema_json", "map<string,string>").isNotNull(), F.col("schema_json")).alias("schema_json"), F.from_json("expected_issue_codes", "array<string>").alias("expected_issue_codes"), "notes",
    )


def text_cases(spark: SparkSession, path: str) -> DataFrame:
    """One case a text file; annotated copies and statistics are left out."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(F.col("value").alias("prompt"), F.col("_metadata.file_name").alias("file"))
    return raw.where(~F.contains("file", F.lit("annotated")) & ~F.contains("file", F.lit("stats"))).select(_stem(F.col("file")).alias("id"), "prompt")


def json_cases(spark: SparkSession, path: str) -> DataFrame:
    """Every JSON file of a directory but its index; the id falls back to the file's name."""
    raw = spark.read.schema(CASE).option("multiLine", True).json(path, pathGlobFilter="*.json").select("*", F.col("_metadata.file_name").alias("file")).where(F.col("file") != "index.json")
    return raw.select(F.coalesce("id", _stem(F.col("file"))).alias("id"), "category", "prompt", "messages", F.col("schema").alias("schema_json"), F.col("expectedIssueCodes").alias("expected_issue_codes"), "notes", _stem(F.col("file")).alias("stem"))


def indexed_cases(spark: SparkSession, path: str) -> DataFrame:
    """The JSON cases that the directory's index names; names without a file are skipped."""
    index = spark.read.schema("testCases array<string>").option("multiLine", True).json(f"{path}/index.json").select(F.explode("testCases").alias("stem")).distinct()
    return json_cases(spark, path).join(index, "stem", "left_semi").drop("stem")


def directory_cases(spark: SparkSession, path: str) -> DataFrame:
    """<sector>/<test>/{prompt.txt, history.json, expected_output.json}; parts may be missing."""
    where = r"/([^/]+)/(test_\d+)/[^/]+$"

    def part(name: str) -> DataFrame:
        raw = spark.read.text(f"{path}/*/test_*/{name}", wholetext=True).select("value", F.col("_metadata.file_path").alias("p"))
        return raw.select(F.url_decode(F.regexp_extract("p", where, 1)).alias("sector"), F.regexp_extract("p", where, 2).alias("test"), "value")

    prompt = part("prompt.txt").withColumnRenamed("value", "prompt")
    history = part("history.json").select("sector", "test", F.from_json("value", MESSAGES).alias("history"))
    expected = part("expected_output.json").select("sector", "test", F.from_json("value", "expected_issue_codes array<string>, missing_references array<struct<text:string,start:bigint,end:bigint,type:string>>, notes string").alias("x")).select("sector", "test", "x.*")
    return prompt.join(history, ["sector", "test"], "full_outer").join(expected, ["sector", "test"], "full_outer")


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from a CSV file, a text file, an indexed directory, or a directory of texts."""
    if path.endswith(".csv"):
        return csv_cases(spark, path)
    if files(spark, f"{path}/index.json"):
        return indexed_cases(spark, path)
    if path.endswith(".txt") or files(spark, f"{path}/*"):
        return text_cases(spark, path)
    raise ValueError(f"no reader for {path}")


def files(spark: SparkSession, pattern: str, names: str = r"^[A-Za-z0-9._ -]+$") -> list[str]:
    """Paths that fit a pattern and whose names fit ``names``, in order; the files are listed, not read. For directories of a person's size."""
    try:
        found = spark.read.format("binaryFile").load(pattern).select("path")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(r["path"] for r in found.where(F.regexp_extract("path", r"([^/]*)$", 1).rlike(names)).collect())


def find_dataset(spark: SparkSession, root: str) -> str | None:
    """The first directory under the root, else under its ``generator``, that has an index."""
    for pattern in (f"{root}/*/index.json", f"{root}/generator/*/index.json"):
        if found := files(spark, pattern):
            return found[0].rsplit("/", 1)[0]
    return None


def parameter_sets(spark: SparkSession, path: str) -> DataFrame:
    """name, description, and the flags of the sets in a file; a flag that a set does not name has its default."""
    raw = spark.read.schema("name string, description string, options map<string,string>").option("multiLine", True).json(path)
    flag = lambda f: F.coalesce(F.lower(F.try_element_at("options", F.lit(f))) == "true", F.lit(f == "usePatternMatching")).alias(f)
    return raw.select(F.col("name").alias("parameter_set"), "description", *[flag(f) for f in evaluate.FLAGS])


def past_reports(spark: SparkSession, path: str, most: int = 10) -> DataFrame:
    """The latest reports by file name; configurations, impact histories and files without a summary are left out."""
    raw = spark.read.option("multiLine", True).schema("metadata map<string,string>, summary struct<byParameterSet:map<string,struct<avgLatency:double,avgAccuracy:struct<f1:double>>>>").json(path, pathGlobFilter="*.json")
    d = raw.select("*", F.col("_metadata.file_name").alias("file")).where(~F.col("file").rlike("(-config|impact-history)\\.json$") & F.col("summary").isNotNull())
    return d.orderBy(F.desc("file")).limit(most)


def not_yet(cases: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Cases whose id has no result yet."""
    return cases.join(done.select(key), key, "left_anti")
