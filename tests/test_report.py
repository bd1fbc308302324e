"""Reports read their cases once."""

from pyspark.sql import functions as F

from tessera.plans import report


def test_cases_are_put_together_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def prompt(i):
        made.add(1)
        return f"Summarize the report {{{{x{i}}}}}. Be concise and brief, step by step."

    cases = spark.range(6).repartition(2).select(F.col("id").cast("string").alias("case_id"), prompt("id").alias("prompt"), F.lit("gpt-4").alias("model"))
    got = report.analyze(cases).collect()
    assert made.value == 6 and len(got) == 6
    assert all(r["cost"]["est_input_tokens"] > 0 and {"MISSING_PLACEHOLDER", "MISSING_REFERENCE", "CONFLICTING_INSTRUCTION"} <= {i["code"] for i in r["issues"]} for r in got)
