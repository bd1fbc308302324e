"""The registered queries of this subpackage: one opN_<name> for each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

#: The rules that the URL query is asked to judge by.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op1_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.templates import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.source_mix import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "rate")


def op3_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.subword_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import byte_cnn

    docs = table(spark, sf_dir, "documents")
    return byte_cnn.score(docs, byte_cnn.fit(docs, table(spark, sf_dir, "labels")))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.divergence import quality_rules

    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})


def op6_license_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.html_main import extract_main

    return extract_main(table(spark, sf_dir, "pages"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_merge import dedup_digest

    return dedup_digest(table(spark, sf_dir, "documents"), length=200)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS rules(host, path, verdict)"))


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lsh_forest import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op11_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.threshold_topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.periodic import find_runs, planted_order

    out = find_runs(table(spark, sf_dir, "documents"), planted_order)
    return out.withColumn("collapsed_sha256", F.sha2("collapsed", 256)).drop("runs", "collapsed", "n_words")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.fill_middle import Plan, fill_in_middle, restore

    out = fill_in_middle(table(spark, sf_dir, "documents"), Plan(salt="7", rate=100, spm=50))
    out = out.withColumn("restored_sha256", restore(out)["sha256"])
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from tessera.llm.oracles import ORACLES

    return dict(ORACLES)
