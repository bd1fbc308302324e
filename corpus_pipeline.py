"""The corpus pipeline: documents in, a mix of their sources out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet and reads it
back as the next stage's docs. All stages but the last return the columns that they were given.

1. ``quality_classifier``: rows that the byte-level network rejects go.
2. ``near_duplicates``: of each group of near-duplicates the row with the smallest id stays; of rows that repeat an id and its text, one.
3. ``repeated_strings``: strings of 200 bytes or more that occur twice are cut out of the texts; ``n_chars`` is counted anew.
4. ``decontamination``: rows that leak a benchmark item go.
5. ``source_mix``: copies of each remaining document so that the sources meet their targets.

Rows with null texts pass stages 2 to 4 unchanged. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_cnn, lsh_forest, source_mix, suffix_merge, templates
from tessera.llm.store import cut
from tessera.session import table

#: Five words a shingle and a similarity of 0.8.
SHINGLE, PERCENT, LENGTH = 5, 80, 200


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = byte_cnn.fit(docs, table(spark, sf_dir, "labels"))
    return byte_cnn.keep_good(docs, net)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = cut(lsh_forest.near_duplicates(docs, shingle=SHINGLE, percent=PERCENT, with_place=True).select("doc_id", "place", "kept"), "judged")
    # An id may stand in rows with other texts, which are judged by themselves.
    key = lambda t: docs["doc_id"].eqNullSafe(t["doc_id"]) & F.xxhash64(docs["text"]).eqNullSafe(t["place"])
    gone = judged.where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id", "place").distinct()
    again = judged.where("kept").groupBy("doc_id", "place").count().where("count > 1").select("doc_id", "place")
    once = docs.join(again, key(again), "left_semi").dropDuplicates(["doc_id", "text"])
    other = gone.union(again)
    return docs.join(other, key(other), "left_anti").union(once.select(*docs.columns))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = suffix_merge.dedup_texts(docs, length=LENGTH)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return templates.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mix_sources(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontamination", decontamination),
    ("source_mix", mix),
]

#: A trained network, minimum hashes and cut texts are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
