"""Connected components of an edge table, by rounds of Spark joins.

Each round lets a node take the smallest label among its neighbours, then the label of
its label (pointer jumping), until nothing changes. State is a written table each round, so a lost
executor costs one round at most, and nothing but a count reaches the driver. Labels fall every round, so the rounds
end; a graph that isn't done after ``MAX_ROUNDS`` raises an error rather than give back parts of components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import cut, drop

MAX_ROUNDS = 1_000


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b), any orderable type. Returns (node, label): label is the smallest node of the node's component."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).where(F.col("a") != F.col("b")).distinct().toDF("u", "v"), "edges")
    state = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label"), F.col("u").alias("old")), "labels")
    for _ in range(MAX_ROUNDS):
        now = state.select("node", "label")
        near = both.join(now.select(F.col("node").alias("v"), F.col("label").alias("near")), "v").groupBy(F.col("u").alias("node")).agg(F.min("near").alias("near"))
        took = now.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = now.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(took.join(jump, "label", "left").select("node", F.least("label", F.coalesce("further", "label")).alias("label"), "old"), "labels")
        drop(state)
        state = new
        if state.where(F.col("label") != F.col("old")).isEmpty():
            drop(both)
            return state.select("node", "label")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def merge_labels(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """labels: (node, label) so far, None for none; links: new edges (a, b). The labels with both; only components that a link joins are worked on."""
    if labels is None:
        return components(links)
    of = labels.select(F.col("node").alias("node_"), F.col("label").alias("label_"))
    for c in ("a", "b"):
        links = links.join(of, F.col(c) == F.col("node_"), "left").withColumn(c, F.coalesce("label_", c)).drop("node_", "label_")
    joined = components(links)
    every = labels.union(joined.select("node", F.col("node").alias("label"))).distinct()
    now = joined.select(F.col("node").alias("label"), F.col("label").alias("new"))
    return cut(every.join(now, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "labels")
