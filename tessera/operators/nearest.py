"""The best match of each query vector among all vectors, exactly, by blocked matrix products.

Rows are packed into blocks of one vector length; queries too, which go along as a broadcast of at most ``ROUND_BYTES``, checked, with as many rounds
over the rows as
that takes. A task multiplies each block of rows by each block of queries and returns one row a query; a grouped maximum picks the best. Cosines are
compared after rounding to 9 decimals, ties go to the smaller id. Null vectors, vectors with a null or non-finite component, rows with a null id and
a query's own id take no part;
zero vectors have a cosine of 0 with all. Vectors of other lengths are not compared.

``best_in_group`` gives the highest cosine among the rows of a query's group by the same products. Vectors without a product follow ``text.cosine``:
0 for other lengths, null with a null vector or component, NaN with a non-finite one. What they give depends only on group, length and kind, so
one row for each of these stands for them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.store import cut

BLOCK_BYTES, ROUND_BYTES = 2 << 20, 32 << 20


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (dims, grp, ids, unit vectors) of the rows (id, vector, grp) of each batch."""
    for batch in batches:
        ids, vectors, groups = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1), batch.column(2).dictionary_encode()
        sizes, flat = vectors.value_lengths().to_numpy(zero_copy_only=False), vectors.flatten().to_numpy(zero_copy_only=False)
        starts, codes = np.cumsum(sizes) - sizes, groups.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((codes, sizes))
        for at in np.split(order, np.flatnonzero(np.diff(sizes[order]) | np.diff(codes[order])) + 1) if len(order) else ():
            dims, group = int(sizes[at[0]]), groups.dictionary[int(codes[at[0]])]
            step = max(1, BLOCK_BYTES // (8 * max(dims, 1)))
            for some in (at[i : i + step] for i in range(0, len(at), step)):
                m = flat[starts[some][:, None] + np.arange(dims)].astype(np.float64)
                norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
                unit = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
                row = {"dims": pa.array([dims], pa.int64()), "grp": pa.array([group.as_py()], pa.string()), "ids": pa.array([ids[some].tobytes()], pa.binary()),
                    "units": pa.array([unit.tobytes()], pa.binary())}
                yield pa.RecordBatch.from_pydict(row)


def products(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Queries' ids, rows' ids in order and their cosines (-inf for the own id) of each row (dims, ids, units, q_ids, q_units)."""
    for batch in batches:
        for i in range(batch.num_rows):
            dims, ids, units, q_ids, q_units = (batch.column(c)[i].as_py() for c in range(5))
            rows, asked = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
            shape = lambda x, n: np.frombuffer(x, np.float64).reshape(n, dims) if x else np.zeros((n, dims))
            order = np.argsort(rows, kind="stable")
            rows = rows[order]
            cosines = shape(q_units, len(asked)) @ shape(units, len(rows))[order].T
            cosines[asked[:, None] == rows[None, :]] = -np.inf
            yield asked, rows, cosines


def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, id, cosine): the best of each block of rows for each query."""
    for asked, rows, cosines in products(batches):
        cosines = np.round(cosines, 9)
        best = cosines.argmax(axis=1)  # the first of equals, the smallest id
        found = cosines[np.arange(len(asked)), best]
        ok = found > -np.inf
        yield pa.RecordBatch.from_pydict({"query": asked[ok], "id": rows[best[ok]], "cosine": found[ok]})


def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, cosine): the highest of each block of rows for each query, not rounded."""
    for asked, _, cosines in products(batches):
        found = cosines.max(axis=1)
        ok = found > -np.inf
        yield pa.RecordBatch.from_pydict({"query": asked[ok], "cosine": found[ok]})


def compared(rows: DataFrame, asked: DataFrame, task, schema: str) -> DataFrame:
    """Rows that ``task`` makes of each block of ``rows`` and each block of ``asked`` of the same length and group; both are rows (id, vector, grp)."""
    pack = lambda d: d.mapInArrow(packed, "dims bigint, grp string, ids binary, units binary")
    asked = cut(pack(asked), "asked")
    asked = cut(asked.withColumn("block", F.concat(F.input_file_name(), F.lit("#"), F.monotonically_increasing_id().cast("string"))), "asked-blocks")
    rounds, room = [[]], ROUND_BYTES
    for b in asked.select("block", (F.octet_length("ids") + F.octet_length("units")).alias("size")).orderBy("block").toLocalIterator():
        if b["size"] > room and rounds[-1]:
            rounds, room = [*rounds, []], ROUND_BYTES
        rounds[-1].append(b["block"])
        room -= b["size"]
    blocks = pack(rows) if len(rounds) == 1 else cut(pack(rows), "vector-blocks")

    def one(some: list[str]) -> DataFrame:
        mine = F.broadcast(asked.where(F.col("block").isin(some)).select("dims", "grp", F.col("ids").alias("q_ids"), F.col("units").alias("q_units")))
        return blocks.join(mine, ["dims", "grp"]).select("dims", "ids", "units", "q_ids", "q_units").mapInArrow(task, schema)

    return reduce(DataFrame.union, [one(some) for some in rounds])


def best_match(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query, id, cosine) of every row for which ``queries`` holds, against all rows but those of its own id; none if there is no other row."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False)))
    pick = lambda d: d.select(F.col(id_col).cast("bigint"), v, F.lit(""))
    found = compared(pick(rows), pick(rows.where(queries)), matched, "query bigint, id bigint, cosine double")
    best = found.groupBy("query").agg(F.max(F.struct("cosine", (-F.col("id")).alias("back"))).alias("best"))
    return best.select("query", (-F.col("best.back")).alias("id"), "best.cosine")


def best_in_group(vectors: DataFrame, queries: Column, group: str, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query, cosine) of every row for which ``queries`` holds: the highest cosine among the rows of its group but those of its own id; none if there is no such row.

    The group is compared as text; rows with a null group or id take no part.
    """
    v = F.col("v")
    kind = F.when(v.isNull() | F.exists(v, lambda x: x.isNull()), "null").when(F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "odd").otherwise("fine")
    rows = vectors.withColumn("asked", F.coalesce(queries, F.lit(False))).where(F.col(id_col).isNotNull() & F.col(group).isNotNull())
    rows = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(group).cast("string").alias("grp"), "asked")
    rows = rows.withColumn("dims", F.when(v.isNotNull(), F.size(v))).withColumn("kind", kind)
    fine = rows.where("kind = 'fine'")
    asked = fine.where("asked").select("id", "v", "grp").hint("rebalance", "grp")  # few blocks a group, none larger than a task's share
    near = compared(fine.select("id", "v", "grp"), asked, highest, "query bigint, cosine double")
    kinds = rows.groupBy("grp", "dims", "kind").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    mine = rows.where("asked").select(F.col("id").alias("query"), "grp", F.col("dims").alias("q_dims"), F.col("kind").alias("q_kind"))
    pairs = mine.join(kinds, "grp").where("lo <> query OR hi <> query")
    either = lambda k: (F.col("kind") == k) | (F.col("q_kind") == k)
    far = F.when(F.col("dims") != F.col("q_dims"), F.lit(0.0)).when(either("null"), F.lit(None).cast("double")).when(either("odd"), F.lit(float("nan")))
    return near.union(pairs.select("query", far)).groupBy("query").agg(F.max("cosine").alias("cosine"))
