"""Exact top-k by inner product with the threshold algorithm over sorted lists.

Vectors become integers, floor(scale * x) a component. The index deals all rows evenly into shards of at most ``SHARD`` rows; a shard keeps, for
each dimension, its rows sorted by that component. A query walks the lists of its non-zero dimensions in parallel, from the end where the
component helps most: each row that a list yields is scored in full, and the walk through a shard stops when the sum of the last
components seen, each times the query's, cannot reach the k-th score so far. A task keeps that score from shard to shard, so later shards are
left earlier. Once a walk has met half of a shard's rows, the other half is scored at once, as the lists would yield it soon. Equal scores go to the
smaller id, so a bound that only equals the k-th score does not end a walk.

Queries are packed into blocks; a block and the next ones go to the index as a broadcast of at most ``ROUND_BYTES``, which is checked, and a larger set of
queries takes more rounds over the index. Each task returns k rows a query, and a window picks the k best of them. Nothing is sampled or capped.

Rows with a null id, and vectors null or with a null or non-finite component, take no part. Vectors meet those of their own length only. Rows that share
an id are never each other's candidates; as candidates of others each of them counts; equal queries (id and vector) answer once, queries of one id with
other vectors each answer. Components beyond the range of long are held at its ends, and so are scores. Empty vectors score 0. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import cut

#: Rows of a shard, bytes of the queries of one block and of one round, and the depth of a walk's first step.
SHARD, BLOCK_BYTES, ROUND_BYTES, FIRST_STEP = 8192, 4 << 20, 32 << 20, 32
_LOW, _HIGH = -(2**63), 2**63 - 1


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(F.forall(vector, fine), F.lit(False))


def dot(rows: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as int64; in Python's integers, held at the ends of long, where doubles would round."""
    if exact:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    return np.clip(rows.astype(object) @ query.astype(object), _LOW, _HIGH).astype(np.int64)


def in_doubles(rows: np.ndarray, queries: np.ndarray) -> bool:
    """Whether all sums of products stay below 2**53."""
    most = lambda x: max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    return max(1, rows.shape[1]) * most(rows) * most(queries) < 2**53


class Best:
    """The k best (score, id) of a query so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def floor(self) -> int | None:
        """The k-th score, which a row must reach; None while there are fewer."""
        return int(self.scores[-1]) if len(self.scores) == self.k else None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(self.scores) == self.k:
            reach = scores >= self.scores[-1]
            scores, ids = scores[reach], ids[reach]
        if len(scores):
            s, i = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
            first = np.lexsort((i, -s.astype(object) if s.min() == _LOW else -s))[: self.k]
            self.scores, self.ids = s[first], i[first]


def walk(best: Best, query_id: int, query: np.ndarray, ids: np.ndarray, rows: np.ndarray, order: np.ndarray, exact: bool) -> int:
    """The threshold algorithm over one shard; returns the rows scored. ``order[d]`` has the shard's rows by component d, smallest first."""
    n = len(ids)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    met, scored, done, depth = np.zeros(n, bool), 0, 0, min(FIRST_STEP, n)

    def score(at: np.ndarray) -> int:
        at = at[ids[at] != query_id]
        best.add(dot(rows[at], query, exact), ids[at])
        return len(at)

    while done < n:
        fresh = np.zeros(n, bool)
        fresh[order[up, n - depth : n - done]] = True
        fresh[order[down, done:depth]] = True
        fresh &= ~met
        met |= fresh
        if 2 * int(met.sum()) >= n or depth == n:
            return scored + score(np.flatnonzero(fresh | ~met))
        scored += score(np.flatnonzero(fresh))
        last = np.concatenate([rows[order[up, n - depth], up], rows[order[down, depth - 1], down]])
        bound = sum(int(a) * int(b) for a, b in zip(last, np.concatenate([query[up], query[down]]), strict=True))
        floor = best.floor()
        if floor is not None and bound < floor:
            return scored
        done, depth = depth, min(n, 2 * depth)
    return scored


def build(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Shards of rows (id, vector) of one length: ids, components and sorted lists as bytes."""
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def made(dims: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
        for at in range(0, len(ids), size):
            i, r = ids[at : at + size], rows[at : at + size]
            order = np.ascontiguousarray(np.argsort(r, axis=0, kind="stable").T.astype(np.int32))
            packed = {"ids": i, "vectors": r, "lists": order}
            yield pa.RecordBatch.from_pydict({"dims": pa.array([dims], pa.int64()), **{c: pa.array([x.tobytes()], pa.binary()) for c, x in packed.items()}})

    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        vectors = batch.column(1)
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
        flat, starts = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
        for dims in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == dims)
            part = waiting.setdefault(dims, [])
            part.append((ids[own], flat[starts[own][:, None] + np.arange(dims)].astype(np.int64)))
            if sum(len(x[0]) for x in part) >= size:
                yield from made(dims, waiting.pop(dims))
    for dims, part in waiting.items():
        yield from made(dims, part)


def whole(cell: pa.Scalar, kind: type) -> np.ndarray:
    data = cell.as_buffer()
    return np.frombuffer(data, kind) if data.size else np.empty(0, kind)


def searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each query among the shards of this task; rows (shard: dims, ids, vectors, lists; block: number, q_ids, q_vectors)."""
    found: dict[tuple[int, int], tuple[np.ndarray, list[Best]]] = {}
    for batch in batches:
        for i in range(batch.num_rows):
            dims, ids, vectors, lists, block, q_ids, q_vectors = (batch.column(c)[i] for c in range(7))
            d, ids = dims.as_py(), whole(ids, np.int64)
            rows, order = whole(vectors, np.int64).reshape(len(ids), d), whole(lists, np.int32).reshape(d, len(ids))
            names = q_ids.values.to_numpy(zero_copy_only=False)
            queries = q_vectors.values.flatten().to_numpy(zero_copy_only=False).reshape(len(names), d)
            exact = in_doubles(rows, queries)
            _, best = found.setdefault((d, block.as_py()), (names, [Best(k) for _ in names]))
            for j in range(len(names)):
                walk(best[j], names[j], queries[j], ids, rows, order, exact)
    for (d, block), (names, best) in found.items():
        sizes = [len(b.ids) for b in best]
        at = np.repeat(np.arange(len(names)), sizes)
        yield pa.RecordBatch.from_pydict({
            "dims": np.full(len(at), d, np.int64), "block": np.full(len(at), block, np.int64), "place": at.astype(np.int64), "query_id": names[at],
            "vec_id": np.concatenate([b.ids for b in best]), "score": np.concatenate([b.scores for b in best]),
        })


def index(vectors: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """The sorted lists of all rows (id, v), written as a table: dims, ids, vectors, lists."""
    # Dealt without a key, so that equal rows and ids spread; the count sizes the plan only.
    parts = min(max(1, -(-vectors.count() // shard_rows)), 10_000)
    dealt = vectors.repartition(parts)
    return cut(dealt.mapInArrow(lambda it: build(it, shard_rows), "dims bigint, ids binary, vectors binary, lists binary"), "sorted-lists")


def query_blocks(queries: DataFrame) -> DataFrame:
    """The distinct queries in blocks of about BLOCK_BYTES of one length: dims, block, q_ids, q_vectors."""
    q = queries.distinct().withColumn("dims", F.size("v").cast("bigint"))
    sizes = q.groupBy("dims").agg(F.greatest(F.ceil(F.count("*") * (F.col("dims") + 1) * 8 / BLOCK_BYTES), F.lit(1)).alias("blocks"))
    q = q.join(sizes, "dims").withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")))
    per = q.groupBy("dims", "block").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("q"))
    return per.select("dims", "block", F.col("q.id").alias("q_ids"), F.col("q.v").alias("q_vectors"))


def top_k(
    vectors: DataFrame, queries: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD, round_bytes: int = ROUND_BYTES
) -> DataFrame:
    """The k best rows of each query (rows for which ``queries`` holds): query_id, rank, vec_id, score."""
    fit = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
    as_rows = lambda d: d.select(F.col(id_col).cast("bigint").alias("id"), integers(F.col(vector_col), scale).alias("v"))
    lists = index(as_rows(fit), shard_rows)
    blocks = cut(query_blocks(as_rows(fit.where(queries))), "query-blocks")
    # Rounds of blocks, each within the size that may be broadcast: sizes of blocks come to the driver, not their rows.
    rounds, room = [[]], round_bytes
    for b in blocks.select("dims", "block", (F.size("q_ids") * (F.col("dims") + 1) * 8).alias("bytes")).orderBy("dims", "block").toLocalIterator():
        if b["bytes"] > room and rounds[-1]:
            rounds.append([])
            room = round_bytes
        rounds[-1].append((b["dims"], b["block"]))
        room -= b["bytes"]
    out = None
    for some in rounds:
        dims = sorted({d for d, _ in some})
        mine = blocks.where(reduce(Column.__or__, [(F.col("dims") == d) & (F.col("block") == b) for d, b in some], F.lit(False)))
        met = lists.where(F.col("dims").isin(dims)).join(F.broadcast(mine), "dims").select("dims", "ids", "vectors", "lists", "block", "q_ids", "q_vectors")
        part = met.mapInArrow(lambda it: searched(it, k), "dims bigint, block bigint, place bigint, query_id bigint, vec_id bigint, score bigint")
        out = part if out is None else out.unionByName(part)
    best = Window.partitionBy("dims", "block", "place").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
