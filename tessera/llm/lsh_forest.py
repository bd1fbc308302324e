"""Near-duplicates by an LSH forest over MinHash signatures.

Texts with equal sets of word shingles form a class; one text of a class stands for it. A class has ``TREES`` labels of ``DEPTH``
MinHash values each. A tree of the forest is the sorted order of its labels: in it, the classes that share the longest prefixes
with a class are its neighbours. The order is dealt out by range partitioning, with the class itself as the last part of the key, so that any
number of equal labels splits. Candidates are neighbours that share ``START`` values at least; where a region (a run of classes with the same
prefix) is crowded, the next values decide who is near whom, so the depth adapts to each region. They are drawn in rounds:

1. in the first ``FIRST_TREES`` trees, each class with the next one;
2. in all trees, each class with the ``BEST`` of other components, by their sketches, among its next 4, then 32 neighbours. Of two
   components, the members of the smaller one ask;
3. at last, in each region that still holds more classes than one can ask and more than one component, all pairs of different components (``exhaust``):
   the region is cut into tiles, each pair of tiles drops the classes that no sketch brings near another one and counts the common shingles of the others in one
   product. A pair of tiles returns one link for two components, so rows grow with the region, though comparisons grow with its square.

Of the neighbours in the rounds before, pairs go on whose sizes allow the threshold and whose sketches (one bit of each MinHash value) differ no more than
4.5 standard deviations above what a pair right at the threshold expects. They are confirmed on the full shingle sets
(100 * intersection >= threshold * union), and confirmed links are joined into components. Those rounds give a fixed number of neighbours a
class and tree, whatever the size of a group, and leave little to the last step.

Chance that a pair of similarity 0.8 shares no START values in any tree: (1 - 0.8**3)**20 = 6e-7. Of the pairs that share them, all whose sketches
are near enough are confirmed or stand in one component already.

Null texts and texts without words have empty sets, link with nothing and are kept. Fewer words than a shingle
make one shingle of the whole. Repeated rows and ties are copies of each other; the smallest id stays. A class whose ids are all null has component id
null. Very long texts are read whole; a signature takes ``_PIECE`` shingles at a time. An empty table gives an empty result. Only the id and the text are
read, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import merge_labels
from tessera.llm.store import cut, drop
from tessera.llm.textbytes import U64, Block, blocks, mix, spark_long, string_parts

TREES, START, DEPTH, FIRST_TREES, REACHES, BEST = 20, 3, 12, 4, (1, 4, 32), 4
#: Rows at the edges of a worker's runs and of a partition that are looked at with what follows.
EDGE = 256
#: Regions of more classes than this are kept whole; in smaller ones a class without such a neighbour goes.
MARKED = 64
#: Classes of a tile of a crowded region, and shingles that one product counts.
TILE, SLICE = 512, 8_192
#: Tree rows of a range partition, of the run that a worker holds at once, and of a block in which neighbours are compared.
PART_ROWS, HELD_ROWS, BLOCK_ROWS = 150_000, 100_000, 4_096
_VALUES = TREES * DEPTH
_RNG = np.random.Generator(np.random.PCG64(77))
_MULT = _RNG.integers(1, 2**31, _VALUES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _RNG.integers(0, 2**32, _VALUES, dtype=np.uint32)
_COMBINE = _RNG.integers(1, 2**62, 64, dtype=np.uint64) * U64(2) + U64(1)
_PIECE = 1024


def shingle_sets(block: Block, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of the block."""
    starts, ends, owner = block.words()
    h = block.hashes(starts, ends, lower=True) if len(starts) else np.empty(0, U64)
    edges = np.searchsorted(owner, np.arange(block.n + 1))
    rolled = np.zeros(max(0, len(h) - k + 1), U64)
    for i in range(k):
        rolled += h[i : len(h) - k + 1 + i] * _COMBINE[i]
    rolled = mix(rolled)
    for t in range(block.n):
        a, b = edges[t], edges[t + 1]
        if b - a >= k:
            yield np.unique(rolled[a : b - k + 1])
        elif b > a:
            yield mix(np.array([(h[a:b] * _COMBINE[: b - a]).sum(dtype=U64) + U64(b - a)], U64))
        else:
            yield np.empty(0, U64)


def digest(s: np.ndarray) -> bytes:
    """128 bits of a set of hashes, and its size."""
    a = mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64) + U64(len(s))
    b = mix(s * U64(0xDA942042E4DD58B5)).sum(dtype=U64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def minhash(s: np.ndarray) -> np.ndarray:
    best = np.full(_VALUES, 2**32 - 1, np.uint32)
    x = (s >> U64(32)).astype(np.uint32)
    for i in range(0, len(x), _PIECE):
        np.minimum(best, ((x[i : i + _PIECE, None] ^ _SHIFT) * _MULT).min(axis=0), out=best)
    return best


def tree_labels(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """For each tree, its label as two numbers: 16 bits of each of the first 4 values, 8 of each of the others; and the sketch, a bit of each value."""
    v = mix(sig.astype(U64) + (np.arange(_VALUES, dtype=U64) << U64(32)))
    by_tree = v.reshape(TREES, DEPTH)
    first, rest = np.zeros(TREES, U64), np.zeros(TREES, U64)
    for i in range(4):
        first = (first << U64(16)) | (by_tree[:, i] & U64(0xFFFF))
    for i in range(4, DEPTH):
        rest = (rest << U64(8)) | (by_tree[:, i] & U64(0xFF))
    return first, rest, np.packbits((v >> U64(63)).astype(np.uint8)).tobytes()


_SKETCH = "doc_id long, place long, cls binary, n_shingles long, firsts array<bigint>, rests array<bigint>, bits binary"


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offs = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(spark_long(np.concatenate(values)) if values else np.empty(0, np.int64)))


def sketch(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """Class, set size, tree labels and sketch of each row. ``place`` is a hash of the text, to find it again."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("place"), F.col(text_col).alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.empty(0, U64), np.empty(0, U64), None)
        for b in batches:
            for block in blocks(b.column(2)):
                cls, n, made = [], [], []
                for s in shingle_sets(block, k):
                    n.append(len(s))
                    cls.append(digest(s) if len(s) else None)
                    made.append(tree_labels(minhash(s)) if len(s) else none)
                firsts, rests, bits = zip(*made, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(block.first, block.n), b.column(1).slice(block.first, block.n), pa.array(cls, pa.binary()), pa.array(n, pa.int64()), _lists(firsts), _lists(rests), pa.array(bits, pa.binary())],
                    names=["doc_id", "place", "cls", "n_shingles", "firsts", "rests", "bits"],
                )

    return rows.mapInArrow(apply, _SKETCH)


def full_sets(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(cls, shingles) of the wanted classes; wanted: (doc_id, place) of one row of each."""
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(F.col(text_col)).alias("p"), F.col(text_col).alias("text"))
    rows = rows.join(wanted, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("p") == F.col("place")), "left_semi").select("text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in blocks(b.column(0)):
                sets = list(shingle_sets(block, k))
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), _lists(sets)], names=["cls", "shingles"])

    return rows.mapInArrow(apply, "cls binary, shingles array<bigint>").dropDuplicates(["cls"])


class Rows:
    """Rows of the trees in their order, as numpy arrays."""

    def __init__(self, table: pa.Table, percent: int):
        self.n = table.num_rows
        num = lambda c: table.column(c).to_numpy()
        self.size = num("n")
        self.region = np.cumsum(np.concatenate(([0], self._differs(num("tree"), num("first") >> 16 * (4 - START))[: self.n - 1]))) if self.n else np.empty(0, np.int64)
        raw, offs = string_parts(table.column("bits").combine_chunks())
        width = len(raw) // self.n if self.n else 0
        wide = np.zeros((self.n, -(-width // 8) * 8), np.uint8)
        wide[:, :width] = raw.reshape(self.n, -1) if self.n else raw.reshape(0, 0)
        self.bits = wide.view(U64)
        self.percent = percent
        agree = (1 + percent / 100) / 2
        self.most = _VALUES * (1 - agree) + 4.5 * math.sqrt(_VALUES * agree * (1 - agree))

    @staticmethod
    def _differs(*columns: np.ndarray) -> np.ndarray:
        return np.any([c[1:] != c[:-1] for c in columns], axis=0)

    def near(self, reach: int, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of places (and by how many bits their sketches differ), at most ``reach`` apart in one region, that may be near enough; not those of one group."""
        i = np.arange(self.n)
        if group is not None:  # regions of one group have none
            change = np.flatnonzero((group[1:] != group[:-1]) & (self.region[1:] == self.region[:-1]))
            i = i[np.isin(self.region, self.region[change])]
        for gap in range(1, reach + 1):
            i = i[i + gap < self.n]
            i = i[self.region[i] == self.region[i + gap]]
            if not len(i):
                return
            j = i + gap
            ok = 100 * np.minimum(self.size[i], self.size[j]) >= self.percent * np.maximum(self.size[i], self.size[j])
            if group is not None:
                ok &= group[i] != group[j]
            a, b = i[ok], j[ok]
            far = np.bitwise_count(self.bits[a] ^ self.bits[b]).sum(axis=1, dtype=np.int64)
            ok = far <= self.most
            yield a[ok], b[ok], far[ok]


_TREE_ROW = "tree int, first long, rest long, cls binary, n long, bits binary, part int, pos long, tail boolean"


def in_regions(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of a range partition's rows in order, those with a neighbour that may be near enough, or that one may stand beyond the partition's edge; with their place."""
    part, at, carry, seen = TaskContext.get().partitionId(), 0, None, np.empty(0, bool)

    def put(t: pa.Table, keep: np.ndarray, start: int, tail: bool) -> Iterator[pa.RecordBatch]:
        at_ = np.flatnonzero(keep)
        t = t.take(pa.array(at_))
        t = t.append_column("part", pa.array(np.full(len(at_), part, np.int32))).append_column("pos", pa.array(at_ + start)).append_column("tail", pa.array(np.full(len(at_), tail)))
        yield from t.combine_chunks().to_batches()

    def step(fresh: list[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal at, carry, seen
        t = pa.Table.from_batches(fresh) if fresh else None
        t = pa.concat_tables([carry, t]) if carry is not None and t is not None else carry if t is None else t
        if t is None or not t.num_rows:
            return
        t = t.combine_chunks()
        rows = Rows(t, percent)
        mark = np.zeros(rows.n, bool)
        mark[: len(seen)] = seen
        for i, j, _ in rows.near(MARKED):
            mark[i] = mark[j] = True
        mark |= np.bincount(rows.region)[rows.region] > MARKED
        if at == 0:
            mark[: min(EDGE, int((rows.region == 0).sum()))] = True  # the region may begin in an earlier partition
        cut_at = max(0, rows.n - EDGE)
        yield from put(t.slice(0, cut_at), mark[:cut_at], at, False)
        at += cut_at
        carry, seen = t.slice(cut_at), mark[cut_at:]
        if last:
            end = rows.region[cut_at:] == rows.region[-1]  # the region may go on in a later one
            yield from put(carry, seen | end, at, True)

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= HELD_ROWS:
            yield from step(held, False)
            held = []
    yield from step(held, True)


def neighbours(trees: DataFrame, labels: DataFrame | None, parts: list[int], reach: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in different components, at most ``reach`` apart in some tree, that may be near enough."""
    if labels is None:
        rows = trees.withColumn("label", F.col("cls"))
    else:
        rows = trees.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    # Blocks of neighbouring rows, each with the first rows of the next one; part ends have blocks of their own.
    block = F.floor(F.col("pos") / BLOCK_ROWS).cast("long")
    before = F.create_map(*[F.lit(x).cast("long") for i in range(1, len(parts)) for x in (parts[i], parts[i - 1])]) if len(parts) > 1 else F.create_map(F.lit(-1).cast("long"), F.lit(-1).cast("long"))
    key = lambda p, b: F.struct(p.cast("long").alias("p"), b.cast("long").alias("b"))
    own, edge = F.col("part").cast("long"), F.lit(-1)
    keys = F.array(
        key(own, block),
        F.when((F.col("pos") >= BLOCK_ROWS) & (F.col("pos") % BLOCK_ROWS < reach), key(own, block - 1)),
        F.when(F.col("tail"), key(own, edge)),
        F.when((F.col("pos") < reach) & before[own].isNotNull(), key(before[own], edge)),
    )
    dealt = rows.select("tree", "first", "cls", "n", "bits", "label", "part", "pos", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("k")).select("*", "k.p", "k.b").drop("k")

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("pos", "ascending")])
        rows = Rows(table, percent)
        label = np.unique(_words(table.column("label")), return_inverse=True, axis=0)[1].ravel()
        cls = _words(table.column("cls"))
        pairs = [np.stack(p, axis=1) for p in rows.near(reach, label)]
        ij = _best(np.concatenate(pairs) if pairs else np.empty((0, 3), np.int64), label)
        x, y = cls[ij[:, 0]], cls[ij[:, 1]]
        swap = (x[:, 0] > y[:, 0]) | ((x[:, 0] == y[:, 0]) & (x[:, 1] > y[:, 1]))
        x[swap], y[swap] = y[swap], x[swap].copy()
        both = np.unique(np.concatenate((x, y), axis=1), axis=0)
        names = both.astype(">u8").tobytes()
        cell = lambda i, o: names[32 * i + o : 32 * i + o + 16]
        return pa.table({"a": pa.array([cell(i, 0) for i in range(len(both))], pa.binary()), "b": pa.array([cell(i, 16) for i in range(len(both))], pa.binary())})

    return dealt.groupBy("p", "b").applyInArrow(lambda t: compare(t), "a binary, b binary").distinct()


def _near(n: np.ndarray, bits: np.ndarray, label: np.ndarray, tile: np.ndarray, one: bool, percent: int) -> np.ndarray:
    """Which classes of a pair of tiles (or of ``one``) have another of a different component that may be near enough."""
    agree = (1 + percent / 100) / 2
    most = _VALUES * (1 - agree) + 4.5 * math.sqrt(_VALUES * agree * (1 - agree))
    out = np.zeros(len(n), bool)
    for at in range(0, len(n), 64):
        i = slice(at, at + 64)
        ok = (label[i, None] != label[None]) & (100 * np.minimum(n[i, None], n[None]) >= percent * np.maximum(n[i, None], n[None]))
        if not one:
            ok &= tile[i, None] != tile[None]
        a, b = np.nonzero(ok)
        far = np.bitwise_count(bits[at + a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= most
        out[at + a[far]] = True
    return out


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, of, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[of] > 1
    number = np.cumsum(times > 1) - 1
    column, owner = number[of[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, SLICE):
        a, b = np.searchsorted(column, (at, at + SLICE))
        has = np.zeros((len(sets), SLICE), np.float32)
        has[owner[a:b], column[a:b] - at] = 1
        out += has @ has.T
    return out.astype(np.int64)


def exhaust(trees: DataFrame, labels: DataFrame | None, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between all components that share a region in which a class has more others than it could ask; one of each two components a pair of tiles."""
    rows = trees.select("tree", F.shiftright("first", 16 * (4 - START)).alias("key"), "cls", "n", "bits")
    if labels is None:
        rows = rows.withColumn("label", F.col("cls"))
    else:
        rows = rows.join(labels.select(F.col("node").alias("cls"), "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    crowded = rows.groupBy("tree", "key").agg(F.count("*").alias("r"), F.min("label").alias("lo"), F.max("label").alias("hi")).where(f"r > {BEST + 1} AND lo <> hi")
    d = rows.join(crowded.select("tree", "key", F.ceil(F.col("r") / TILE).alias("tiles")), ["tree", "key"]).withColumn("t", F.pmod(F.xxhash64("cls"), F.col("tiles")))
    d = d.withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    d = d.select("tree", "key", F.least("t", "u").alias("ta"), F.greatest("t", "u").alias("tb"), "t", "cls", "label", "n", "bits")
    keys, kept = ["tree", "key", "ta", "tb"], ["tree", "key", "ta", "tb", "t", "cls", "label"]
    numbers = lambda column: np.unique(_words(column), return_inverse=True, axis=0)[1].ravel()
    one = lambda table: table.column("ta")[0].as_py() == table.column("tb")[0].as_py()

    def near(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        raw, _ = string_parts(table.column("bits").combine_chunks())
        bits = raw.reshape(table.num_rows, -1)
        wide = np.zeros((len(bits), -(-bits.shape[1] // 8) * 8), np.uint8)
        wide[:, : bits.shape[1]] = bits
        ok = _near(table.column("n").to_numpy(), wide.view(U64), numbers(table.column("label")), table.column("t").to_numpy(), one(table), percent)
        return table.filter(pa.array(ok)).select(kept)

    def link(table: pa.Table) -> pa.Table:
        cls, label, tile = table.column("cls").to_pylist(), numbers(table.column("label")), table.column("t").to_numpy()
        held = table.column("shingles").combine_chunks()
        flat, offs = held.flatten().to_numpy(), np.concatenate(([0], np.cumsum(held.value_lengths().to_numpy(zero_copy_only=False))))
        size = np.diff(offs)
        common = _common([flat[offs[i] : offs[i + 1]] for i in range(len(cls))])
        ok = np.triu((100 * common >= percent * (size[:, None] + size[None] - common)) & (label[:, None] != label[None]), 1)
        if not one(table):
            ok &= tile[:, None] != tile[None]
        i, j = np.nonzero(ok)
        pair = np.sort(np.column_stack((label[i], label[j])), axis=1)
        first = np.unique(pair, axis=0, return_index=True)[1]
        found = [tuple(sorted((cls[i[x]], cls[j[x]]))) for x in first]
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    may = d.groupBy(*keys).applyInArrow(lambda t: near(t), "tree int, key bigint, ta bigint, tb bigint, t bigint, cls binary, label binary")
    return may.join(sets, "cls").groupBy(*keys).applyInArrow(lambda t: link(t), "a binary, b binary").distinct()


def _best(pairs: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Those of the pairs (i, j, difference) that are among the BEST least different ones of i or of j: of the one whose component is smaller here."""
    size = np.bincount(label)[label]
    i, j = pairs[:, 0], pairs[:, 1]
    at = np.concatenate((np.flatnonzero(size[i] <= size[j]), np.flatnonzero(size[j] <= size[i]) + len(pairs)))
    both = np.concatenate((pairs, pairs[:, [1, 0, 2]]))[at]
    order = np.lexsort((both[:, 1], both[:, 2], both[:, 0]))
    of = both[order, 0]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    return pairs[np.unique(at[order[rank < BEST]] % max(1, len(pairs)))]


def _words(column: pa.ChunkedArray) -> np.ndarray:
    """16-byte values as two numbers each, in the order of the bytes."""
    raw, _ = string_parts(column.combine_chunks())
    return raw.reshape(-1, 16).copy().view(">u8").astype(U64)


def near_duplicates(
    docs: DataFrame, shingle: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", with_place: bool = False
) -> DataFrame:
    """One row for each document: id, n_shingles, component_id (smallest id in its component), kept; and place, if asked for."""
    sketched = cut(sketch(docs, shingle, id_col, text_col), "sketch")
    rows = sketched.select("doc_id", "place", "cls", "n_shingles")
    at = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("at")
    some = sketched.where(F.col("cls").isNotNull())
    classes = cut(some.groupBy("cls").agg(at, *[F.first(c).alias(c) for c in ("n_shingles", "firsts", "rests", "bits")]), "classes")
    parts = max(1, -(-classes.count() * TREES // PART_ROWS))
    spread = classes.select("cls", F.col("n_shingles").alias("n"), "bits", F.posexplode(F.arrays_zip("firsts", "rests")).alias("tree", "z")).select("tree", F.col("z.firsts").alias("first"), F.col("z.rests").alias("rest"), "cls", "n", "bits")
    order = ["tree", "first", "rest", "cls"]
    trees = cut(spread.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(lambda it: in_regions(it, percent), _TREE_ROW), "trees")
    held = sorted(r["part"] for r in trees.select("part").distinct().collect())  # at most ``parts`` numbers
    wanted = classes.join(trees.select("cls").distinct(), "cls", "left_semi").select("at.doc_id", "at.place")
    sets = cut(full_sets(docs, wanted, shingle, id_col, text_col), "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose full sets are near enough."""
        left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        return cut(pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b"), "links")

    labels, tested = None, None
    for reach in REACHES:
        pairs = neighbours(trees.where(F.col("tree") < FIRST_TREES) if reach == 1 else trees, labels, held, reach, percent)
        pairs = cut(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        links = confirm(pairs)
        if not links.isEmpty():
            labels = merge_labels(labels, links)
    links = cut(exhaust(trees, labels, sets, percent), "links")
    if not links.isEmpty():
        labels = merge_labels(labels, links)
    drop(trees, sets)
    if labels is None:
        labels = rows.select(F.col("cls").alias("node"), F.col("cls").alias("label")).limit(0)
    first = classes.select(F.col("cls").alias("node"), F.col("at.doc_id").alias("first_id"))
    merged = labels.join(first, "node")
    least = merged.groupBy("label").agg(F.min("first_id").alias("least"))
    of_class = first.join(labels.join(least, "label").select("node", F.lit(True).alias("linked"), "least"), "node", "left")
    of_class = of_class.select(F.col("node").alias("cls"), F.when(F.col("linked"), F.col("least")).otherwise(F.col("first_id")).alias("component"))
    out = rows.join(of_class, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"), *(["place"] if with_place else []))
