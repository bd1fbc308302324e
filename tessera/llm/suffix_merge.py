"""Removal of byte strings that occur twice: sampled suffixes of all shards, merged by refining their interleave.

A shard is an Arrow batch of texts. Sorting and merging every suffix of a shard would move more than ten
times the text, so a shard contributes sampled suffixes (``minimizers``): any string of ``length`` bytes that occurs
twice holds a sampled place at the same offset, whose first bytes (the gram) and left context decide how the suffix
interleaves with those of other shards. Nothing is sorted again; the interleave is refined in rounds, each telling apart
suffixes that agreed so far, and suffixes alone in their interval leave:

1. intervals by gram: a suffix whose gram is alone shares no string of ``length`` bytes with any other;
2. intervals by whole context (all windows that the place serves): members of a larger interval are repeated as a whole;
3. for the rest, and one member of each interval they may still share a string with, intervals by runs of ``RUN`` left offsets;
4. where a run is alone but the bytes common to its windows are not, intervals by single window.

Rounds are equi-joins and counts on hashes, with map-side combining; groups of any size cost a row a
member. Common prefixes appear as byte ranges: the union of all repeated windows is what is removed.

Null texts count as empty. Texts shorter than ``length`` lose nothing. Repeated rows repeat each other's strings and so lose them. An
empty table gives an empty result. Strings are judged on the input, not on what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.minimizers import GRAM, sampled
from tessera.llm.store import cut, drop
from tessera.llm.textbytes import U64, Block, blocks, mix, spark_long, string_parts

RUN = 16


def _ref(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col), F.col(text_col))


def shard_suffixes(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """Sampled suffixes: ref of the row, gram and whole-context hashes, place, and the first and last window start."""
    rows = docs.select(_ref(id_col, text_col).alias("ref"), F.col(text_col).alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            refs = b.column(0).to_numpy()
            for k in blocks(b.column(1)):
                text, place, first, last = sampled(k, length)
                if not len(text):
                    continue
                gram = k.hashes(place, place + GRAM)
                whole = mix(k.hashes(first, last + length) + (place - first).astype(U64))
                base = k.offsets[text]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(refs[text + k.first]), pa.array(spark_long(gram)), pa.array(spark_long(whole)), pa.array(place - base), pa.array((place - first).astype(np.int32)), pa.array((place - last).astype(np.int32))],
                    names=["ref", "gram", "whole", "place", "far", "near"],
                )

    return rows.mapInArrow(apply, "ref long, gram long, whole long, place long, far int, near int")


def contexts(docs: DataFrame, wanted: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """Bytes around each wanted suffix; wanted: (ref, list of (place, gram, far, near))."""
    rows = docs.select(_ref(id_col, text_col).alias("ref"), F.col(text_col).alias("text")).join(wanted, "ref")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            refs = b.column(0).to_numpy()
            data, offs = string_parts(b.column(1))
            lists = b.column(2)
            owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            place, far, near = (flat.field(n).to_numpy().astype(np.int64) for n in ("place", "far", "near"))
            size = np.diff(offs)[owner]
            lo = np.maximum(0, place - (far // RUN * RUN + RUN - 1))
            hi = np.minimum(size, place - near // RUN * RUN + length)
            at = offs[owner] + lo
            n = hi - lo
            o = np.concatenate(([0], np.cumsum(n)))
            take = np.arange(int(o[-1])) + np.repeat(at - o[:-1], n)
            part = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(o.astype(np.int64)), pa.py_buffer(data[take])])
            yield pa.RecordBatch.from_arrays(
                [pa.array(refs[owner]), flat.field("gram"), pa.array(place), pa.array(far.astype(np.int32)), pa.array(near.astype(np.int32)), pa.array(lo), part.cast(pa.binary())],
                names=["ref", "gram", "place", "far", "near", "from", "bytes"],
            )

    return rows.mapInArrow(apply, "ref long, gram long, place long, far int, near int, `from` long, bytes binary")


def _span_hash(data: np.ndarray, offs: np.ndarray, owner, lo, hi) -> np.ndarray:
    k = Block(data, offs, 0)
    return k.hashes(offs[owner] + lo, offs[owner] + hi)


def runs(ctx: DataFrame, length: int) -> DataFrame:
    """A row for each run of left offsets of a suffix: hashes of the run's bytes (null past the text's ends) and of what its windows have in common."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = string_parts(b.column("bytes"))
            place, far, near, start = (b.column(n).to_numpy().astype(np.int64) for n in ("place", "far", "near", "from"))
            first, n = near // RUN, far // RUN - near // RUN + 1
            owner = np.repeat(np.arange(len(n)), n)
            j = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + first[owner]
            rel = place[owner] - start[owner]
            lo, hi = rel - j * RUN - (RUN - 1), rel - j * RUN + length
            whole = (lo >= 0) & (hi <= np.diff(offs)[owner])
            h = np.zeros(len(j), U64)
            tag = j.astype(U64) * U64(0x9E3779B97F4A7C15)
            h[whole] = mix(_span_hash(data, offs, owner[whole], lo[whole], hi[whole]) ^ tag[whole])
            core = mix(_span_hash(data, offs, owner, lo + RUN - 1, hi - RUN + 1) + tag)
            col = lambda c: b.column(c).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [col("ref"), col("gram"), col("place"), pa.array(j.astype(np.int32)), pa.array(spark_long(h), mask=~whole), pa.array(spark_long(core))],
                names=["ref", "gram", "place", "run", "whole", "core"],
            )

    return ctx.mapInArrow(apply, "ref long, gram long, place long, run int, whole long, core long")


def windows(ctx: DataFrame, length: int) -> DataFrame:
    """A row for each window of the runs in ``todo`` that the suffix serves."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = string_parts(b.column("bytes"))
            place, far, near, start = (b.column(n).to_numpy().astype(np.int64) for n in ("place", "far", "near", "from"))
            todo = b.column("todo")
            owner = np.repeat(np.arange(len(place)), np.diff(todo.offsets.to_numpy()))
            j = todo.flatten().to_numpy().astype(np.int64)
            owner, left = np.repeat(owner, RUN), (j[:, None] * RUN + np.arange(RUN)).ravel()
            ok = (left >= near[owner]) & (left <= far[owner])
            owner, left = owner[ok], left[ok]
            lo = place[owner] - start[owner] - left
            h = mix(_span_hash(data, offs, owner, lo, lo + length) ^ (left.astype(U64) * U64(0xC2B2AE3D27D4EB4F)))
            col = lambda c: b.column(c).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([col("ref"), pa.array(place[owner] - left), pa.array(spark_long(h))], names=["ref", "at", "h"])

    return ctx.mapInArrow(apply, "ref long, at long, h long")


def repeated_spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ref, spans): byte ranges whose windows occur elsewhere too, for each row's ref that has any."""
    all_ = cut(shard_suffixes(docs, length, id_col, text_col), "suffixes")
    shared = all_.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("gram")
    kept = cut(all_.join(shared, "gram"), "intervals")
    drop(all_)
    one = F.min(F.struct("ref", "place", "far", "near")).alias("one")
    intervals = cut(kept.groupBy("whole").agg(F.count("*").alias("n"), F.min("gram").alias("gram"), one), "contexts")
    spans = kept.join(intervals.where(F.col("n") > 1).select("whole"), "whole").select("ref", (F.col("place") - F.col("far")).alias("a"), (F.col("place") - F.col("near") + length).alias("b"))
    spans = cut(spans, "spans")
    drop(kept)
    open_ = intervals.groupBy("gram").agg(F.min("n").alias("least"), F.count("*").alias("kinds")).where((F.col("least") == 1) & (F.col("kinds") > 1)).select("gram")
    wanted = intervals.join(open_, "gram").groupBy("one.ref").agg(F.collect_list(F.struct("one.place", "gram", "one.far", "one.near")).alias("list"))
    ctx = cut(contexts(docs, wanted, length, id_col, text_col).dropDuplicates(["ref", "place"]), "bytes")

    by_run = cut(runs(ctx, length), "runs")
    twice = lambda c: by_run.where(F.col(c).isNotNull()).groupBy(c).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(F.col(c))
    alike = by_run.join(twice("whole"), "whole").select("ref", (F.col("place") - F.col("run") * RUN - (RUN - 1)).alias("a"), (F.col("place") - F.col("run") * RUN + length).alias("b"))
    # A run goes on to single windows if what its windows share is repeated; of runs repeated as a whole, one of each kind goes along.
    here = F.struct("ref", "place", "run").alias("one")
    kinds = by_run.where(F.col("whole").isNotNull()).groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(F.struct("ref", "place", "run")).alias("one"))
    cut_off = by_run.where(F.col("whole").isNull()).select("core", here, F.lit(1).cast("long").alias("n"))
    each = kinds.select("core", "one", "n").union(cut_off.select("core", "one", "n"))
    split = each.groupBy("core").agg(F.min("n").alias("least"), F.sum("n").alias("n")).where((F.col("least") == 1) & (F.col("n") > 1)).select("core")
    more = each.join(split, "core").groupBy("one.ref", "one.place").agg(F.collect_set("one.run").alias("todo"))
    single = cut(windows(ctx.join(more, ["ref", "place"]), length), "windows")
    same = single.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("h")
    found = single.join(same, "h").select("ref", F.col("at").alias("a"), (F.col("at") + length).alias("b"))
    return spans.union(alike).union(found).groupBy("ref").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def _union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate(([True], a[1:] > b[:-1]))
    return a[new], b[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(a) - 1]))]


def _with_spans(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    spans = cut(repeated_spans(docs, length, id_col, text_col), "removed")
    return docs.join(spans, _ref(id_col, text_col) == spans["ref"], "left").select(*[docs[c] for c in docs.columns], spans["spans"])


def _cut_out(b: pa.RecordBatch, text: int, spans: int) -> Iterator[tuple[int, int, int, bytes]]:
    """For each row: bytes, bytes removed, runs removed, what is left."""
    data, offs = string_parts(b.column(text))
    lists = b.column(spans)
    for i in range(b.num_rows):
        raw = data[offs[i] : offs[i + 1]]
        if not lists[i].is_valid:
            yield len(raw), 0, 0, raw.tobytes()
            continue
        pairs = lists[i].values
        a, e = _union(pairs.field("a").to_numpy(), pairs.field("b").to_numpy())
        edge = np.concatenate(([0], np.column_stack((a, e)).ravel(), [len(raw)]))
        yield len(raw), int((e - a).sum()), len(a), b"".join(raw[edge[k] : edge[k + 1]].tobytes() for k in range(0, len(edge), 2))


def dedup_digest(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes that are left, for each row."""
    rows = _with_spans(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), length, "doc_id", "text")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(n, r, s, hashlib.sha256(x).hexdigest()) for n, r, s, x in _cut_out(b, 1, 2)]
            n, r, s, h = zip(*got, strict=True) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(r, pa.int64()), pa.array(s, pa.int64()), pa.array(h, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = rows.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)


def dedup_texts(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with repeated strings cut out of the text; halves of characters that a cut leaves go too. Other columns stay."""
    names, schema = docs.columns, docs.schema
    rows = _with_spans(docs, length, id_col, text_col)
    at = names.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            valid = b.column(at).is_valid().to_pylist()
            text = [x.decode("utf-8", "ignore") if v else None for v, (_, _, _, x) in zip(valid, _cut_out(b, at, len(names)), strict=True)]
            cols = [b.column(i) for i in range(len(names))]
            cols[at] = pa.array(text, b.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(apply, schema)
