"""Periodic runs of words: stretches that repeat with a period, at least twice and over at least 12 words.

Every lag is scanned: the array of word numbers is compared with itself shifted by each lag up to half of its length, and stretches of
equal places are measured; a stretch whose period is a multiple of a smaller one goes. Many short documents share one flat array, longest first, in
which equal words of different documents bear different numbers, so one comparison serves them all.

The work on a document grows with the square of its words. Documents of more than ``whole_bytes`` bytes are therefore scanned
by ranges of lags, each of about ``UNIT`` comparisons, which Spark deals to all executors; their runs meet the text again in one join by id
and digest. Results do not depend on that limit.

Null and empty texts have no words and no run. A null id counts as the text "" where ids seed anything; repeated rows each get their
own row. Runs of equal length: the smallest start, then the smallest period is the longest. Other columns, whatever their names, are not read. A
task holds some thousand short documents or one long one with its runs. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least words of a run; comparisons of one range of lags; bytes up to which a document is scanned in one task; words of a flat array.
LEAST, UNIT, WHOLE_BYTES, FLAT_WORDS = 12, 1 << 30, 1 << 17, 1 << 16
EIGHT = np.uint64(0x0101010101010101)
WORD = r"[^\x20\x09-\x0D]+"
_RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
Order = Callable[[str, int], np.ndarray | None]


def least_equal(lag: int) -> int:
    """Equal places in a row that make a run of this period."""
    return max(LEAST - lag, lag)


def primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def scan(flat: np.ndarray, sizes: np.ndarray, low: int, high: int) -> np.ndarray:
    """Runs of the lags from ``low`` to below ``high``: rows (document, start in the flat array, length, period).

    ``flat`` holds the documents one after another, longest first, with numbers that no two documents share; ``sizes`` are their words.
    """
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    found, room = [], np.zeros(len(flat) // 8 * 8 + 8, bool)
    for lag in range(low, high):
        # Only documents that are long enough for a run of this period; they stand first.
        reach = bounds[np.searchsorted(-sizes, -max(LEAST, 2 * lag), "right")]
        if reach <= lag:
            break
        n, need = reach - lag, least_equal(lag)
        equal = np.equal(flat[lag:reach], flat[:n], out=room[:n])
        room[n : n // 8 * 8 + 8] = False
        # A stretch of 15 places or more holds eight in a row at a multiple of eight, which one number tells.
        if need >= 15 and not (room[: n // 8 * 8 + 8].view(np.uint64) == EIGHT).any():
            continue
        same = np.flatnonzero(equal)
        if len(same) < need:
            continue
        ends = np.flatnonzero(np.diff(same) != 1)
        first, last = np.concatenate([[0], ends + 1]), np.concatenate([ends, [len(same) - 1]])
        long = last - first + 1 >= need
        for start, stop in zip(same[first[long]], same[last[long]], strict=True):
            if not any(np.array_equal(flat[start : start + 2 * lag - lag // p], flat[start + lag // p : start + 2 * lag]) for p in primes(lag)):
                found.append((start, stop - start + 1 + lag, lag))
    out = np.array(found, np.int64).reshape(-1, 3)
    return np.column_stack([np.searchsorted(bounds, out[:, 0], "right") - 1, out])


def numbered(words: list[bytes], base: int) -> np.ndarray:
    """A number for each distinct word, from ``base`` on."""
    number = dict(zip(dict.fromkeys(words), range(base, base + len(words)), strict=False))
    return np.fromiter(map(number.__getitem__, words), np.int32, len(words))


def ordered(words: list[bytes], order: np.ndarray | None) -> list[bytes]:
    return words if order is None else [words[i] for i in order]


def planted_order(doc_id: str, n: int) -> np.ndarray | None:
    """Which word each place of a document takes: for one id in ten its tail repeats with a period drawn from the id; else as written."""
    h = zlib.crc32(doc_id.encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def words_of(text: bytes | None, doc_id: str | None, order: Order | None) -> list[bytes]:
    """bytes.split() cuts at just the white space of ``WORD``."""
    words = (text or b"").split()
    return ordered(words, order(doc_id or "", len(words))) if order else words


def summary(words: list[bytes], runs: np.ndarray) -> dict:
    """A document's row from its words and its runs (start, length, period)."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    kept = words if keep.all() else [words[i] for i in np.flatnonzero(keep)]
    best = max(map(tuple, runs.tolist()), key=lambda r: (r[1], -r[0], -r[2]), default=None)
    return {
        "n_words": len(words), "n_runs": len(runs), "start": best and best[0], "length": best and best[1], "period": best and best[2],
        "exponent_milli": best and 1000 * best[1] // best[2], "runs": [{"start": s, "length": n, "period": p} for s, n, p in runs.tolist()],
        "runs_sha256": hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs.tolist()).encode()).hexdigest(), "collapsed": b" ".join(kept).decode(),
    }


_ROW = {
    "n_words": pa.int64(), "n_runs": pa.int64(), "start": pa.int64(), "length": pa.int64(), "period": pa.int64(), "exponent_milli": pa.int64(),
    "runs": pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), "runs_sha256": pa.string(), "collapsed": pa.string(),
}
_DDL = f"n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs {_RUN}, runs_sha256 string, collapsed string"


def rows(ids: pa.Array, made: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.cast(kind), *[pa.array([m[c] for m in made], t) for c, t in _ROW.items()]], ["doc_id", *_ROW])


def whole(order: Order | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All lags of all documents of a batch at once, some flat arrays a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).to_pylist()
            texts = batch.column(2).cast(pa.binary())
            words = [words_of(t.as_py(), i, order) for t, i in zip(texts, names, strict=True)]
            sizes = np.array([len(w) for w in words], np.int64)
            by_size = np.argsort(-sizes, kind="stable")
            runs = [np.empty((0, 3), np.int64)] * len(words)
            at = 0
            while at < len(by_size) and sizes[by_size[at]] >= LEAST:
                some = by_size[at : at + max(1, int(np.searchsorted(np.cumsum(sizes[by_size[at:]]), FLAT_WORDS)))]
                at += len(some)
                base, parts = 0, []
                for d in some:
                    parts.append(numbered(words[d], base))
                    base = int(parts[-1].max(initial=base - 1)) + 1
                found = scan(np.concatenate(parts), sizes[some], 1, int(sizes[some[0]]) // 2 + 1)
                starts = np.concatenate([[0], np.cumsum(sizes[some])])
                for d in np.unique(found[:, 0]):
                    mine = found[found[:, 0] == d, 1:]
                    runs[some[d]] = mine - [starts[d], 0, 0]
            yield rows(batch.column(0), [summary(w, r) for w, r in zip(words, runs, strict=True)], batch.schema.field(0).type)

    return run


def lag_ranges(order: Order | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The runs of one range of lags a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_id, name, text, low, high = (batch.column(c)[i] for c in range(5))
                words = words_of(text.as_py().encode(), name.as_py(), order)
                found = scan(numbered(words, 0), np.array([len(words)]), low.as_py(), min(high.as_py(), len(words) // 2 + 1))
                n = len(found)
                ids, digests = pa.array([doc_id.as_py()] * n, batch.schema.field(0).type), pa.array([batch.column(5)[i].as_py()] * n, pa.string())
                yield pa.RecordBatch.from_arrays([ids, digests, *[pa.array(found[:, c]) for c in (1, 2, 3)]], ["doc_id", "digest", "start", "length", "period"])

    return run


def joined(order: Order | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of long documents with all their runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = words_of(batch.column(2)[i].as_py().encode(), batch.column(1)[i].as_py(), order)
                found = np.array([[r["start"], r["length"], r["period"]] for r in batch.column(3)[i].as_py() or []], np.int64).reshape(-1, 3)
                yield rows(batch.column(0).slice(i, 1), [summary(words, found)], batch.schema.field(0).type)

    return run


def find_runs(docs: DataFrame, order: Order | None = None, whole_bytes: int = WHOLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_runs, the longest run, exponent_milli, all runs with their digest, and the text without
    repeats (``collapsed``: words that a run repeats go, those left are joined by one space). ``order``, if given, maps (id, words) to the
    numbers of the words that a document is read as.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    short = F.octet_length(F.coalesce("text", F.lit(""))) <= whole_bytes
    out = d.where(short).mapInArrow(whole(order), f"doc_id {kind}, {_DDL}")

    long = d.where(~short).withColumn("digest", F.sha2("text", 256))
    once = long.dropDuplicates(["doc_id", "digest"]).withColumn("n", F.regexp_count("text", F.lit(WORD)))
    step = F.greatest(F.lit(UNIT) / F.col("n"), F.lit(1)).cast("bigint")
    ranges = once.where(F.col("n") >= LEAST).withColumn("low", F.explode(F.sequence(F.lit(1).cast("bigint"), F.floor(F.col("n") / 2), step)))
    units = ranges.select("doc_id", "name", "text", "low", (F.col("low") + step).alias("high"), "digest").repartition("doc_id", "digest", "low")
    found = units.mapInArrow(lag_ranges(order), f"doc_id {kind}, digest string, start bigint, length bigint, period bigint")
    runs = found.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "length", "period")).alias("runs"))
    met = long.join(runs, long["doc_id"].eqNullSafe(runs["doc_id"]) & (long["digest"] == runs["digest"]), "left")
    return out.unionByName(met.select(long["doc_id"], "name", "text", "runs").mapInArrow(joined(order), f"doc_id {kind}, {_DDL}"))
