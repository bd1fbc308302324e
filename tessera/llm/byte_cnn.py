"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into half-chunks of ``HALF`` bytes, the last one padded with zero bytes; each two
neighbours make a chunk, so chunks overlap by half and cover the whole text. ``FILTERS`` learned filters of
``WIDTH`` bytes slide over every position and are max-pooled in each chunk; a hidden layer reads the pooled
filters of a chunk. The mean and the maximum of the hidden units over all chunks, and the logarithm of the
number of bytes, are combined into one probability.

Training is by Adam in one task, from at most ``max_rows`` labelled rows a class (a documented bound; rows are
taken in order of a hash of the id), never from held-out rows. Scoring is a map over Arrow batches: nothing is shuffled, and a
worker holds one block of texts at a time.

Null texts count as empty and get the score of one padded half-chunk. Repeated rows get equal scores. Labels other than 0 and 1,
labels without a document and null ids are not learned from. Without any label of one class the score is the constant 0.5.
An empty table gives an empty result. Very long texts are scored whole, a block each; equal values of a pooled filter or hidden unit share its
gradient. Only the id and the text of a row are read, so other columns may have any names.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textbytes import blocks, string_parts

WIDTH, FILTERS, HIDDEN, HALF = 5, 32, 16, 128
MAX_ROWS = 1_500
EPOCHS, BATCH, RATE, DECAY = 12, 24, 3e-3, 1e-4
#: Weight of a class in training: labels of 1 are the common case, and rejecting a good text costs more.
PRIOR = {0: 0.35, 1: 0.65}
STEP = 16  # half-chunks that one numpy step handles


def held_out(doc_id: Column, folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Half-chunks, each with the WIDTH - 1 bytes behind it (zeros behind a text's last one), and the number of half-chunks of each text."""
    sizes = np.diff(offsets)
    halves = np.maximum(1, -(-sizes // HALF))
    begin = np.concatenate(([0], np.cumsum(halves)[:-1])) * HALF
    flat = np.zeros(int(halves.sum()) * HALF, np.uint8)
    flat[np.arange(len(data)) + np.repeat(begin - offsets[:-1], sizes)] = data
    out = np.zeros((int(halves.sum()), HALF + WIDTH - 1), np.uint8)
    out[:, :HALF] = flat.reshape(-1, HALF)
    out[:-1, HALF:] = out[1:, : WIDTH - 1]
    out[np.cumsum(halves) - 1, HALF:] = 0
    return out, halves


def pooled(x: np.ndarray, table: np.ndarray, places: bool = False):
    """Largest answer of each filter in each half-chunk (and where it is)."""
    n = len(x)
    best = np.empty((n, table.shape[2]), np.float32)
    where = np.empty((n, table.shape[2]), np.int64) if places else None
    for i in range(0, n, STEP):
        j = min(n, i + STEP)
        acc = table[0].take(x[i:j, :HALF], axis=0)
        for k in range(1, WIDTH):
            acc += table[k].take(x[i:j, k : k + HALF], axis=0)
        if places:
            at = acc.argmax(axis=1)
            where[i:j] = at + (np.arange(i, j) * x.shape[1])[:, None]
            best[i:j] = np.take_along_axis(acc, at[:, None, :], 1)[:, 0]
        else:
            acc.max(axis=1, out=best[i:j])
    return (best, where) if places else best


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.Generator(np.random.PCG64(seed))
        g = lambda *s, sd: r.normal(0, sd, s).astype(np.float32)
        self.p = {
            "table": g(WIDTH, 256, FILTERS, sd=0.3), "w1": g(FILTERS, HIDDEN, sd=0.25), "b1": np.zeros(HIDDEN, np.float32),
            "w2": g(2 * HIDDEN + 1, sd=0.2), "b2": np.zeros(1, np.float32), "mu": np.zeros(FILTERS, np.float32),
        }

    def forward(self, best: np.ndarray, halves: np.ndarray, sizes: np.ndarray):
        """Logits of the texts from their pooled half-chunks, and what the backward pass needs."""
        p = self.p
        first = np.concatenate(([0], np.cumsum(halves)[:-1]))
        nxt = np.minimum(np.arange(len(best)) + 1, np.repeat(first + halves - 1, halves))
        right = best[nxt] > best
        chunk = np.maximum(best, best[nxt])
        keep = np.ones(len(best), bool)
        keep[(first + halves - 1)[halves > 1]] = False  # the last half-chunk starts no chunk of its own
        counts = np.where(halves > 1, halves - 1, 1)
        rows = np.flatnonzero(keep)
        h = chunk[rows] - p["mu"]
        z = h @ p["w1"] + p["b1"]
        u = np.maximum(z, 0)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        mean = np.add.reduceat(u, starts, axis=0) / counts[:, None]
        top = np.maximum.reduceat(u, starts, axis=0)
        f = np.concatenate([mean, top, np.log1p(sizes)[:, None] / 8], axis=1).astype(np.float32)
        return f @ p["w2"] + p["b2"][0], (nxt, right, rows, h, z, u, starts, counts, top, f)

    def loss_grads(self, x, halves, sizes, y, weight):
        p = self.p
        best, where = pooled(x, p["table"], places=True)
        logit, (nxt, right, rows, h, z, u, starts, counts, top, f) = self.forward(best, halves, sizes)
        q = 1 / (1 + np.exp(-logit))
        d = ((q - y) * weight).astype(np.float32)
        g = {"w2": f.T @ d, "b2": np.array([d.sum()], np.float32)}
        df = d[:, None] * p["w2"][None, :]
        du = np.repeat(df[:, :HIDDEN] / counts[:, None], counts, axis=0)
        tie = u == np.repeat(top, counts, axis=0)
        n_tie = np.add.reduceat(tie.astype(np.float32), starts, axis=0)
        du += tie * np.repeat(df[:, HIDDEN : 2 * HIDDEN] / n_tie, counts, axis=0)
        dz = du * (z > 0)
        g["w1"], g["b1"] = h.T @ dz, dz.sum(0)
        dh = dz @ p["w1"].T
        side = np.where(right[rows], where[nxt[rows]], where[rows])
        gt = np.zeros_like(p["table"])
        col = np.broadcast_to(np.arange(FILTERS), side.shape).ravel()
        flat, seen = side.ravel(), x.ravel()
        for k in range(WIDTH):
            gt[k] = np.bincount(seen[flat + k].astype(np.int64) * FILTERS + col, dh.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        g["table"] = gt
        return float(-(weight * (y * np.log(q + 1e-9) + (1 - y) * np.log(1 - q + 1e-9))).sum()), g

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.p)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Network:
        net = cls()
        with np.load(io.BytesIO(raw)) as f:
            net.p = {k: f[k] for k in f.files}
        return net

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) < 2:
            return np.empty(0)
        x, halves = padded(data, offsets)
        return 1 / (1 + np.exp(-self.forward(pooled(x, self.p["table"]), halves, np.diff(offsets))[0].astype(np.float64)))


def train(texts: list[str], labels: list[int], seed: int = 7, epochs: int = EPOCHS) -> Network | None:
    """A network fitted to the texts; None if a class is missing."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    share = {c: PRIOR[c] / (y == c).mean() for c in (0, 1)}
    weight = np.where(y == 1, share[1], share[0]).astype(np.float32)
    net, r = Network(seed), np.random.Generator(np.random.PCG64(seed))
    data, offs = string_parts(pa.array(texts, pa.large_string()))
    # Short neighbours first, so that a batch has texts of like length; batches come in random order.
    order = np.argsort(np.diff(offs), kind="stable")
    batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    net.p["mu"] = pooled(padded(data[: 1 << 18], np.array([0, min(len(data), 1 << 18)]))[0], net.p["table"]).mean(0)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    t = 0
    for epoch in range(epochs):
        rate = RATE * (0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 0.05)
        for b in r.permutation(len(batches)):
            ids = batches[b]
            part = np.concatenate([data[offs[i] : offs[i + 1]] for i in ids])
            o = np.concatenate(([0], np.cumsum([offs[i + 1] - offs[i] for i in ids])))
            x, halves = padded(part, o)
            _, g = net.loss_grads(x, halves, np.diff(o), y[ids], weight[ids] / len(ids))
            t += 1
            for k, d in g.items():
                if k in ("w1", "w2"):
                    d = d + DECAY * net.p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v2[k] = 0.999 * v2[k] + 0.001 * d * d
                net.p[k] = net.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v2[k] / (1 - 0.999**t)) + 1e-7)
    return net


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """Train on at most ``max_rows`` labelled rows of each class that are not held out."""
    lab = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("y")).where(F.col("l_id").isNotNull() & ~held_out(F.col("l_id")))
    picked = None
    for c in (0, 1):
        part = lab.where(F.col("y") == c).orderBy(F.xxhash64("l_id"), "l_id").limit(max_rows)
        picked = part if picked is None else picked.union(part)
    ids = [(r["l_id"], r["y"]) for r in picked.distinct().collect()]  # at most 2 * max_rows
    if not ids:
        return None
    side = docs.sparkSession.createDataFrame(ids, "l_id long, y int")
    # An id may stand in several rows; the learner takes each id's first text by order.
    rows = docs.select(F.col(id_col).alias("d_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).join(F.broadcast(side), F.col("d_id") == F.col("l_id"))
    sample = rows.groupBy("l_id", "y").agg(F.min("t").alias("t")).repartition(1)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(((r["l_id"], r["y"], r["t"]) for b in batches for r in b.to_pylist()), key=lambda r: r[:2])
        net = train([r[2] for r in got], [r[1] for r in got])
        yield pa.RecordBatch.from_arrays([pa.array([net.dump() if net else None], pa.binary())], names=["net"])

    made = sample.mapInArrow(learn, "net binary").first()
    return Network.load(bytes(made["net"])) if made and made["net"] is not None else None


def score(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted for each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [net.predict(k.data, k.offsets) if net else np.full(k.n, 0.5) for k in blocks(b.column(2))]
            s = np.concatenate(parts) if parts else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"]
            )

    out = rows.mapInArrow(apply, "doc_id long, held_out boolean, score double, predicted int")
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)


def keep_good(docs: DataFrame, net: Network | None, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    schema, place = docs.schema, docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [net.predict(k.data, k.offsets) if net else np.full(k.n, 0.5) for k in blocks(b.column(place))]
            good = np.concatenate(parts) >= threshold if parts else np.empty(0, bool)
            yield b.filter(pa.array(good))

    return docs.mapInArrow(apply, schema)
