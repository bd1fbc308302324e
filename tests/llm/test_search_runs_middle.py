"""Exact top-k, periodic runs and fill-in-the-middle against brute force, with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import fill_middle, periodic, threshold_topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# Exact top-k


def _best(rows, wanted, k):
    """Each query against all rows of its length, in Python's integers."""
    fit = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in fit if wanted(i)}:
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fit if i != q and len(w) == len(v))
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def _vectors(r, n, dims):
    centre = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    return [[np.float32(c + r.gauss(0, 0.3)).item() for c in r.choice(centre)] for _ in range(n)]


@pytest.mark.parametrize("shard_rows,round_bytes", [(1 << 13, 1 << 25), (37, 1), (1, 1 << 25)])
def test_top_k(spark, monkeypatch, shard_rows, round_bytes):
    r = random.Random(shard_rows)
    rows = [(i, v) for i, v in enumerate(_vectors(r, 160, 6))] + [(200 + i, v) for i, v in enumerate(_vectors(r, 30, 3))]
    hot = rows[10][1]
    rows += [(i, hot) for i in range(300, 360)] + [rows[10], rows[20], (20, rows[21][1])]  # equal vectors, repeated rows, an id with two vectors
    rows += [(None, hot), (400, None), (410, []), (420, []), (430, [None, 1.0, 1.0, 1.0, 1.0, 1.0]), (440, [float("nan")] * 6), (450, [float("inf")] + [0.0] * 5), (460, [0.0] * 6), (470, [1.0])]
    monkeypatch.setattr(threshold_topk, "BLOCK_BYTES", 500)
    d = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, dims string, block int").repartition(3)
    got = threshold_topk.top_k(d, F.col("vec_id") % 10 == 0, k=7, shard_rows=shard_rows, round_bytes=round_bytes)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == _best(rows, lambda i: i % 10 == 0, 7)


def test_top_k_of_an_empty_table(spark):
    d = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert threshold_topk.top_k(d, F.col("vec_id") % 10 == 0).collect() == []


def test_top_k_beyond_doubles(spark):
    rows = [(0, [1e12, -3.0, 7.0]), (1, [1e12, 2.0, 1.0]), (2, [1e12, 2.0, 1.0009765625]), (3, [-1e12, 5.0, 5.0]), (4, [1e30, 0.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    hold = lambda x: max(-(2**63), min(2**63 - 1, x))
    v = {i: [hold(math.floor(1024 * x)) for x in w] for i, w in rows}
    want = sorted((-hold(sum(a * b for a, b in zip(v[0], v[i], strict=True))), i) for i in (1, 2, 3, 4))
    assert [(-r["score"], r["vec_id"]) for r in threshold_topk.top_k(d, F.col("vec_id") == 0).orderBy("rank").collect()] == want


def test_a_walk_stops_early():
    """On vectors with a few large components a walk leaves most rows alone, and finds the same."""
    r = np.random.default_rng(4)
    rows = np.floor(r.standard_normal((4000, 8)) ** 5 * 100).astype(np.int64)
    ids, order = np.arange(4000), np.argsort(rows, axis=0, kind="stable").T
    for q in range(20):
        best = threshold_topk.Best(10)
        seen = threshold_topk.walk(best, q, rows[q], ids, rows, order, True)
        want = np.lexsort((ids, -(rows @ rows[q])))
        assert best.ids.tolist() == [i for i in want if i != q][:10] and seen < 2500


# Periodic runs


def _runs(w):
    """All runs by definition: each lag, each maximal stretch, its smallest period."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(12, 2 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + size - p)) for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


def _row(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = _runs(w)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
    s, n, q = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    return (doc_id, len(runs), s, n, q, n and 1000 * n // q, sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(kept)))


def _texts():
    r = random.Random(8)
    say = lambda n, k=30: [f"w{r.randrange(k)}" for _ in range(n)]
    out = [None, "", " \t\n", "one", "a " * 40, "a b " * 30, "x y z x y z", "é ü é ü " * 9, "no break here " * 8, "\x1cw " * 20, "a a b " * 12 + "c " + "a a b " * 12]
    for _ in range(60):
        w = say(r.randrange(1, 90), r.choice([2, 3, 30]))
        p, a = r.randrange(1, 20), r.randrange(len(w))
        out.append(r.choice([" ", "\n", " \t "]).join([*w[:a], *(w[a : a + p] * r.randrange(1, 6))]))
    long = say(3000, 500)
    out += [" ".join(long[:1500] + long[200:1200] * 2 + long[1500:]), " ".join(say(700, 2))]  # longer than WHOLE in the test below
    return out


@pytest.mark.parametrize("whole_bytes", [1 << 17, 3000, 0])
def test_periodic_runs(spark, monkeypatch, whole_bytes):
    monkeypatch.setattr(periodic, "UNIT", 1 << 18)  # many ranges of lags
    monkeypatch.setattr(periodic, "FLAT_WORDS", 2000)
    rows = [(i, t) for i, t in enumerate(_texts())]
    rows += [rows[4], rows[30], (30, rows[31][1]), (None, rows[5][1]), (None, None), rows[-1], (None, rows[-2][1])]
    d = spark.createDataFrame([(i, t, "r", 5) for i, t in rows], "doc_id long, text string, runs string, n_runs int").repartition(3)
    got = periodic.find_runs(d, periodic.planted_order, whole_bytes)
    got = got.withColumn("collapsed_sha256", F.sha2("collapsed", 256)).drop("runs", "collapsed", "n_words").collect()
    key = lambda x: tuple((y is None, str(y)) for y in x)
    assert sorted(map(tuple, got), key=key) == sorted((_row(*x) for x in rows), key=key)


def test_periodic_runs_of_an_empty_table_and_of_texts_as_written(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.find_runs(empty, periodic.planted_order).collect() == []
    d = spark.createDataFrame([("k", "go " + "on and " * 8 + "end")], "doc_id string, text string")
    r = periodic.find_runs(d).first()
    assert (r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) == ("k", 18, [(1, 16, 2)], "go on and end")


# Fill in the middle


def _middle(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    s = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(s[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<S>{z}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{z}<M>{m}"
    return (doc_id, n, form, len(p), len(m), sha(out), sha(text))


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0), (100, 100), (0, 50)])
def test_fill_in_middle(spark, rate, spm):
    r = random.Random(rate)
    texts = [None, "", "\n", "\n\n\n", "one line", "é\n\U0001f600 two\n", "a <P> b\nc", "<S>", "x\n<M>\n", "<p>\n<s>\n", "P><S\n<\nM>\n", "\r\n\r\n", "a\rb c\n", "line\n" * 5000]
    texts += ["".join(r.choice(["\n", "ab", "é", "<P", ">"]) for _ in range(r.randrange(60))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (4, texts[5]), (None, texts[5]), (None, None), (-3, texts[13])]
    d = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n int, FORM string, made__ int").repartition(3)
    out = fill_middle.fill_in_middle(d, fill_middle.Plan(rate=rate, spm=spm))
    out = out.withColumn("back", fill_middle.restore(out))
    assert out.where(~F.col("back.text").eqNullSafe(F.coalesce("text", F.lit("")))).count() == 0
    assert out.where(F.sha2("output", 256) != F.col("output_sha256")).count() == 0
    got = out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "back.sha256").collect()
    key = lambda x: tuple((y is None, str(y)) for y in x)
    assert sorted(map(tuple, got), key=key) == sorted((_middle(i, t, rate, spm) for i, t in rows), key=key)


def test_fill_in_middle_by_words_and_of_an_empty_table(spark):
    plan = fill_middle.Plan(salt="x", unit=r"\S+\s*")
    assert fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), plan).collect() == []
    out = fill_middle.fill_in_middle(spark.createDataFrame([("a", "one two three four")], "doc_id string, text string"), plan)
    r = out.withColumn("back", fill_middle.restore(out)).first()
    assert r["n"] == 4 and r["form"] != "plain" and r["back"]["text"] == "one two three four"
