"""The line diff against the same definition over lists, and against its own texts."""

import itertools
import random

from pyspark.sql import functions as F

from tessera.operators import linediff


def _length(places):
    best = []
    for i, x in enumerate(places):
        best.append(1 + max([best[j] for j in range(i) if places[j] < x], default=0))
    return max(best, default=0)


def test_longest_run():
    r = random.Random(1)
    for n in range(40):
        places = r.sample(range(100), n)
        run = linediff.longest_run(places)
        values = [places[i] for i in run]
        assert run == sorted(run) and values == sorted(values) and len(run) == _length(places)


def _same(a, b):
    """How many lines a patience diff of two lists keeps."""
    for n in itertools.count():
        if n >= min(len(a), len(b)) or a[n] != b[n]:
            break
    a, b = a[n:], b[n:]
    k = 0
    while k < min(len(a), len(b)) and a[-1 - k] == b[-1 - k]:
        k += 1
    a, b = a[: len(a) - k], b[: len(b) - k]
    both = [x for x in a if a.count(x) == 1 == b.count(x)]
    run = linediff.longest_run([b.index(x) for x in both])
    if not run:
        return n + k
    total, i, j = n + k, 0, 0
    for x in [both[t] for t in run]:
        total += 1 + _same(a[i : a.index(x)], b[j : b.index(x)])
        i, j = a.index(x) + 1, b.index(x) + 1
    return total + _same(a[i:], b[j:])


def _cases():
    r = random.Random(7)
    for i in range(60):
        a = [r.choice("abcdefghijklmnop"[: 3 + i % 14]) * (1 + i % 3) for _ in range(r.randrange(1, 30))]
        b = list(a)
        for _ in range(r.randrange(0, 8)):
            at = r.randrange(len(b) + 1)
            b[at : at + r.randrange(3)] = [r.choice("abcxyz-+ ") for _ in range(r.randrange(3))]
        yield i, "\n".join(a), "\n".join(b)
    yield 60, None, "x"
    yield 61, "x\n", "x"
    yield 62, "", ""
    yield 63, "a\nb", "a\nc"
    yield 64, "a\nm\nb\nc\nn\nd", "b\nm\nd\nq\na\nn\nc"
    yield 64, "same id", "other texts"
    yield None, "no id", "no id\nat all"
    yield 65, "\n".join(f"line {i % 400}" for i in range(3000)), "\n".join(f"line {i % 400}" for i in range(3000) if i % 97)


def test_patches(spark):
    rows = list(_cases())
    d = spark.createDataFrame([(*x, "c") for x in [*rows, rows[3]]], "id long, old string, new string, pos string").repartition(3)
    out = linediff.patches(d, "id", "old", "new")
    before, after = linediff.side_of(F.col("diff"), linediff.ADDED), linediff.side_of(F.col("diff"), linediff.REMOVED)
    got = out.select("*", before.alias("before"), after.alias("after")).collect()
    want = {(i, a or "", b or "") for i, a, b in rows}
    assert len(got) == len(want) and {(x["id"], x["before"], x["after"]) for x in got} == want
    for x in got:
        a, b = x["before"].split("\n"), x["after"].split("\n")
        assert x["n_same"] == _same(a, b) and x["n_same"] + x["n_removed"] == len(a) and x["n_same"] + x["n_added"] == len(b)
    assert {x["id"]: x["diff"] for x in got}[63] == " a\n-b\n+c"


def test_no_pairs(spark):
    none = spark.createDataFrame([], "id long, old string, new string")
    assert linediff.patches(none, "id", "old", "new").collect() == []


def test_copies(spark):
    rows = [(3, "aa\nlong line"), (1, "long line\nb"), (2, "long line"), (4, None), (5, "alone"), (None, "long line"), (2, "long line"), (6, ""), (7, "")]
    d = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, longest int")
    got = sorted(tuple(x) for x in linediff.copies(d).collect())
    assert got == [(1, 2, "long line\nb", "long line")] * 2 + [(1, 3, "long line\nb", "aa\nlong line"), (6, 7, "", "")]
