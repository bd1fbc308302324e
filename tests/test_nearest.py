"""The best match against comparing all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import nearest


def _cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return round(sum(x * y for x, y in zip(a, b, strict=True)) / n, 9) if n else 0.0


@pytest.mark.parametrize("block,round_bytes", [(2 << 20, 32 << 20), (200, 300)])
def test_best_match(spark, monkeypatch, block, round_bytes):
    monkeypatch.setattr(nearest, "BLOCK_BYTES", block)
    monkeypatch.setattr(nearest, "ROUND_BYTES", round_bytes)
    r = random.Random(block)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(80)]
    rows += [(100 + i, rows[10][1]) for i in range(5)] + [(20, rows[20][1])]  # ties, a repeated row
    rows += [(200, [0.0] * 4), (210, [1.0, 2.0]), (220, [2.0, 4.0]), (230, [3.0])]
    bad = [(240, None), (250, [None, 1.0, 1.0, 1.0]), (260, [float("nan")] * 4), (None, rows[0][1])]
    d = spark.createDataFrame([(i, v, 7) for i, v in rows + bad], "vec_id long, embedding array<double>, dims int").repartition(3)
    want = {}
    for q, v in rows:
        others = [(-_cosine(v, w), i) for i, w in rows if i != q and len(w) == len(v)]
        if q % 10 == 0 and others:
            want[q] = (min(others)[1], -min(others)[0])
    got = {x["query"]: (x["id"], x["cosine"]) for x in nearest.best_match(d, F.col("vec_id") % 10 == 0).collect()}
    assert {q: x[0] for q, x in got.items()} == {q: x[0] for q, x in want.items()} and 230 not in got
    assert {q: x[1] for q, x in got.items()} == pytest.approx({q: x[1] for q, x in want.items()})


def test_no_vectors(spark):
    assert nearest.best_match(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") > 0).collect() == []


@pytest.mark.parametrize("block,round_bytes", [(2 << 20, 32 << 20), (200, 300)])
def test_best_in_group(spark, monkeypatch, capsys, block, round_bytes):
    """Against the cosine of every pair, odd vectors included; the plan compares blocks, not rows."""
    monkeypatch.setattr(nearest, "BLOCK_BYTES", block)
    monkeypatch.setattr(nearest, "ROUND_BYTES", round_bytes)
    r = random.Random(round_bytes)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], i % 3) for i in range(80)]
    rows += [(20, rows[20][1], 2), (85, rows[50][1], 2), (90, [0.0] * 4, 4), (91, [1.0] * 4, 4), (100, [1.0], 1), (110, [2.0, 2.0], 5), (111, [-1.0, -2.0], 5), (112, [3.0], 5)]
    rows += [(120, None, 6), (121, [1.0], 6), (130, [1.0, None], 7), (131, [1.0, 2.0], 7), (132, [1.0], 7), (140, [float("nan"), 1.0], 8), (141, [1.0, 1.0], 8), (150, [1.0, 1.0], 8)]
    rows += [(160, [float("inf")], 9), (161, [1.0, 2.0], 9), (170, [], 10), (171, [], 10), (180, [1.0], 11), (190, [1.0], None), (None, [1.0], 11), (200, [1.0], 12), (200, [2.0], 12)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    q = d.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query"), "label", F.col("embedding").alias("x"))
    want = q.join(d, "label").where("query <> vec_id").groupBy("query").agg(F.max(T.cosine(F.col("x"), F.col("embedding"))).alias("c"))
    got = nearest.best_in_group(d, F.col("vec_id") % 10 == 0, "label")
    same = lambda x: sorted((a, None if c is None else "nan" if c != c else round(c, 9) + 0.0) for a, c in x.collect())
    assert same(got) == same(want) and len(same(got)) == 17
    from tessera import queries

    monkeypatch.setattr(queries, "table", lambda *_: d)
    queries.best_match_similarity(spark, "").explain()
    assert "MapInArrow" in capsys.readouterr().out
