"""Exact tokens against merging by definition, and against a library's counts."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import bpe, tokens
from tessera.options import Options
from tessera.plans import report

ONE, TWO = (f"/opt/tokenizers/{f}.tiktoken" for f in ("byte_bpe_50k", "byte_bpe_multi_50k"))
needs_files = pytest.mark.skipif(not os.path.exists(ONE), reason="no vocabularies here")


def _slow(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if piece in ranks:
        return 1
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return len(parts)


def test_merge_by_definition():
    r = random.Random(2)
    for _ in range(300):
        letters = [bytes([c]) for c in b"abcd"]
        made = {x: i for i, x in enumerate(letters)}
        for _ in range(r.randrange(1, 25)):
            made.setdefault(r.choice(list(made)) + r.choice(list(made)), len(made))
        piece = b"".join(r.choice(letters) for _ in range(r.randrange(0, 40)))
        assert bpe.merge(piece, made) == (_slow(piece, made) if piece else 0), (piece, made)
    assert bpe.merge(b"a" * 50_000, {b"a": 0, b"aa": 1, b"aaaa": 2}) == 12_500


def _texts():
    r = random.Random(3)
    some = ["the ", "of", "  ", "\n", "\n\n ", "\t", "it's", " we'll", "12", "3.5", "é", "日本", "  ", "　x", "!!", " -", "A", "'", "\x0b", "​", "x" * 40]
    out = [None, "", " ", "\n", "   end", "a  b   c", "'s't", "word " * 300]
    return out + ["".join(r.choice(some) for _ in range(r.randrange(1, 30))) for _ in range(120)]


@needs_files
def test_counts_against_a_library(spark, monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    shape = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    ask = {f: tiktoken.Encoding("t", pat_str=shape, mergeable_ranks=bpe.read_ranks(f), special_tokens={}) for f in (ONE, TWO)}
    rows = [(i, t, ["m", "n", None][i % 3]) for i, t in enumerate(_texts())] + [(3, " ", "m"), (8, _texts()[8], "m"), (8, _texts()[8], "m")]
    d = spark.createDataFrame(rows, "id long, text string, model string").repartition(3)
    files = bpe.RankFiles(ONE, {"n": TWO})
    want = sorted((i, len(ask[TWO if m == "n" else ONE].encode_ordinary(t)) if t else 0) for i, t, m in rows)
    for head in (1, 50, 4096):  # all pieces rare, some, most frequent
        monkeypatch.setattr(bpe, "HEAD", head)
        got = bpe.count_tokens(d, "text", files, "model")
        assert got.columns == ["id", "text", "model", "tokens"]
        assert sorted((r["id"], r["tokens"]) for r in got.collect()) == want
    assert bpe.count_tokens(d.limit(0), "text", files).count() == 0


@needs_files
def test_rules_use_exact_counts(spark):
    rows = [("a", "antidisestablishmentarianism " * 40, "gpt-4"), ("b", "short", "gpt-4"), ("c", "x", None)]
    cases = report.complete(spark.createDataFrame(rows, "case_id string, prompt string, model string"))
    files = bpe.RankFiles(ONE, {"gpt-4o": TWO})
    got = {r["case_id"]: (r["tokens"], r["method"]) for r in tokens.costs(cases, Options(token_estimation="exact"), files).collect()}
    ranks = bpe.read_ranks(ONE)
    want = _slow(b"antidisestablishmentarianism", ranks) + 39 * _slow(b" antidisestablishmentarianism", ranks) + 1
    assert got == {"a": (want, "exact"), "b": (_slow(b"short", ranks), "exact")}
    words = tokens.estimate(cases, "prompt", F.lit(100).cast("long"), "exact").select("case_id", "tokens").collect()
    assert {r[0]: r[1] for r in words} == {"a": 30, "b": 1, "c": 1}


@needs_files
def test_memory_of_a_task_is_bounded(spark, monkeypatch, capsys):
    """Pieces are counted inside each row, without a group or shuffle of texts; rare pieces are dealt by their number; copies and texts without a piece count right."""
    rows = [(i, t) for i, t in enumerate(["b a  b", "b a  b", "a" * 9, None, "", "7 7 7 x"])]
    d = spark.createDataFrame(rows, "id long, text string").selectExpr("encode(string(id), 'UTF-8') AS digest", "0 AS file", "text").repartition(2)
    counted = bpe.piece_counts(d, r"\w")
    assert sorted((sorted(map(tuple, r["pieces"]))) for r in counted.collect()) == [[("7", 3), ("x", 1)], [("a", 1), ("b", 2)], [("a", 1), ("b", 2)], [("a", 9)]]
    assert bpe.piece_counts(d, "z").select("pieces").distinct().collect()[0][0] == []
    counted.explain()
    plan = capsys.readouterr().out.split("RoundRobin")[0]
    assert "Aggregate" not in plan and "hashpartitioning" not in plan and "Sort " not in plan
    words = spark.createDataFrame(rows, "id long, text string")
    want = bpe.count_tokens(words, "text", bpe.RankFiles(ONE)).collect()
    monkeypatch.setattr(bpe, "HEAD", 1)
    monkeypatch.setattr(bpe, "RARE_ROWS", 2)
    got = bpe.count_tokens(words, "text", bpe.RankFiles(ONE))
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and got.where("tokens > 0").count() == 4


@needs_files
def test_boundary_counts_inside_rows(spark, monkeypatch, capsys):
    """Automatic estimates near the window count pieces row by row too."""
    plans, write = [], bpe.cut

    def seen(df, name):
        df.explain()
        plans.append((name, capsys.readouterr().out))
        return write(df, name)

    monkeypatch.setattr(bpe, "cut", seen)
    d = spark.createDataFrame([(1, "a b " * 10, "m"), (2, "c", "m")], "id long, text string, model string")
    got = tokens.estimate(d, "text", F.lit(10).cast("long"), ranks=bpe.RankFiles(ONE), model="model")
    assert {r["id"]: r["method"] for r in got.collect()} == {1: "exact_boundary", 2: "cheap"}
    assert plans[0][0] == "pieces" and "Aggregate" not in plans[0][1] and "Exchange" not in plans[0][1]
