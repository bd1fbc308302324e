import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as T


@pytest.mark.parametrize("word, want", [("reports", "report"), ("tables", "table"), ("stories", "story"), ("boxes", "box"), ("classes", "class"), ("messages", "messag"), ("class", "class"), ("ies", "i")])
def test_singular(spark, word, want):
    assert spark.range(1).select(T.normalize_noun(F.lit(word))).first()[0] == want


def test_phrase_and_preview(spark):
    d = spark.createDataFrame([("Hello, World!  (again)", "a" * 60 + "X" + "b" * 60)], "t string, p string")
    assert d.select(T.normalize_phrase(F.col("t"))).first()[0] == "hello world again"
    assert d.select(T.preview(F.col("p"), F.lit(60), F.lit(61))).first()[0] == "…" + "a" * 40 + "X" + "b" * 40 + "…"
    assert spark.range(1).select(T.utf16_length(F.lit("a😀"))).first()[0] == 3


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab{} .é😀", max_size=30), min_size=1, max_size=20))
def test_offsets(spark, texts):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = d.select("i", F.explode(T.find_all(F.col("t"), r"\{\{\s*([a-z]+)\s*\}\}", 1)).alias("m")).collect()
    import re

    want = sorted((i, m.start(), m.end(), m[0], m[1]) for i, t in enumerate(texts) for m in re.finditer(r"\{\{\s*([a-z]+)\s*\}\}", t))
    assert sorted((r["i"], r["m"]["start"], r["m"]["end"], r["m"]["text"], r["m"]["value"]) for r in rows) == want


def test_chunks_and_sentences(spark):
    d = spark.createDataFrame([("x" * 1200, "Short. This one is long enough! And so is this one?  no")], "a string, b string")
    assert [len(c) for c in d.select(T.chunks(F.col("a"))).first()[0]] == [500, 500, 400]
    assert d.select(T.sentences(F.col("b"))).first()[0] == ["This one is long enough", "And so is this one"]
    assert d.select(T.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == 0.0
