"""The pipeline on a small folder: each stage's decisions against what was planted."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(3)
    d = str(tmp_path_factory.mktemp("sf"))
    good = lambda n=80: " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(n)) + "."
    bad = lambda: " ".join("#$%" + r.choice("XYZ") * 3 for _ in range(60))
    item, passage = good(30), good(50)
    docs = [(i, bad() if i % 5 == 0 else good(), "en", f"s{i % 3}") for i in range(150)]
    copy = docs[1][1]
    docs += [(200, copy, "en", "s1"), (201, copy + " tail", "en", "s2"), (202, good() + " " + item, "en", "s0"), (203, good() + " " + passage, "en", "s0"), (204, good() + " " + passage + " " + good(5), "en", "s1"), (205, None, None, None), (1, copy, "en", "s1")]
    spark.createDataFrame([(*x, len(x[1] or "")) for x in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(150)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, passage


def test_stages(spark, folder):
    from tessera.llm.store import cut

    d, passage = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, ids, seen = docs.columns, {}, {}
    for name, stage in pipeline.STAGES:
        docs = cut(stage(spark, docs, d), name)
        ids[name] = sorted(x for r in docs.collect() if (x := r["doc_id"]) is not None)
        seen[name] = docs.columns
    good = {i for i in range(150) if i % 5}
    assert good <= set(ids["quality_classifier"]) and not set(ids["quality_classifier"]) & {i for i in range(150) if i % 5 == 0}
    assert ids["near_duplicates"].count(1) == 1 and not {200, 201} & set(ids["near_duplicates"]) and good <= set(ids["near_duplicates"])
    assert ids["repeated_strings"] == ids["near_duplicates"]
    assert 202 not in ids["decontamination"] and good <= set(ids["decontamination"])
    assert all(seen[n] == columns for n in list(seen)[:-1])
    assert ids["source_mix"] == ids["decontamination"]


def test_run(spark, folder):
    out = pipeline.run(spark, folder[0])
    assert {"doc_id", "taken", "target"} <= set(out.columns) and out.count() > 100


def test_empty_tables_pass_through(spark, folder, tmp_path):
    d, _ = folder
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_an_id_with_two_texts_keeps_both(spark, folder):
    d, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id IN (1, 2, 3)")
    twice = docs.union(docs.where("doc_id = 2").selectExpr("1L", "text", "lang", "source", "n_chars")).union(docs.where("doc_id = 3"))
    out = pipeline.near_duplicates(spark, twice, d)
    assert out.columns == docs.columns
    # (1, text of 2) is a copy of (2, text of 2): the smaller id stays, beside the text of its own.
    assert sorted((r["doc_id"], r["text"][:20]) for r in out.collect()) == sorted([(1, docs.where("doc_id = 1").first()["text"][:20]), (1, docs.where("doc_id = 2").first()["text"][:20]), (3, docs.where("doc_id = 3").first()["text"][:20])])
