import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import reference
from tessera.options import Options
from tessera.plans import report
from tessera.streaming import stream


@pytest.fixture
def store(spark):
    """A state store for processors, for one test."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, stream.STATE_STORE)
    yield
    spark.conf.set(key, before)


def _turns():
    r = random.Random(4)
    say = ["We have a memo.", "Read the report.", "Compare the list with the table.", "See the following results.", "Nothing here.", "A table of items.", "Continue as discussed above.", "Some report."]
    return [(c, t, ["user", "assistant"][t % 2], r.choice(say) + " " + r.choice(say)) for c in range(3) for t in range(5)]


def _replay(folder, rows, per_file, extra=lambda i: ""):
    folder.mkdir()
    for i in range(0, len(rows), per_file):
        lines = [f'{{"conv_id":{c},"turn":{t},"role":"{role}","text":"{text}"{extra(t)}}}' for c, t, role, text in rows[i : i + per_file]]
        (folder / f"{i:04}.json").write_text("\n".join(lines))
        os.utime(folder / f"{i:04}.json", (1_700_000_000 + i, 1_700_000_000 + i))


@pytest.mark.parametrize("keep", [2, 0])
def test_a_replayed_stream_gives_the_batch_rules_rows(spark, store, tmp_path, keep):
    rows = sorted(_turns(), key=lambda x: (x[1], x[0]))  # conversations interleave
    _replay(tmp_path / "in", rows, 8)
    live = spark.readStream.schema(stream.TURNS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    start = lambda: stream.write_references(live, str(tmp_path / "out"), str(tmp_path / "cp"), keep).trigger(availableNow=True).start()
    assert start().awaitTermination(200)
    cases = [(f"{c}:{t}", t, [(a, x) for k, n, a, x in rows if k == c and n <= t]) for c, t, _, _ in rows]
    whole = report.complete(spark.createDataFrame(cases, "case_id string, seen long, messages array<struct<role:string,content:string>>"))
    # Without history the last message stands alone.
    batch = reference.rule(whole, Options(window_messages=keep)) if keep else reference.rule(whole.withColumn("messages", F.slice("messages", -1, 1)))
    key = lambda d: sorted((r["case_id"], r["id"], r["detail"], r["confidence"], r["first_char"], str(r["summary"])) for r in d.collect())
    got = spark.read.parquet(str(tmp_path / "out"))
    assert key(got) == key(batch) and got.count() > 3
    assert {r["case_id"]: r["message_index"] for r in got.collect()} == {i: int(i.split(":")[1]) for i in {r["case_id"] for r in got.collect()}}


def test_idle_history_leaves_by_event_time(spark, store, tmp_path):
    rows = [(1, 0, "user", "a memo"), (2, 1, "user", "x"), (2, 5, "user", "y"), (1, 9, "user", "the memo"), (2, 10, "user", "z")]
    _replay(tmp_path / "in", rows, 1, lambda t: f',"ts":"2024-01-01T{t:02}:00:00Z"')
    live = spark.readStream.schema(stream.TURNS + ", ts timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    made = stream.with_history(live, 3, idle_ms=2 * 3600 * 1000, time_col="ts", delay="1 second")
    q = made.writeStream.format("memory").queryName("history_t").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    got = {r["case_id"]: (r["seen"], [m["content"] for m in r["messages"]]) for r in spark.table("history_t").collect()}
    assert got["1:9"] == (0, ["the memo"]) and got["2:1"] == (0, ["x"]) and got["2:10"][1][-1] == "z"


def test_batch_and_stream_agree(spark, tmp_path):
    rows = [(str(i), f"Dear {{{{name{i}}}}}, summarize the report.") for i in range(6)]
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    cases = spark.createDataFrame(rows, "case_id string, prompt string")
    cases.repartition(3).write.json(src)
    live = spark.readStream.schema("case_id string, prompt string").option("maxFilesPerTrigger", 1).json(src)
    q = stream.write_issues(live, out, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted((r["case_id"], r["code"], r["id"]) for r in report.issue_table(cases).collect())
    assert sorted((r["case_id"], r["code"], r["id"]) for r in spark.read.parquet(out).collect()) == want


def test_conversation_state(spark, tmp_path):
    src = str(tmp_path / "turns")
    spark.createDataFrame([(1, 0, "user", "abcd"), (1, 1, "assistant", "abcde"), (2, 0, "user", None)], stream.TURNS).write.json(src)
    q = stream.conversation_state(stream.read_turns(spark, src)).writeStream.format("memory").queryName("state_t").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("state_t").collect())) == [(1, 2, 9, 3), (2, 1, 0, 0)]


def test_idle_conversations_and_windows(spark, tmp_path):
    src, kind = tmp_path / "timed", "conv_id bigint, turn bigint, role string, text string, ts timestamp"
    src.mkdir()
    for i, (conv, ts) in enumerate([(1, "2024-01-01T00:00:00Z"), (2, "2024-01-02T00:00:00Z"), (2, "2024-01-02T00:00:30Z"), (1, "2024-01-02T00:01:00Z")]):
        (src / f"{i}.json").write_text(f'{{"conv_id":{conv},"turn":{i},"role":"user","text":"{{{{a}}}}","ts":"{ts}"}}')
        os.utime(src / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are read by age
    live = lambda: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(src))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return spark.table(name).collect()

    got = run(stream.conversation_state(live(), "ts", "1 minute", 60_000), "idle_t")
    assert sorted((r["conv_id"], r["turns"]) for r in got) == [(1, 1), (1, 1), (2, 1), (2, 2)]
    counts = run(stream.placeholder_counts(live(), "ts", "2 days", "1 day"), "window_t")
    assert max(r["count"] for r in counts) == 3 and {r["variable"] for r in counts} == {"a"}
