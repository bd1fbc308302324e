"""The rules over streams: reports per micro-batch, the reference rule with each conversation's last messages as state, and running counts.

State that a processor keeps needs a store that knows it: set ``spark.sql.streaming.stateStore.providerClass`` to ``STATE_STORE``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators import placeholders, reference
from tessera.options import Options
from tessera.plans import report
from tessera.store import cut, drop

TURNS = "conv_id bigint, turn bigint, role string, text string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CASES = "case_id string, seen bigint, messages array<struct<role:string,content:string>>"


def read_turns(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return spark.readStream.schema(TURNS).format(fmt).load(path)


def write_issues(cases: DataFrame, path: str, checkpoint: str, options: Options = Options()):
    """Issues of each micro-batch of cases, appended as Parquet under the batch's id so that a replayed batch replaces itself."""

    def batch(df: DataFrame, batch_id: int) -> None:
        report.issue_table(df, options).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return cases.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def placeholder_counts(turns: DataFrame, time_col: str = "ts", delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Placeholders by window and variable, with a watermark for late turns."""
    found = placeholders.scan(turns)
    return found.withWatermark(time_col, delay).groupBy(F.window(time_col, window).alias("window"), "variable").agg(F.count("*").alias("count"))


def conversation_state(turns: DataFrame, time_col: str | None = None, delay: str = "1 hour", idle_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """Running turns, characters and cheap tokens of each conversation; state is three numbers a conversation.

    With a time column, state goes once the watermark has passed a conversation's last turn by ``idle_ms``; without one it stays.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, chars, tokens = state.get if state.exists else (0, 0, 0)
        last = 0
        for p in parts:
            lengths = p["text"].fillna("").str.len()
            n, chars, tokens = n + len(p), chars + int(lengths.sum()), tokens + int((-(-lengths // 4)).sum())
            if time_col and p[time_col].notna().any():
                last = max(last, int(p[time_col].max().timestamp() * 1000))
        state.update((n, chars, tokens))
        if time_col:
            state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"conv_id": [key[0]], "turns": [n], "chars": [chars], "tokens": [tokens]})

    rows, ends = (turns.withWatermark(time_col, delay), GroupStateTimeout.EventTimeTimeout) if time_col else (turns, GroupStateTimeout.NoTimeout)
    return rows.groupBy("conv_id").applyInPandasWithState(step, "conv_id bigint, turns bigint, chars bigint, tokens bigint",
        "n bigint, chars bigint, tokens bigint", "update", ends)


class History(StatefulProcessor):
    """The last ``keep`` messages of each conversation as list state, and how many there were.

    Messages count in the order of their turns within a micro-batch, and of the micro-batches. By event time a timer clears a conversation that has
    been idle for
    ``idle_ms``; by processing time the state's time to live does; without ``idle_ms`` it stays.
    """

    def __init__(self, keep: int, idle_ms: int | None, by_event_time: bool):
        self.keep, self.idle_ms, self.by_event_time = keep, idle_ms, by_event_time

    def init(self, handle) -> None:
        self.handle, ttl = handle, None if self.by_event_time else self.idle_ms
        self.last = handle.getListState("last", "role string, text string", ttlDurationMs=ttl)
        self.seen = handle.getValueState("seen", "n bigint", ttlDurationMs=ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        past = [tuple(r) for r in self.last.get()] if self.last.exists() else []
        n = self.seen.get()[0] if self.seen.exists() else 0
        for r in sorted(rows, key=lambda r: (r.turn is None, r.turn, r.role or "", r.text or "")):
            messages = [*past, (r.role, r.text)]
            yield Row(case_id=f"{key[0]}:{r.turn}", seen=n, messages=[Row(role=a, content=b) for a, b in messages])
            past, n = messages[-self.keep :] if self.keep else [], n + 1
        self.seen.update((n,))
        if past:
            self.last.put(past)
        if self.by_event_time:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def with_history(turns: DataFrame, keep: int, idle_ms: int | None = None, time_col: str | None = None, delay: str = "1 hour") -> DataFrame:
    """A case for each turn of a stream: case_id (conversation:turn), seen (messages before it), messages (the last ``keep`` before it, and itself).

    With ``idle_ms`` the state of an idle conversation goes: by the watermark of a time column if there is one, else by the clock; a stream that
    lives by the clock
    does not end by itself, even where it is asked for what is available now.
    """
    rows = turns.withWatermark(time_col, delay) if time_col else turns
    mode = "None" if idle_ms is None else "EventTime" if time_col else "ProcessingTime"
    return rows.groupBy("conv_id").transformWithState(History(keep, idle_ms, mode == "EventTime"), _CASES, "Append", mode)


def write_references(turns: DataFrame, path: str, checkpoint: str, keep: int, options: Options = Options(), **state):
    """The reference rule on every turn of a stream, with its conversation's last ``keep`` messages as history; a replayed batch replaces itself."""

    def batch(df: DataFrame, batch_id: int) -> None:
        cases = cut(report.complete(df), "turns")  # a stateful batch must be computed once
        found = reference.rule(cases, options).drop("message_index").join(cases.select("case_id", F.col("seen").cast("int").alias("message_index")), "case_id")
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        drop(cases)

    return with_history(turns, keep, **state).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
