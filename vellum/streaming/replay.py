"""Structured Streaming over recorded events: windows with a watermark, and replay of trajectories under limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema, pattern: str = "events*.parquet") -> DataFrame:
    """Parquet files of a folder as a stream. Timestamps without zone become UTC ones, as watermarks need them."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(rows: DataFrame, late: str, width: str) -> DataFrame:
    """Counts and sums by window and type; events later than ``late`` behind the newest are dropped."""
    counted = rows.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(rows: DataFrame, late: str, gap: str) -> DataFrame:
    counted = rows.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


TURNS = "sample string, turn long, status string, calls long, tokens long"


def limits(max_turns: int, max_calls: int, max_tokens: int, forced_answer: bool):
    """The step of a replayed trajectory: what a turn's status is, given what came before.

    A trajectory ends on an answer, on its last turn, when its tokens are used up, or when a call passes the limit.
    With forced_answer the turn after the last call may still answer; otherwise that call ends it.
    """

    def step(state: tuple[int, int, int, bool], is_call: bool, tokens: int) -> tuple[tuple[int, int, int, bool], str]:
        turns, calls, used, over = state
        if over:
            return state, "ignored"
        turns, used, calls = turns + 1, used + tokens, calls + is_call
        if used > max_tokens:
            status = "token_budget"
        elif not is_call:
            status = "answered"
        elif calls > max_calls or (calls == max_calls and not forced_answer):
            status = "call_limit"
        elif turns >= max_turns:
            status = "turn_limit"
        else:
            status = "running"
        return (turns, calls, used, status != "running"), status

    return step


def replay(rows: DataFrame, max_turns: int = 9, max_calls: int = 8, max_tokens: int = 10_240, forced_answer: bool = True) -> DataFrame:
    """A stream of turns (sample, turn, is_call, tokens) with each turn's status; state is a few numbers a sample."""
    step = limits(max_turns, max_calls, max_tokens, forced_answer)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (0, 0, 0, False)
        turns = pd.concat(list(batches)).sort_values("turn")
        out = []
        for turn, is_call, tokens in zip(turns["turn"], turns["is_call"], turns["tokens"], strict=True):
            now, status = step(tuple(now), bool(is_call), int(tokens))
            out.append((key[0], int(turn), status, now[1], now[2]))
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=["sample", "turn", "status", "calls", "tokens"])

    return rows.groupBy("sample").applyInPandasWithState(run, TURNS, "turns long, calls long, used long, over boolean", "append", GroupStateTimeout.NoTimeout)


def rebatch_each(target: str, keep, size: int):
    """A foreachBatch function: the rows that keep() lets through, in full batches; the rest waits in a table beside them.

    A micro-batch that is run again writes the same folder again, and reads what waited before it.
    """

    def run(rows: DataFrame, epoch: int) -> None:
        spark = rows.sparkSession
        kept = rows.where(keep).select("event_id")
        if epoch:
            kept = kept.unionByName(spark.read.parquet(f"{target}/waiting/epoch={epoch - 1}"))
        n = kept.count()
        ordered = kept.orderBy("event_id")
        full = n - n % size
        ordered.limit(full).write.mode("overwrite").parquet(f"{target}/batches/epoch={epoch}")
        ordered.offset(full).write.mode("overwrite").parquet(f"{target}/waiting/epoch={epoch}")

    return run
