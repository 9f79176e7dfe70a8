"""Stateful operators over streams; each gives what its batch form gives once all input is in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirelake.operators.telemetry import RATE


def _costs(priors: dict[str, tuple[float, float, float]]) -> Callable:
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(parts)).sort_values(["ts", "call_id"])
        latency, success, quality, n = state.get if state.exists else (*priors.get(key[0], (2000.0, 0.5, 0.5)), 0)
        for value, ok, results in zip(calls["latency"], calls["ok"], calls["results"], strict=True):
            latency += RATE * (value - latency)
            success += RATE * (float(ok) - success)
            quality += RATE * (min(results / 10, 1.0) - quality)
            n += 1
        state.update((float(latency), float(success), float(quality), int(n)))
        yield pd.DataFrame({"source": [key[0]], "n": [n], "latency": [latency], "success": [success], "quality": [quality]})

    return step


def average_cost(calls: DataFrame, priors: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Exponential averages of latency, success and quality of each source; the calls of a batch are taken in order of time."""
    out = "source string, n bigint, latency double, success double, quality double"
    return calls.groupBy("source").applyInPandasWithState(_costs(priors), out, "latency double, success double, quality double, n bigint", "update", GroupStateTimeout.NoTimeout)


def _uses(idle_ms: int | None) -> Callable:
    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": [key[0]], "uses": [0], "last_used": [0]})
            return
        uses, last = state.get if state.exists else (0, 0)
        for part in parts:
            uses += len(part)
            last = max(last, int(part["used_us"].max()))
        state.update((int(uses), int(last)))
        if idle_ms is not None:
            state.setTimeoutTimestamp(max(last // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "uses": [uses], "last_used": [last]})

    return step


def popularity(uses: DataFrame, key: str, idle_days: float | None = None, late: str = "0 seconds") -> DataFrame:
    """Uses of each key and the last one in microseconds.

    With `idle_days`, keys that stay idle so long, by the time of the uses, are
    forgotten: they come out once more with no uses, and start anew when used.
    """
    timed = uses.withColumns({"used_us": F.unix_micros("ts"), "key": F.col(key).cast("string")})
    if idle_days is not None:
        timed = timed.withWatermark("ts", late)
    timeout = GroupStateTimeout.NoTimeout if idle_days is None else GroupStateTimeout.EventTimeTimeout
    step = _uses(None if idle_days is None else int(idle_days * 86_400_000))
    return timed.groupBy("key").applyInPandasWithState(step, "key string, uses bigint, last_used bigint", "uses bigint, last_used bigint", "update", timeout)


def stepwise(rows: DataFrame, key: str, step: Callable, start: tuple, state: str, out: str) -> DataFrame:
    """(id, result) of each row (id, ts, and what `step` reads): a state for each key, changed by its rows in order of time.

    `step(state, row)` gives (new state, result); it sees the rows of a batch
    sorted by ts and id.
    """

    def run(_: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        now = held.get if held.exists else start
        taken = pd.concat(list(parts)).sort_values(["ts", "id"])
        ids, results = [], []
        for row in taken.itertuples(index=False):
            now, result = step(now, row)
            ids.append(row.id)
            results.append(result)
        held.update(tuple(now))
        yield pd.DataFrame({"id": ids, "result": results})

    return rows.groupBy(key).applyInPandasWithState(run, f"id bigint, result {out}", state, "append", GroupStateTimeout.NoTimeout)


def _us(row) -> int:
    return row.ts.value // 1000


def cache_levels(accesses: DataFrame, key: str, ttl: tuple[int, int, int], last_expires: bool = False) -> DataFrame:
    """(id, result): the cache level that answers each access, 0 where none does and the entry is stored anew.

    What a slower level answers is stored again in the faster ones. The last
    level forgets only if `last_expires`.
    """
    one, two, three = (s * 1_000_000 for s in ttl)

    def step(state: tuple[int, int, int], row) -> tuple[tuple[int, int, int], int]:
        fast, middle, slow = state
        t = _us(row)
        if t <= fast:
            return state, 1
        if t <= middle:
            return (t + one, middle, slow), 2
        if slow and (not last_expires or t <= slow):
            return (t + one, t + two, slow), 3
        return (t + one, t + two, t + three), 0

    return stepwise(accesses, key, step, (0, 0, 0), "fast bigint, middle bigint, slow bigint", "int")


def cached_errors(calls: DataFrame, key: str, seconds: int) -> DataFrame:
    """(id, result): ok, failed, or suppressed for a call that an error of the last seconds answers."""
    wait = seconds * 1_000_000

    def step(state: tuple[int], row) -> tuple[tuple[int], str]:
        t = _us(row)
        if state[0] and t - state[0] <= wait:
            return state, "suppressed"
        return ((0,), "ok") if row.ok else ((t,), "failed")

    return stepwise(calls, key, step, (0,), "error_at bigint", "string")


def single_flights(calls: DataFrame, key: str, seconds: int) -> DataFrame:
    """(id, result): started, or joined for a call that comes while the one started before is still under way."""
    long = seconds * 1_000_000

    def step(state: tuple[int], row) -> tuple[tuple[int], str]:
        t = _us(row)
        return (state, "joined") if t < state[0] else ((t + long,), "started")

    return stepwise(calls, key, step, (0,), "until bigint", "string")


def ring(reports: DataFrame, key: str, most: int) -> DataFrame:
    """(id, result): for each report the one that leaves the ring of the last `most` for it, -1 while there is room."""

    def step(state: tuple[list], row) -> tuple[tuple[list], int]:
        held = [*state[0], int(row.id)]
        return (held[-most:],), held[0] if len(held) > most else -1

    return stepwise(reports, key, step, ([],), "held array<bigint>", "bigint")


def sampled(points: DataFrame, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """The last point of each service and slice: in append mode once no more late points are awaited, in update mode as far as known."""
    w = points.withWatermark("ts", late).groupBy(F.window("ts", every).alias("w"), "service")
    return w.agg(F.max_by("call_id", F.struct("ts", "call_id")).alias("call_id"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("slice"), "service", "call_id", "n")


def counted(calls: DataFrame) -> DataFrame:
    """Running counters of each service."""
    return calls.groupBy("service").agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("ok")).alias("errors"), F.avg("latency").alias("mean_ms"))


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Everything that the stream gives for the input at hand, as a table; `folder` is shared by the executors."""
    spark = stream.sparkSession
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{folder}/out")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{folder}/out")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")
