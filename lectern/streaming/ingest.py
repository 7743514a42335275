"""Structured Streaming: staged ingest of files, parked writes, gauges and key states."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.replay import Handler, Parked, apply_batch, replay
from lectern.operators.usage import ALPHA, ZONE, zone_day
from lectern.sources.store import Store

#: A key rests for this many seconds times its failures in a row, an hour at most.
REST, MOST_REST = 30, 3600


class Stopped(RuntimeError):
    """Too many batches in a row failed."""


def records(spark: SparkSession, folder: str, schema: str, archive: str | None = None, per_trigger: int = 100) -> DataFrame:
    """A stream of the JSON records of a folder's files; each file comes once, and is archived if a folder is given.

    Files must be put there by a rename, as a file that has been listed is not read again.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.json(folder)


WAITING = "path string, modified timestamp, payload string"


def mature(offered: DataFrame, seconds: float) -> DataFrame:
    """Files (path, modified, payload) once they have not changed for so many seconds, each state of a file once.

    A file that is too young waits in the stream's state until a timer says that it is old enough; if it is offered
    again with a later time, the wait begins anew. A file that came out comes again only with a later time. The
    stream has to run with a trigger that goes on, as timers need batches.
    """
    span = datetime.timedelta(seconds=seconds)

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        newest, payload, out = state.get if state.exists else (0, None, 0)
        if not state.hasTimedOut:
            for batch in batches:
                last = batch.loc[batch["modified"].idxmax()]
                at = int(last["modified"].value // 1000)
                if at >= newest:
                    newest, payload = at, last["payload"]
        now = state.getCurrentProcessingTimeMs() * 1000
        left = newest + span // datetime.timedelta(microseconds=1) - now
        if newest > out and left <= 0:
            out = newest
            yield pd.DataFrame({"path": [key[0]], "modified": pd.to_datetime([newest], unit="us"), "payload": [payload]})
        elif newest > out:
            state.setTimeoutDuration(max(1, -(-left // 1000)))
        state.update((newest, payload if newest > out else None, out))

    held = "newest long, payload string, out long"
    return offered.groupBy("path").applyInPandasWithState(step, WAITING, held, "append", GroupStateTimeout.ProcessingTimeTimeout)


def guarded(write: Callable[[DataFrame, int], None], park: Callable[[DataFrame, int], None], most: int) -> Callable[[DataFrame, int], None]:
    """A batch function that parks what fails to be written and stops the stream after `most` failures in a row."""
    failures = {"n": 0}

    def run(batch: DataFrame, number: int) -> None:
        try:
            write(batch, number)
            failures["n"] = 0
        except Exception as e:  # whatever the sink raises
            failures["n"] += 1
            park(batch, number)
            if failures["n"] >= most:
                raise Stopped(f"{most} batches in a row failed") from e

    return run


def durable(store: Store, parked: Parked, stream: str, steps: Callable[[DataFrame], list[tuple[str, DataFrame]]], handlers: dict[str, Handler], most: int) -> Callable[[DataFrame, int], None]:
    """A batch function that writes each batch of a stream once, in order, whatever fails in between.

    What is parked is written first; while something of the stream stays parked, new batches are parked behind it.
    `most` batches in a row that end parked stop the stream.
    """
    failures = {"n": 0}

    def run(batch: DataFrame, number: int) -> None:
        made = [(op, rows) for op, rows in steps(batch)]
        held = [r for r in replay(store, parked, handlers, 1, {stream}) if r["outcome"] == "held" and r["batch"] != number]
        error: Exception | None = None
        if not held:
            try:
                apply_batch(store, stream, number, made, handlers)
                failures["n"] = 0
                return
            except Exception as e:  # whatever a handler or the storage raises
                error = e
        parked.park(stream, made, number)
        failures["n"] += 1
        if failures["n"] >= most:
            raise Stopped(f"{most} batches in a row failed") from error

    return run


def upsert_into(merge: Callable[[DataFrame, DataFrame], DataFrame], read: Callable[[], DataFrame], publish: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A batch function that publishes the table after each batch's keyed write; a batch that comes twice changes nothing more."""
    return lambda batch, number: publish(merge(read(), batch))


def start(df: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Run a batch function on a stream: every so often, or until all that is there is read. `stop()` ends it between batches."""
    writer = df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def daily_gauge(calls: DataFrame, late: str = "2 days", zone: str = ZONE) -> DataFrame:
    """(day, key, model, used): calls by local day as they come; rows later than `late` are dropped."""
    local = calls.withColumn("local", F.from_utc_timestamp("ts", zone)).withWatermark("local", late)
    return local.groupBy(F.window("local", "1 day").alias("w"), "key", "model").agg(F.count("*").alias("used")).select(F.to_date("w.start").alias("day"), "key", "model", "used")


def live_chart(calls: DataFrame, late: str = "2 days", zone: str = ZONE) -> DataFrame:
    """(day, model, calls, tokens): the usage chart as it grows."""
    local = calls.withColumn("day", zone_day(F.col("ts"), zone)).withWatermark("ts", late)
    return local.groupBy("day", "model").agg(F.count("*").alias("calls"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))


def sliding_counts(calls: DataFrame, hours: int, step: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(from, until, model, calls): calls of each period of so many hours."""
    w = calls.withWatermark("ts", late).groupBy(F.window("ts", f"{hours} hours", step).alias("w"), "model").agg(F.count("*").alias("calls"))
    return w.select(F.col("w.start").alias("from"), F.col("w.end").alias("until"), "model", "calls")


KEY_STATE = "key string, calls long, failures long, latency double, rest_until double, model string"


def key_states(calls: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """The state of each key after each batch of its calls (ts, key, model, ok, ms).

    latency is the running mean of the calls that went well, rest_until the epoch second until which the key rests,
    and model the last one that it served.
    """

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, failures, latency, rest, model = state.get if state.exists else (0, 0, 0.0, 0.0, "")
        rows = pd.concat(batches).sort_values("ts")
        for ts, name, ok, ms in zip(rows["ts"], rows["model"], rows["ok"], rows["ms"]):
            n += 1
            if ok:
                failures, rest, model = 0, 0.0, name
                latency = float(ms) if not latency else alpha * float(ms) + (1 - alpha) * latency
            else:
                failures += 1
                rest = ts.timestamp() + min(MOST_REST, REST * 2 ** (failures - 1))
        state.update((n, failures, latency, rest, model))
        yield pd.DataFrame([(key[0], n, failures, latency, rest, model)], columns=["key", "calls", "failures", "latency", "rest_until", "model"])

    state = "n long, failures long, latency double, rest double, model string"
    return calls.groupBy("key").applyInPandasWithState(step, KEY_STATE, state, "update", GroupStateTimeout.NoTimeout)


def newest_events(events: DataFrame, run: str = "run_id", most: int = 400) -> DataFrame:
    """The newest events of each run; partitions keep no more than these before the shuffle."""
    from pyspark.sql import Window

    return events.withColumn("rank", F.row_number().over(Window.partitionBy(run).orderBy(F.desc("ts"), F.desc("seq")))).filter(F.col("rank") <= most).drop("rank")
