"""States of keys over time: calls in the order of their times, and timers that end a rest or a penalty by themselves.

What a call did is decided only when the watermark has passed it, so calls that come late, but not later than the
watermark allows, take their place, and any split of the input into batches gives the same rows as `history` does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.usage import ALPHA
from lectern.streaming.ingest import MOST_REST, REST

#: Seconds for which a key that failed stands behind all others.
PENALTY = 600
STATES = "key string, at timestamp, event string, calls long, failures long, latency double, rest_until timestamp, penalty_until timestamp, model string"
_START = {"calls": 0, "failures": 0, "latency": 0.0, "rest": 0, "penalty": 0, "model": ""}


def _row(key: str, at: int, event: str, s: dict) -> tuple:
    time = lambda us: pd.Timestamp(us, unit="us") if us else pd.NaT
    return key, time(at), event, s["calls"], s["failures"], s["latency"], time(s["rest"]), time(s["penalty"]), s["model"]


def _due(key: str, s: dict, until: int) -> Iterator[tuple]:
    """Rests and penalties that are over by `until`, in the order of their ends; a rest before a penalty."""
    for at, name, event in sorted((s[n], n, e) for n, e in (("rest", "rested"), ("penalty", "clear")) if 0 < s[n] <= until):
        s[name] = 0
        yield _row(key, at, event, s)


def _called(key: str, s: dict, call: tuple, alpha: float) -> Iterator[tuple]:
    """What a call (time, model, ok, ms) does to a key's state, after what was due before it."""
    at, model, ok, ms = call
    yield from _due(key, s, at)
    s["calls"] += 1
    if ok:
        # A success ends rest and penalty, and its model is asked first from now on.
        s |= {"failures": 0, "rest": 0, "penalty": 0, "model": model, "latency": ms if not s["latency"] else alpha * ms + (1 - alpha) * s["latency"]}
    else:
        s["failures"] += 1
        s |= {"rest": at + 1_000_000 * min(MOST_REST, REST * 2 ** min(s["failures"] - 1, 20)), "penalty": at + 1_000_000 * PENALTY}
    yield _row(key, at, "call", s)


def _calls(batch: pd.DataFrame) -> list[list]:
    micros = batch["ts"].to_numpy("datetime64[us]").astype("int64")
    return [[int(t), m or "", bool(ok), float(ms or 0)] for t, m, ok, ms in zip(micros, batch["model"], batch["ok"].fillna(False), batch["ms"].fillna(0.0))]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in STATES.split(", ")])
    return out.astype({c: "datetime64[us]" for c in ("at", "rest_until", "penalty_until")})


def key_events(calls: DataFrame, late: str = "10 minutes", alpha: float = ALPHA) -> DataFrame:
    """A stream of each key's states (`STATES`): after each of its calls (ts, key, model, ok, ms), and when a rest or a penalty ends.

    Calls of one time are taken in the order of model, failures first. Calls later than `late` are dropped. The state
    holds the calls that the watermark has not passed yet, and nothing else that grows.
    """

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waiting = (json.loads(x) for x in state.get) if state.exists else (dict(_START), [])
        if not state.hasTimedOut:
            for batch in batches:
                waiting += _calls(batch)
        mark, out = state.getCurrentWatermarkMs() * 1000, []
        ready = sorted((c for c in waiting if c[0] <= mark), key=lambda c: (c[0], c[1], c[2], c[3]))
        for call in ready:
            out += _called(key[0], held, call, alpha)
        out += _due(key[0], held, mark)
        waiting = [c for c in waiting if c[0] > mark]
        state.update((json.dumps(held), json.dumps(waiting)))
        if soon := [c[0] for c in waiting] + [held[n] for n in ("rest", "penalty") if held[n]]:
            state.setTimeoutTimestamp(max(min(soon) // 1000, mark // 1000 + 1))
        if out:
            yield _frame(out)

    marked = calls.select("key", "ts", "model", "ok", F.col("ms").cast("double").alias("ms")).filter("key is not null and ts is not null").withWatermark("ts", late)
    return marked.groupBy("key").applyInPandasWithState(step, STATES, "held string, waiting string", "append", GroupStateTimeout.EventTimeTimeout)


def history(calls: DataFrame, until: str, alpha: float = ALPHA) -> DataFrame:
    """The same rows from a table of calls, as of the time `until`. A key's calls pass a task in order, and are never held together."""
    end = F.lit(until).cast("timestamp")
    ordered = calls.select("key", "ts", "model", "ok", F.col("ms").cast("double").alias("ms")).filter(F.col("key").isNotNull() & (F.col("ts") <= end))
    # A row without a call closes each key, so that what is due by then comes out.
    closing = ordered.select("key").distinct().select("key", end.alias("ts"), F.lit(None).cast("string").alias("model"), F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("double").alias("ms"), F.lit(1).alias("last"))
    both = ordered.withColumn("last", F.lit(0)).union(closing).withColumn("model", F.when(F.col("last") == 0, F.coalesce("model", F.lit("")))).withColumn("ok", F.coalesce("ok", F.lit(False)))

    def replayed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, {}
        for batch in batches:
            out = []
            for k, call, last in zip(batch["key"], _calls(batch), batch["last"]):
                if k != key:
                    key, held = k, dict(_START)
                out += _due(k, held, call[0]) if last else _called(k, held, tuple(call), alpha)
            if out:
                yield _frame(out)

    return both.repartition("key").sortWithinPartitions("key", "last", "ts", "model", "ok", "ms").mapInPandas(replayed, STATES)
