"""The usage report: period filter, totals, day by series chart, daily gauge and running latency.

Days are those of the Pacific time zone, as quotas count them. The time of reference is a parameter, so results
repeat.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZONE = "America/Los_Angeles"
# The periods in hours, and the daily caps of a key and model.
PERIODS = {"24h": 24, "7d": 168, "30d": 720}
DAY_LIMIT = 20
MODEL_LIMITS = {"gemini-3.5-flash-lite": 500}
#: Weight of a new value in the running latency.
ALPHA = 0.3
#: A weight that changes no double.
NEGLIGIBLE = 1e-30


HISTORY = "id long, ts timestamp_ntz, model string, key_name string, key_masked string, source string, tokens_in long, tokens_out long, ms long, ok boolean"


def history(spark: SparkSession, path: str) -> DataFrame:
    """The calls that a JSON array, or JSON lines, hold; what is missing or no JSON gives no rows, broken rows are left out."""
    from lectern.sources.files import read_records

    return read_records(spark, path, HISTORY).filter("ts is not null")


def zone_day(ts: Column, zone: str = ZONE) -> Column:
    """The date of a UTC time in a zone."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), zone))


def period_start(now: Column, days: int) -> Column:
    """The first day of a period of so many days that ends with the day of `now`."""
    return F.date_sub(F.to_date(now), days - 1)


def next_midnight(ts: Column, zone: str = ZONE) -> Column:
    """The UTC time at which the zone's day of `ts` ends; 23 or 25 hours long where clocks change."""
    return F.to_utc_timestamp(F.date_add(zone_day(ts, zone), 1).cast("timestamp"), zone)


def in_period(usage: DataFrame, period: str, now: str) -> DataFrame:
    """Rows of the last hours before `now`; an unknown period keeps all. The bound reaches the scan."""
    hours = PERIODS.get(period)
    kind = usage.schema["ts"].dataType
    return usage if hours is None else usage.filter(F.col("ts") >= (F.lit(now).cast(kind) - F.expr(f"interval {hours} hours")).cast(kind))


def without_lane_noise(usage: DataFrame, lane: str = "9router") -> DataFrame:
    """Leave out the routing lane's own pipeline calls."""
    noise = (F.coalesce("key_name", F.lit("")) == lane) & (source_of(F.col("source")) == "pipeline")
    return usage.filter(~noise)


def source_of(source: Column) -> Column:
    return F.coalesce(F.nullif(source, F.lit("")), F.lit("pipeline"))


def totals(usage: DataFrame) -> DataFrame:
    """One row: calls, errors (a missing flag is one), tokens in and out, milliseconds."""
    return usage.agg(
        F.count("*").alias("calls"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("errors"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"), F.round(F.coalesce(F.sum("ms"), F.lit(0)), 1).alias("ms"),
    )


def tokens() -> Column:
    return F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))


def by_source(usage: DataFrame) -> DataFrame:
    """(source, calls, tokens); a blank source is the pipeline."""
    return usage.groupBy(source_of(F.col("source")).alias("source")).agg(F.count("*").alias("calls"), F.sum(tokens()).alias("tokens"))


def series_label(group: str) -> Column:
    """What one series stands for: the model, or the key by name, mask or 'unknown'."""
    names = ["model"] if group != "key" else ["key_name", "key_masked"]
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names], F.lit("unknown"))


def chart(usage: DataFrame, group: str = "model", y: str = "calls") -> DataFrame:
    """(day, place, series, value): each day that has rows crossed with each series, absent cells 0.

    Series are placed by falling total, then name. `y` is calls, tokens, sec or avg_sec (rounded to 0.1); anything
    else counts as calls. The cells are the aggregate, so what is crossed and ranked is days by series in number.
    """
    value = {"tokens": tokens().cast("double"), "sec": F.coalesce("ms", F.lit(0)) / 1000.0, "avg_sec": F.coalesce("ms", F.lit(0)) / 1000.0}.get(y, F.lit(1.0))
    cells = usage.groupBy(zone_day(F.col("ts")).alias("day"), series_label(group).alias("series")).agg(F.sum(value).alias("total"), F.count("*").alias("calls"))
    places = cells.groupBy("series").agg(F.sum("total").alias("of_series"))
    # One row per series.
    places = places.withColumn("place", F.row_number().over(Window.orderBy(F.desc("of_series"), "series"))).drop("of_series")
    # A dense matrix: every day gets the array of all series, so no join multiplies rows of data.
    days = cells.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("series", F.struct("total", "calls")))).alias("cells"))
    all_series = places.agg(F.sort_array(F.collect_list(F.struct("place", "series"))).alias("all"))
    dense = days.join(F.broadcast(all_series)).select("day", "cells", F.explode("all").alias("s"))
    cell = F.try_element_at(F.col("cells"), F.col("s.series"))
    amount = F.round(cell["total"] / cell["calls"], 1) if y == "avg_sec" else cell["total"]
    return dense.select("day", F.col("s.place").alias("place"), F.col("s.series").alias("series"), F.coalesce(amount, F.lit(0.0)).alias("value"))


def model_limits(overrides: str = "") -> dict[str, int]:
    """The daily caps with 'model:limit,model:limit' overrides; bad entries are passed over, a cap is 1 at least."""
    limits = dict(MODEL_LIMITS)
    for name, _, value in (x.partition(":") for x in overrides.split(",")):
        if name.strip() and value.strip().lstrip("-").isdigit():
            limits[name.strip()] = max(1, int(value))
    return limits


def daily_gauge(usage: DataFrame, overrides: str = "", default: int = DAY_LIMIT) -> DataFrame:
    """(day, key, model, used, cap, spent): calls per key and model on each Pacific day against their cap."""
    caps = model_limits(overrides)
    cap = F.coalesce(F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])[F.col("model")], F.lit(default)).cast("long")
    counts = usage.groupBy(zone_day(F.col("ts")).alias("day"), F.col("key_masked").alias("key"), "model").agg(F.count("*").alias("used"))
    return counts.withColumn("cap", cap).withColumn("spent", F.col("used") >= F.col("cap"))


def running_latency(usage: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(model, latency): the exponentially weighted mean of ms in the order of time; 0 counts as not set yet.

    A value's weight falls by (1 - alpha) with each later one, the first value seeds the mean. As many of the newest
    values are taken as it needs for the weight of what lies behind them to be under `NEGLIGIBLE`, so they decide the
    mean to double precision. Each partition keeps no more than these of a model before the shuffle, so a model's
    traffic does not meet in one task.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha is over 0, and 1 at most")
    newest = 1 if alpha == 1 else math.ceil(math.log(NEGLIGIBLE) / math.log1p(-alpha))
    rows = usage.filter("ms is not null and ms > 0")
    rank = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("ts"), F.desc("id")))
    last = rows.select("model", "ts", "id", F.col("ms").cast("double").alias("ms")).withColumn("rank", rank).filter(F.col("rank") <= newest + 1)
    counted = last.groupBy("model").agg(F.max("rank").alias("n"))
    weight = F.when((F.col("rank") == F.col("n")) & (F.col("n") <= newest), F.pow(F.lit(1 - alpha), F.col("rank") - 1)).otherwise(alpha * F.pow(F.lit(1 - alpha), F.col("rank") - 1))
    return last.join(counted, "model").groupBy("model").agg(F.sum(F.col("ms") * weight).alias("latency"))


def last_calls(usage: DataFrame, n: int = 200) -> DataFrame:
    """The newest calls: top-k, with the id to break ties."""
    return usage.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def report(usage: DataFrame, period: str, now: str) -> dict[str, DataFrame]:
    """The whole report: calls, totals, by_source and the two charts."""
    rows = without_lane_noise(in_period(usage, period, now))
    return {"calls": rows, "totals": totals(rows), "by_source": by_source(rows), "by_model": chart(rows, "model"), "by_key": chart(rows, "key")}


def union_of_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the size of each table."""
    return reduce(DataFrame.union, [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()])
