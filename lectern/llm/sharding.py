"""Sharding by sampled splitters.

Records are ordered by (hash of the text, document id, salt), so equal texts lie side by side; the salt is a hash
of a row number and orders rows that are equal otherwise. A size-weighted sample of the keys gives quantile
splitters, the splitters cut the key space into fine ranges, and every record goes to its range. A range that
holds more rows than `RANGE_ROWS` is cut again at splitters sampled inside it, until none does, so no task sorts
more whatever the corpus and however often one row is repeated. Exact sums per range then place each record on
the byte axis, and a shard is a stretch of that axis. A run of equal texts that is too big for its place (a hot
group) is subdivided.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import discard, materialise

#: Expected number of sampled keys that reach the driver for the first splitters, whatever the input size.
SAMPLE = 8192
#: Fine ranges per shard at first.
RANGES_PER_SHARD = 16
#: Rows that one range may hold; a fuller one is cut again.
RANGE_ROWS = 1 << 20
#: Keys sampled for each piece that an overfull range is to have. So the driver sees one key in 2^15 of a huge input.
SAMPLE_PER_PIECE = 16
#: A group of equal texts of up to this share of a shard is kept together.
GROUP_SHARE = 1 / 64
_KEY = ["h", "id", "salt"]
_NO_ID = -(1 << 63)


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("id"),
        F.xxhash64(text).alias("h"),
        F.xxhash64(F.monotonically_increasing_id()).alias("salt"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
    )


def _draw(seed: int) -> Column:
    """A number in [0, 1) from the whole key, so that repeated rows are drawn one by one."""
    return F.pmod(F.xxhash64(*_KEY, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def _sampled(rows: list) -> np.ndarray:
    """Sampled keys in order, one row each."""
    return np.array(sorted((r["h"], r["id"], r["salt"]) for r in rows), np.int64).reshape(-1, 3)


def splitters(keys: DataFrame, count: int, sample: int = SAMPLE) -> np.ndarray:
    """Up to `count` - 1 splitters, one key (h, id, salt) a row: quantiles of a sample in which a key's chance is in proportion to its size."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    drawn = keys.filter(_draw(7) * float(total) < F.col("size") * float(sample)).select("h", F.coalesce("id", F.lit(_NO_ID)).alias("id"), "salt", "size")
    rows = sorted(drawn.collect()) if total else []
    if not rows:
        return _sampled([])
    weight = np.maximum(np.array([r["size"] for r in rows], float), total / sample)
    at = np.searchsorted(np.cumsum(weight), np.linspace(0, weight.sum(), count + 1)[1:-1])
    return np.unique(_sampled([rows[i] for i in np.minimum(at, len(rows) - 1)]), axis=0)


def _range_of(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The number of splitters at or before each key."""
    both = np.concatenate([bounds, keys])
    order = np.lexsort(both.T[::-1])  # stable, so a splitter comes before the keys equal to it
    is_bound = order < len(bounds)
    out = np.empty(len(both), np.int32)
    out[order] = np.cumsum(is_bound)
    return out[len(bounds) :]


def _with_range(keys: DataFrame, bounds: np.ndarray) -> DataFrame:
    @F.pandas_udf("int")
    def fine(h: pd.Series, ident: pd.Series, salt: pd.Series) -> pd.Series:
        return pd.Series(_range_of(np.stack([x.to_numpy(np.int64) for x in (h, ident, salt)], 1), bounds))

    return keys.withColumn("fine", fine("h", F.coalesce("id", F.lit(_NO_ID)), "salt"))


def ranges(keys: DataFrame, count: int, most: int = RANGE_ROWS) -> DataFrame:
    """`keys` with fine, the number of its range in key order; no range holds more than `most` rows (at least 1)."""
    bounds, seed = splitters(keys, count), 8
    ranged = materialise(_with_range(keys, bounds), "shard-keys")
    while True:
        # One row for each overfull range, so rows / `most` at most.
        full = {r["fine"]: r["n"] for r in ranged.groupBy("fine").agg(F.count("*").alias("n")).filter(F.col("n") > most).collect()}
        if not full:
            return ranged
        pieces = {k: -(-2 * n // most) for k, n in full.items()}
        chances = ranged.sparkSession.createDataFrame([(k, SAMPLE_PER_PIECE * pieces[k] / n) for k, n in full.items()], "fine int, chance double")
        drawn = ranged.join(F.broadcast(chances), "fine").filter(_draw(seed) < F.col("chance")).select("fine", "h", F.coalesce("id", F.lit(_NO_ID)).alias("id"), "salt").collect()
        inside: dict[int, list] = {}
        for r in drawn:
            inside.setdefault(r["fine"], []).append(r)
        cuts = [_sampled(rows)[np.arange(1, pieces[k]) * len(rows) // pieces[k]] for k, rows in inside.items()]
        bounds, seed = np.unique(np.concatenate([bounds, *cuts]), axis=0), seed + 1
        before, ranged = ranged, materialise(_with_range(ranged.drop("fine"), bounds), "shard-keys")
        discard(before)


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", range_rows: int = RANGE_ROWS) -> DataFrame:
    """Assign every record to one of `shards` shards of near equal bytes (UTF-8 length of the text plus 1).

    Returns one row per record: `id_col`, size, text_crc32, shard, slot. Within a shard, slots run from 0
    without gaps in key order. Equal texts share a shard unless their group exceeds `GROUP_SHARE` of one.
    A null text counts as empty; null ids sort first; repeated rows each get a slot of their own; an empty
    table gives no rows; other columns are ignored. No text is shuffled, only keys are.
    """
    keys = _keys(docs, id_col, text_col)
    return _place(ranges(keys, shards * RANGES_PER_SHARD, range_rows), shards).withColumnRenamed("id", id_col)


def _place(ranged: DataFrame, shards: int) -> DataFrame:
    # One row per range, and ranges hold up to `RANGE_ROWS` rows each, so this window is small: 25,000 rows at 2.5e10 documents.
    sums = ranged.groupBy("fine").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("fine").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        "fine", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte_base"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("row_base"), F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("fine").orderBy(*_KEY)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ranged.withColumn("rn", F.row_number().over(inside)).withColumn("cum", F.sum("size").over(upto))
        .join(F.broadcast(bases), "fine")
        .withColumn("rank", F.col("row_base") + F.col("rn") - 1).withColumn("end", F.col("byte_base") + F.col("cum"))
    )
    placed = materialise(placed.select(*_KEY, "size", "text_crc32", "total", "rank", "end"), "shard-ends")
    # A group of equal texts may span ranges, so its extent comes from partial aggregates, not from a window on it.
    # Hot groups stay out of the join: there are shards / `GROUP_SHARE` of them at most, so their hashes are broadcast.
    groups = ranged.groupBy("h").agg(F.count("*").alias("copies"), F.sum("size").alias("group_bytes")).filter("copies > 1")
    total = F.broadcast(sums.agg(F.sum("bytes").alias("all_bytes")))
    groups = groups.join(total).withColumn("together", F.col("group_bytes") * F.lit(shards) <= F.col("all_bytes") * F.lit(GROUP_SHARE))
    hot = groups.filter("not together").select("h", F.lit(True).alias("hot"))
    marked = placed.join(F.broadcast(hot), "h", "left")
    cold = marked.filter("hot is null")
    starts = cold.groupBy("h").agg(F.min(F.col("end") - F.col("size")).alias("group_start"))
    small = groups.filter("together").select("h", "group_bytes").join(starts, "h")
    out = cold.join(small, "h", "left").unionByName(marked.filter("hot"), allowMissingColumns=True)
    middle = F.coalesce(F.col("group_start") + F.col("group_bytes") / 2, F.col("end") - F.col("size") / 2)
    out = out.withColumn("shard", F.least(F.floor(middle * shards / F.col("total")), F.lit(shards - 1)).cast("int"))
    out = materialise(out.select("id", "size", "text_crc32", "shard", "rank"), "shard-places")
    firsts = out.groupBy("shard").agg(F.min("rank").alias("first"))
    return out.join(F.broadcast(firsts), "shard").select("id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first")).alias("slot"))
