"""Best-fit packing of token ids into sequences of one length, by linear grouping.

Texts longer than a sequence are cut into pieces of its full length, the first of which may be shorter. What is left
to decide depends on lengths alone, and there are no more distinct lengths than a sequence has tokens. So the plan is
made on the driver from one count for each length, whatever the corpus:

1. large lengths are put in order and parted into groups of equal cardinality, each rounded up to its greatest;
2. configurations of these few sizes are optimised by column generation, and whole multiples of them are taken;
3. the lengths that a group really has take its places in the configurations, as runs of equal lengths, but for the
   last place of each, which is filled in the next step;
4. what has no place yet, and the small lengths, go to the sequences with the least room that fits.

Tasks number their pieces within each length, sums over tasks turn these numbers into ranks, and a rank's place is
looked up in the plan's runs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.byte_bpe import BLOCK, blocks, vocabulary
from lectern.llm.common import small_batches, texts_of, utf8
from lectern.session import materialise

#: Groups that the large lengths are parted into.
GROUPS = 256
#: The share of a sequence up to which a length is small.
SMALL = 1 / 4
#: The share by which the number of sequences of rounded lengths may exceed the least one.
GAP = 1e-4
#: Exchanges of the column generation at most. Each step has a whole packing, so an early end costs room, never pieces.
EXCHANGES = 20_000
PIECES = "doc_id {id}, piece int, start long, length int, ids_crc32 long, part int, nth long{ids}"
#: Lengths stand in the upper bits of a run's key, ranks below.
_RANK_BITS = 40


class Pattern(NamedTuple):
    """So many sequences that hold these lengths, in this order."""

    times: int
    lengths: tuple[int, ...]


def grouped(counts: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count) in falling order, cut into `groups` groups of equal cardinality (the last may be smaller)."""
    each = max(1, -(-sum(counts.values()) // groups))
    out, room = [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append([])
                room = each
            n = min(left, room)
            out[-1].append((length, n))
            left, room = left - n, room - n
    return out


def _worthy_configurations(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The greatest worth of a multiset of sizes within the capacity, and as columns the worthiest that hold each size."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes)
    small_first, fitting = sizes[order], np.searchsorted(np.sort(sizes), np.arange(capacity + 1), "right")
    priced = worth[order]
    for room in range(int(small_first[0]), capacity + 1):
        n = fitting[room]
        gains = best[room - small_first[:n]] + priced[:n]
        k = gains.argmax()
        best[room] = best[room - 1]
        if gains[k] > best[room]:
            best[room], taken[room] = gains[k], order[k]
    columns = np.eye(len(sizes))
    for k, size in enumerate(sizes):
        room = capacity - int(size)
        while room > 0:
            if taken[room] < 0:
                room -= 1
                continue
            columns[taken[room], k] += 1
            room -= int(sizes[taken[room]])
    return float(best[capacity]), columns


def configurations(sizes: list[int], demand: list[int], capacity: int, exchanges: int = EXCHANGES) -> list[tuple[float, np.ndarray]]:
    """Configurations of the sizes and how often each is used (a fraction), so that together they meet the demand.

    A simplex basis takes in the configuration of a pool that is worth most by the present prices; when none is left
    there, the worthiest of all are put into the pool. It ends when no configuration is worth over 1 + `GAP`: then
    the number of sequences is at most 1 + `GAP` times the least one.
    """
    size, need = np.array(sizes, np.int64), np.array(demand, float)
    basis = np.diag(capacity // size).astype(float)
    inverse, amounts, pool = np.linalg.inv(basis), need / np.diag(basis), np.empty((len(size), 0))
    for step in range(exchanges):
        prices = inverse.sum(axis=0)
        values = prices @ pool
        if not values.size or values.max() <= 1 + GAP:
            worth, columns = _worthy_configurations(size, prices, capacity)
            if worth <= 1 + GAP:
                break
            pool = np.unique(np.concatenate([pool[:, values > 1 - 10 * GAP], columns], axis=1), axis=1)
            values = prices @ pool
        column = pool[:, values.argmax()]
        change = inverse @ column
        rises = change > 1e-9
        ratios = np.full(len(size), np.inf)
        ratios[rises] = amounts[rises] / change[rises]
        leaves = int(ratios.argmin())
        basis[:, leaves] = column
        if step % 128 == 127:
            inverse = np.linalg.inv(basis)  # drops the error that updates gather
        else:
            row = inverse[leaves] / change[leaves]
            inverse -= np.outer(change, row)
            inverse[leaves] = row
        amounts = np.maximum(inverse @ need, 0)
    return [(float(x), basis[:, k].round().astype(np.int64)) for k, x in enumerate(np.maximum(np.linalg.solve(basis, need), 0))]


class _Runs:
    """Lengths of a group, handed out as runs."""

    def __init__(self, runs: list[tuple[int, int]]):
        self.runs = list(reversed(runs))

    def take(self, n: int) -> list[tuple[int, int]]:
        out = []
        while n:
            length, have = self.runs.pop()
            used = min(n, have)
            if have > used:
                self.runs.append((length, have - used))
            out.append((length, used))
            n -= used
        return out


def _merged(places: list[list[tuple[int, int]]]) -> list[Pattern]:
    """Runs of each place of a configuration, all of one total, as patterns of whole sequences."""
    out, at = [], [0] * len(places)
    left = [runs[0][1] for runs in places]
    while at[0] < len(places[0]):
        n = min(left)
        out.append(Pattern(n, tuple(runs[k][0] for runs, k in zip(places, at, strict=True))))
        for i, runs in enumerate(places):
            left[i] -= n
            if not left[i]:
                at[i] += 1
                left[i] = runs[at[i]][1] if at[i] < len(runs) else 0
    return out


def best_fit(patterns: list[Pattern], counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Put the lengths, greatest first, into the sequences with the least room that fits; new ones where none does.

    Sequences of one pattern are treated as one run, so the work does not grow with their number.
    """
    rooms: dict[int, list[Pattern]] = {}
    for p in patterns:
        rooms.setdefault(capacity - sum(p.lengths), []).append(p)

    def put(p: Pattern, length: int, left: int) -> int:
        room = capacity - sum(p.lengths)
        each = room // length
        full = min(p.times, left // each)
        parts = [(full, each)]
        if full < p.times and left - full * each:
            parts.append((1, left - full * each))
        used = sum(n for n, _ in parts)
        for n, k in [*parts, (p.times - used, 0)]:
            if n:
                rooms.setdefault(room - k * length, []).append(Pattern(n, p.lengths + (length,) * k))
        return left - sum(n * k for n, k in parts)

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left and (room := min((r for r, ps in rooms.items() if r >= length and ps), default=None)) is not None:
            left = put(rooms[room].pop(), length, left)
        if left:
            put(Pattern(-(-left // (capacity // length)), ()), length, left)
    return [p for ps in rooms.values() for p in ps if p.lengths]


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS, small: float = SMALL) -> list[Pattern]:
    """Patterns that hold every length as often as it is counted. Lengths are from 1 to `capacity`."""
    counts = {k: n for k, n in counts.items() if n}
    full = [Pattern(counts.pop(capacity), (capacity,))] if capacity in counts else []
    large = {k: n for k, n in counts.items() if k > capacity * small}
    rest = {k: n for k, n in counts.items() if k not in large}
    runs = grouped(large, groups)
    by_size: dict[int, list[tuple[int, int]]] = {}
    for group in runs:
        by_size.setdefault(group[0][0], []).extend(group)
    patterns: list[Pattern] = []
    if by_size:
        sizes = sorted(by_size, reverse=True)
        sources = [_Runs(by_size[s]) for s in sizes]
        for amount, configuration in configurations(sizes, [sum(n for _, n in by_size[s]) for s in sizes], capacity):
            times = int(amount + 1e-9)
            have = [sum(n for _, n in s.runs) for s in sources]
            times = min([times, *(have[k] // c for k, c in enumerate(configuration) if c)])
            if times:
                for p in _merged([sources[k].take(times) for k, c in enumerate(configuration) for _ in range(c)]):
                    patterns.append(Pattern(p.times, p.lengths[:-1]))
                    rest[p.lengths[-1]] = rest.get(p.lengths[-1], 0) + p.times
        for source in sources:
            for length, n in source.runs:
                rest[length] = rest.get(length, 0) + n
    return full + best_fit(patterns, rest, capacity)


def _lookup(patterns: list[Pattern]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the plan in the order of (length, first rank): key, number of the first sequence, place in it."""
    runs, used, sequence = [], {}, 0
    for p in patterns:
        place = 0
        for length in p.lengths:
            rank = used.get(length, 0)
            runs.append(((length << _RANK_BITS) + rank, sequence, place))
            used[length] = rank + p.times
            place += length
        sequence += p.times
    return tuple(np.array(sorted(runs), np.int64).reshape(-1, 3).T)


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """The pieces of every whole text: its ids with `end_id` behind, cut to `capacity`; the first piece may be shorter.

    part and nth say which task made a piece and how many of its length that task made before.
    """
    small_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), {}
        encoder, end = vocabulary(path), end_id.to_bytes(4, "little")

        def rows(ids: list[bytes], keys: pa.Array) -> pa.RecordBatch:
            row, number, start, length, crc, nth, kept = [], [], [], [], [], [], []
            for k, text in enumerate(ids):
                n, at = len(text) >> 2, 0
                size = n % capacity or capacity
                while at < n:
                    cut = text[at << 2 : (at + size) << 2]
                    rank = made.get(size, 0)
                    made[size] = rank + 1
                    row.append(k)
                    number.append((at + capacity - 1) // capacity)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(cut))
                    nth.append(rank)
                    if keep_ids:
                        kept.append(np.frombuffer(cut, "<i4"))
                    at, size = at + size, capacity
            columns = {
                "doc_id": keys.take(pa.array(row, pa.int64())), "piece": pa.array(number, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int32()),
                "ids_crc32": pa.array(crc, pa.int64()), "part": pa.array(np.full(len(row), part, np.int32)), "nth": pa.array(nth, pa.int64()),
            }
            if keep_ids:
                columns["ids"] = pa.array(kept, pa.list_(pa.int32()))
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            held, size, begin = [], 0, 0
            texts = list(utf8(batch.column("text")))
            for k, text in enumerate(texts):
                held.append(text)
                size += len(text)
                if size >= BLOCK or k == len(texts) - 1:
                    parted = [blocks(t) for t in held]
                    found, counts = [], np.array([len(p) for p in parted])
                    if len(held) == 1:
                        found = [b"".join(encoder.encode([b])[0].tobytes() for b in parted[0])]
                    else:
                        flat, n = encoder.encode([b for p in parted for b in p])
                        upto = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])]
                        found = [flat[a:b].tobytes() for a, b in zip(upto[:-1], upto[1:], strict=True)]
                    yield rows([x + end for x in found], batch.column(0).slice(begin, len(held)))
                    held, size, begin = [], 0, k + 1

    source = texts_of(docs, id_col, text=text_col)
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(encode, PIECES.format(id=kind, ids=", ids array<int>" if keep_ids else ""))


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 1024, groups: int = GROUPS, small: float = SMALL, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Pack the ids of all texts into sequences of at most `capacity` ids.

    One row a piece: `id_col`, piece (from 0), start (ids of its text before it), length, ids_crc32 (little-endian
    unsigned 32-bit ids), sequence_id, offset (place in the sequence, gapless from 0), and ids with `keep_ids`.
    A null text is empty, and an empty text is its end id alone; null and repeated ids are texts of their own; other
    columns are ignored; an empty table gives no rows. `capacity` is 4096 at most.
    """
    if not 1 <= capacity <= 4096:
        raise ValueError("capacity is from 1 to 4096")
    found = materialise(pieces(docs, path, end_id, capacity, id_col, text_col, keep_ids), "pieces")
    sizes = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    # One row for each length, so `capacity` rows at most.
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    key, sequence, place = _lookup(plan(counts, capacity, groups, small))
    # One row for each task and length; a window has one row for each task.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            wanted = (batch.column("length").to_numpy().astype(np.int64) << _RANK_BITS) + rank
            run = np.searchsorted(key, wanted, "right") - 1
            out = {n: batch.column(n) for n in batch.schema.names if n != "rank"}
            yield pa.RecordBatch.from_pydict(out | {"sequence_id": pa.array(sequence[run] + wanted - key[run]), "offset": pa.array(place[run])})

    ranked = found.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).withColumn("length", F.col("length").cast("long"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    schema = ", ".join(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.select(*columns, "rank").mapInArrow(look_up, f"{schema}, sequence_id long, offset long").withColumnRenamed("doc_id", id_col)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """sequence_id, ids, and the texts that lie in it as (id, offset, length), from `pack` with ids kept."""
    part = F.struct("offset", F.col(id_col).alias("id"), "length", "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))  # no more than `capacity` parts
    return rows.select("sequence_id", F.flatten("parts.ids").alias("ids"), F.transform("parts", lambda p: p.dropFields("ids")).alias("texts"))
