"""Conversation structure repair: the cheapest edits that give a conversation the order of roles `(s?(ua)+)?`.

DuckDB runs a recursive query inside hash-partitioned batches: each recursion advances one turn for all conversations
of a batch and keeps, for each state of the grammar, the least cost and its audit. Nothing meets in one task:

* rows are put in order by a range partitioning, so a conversation may lie over many tasks; every `SEGMENT` rows of
  the order are a segment, and a batch works on segments, from every state in which one may be entered;
* the ways through a segment, at most one for each state before and state after, are then what a turn is one level
  up: the same query advances one segment for all conversations that have several, level by level;
* the ways taken are handed down to the rows, which are joined with their texts.

An insert costs 5 and is never among the cheapest edits: its partner in the pair `ua` can go with it, for 2 at most if
it is a row, and a system row that is left alone goes for 2 more. So the query leaves inserts out, and every way
through a segment has one letter for each row; tests hold it against a search that has them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import small_batches
from lectern.session import materialise

#: Bits of a segment's number of rows: 2^8 rows in one segment, and as many segments in one of the next level.
SEGMENT = 8
#: Rows, or segments, in one DuckDB batch, about; a segment is never cut.
BATCH = 20_000
_BLANK = " \t\n\v\f\r"
#: States of the grammar: nothing yet, system, user, assistant. They are also the codes of the roles, 0 for any other.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_AFTER = {(_START, _SYSTEM), (_START, _USER), (_SYSTEM, _USER), (_USER, _ASSISTANT), (_ASSISTANT, _USER)}
_WAY = "struct<entry:int,leave:int,cost:bigint,audit:string,steps:array<struct<key:bigint,entry:int,leave:int>>>"
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_SEGMENTS = f"conv string, key long, first_pos long, {', '.join(f'{c} long' for c in _COUNTS)}, first_role int, last_role int, min_turn long, max_turn long, ways array<{_WAY}>"


def _moves() -> list[tuple[int, int, int, int, str]]:
    """(kind of row, state, next state, cost, letter); a kind is 4 * role + 2 * (has to go) + is truncated."""
    out = []
    for kind in range(16):
        role, gone, cut = kind >> 2, kind & 2, kind & 1
        for state in range(4):
            out.append((kind, state, state, 2, "D"))
            if not gone:
                if (state, role) in _AFTER:
                    out.append((kind, state, role, 5 * cut, "K"))
                out.append((kind, state, _ASSISTANT if state == _USER else _USER, 1 + 5 * cut, "R"))
    return out


_WALK = """
with recursive path as (
  select seg, entry, entry as state, 0 as i, 0::bigint as cost, '' as audit from entries
  union all
  select seg, entry, state, i, best.c, best.a from (
    select p.seg, p.entry, m.leave as state, p.i + 1 as i, min(struct_pack(c := p.cost + m.cost, a := p.audit || m.letter)) as best
    from path p join turns t on t.seg = p.seg and t.i = p.i join moves m on m.kind = t.kind and m.state = p.state
    group by p.seg, p.entry, m.leave, p.i) x)
select seg, entry, state, cost, audit from path join sizes using (seg) where i = n order by seg, entry, state"""


def _walk(turns: pa.Table, moves: pa.Table, entries: pa.Table, sizes: pa.Table) -> dict[str, list]:
    """The ways through each segment of a batch, by one recursive query."""
    import duckdb

    with duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""}) as con:
        for name, rows in (("turns", turns), ("moves", moves), ("entries", entries), ("sizes", sizes)):
            con.register(name, rows)
        return con.execute(_WALK).to_arrow_table().to_pydict()


def _by_segment(batches: Iterator[pa.RecordBatch], work: Callable[[pa.Table, np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Call `work` with rows of whole groups (conv, group), sorted, and where each group starts."""
    held, size = [], 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size
        rows = pa.Table.from_batches(held).combine_chunks()
        conv = rows.column("conv").combine_chunks().dictionary_encode().indices.to_numpy()
        group = rows.column("group").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (group[1:] != group[:-1])]))
        upto = len(rows) if last else int(starts[-1])
        starts = starts[starts < upto]
        if len(starts):
            yield work(rows.slice(0, upto), np.append(starts, upto))
        held = rows.slice(upto).to_batches()
        size = len(rows) - upto

    for batch in batches:
        if len(batch):
            held.append(batch)
            size += len(batch)
            if size >= BATCH:
                yield from flush(False)
    if held:
        yield from flush(True)


def _entries(open_left: np.ndarray) -> pa.Table:
    """A segment that may continue a conversation is entered from every state, any other at the start."""
    seg = np.concatenate([np.arange(len(open_left)), *[np.flatnonzero(open_left)] * 3])
    entry = np.concatenate([np.zeros(len(open_left), np.int32), *[np.full(int(open_left.sum()), s, np.int32) for s in (1, 2, 3)]])
    return pa.table({"seg": pa.array(seg, pa.int32()), "entry": pa.array(entry, pa.int32())})


def _ways(found: dict[str, list], count: int, steps: Callable[[int, int, str], list] | None = None) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(count)]
    for seg, entry, leave, cost, audit in zip(*(found[c] for c in ("seg", "entry", "state", "cost", "audit")), strict=True):
        out[seg].append({"entry": entry, "leave": leave, "cost": cost, "audit": audit, "steps": steps(seg, entry, audit) if steps else []})
    return out


def _segments(columns: dict[str, list]) -> pa.RecordBatch:
    step = pa.list_(pa.struct([("key", pa.int64()), ("entry", pa.int32()), ("leave", pa.int32())]))
    way = pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("steps", step)])
    kinds = {"conv": pa.string(), "first_role": pa.int32(), "last_role": pa.int32(), "ways": pa.list_(way)}
    names = [c.split()[0] for c in _SEGMENTS.split(", ")[:-1]] + ["ways"]
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds.get(n, pa.int64())) for n in names], names)


def _of_rows(rows: pa.Table, starts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Segments of turns: their counts, and the ways through them."""
    first, number = starts[:-1], np.diff(starts)
    get = {c: rows.column(c).to_numpy() for c in ("pos", "role", "blank", "repeated", "cut")}
    blank, role = get["blank"].astype(bool), get["role"]
    repeated = get["repeated"].astype(bool) & ~blank
    cut = get["cut"].astype(bool) & ~blank & ~repeated
    seg = np.repeat(np.arange(len(first)), number)
    inside = np.concatenate([[False], seg[1:] == seg[:-1]])
    legal = np.isin(4 * np.roll(role, 1) + role, [4 * a + b for a, b in ((1, 2), (2, 3), (3, 2))])
    column = rows.column("turn").combine_chunks()
    known = np.asarray(column.is_valid())
    turn = np.asarray(column.fill_null(0))
    fresh = known & ~(inside & np.roll(known, 1) & (np.roll(turn, 1) == turn))
    some = np.add.reduceat(known, first, dtype=np.int64) > 0
    low, high = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    least, most = (f.reduceat(np.where(known, turn, fill), first) for f, fill in ((np.minimum, high), (np.maximum, low)))
    kinds = 4 * role + 2 * (blank | repeated) + cut
    found = _walk(
        pa.table({"seg": pa.array(seg, pa.int32()), "i": pa.array(np.arange(len(seg)) - np.repeat(first, number), pa.int32()), "kind": pa.array(kinds, pa.int32())}),
        pa.table(dict(zip(("kind", "state", "leave", "cost", "letter"), zip(*_moves(), strict=True), strict=True))),
        _entries(get["pos"][first] & ((1 << bits) - 1) == 0),
        pa.table({"seg": pa.array(np.arange(len(first)), pa.int32()), "n": pa.array(number, pa.int32())}),
    )
    total = {n: np.add.reduceat(x, first, dtype=np.int64) for n, x in (("blank", blank), ("duplicate", repeated), ("truncated", cut), ("illegal", inside & ~legal), ("turns", fresh))}
    return _segments({
        "conv": rows.column("conv").take(pa.array(first)).to_pylist(), "key": rows.column("group").to_numpy()[first], "first_pos": get["pos"][first], **total,
        "first_role": role[first], "last_role": role[starts[1:] - 1], "min_turn": [int(x) if s else None for x, s in zip(least, some)], "max_turn": [int(x) if s else None for x, s in zip(most, some)],
        "ways": _ways(found, len(first)),
    })


def _of_segments(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    """Segments of segments: the ways through each are moves, in the order of their audits."""
    child = rows.drop_columns(["group"]).to_pylist()
    group = rows.column("group").to_numpy()
    turns, moves, ranked = ([], [], []), ([], [], [], [], []), []
    for seg, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        for k in range(a, b):
            for column, x in zip(turns, (seg, k - a, k), strict=True):
                column.append(int(x))
            order = {w: chr(ord("a") + r) for r, w in enumerate(sorted({w["audit"] for w in child[k]["ways"]}))}
            ranked.append({(w["entry"], order[w["audit"]]): w["leave"] for w in child[k]["ways"]})
            for w in child[k]["ways"]:
                for column, x in zip(moves, (k, w["entry"], w["leave"], w["cost"], order[w["audit"]]), strict=True):
                    column.append(int(x) if not isinstance(x, str) else x)

    def steps(seg: int, entry: int, audit: str) -> list[dict]:
        out = []
        for k, letter in enumerate(audit, int(starts[seg])):
            leave = ranked[k][entry, letter]
            out.append({"key": child[k]["key"], "entry": entry, "leave": leave})
            entry = leave
        return out

    int32 = lambda xs: pa.array(xs, pa.int32())
    heads = [child[a] for a in starts[:-1]]
    # A segment of segments may continue a conversation if its first part may, which has ways from every state then.
    opens = np.array([any(w["entry"] for w in c["ways"]) for c in heads])
    found = _walk(
        pa.table(dict(zip(("seg", "i", "kind"), map(int32, turns), strict=True))),
        pa.table({"kind": int32(moves[0]), "state": int32(moves[1]), "leave": int32(moves[2]), "cost": pa.array(moves[3], pa.int64()), "letter": pa.array(moves[4], pa.string())}),
        _entries(opens), pa.table({"seg": int32(range(len(heads))), "n": int32(np.diff(starts))}),
    )
    out: dict[str, list] = {n: [] for n in ("conv", "key", "first_pos", *_COUNTS, "first_role", "last_role", "min_turn", "max_turn")}
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        parts = child[a:b]
        total = {c: sum(p[c] for p in parts) for c in _COUNTS}
        for p, q in zip(parts, parts[1:]):
            total["illegal"] += (p["last_role"], q["first_role"]) not in ((_SYSTEM, _USER), (_USER, _ASSISTANT), (_ASSISTANT, _USER))
            total["turns"] -= p["max_turn"] is not None and p["max_turn"] == q["min_turn"]
        known = [p for p in parts if p["min_turn"] is not None]
        values = {
            "conv": parts[0]["conv"], "key": int(group[a]), "first_pos": parts[0]["first_pos"], **total, "first_role": parts[0]["first_role"], "last_role": parts[-1]["last_role"],
            "min_turn": known[0]["min_turn"] if known else None, "max_turn": known[-1]["max_turn"] if known else None,
        }
        for n, x in values.items():
            out[n].append(x)
    return _segments(out | {"ways": _ways(found, len(heads), steps)})


def _dealt(df: DataFrame, bits: int | Column) -> DataFrame:
    """Rows in hash partitions by conversation and segment, in order."""
    grouped = df.withColumn("group", bits if isinstance(bits, Column) else F.shiftright("key", bits))
    order = "pos" if "pos" in df.columns else "key"
    return grouped.repartition("conv", "group").sortWithinPartitions("conv", "group", order)


def damaged(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, text of the rows after the damage that crc32 of "conv:turn" deals out.

    By remainder 20: 0 drops the row, 1 empties its text, 2 removes full stops, exclamation and question marks,
    3 repeats it, 4 makes it a user's. Nulls count as one space but in turn, which stays.
    """
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    lot = F.pmod(F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col)).cast("binary")), F.lit(20))
    text = F.when(lot == 1, F.lit("")).when(lot == 2, F.translate(space(text_col), ".!?", "")).otherwise(space(text_col))
    role = F.when(lot == 4, F.lit("user")).otherwise(space(role_col))
    copies = F.explode(F.when(lot == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    whole = rows.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), role.alias("role"), text.alias("text"), lot.alias("lot"), copies.alias("copy"))
    return whole.filter("lot != 0").select("conv_id", "turn", "role", "text")


def conv_key(column: str) -> Column:
    """A conversation's key as a string that tells null from all values."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`").cast("string")), F.lit(" "))


def _digests(rows: DataFrame) -> DataFrame:
    """(conv, sha256) of the repaired rows. A conversation of several segments passes its bytes on, segment by segment."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, body, out = None, [], ([], [], [], [])
        state = at = 0

        def close() -> None:
            data = "\n".join(body).encode()
            for column, x in zip(out, (last[0], last[1], hashlib.sha256(data).hexdigest() if last[2] else None, None if last[2] else data), strict=True):
                column.append(x)

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(out, (pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["conv", "key", "sha256", "bytes"])

        for batch in batches:
            for conv, key, whole, entry, audit, code, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv", "key", "whole", "entry", "audit", "code", "role", "text")), strict=True):
                if last is None or (conv, key) != last[:2]:
                    if last is not None:
                        close()
                    last, body, state, at = (conv, key, whole), [], entry, 0
                letter = audit[at]
                at += 1
                if letter == "R":
                    state = _ASSISTANT if state == _USER else _USER
                    role = "assistant" if state == _ASSISTANT else "user"
                if letter == "K":
                    state = code
                if letter != "D":
                    body.append(f"{role}:{text}")
            if out[0]:
                yield made()
                out = ([], [], [], [])
        if last is not None:
            close()
            yield made()

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest, some, out = None, None, False, []
        for batch in batches:
            for conv, data in zip(batch.column("conv").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if conv != last:
                    if last is not None:
                        out.append((last, digest.hexdigest()))
                    last, digest, some = conv, hashlib.sha256(), False
                if data:
                    digest.update(b"\n" + data if some else data)
                    some = True
        if last is not None:
            out.append((last, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in (0, 1)], ["conv", "sha256"])

    parts = materialise(rows.mapInArrow(segments, "conv string, key long, sha256 string, bytes binary"), "repaired")
    # SHA-256 has no parallel form: the bytes of a conversation of many segments pass one task, as a stream.
    split = parts.filter("sha256 is null").repartition("conv").sortWithinPartitions("conv", "key").select("conv", "bytes")
    return parts.filter("sha256 is not null").select("conv", "sha256").union(split.mapInArrow(chained, "conv string, sha256 string"))


def repair(rows: DataFrame, conv_col: str = "conv_id", role_col: str = "role", text_col: str = "text", turn_col: str = "turn", bits: int = SEGMENT) -> DataFrame:
    """The faults of each conversation and its cheapest repair. Rows stand in the order of their turns, nulls first.

    One row for each conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    Rows of one turn stand in the order of role and then of a hash of the text. Null roles and texts are one space; a
    null conversation is one of its own; a repeated row is a duplicate; other columns are ignored; an empty table
    gives no rows.
    """
    small_batches(rows.sparkSession)
    space = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    trimmed = F.rtrim(F.col("text"), F.lit(_BLANK))
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    named = rows.select(conv_key(conv_col).alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    # The last key parts rows that are equal otherwise, so no row has to follow another into a partition.
    keys = ["conv", F.col("turn").asc_nulls_first(), "role", F.xxhash64("text"), F.xxhash64(F.monotonically_increasing_id())]
    ordered = named.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("pos", F.monotonically_increasing_id())
    turns = materialise(ordered.select("*", code.cast("int").alias("code"), (trimmed == "").alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.unhex(F.md5("text")).alias("digest")), "turns")
    first = turns.groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(False).alias("again"))
    light = turns.select("conv", "pos", "turn", F.col("code").alias("role"), "blank", "cut").join(first, "pos", "left")
    light = light.withColumn("repeated", F.coalesce("again", F.lit(True))).drop("again")
    level = materialise(_dealt(light, F.shiftright("pos", bits)).mapInArrow(lambda x: _by_segment(x, partial(_of_rows, bits=bits)), _SEGMENTS), "segments")
    levels, done = [], []
    while True:
        several = level.groupBy("conv").count().filter("count > 1").select("conv")
        levels.append(level)
        done.append(level.join(several, "conv", "left_anti"))
        more = level.join(several, "conv", "left_semi")
        if several.isEmpty():
            break
        level = materialise(_dealt(more, bits).mapInArrow(lambda x: _by_segment(x, _of_segments), _SEGMENTS), "segments")
    best = F.array_min(F.transform(F.filter("ways", lambda w: (w.entry == 0) & w.leave.isin(0, 3)), lambda w: F.struct(w.cost.alias("cost"), w.audit.alias("audit"), w.leave.alias("leave"), w.steps.alias("steps"))))
    top = [d.withColumn("best", best) for d in done]
    # Down again: the way through a segment says which way was taken through each of its parts.
    taken = top[-1].select("conv", "key", F.lit(0).alias("entry"), "best.leave", F.lit(len(top) == 1).alias("whole"))
    for k in range(len(levels) - 1, 0, -1):
        way = F.filter("ways", lambda w: (w.entry == F.col("way_entry")) & (w.leave == F.col("way_leave")))[0]
        above = levels[k].join(taken.select("conv", "key", F.col("entry").alias("way_entry"), F.col("leave").alias("way_leave")), ["conv", "key"])
        below = above.select("conv", F.explode(way["steps"]).alias("s")).select("conv", "s.key", "s.entry", "s.leave", F.lit(False).alias("whole"))
        taken = below.union(top[k - 1].select("conv", "key", F.lit(0), "best.leave", F.lit(k == 1)))
    taken = taken.withColumnsRenamed({"entry": "way_entry", "leave": "way_leave"})
    way = F.filter("ways", lambda w: (w.entry == F.col("way_entry")) & (w.leave == F.col("way_leave")))[0]
    chosen = materialise(levels[0].join(taken, ["conv", "key"]).select("conv", "key", "whole", F.col("way_entry").alias("entry"), way["audit"].alias("audit")), "chosen")
    met = turns.withColumn("key", F.shiftright("pos", bits)).join(chosen, ["conv", "key"])
    digests = _digests(met.repartition("conv", "key").sortWithinPartitions("conv", "key", "pos").select("conv", "key", "whole", "entry", "audit", "code", "role", "text"))
    audits = chosen.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "audit"))), lambda x: x.audit), "").alias("audit"))
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns"), F.lit(0))
    facts = [t.select("conv", gaps.alias("gaps"), *_COUNTS[:4], F.col("best.cost").alias("cost")) for t in top]
    out = facts[0]
    for f in facts[1:]:
        out = out.union(f)
    return out.join(audits, "conv").join(digests.withColumnRenamed("sha256", "repaired_sha256"), "conv")


def repair_damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", bits: int = SEGMENT) -> DataFrame:
    """`repair` of the rows after `damaged`, one row for each conversation of `rows`; one that lost all its rows has zeros."""
    ids = rows.select(F.col(f"`{conv_col}`").alias("conv_id")).distinct().withColumn("conv", conv_key("conv_id"))
    found = ids.join(repair(damaged(rows, conv_col, turn_col, role_col, text_col), bits=bits), "conv", "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *_COUNTS[:4], "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return found.select(F.col("conv_id").alias(conv_col), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
