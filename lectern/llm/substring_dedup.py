"""Suffix-array dedup: removal of every byte that lies in a string of `WIDTH` bytes standing elsewhere too.

No suffix array of the whole corpus is built. Each window of `WIDTH` bytes is known by its anchor, the place of
the least hash of `GRAM` bytes inside it, which depends on the window's bytes alone: equal windows have equal
anchors at equal offsets. The windows of one anchor lie side by side, so an anchor with the bytes its windows
span stands for all of them, and one row in about 185 bytes is shuffled instead of one for each byte.

- Anchors whose hash occurs once have no repeat.
- Equal spans around equal anchors are counted by partial sums; where there are two, all their windows repeat.
- Different spans around equal anchors, one of each kind, go to suffix sorting: those of one hash meet in one
  task, many hashes to a task, and two-stage sorting with adjacent common prefixes finds the windows that
  repeat. More than `MOST_SPANS` kinds of one hash are first parted by what surrounds the anchor, by halving the
  distances at which windows begin before it, until each part is small, alone or equal throughout.

Matches never cross documents, since no window does.

Passages of `WORDS` words and more that stand in another document too are counted beside that, and stay unless
they hold `WIDTH` bytes that go. Their anchors are those of windows of words, each known by a 64-bit code; equal
spans in two documents are passages, and the windows of spans that differ are compared, one by one where more than `MOST_SPANS` meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import buffer_of, small_batches, split_by_sieve, utf8
from lectern.llm.suffixes import repeated_starts
from lectern.session import discard, materialise

WIDTH, GRAM = 400, 32
#: The same for passages, in words: over 50 of them.
WORDS, WORD_GRAM = 51, 8
#: Kinds of spans around one anchor hash that are sorted in one task, at most.
MOST_SPANS = 1000
#: Bytes of text whose suffixes are sorted at once.
SORT_BYTES = 1 << 19
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20
_NO_ID = -(1 << 63)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Words of more bytes get their code from a digest.
_LONG = 256


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the `gram` (a power of two) bytes from each place on."""
    h, factor = raw.astype(np.uint64) + np.uint64(1), _MULTIPLIER
    step = 1
    with np.errstate(over="ignore"):
        while step < gram:
            h = h[:-step] * factor + h[step:]
            factor, step = factor * factor, 2 * step
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def anchors_of(raw: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, anchor, hash) of the runs of windows that share an anchor; `ends` are the texts' ends in `raw`."""
    if len(raw) < width:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    hashes, w = gram_hashes(raw, gram), width - gram + 1
    low = np.uint64((1 << 30) - 1)
    keys = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)  # of equal hashes the leftmost is least
    padded = np.full(-(-len(keys) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, w)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(raw) - width + 1
    anchor = (np.minimum(onward[:n], upto[w - 1 : w - 1 + n]) & low).astype(np.int64)
    end_of = np.repeat(ends, np.diff(ends, prepend=0))[:n]
    valid = np.flatnonzero(np.arange(n) + width <= end_of)
    if not len(valid):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    at = anchor[valid]
    new = np.flatnonzero(np.append(True, (np.diff(at) != 0) | (np.diff(valid) != 1)))
    first, last = valid[new], valid[np.append(new[1:], len(valid)) - 1]
    return first, last, at[new], hashes[at[new]]


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def word_codes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, offsets): a 64-bit code of every word `[^\\x20\\x09-\\x0D]+`, and where the words of each text begin among them."""
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begins, closes = ~blank, ~blank
    begins[1:] &= blank[:-1]
    closes[:-1] &= blank[1:]
    filled = np.diff(offsets) > 0
    for edge, at in ((begins, offsets[:-1][filled]), (closes, offsets[1:][filled] - 1)):
        edge[at] = ~blank[at]
    starts = np.flatnonzero(begins)
    length = np.flatnonzero(closes) + 1 - starts
    eights = np.ndarray(len(raw) + 1, "<u8", np.append(raw, np.zeros(8, np.uint8)), strides=(1,))  # the eight bytes from each place on
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    with np.errstate(over="ignore"):
        codes = length.astype(np.uint64) * _MULTIPLIER
        todo = np.flatnonzero(length <= _LONG)
        at, left = starts[todo], length[todo]
        while len(todo):
            h = (codes[todo] ^ (eights[at] & masks[np.minimum(left, 8)])) * _MULTIPLIER
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            codes[todo] = h ^ (h >> np.uint64(29))
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(length > _LONG).tolist():
        codes[k] = int.from_bytes(_digest(raw[starts[k] : starts[k] + length[k]].tobytes())[:8], "little")
    return codes, np.searchsorted(starts, offsets)


def _pieces(ends: np.ndarray, chunk: int, width: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, number of the first text): stretches of whole texts of about `chunk` bytes or words; a longer text is cut with an overlap."""
    start, k = 0, 0
    while k < len(ends):
        upto = int(np.searchsorted(ends, start + chunk, "right"))
        if upto > k:
            yield start, int(ends[upto - 1]), k
            start, k = int(ends[upto - 1]), upto
        else:
            for a in range(start, int(ends[k]), chunk):
                yield a, min(a + chunk + width - 1, int(ends[k])), k
            start, k = int(ends[k]), k + 1


ANCHORS = "id long, digest long, hash long, span binary, first int, last int, anchor int"


def anchor_rows(keyed: DataFrame, words: bool = False) -> DataFrame:
    """The anchors of every text of (id, digest, text), with places relative to the text's bytes, or its words."""
    small_batches(keyed.sparkSession)
    width, gram = (WORDS, WORD_GRAM) if words else (WIDTH, GRAM)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = buffer_of(batch.column("text"))
            if words:
                raw, offsets = word_codes(raw, offsets)
            ids, digests = batch.column("id").to_numpy(), batch.column("digest").to_numpy()
            ends, size = offsets[1:], raw.itemsize
            for a, b, k in _pieces(ends, CHUNK, width):
                inside = ends[k:][ends[k:] <= b] - a
                inside = inside if len(inside) and inside[-1] == b - a else np.append(inside, b - a)
                first, last, anchor, found = anchors_of(raw[a:b], inside, width, gram)
                text = raw[a:b].tobytes()
                spans = [_digest(text[f * size : (e + width) * size] + (p - f).to_bytes(2, "little")) for f, e, p in zip(first.tolist(), last.tolist(), anchor.tolist())]
                doc = k + np.searchsorted(inside, first, "right")
                base = a - offsets[doc]
                places = [pa.array((x + base).astype(np.int32)) for x in (first, last, anchor)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[doc]), pa.array(digests[doc]), pa.array(found.view(np.int64)), pa.array(spans, pa.binary()), *places], names=["id", "digest", "hash", "span", "first", "last", "anchor"]
                )

    return keyed.mapInArrow(compute, ANCHORS)


SPANS = "key binary, bytes binary, starts int, id long, digest long, first int, anchor int, copies long, crowd long"


def _cut(keyed: DataFrame, contested: DataFrame) -> DataFrame:
    """The bytes of the contested spans, one row for each; key is the anchor's hash and crowd the number of its kinds."""
    needed = contested.groupBy("id", "digest").agg(F.collect_list(F.struct("hash", "first", "last", "anchor", "copies", "kinds")).alias("spans"))
    joined = split_by_sieve(keyed, contested, "id", "digest")[0].dropDuplicates(["id", "digest"]).join(needed, ["id", "digest"])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, ident, digest, spans in zip(utf8(batch.column("text")), batch.column("id").to_pylist(), batch.column("digest").to_pylist(), batch.column("spans").to_pylist()):
                for k in range(0, len(spans), 10_000):
                    rows = []
                    for s in spans[k : k + 10_000]:
                        first, last = s["first"], s["last"]
                        rows.append((s["hash"].to_bytes(8, "little", signed=True), raw[first : last + WIDTH], last - first + 1, ident, digest, first, s["anchor"], s["copies"], s["kinds"]))
                    yield _span_batch(rows)

    return joined.select("id", "digest", "text", "spans").mapInArrow(compute, SPANS)


def _span_batch(rows: list[tuple], *more: str) -> pa.RecordBatch:
    names = [x.split()[0] for x in SPANS.split(", ")][: len(rows[0]) - len(more)] + list(more)
    kinds = {"key": pa.binary(), "bytes": pa.binary(), "outer": pa.binary(), "starts": pa.int32(), "first": pa.int32(), "anchor": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, zip(*rows), strict=True)], names=names)


def _halves(spans: DataFrame, level: int) -> DataFrame:
    """Each span in two, by how far a window begins before the anchor.

    `level` counts the halvings of the distances 0..WIDTH - GRAM. The windows of one part all hold the bytes from
    the anchor minus the least distance to the anchor plus WIDTH minus the greatest: those are the part's key, so
    equal windows stay together. outer digests all that the part's windows of this span cover.
    """
    size = 1 << max(0, (WIDTH - GRAM).bit_length() - level)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                near, far = r["anchor"] - r["first"] - r["starts"] + 1, r["anchor"] - r["first"]  # distances of its windows
                for part in range(near // size, far // size + 1):
                    low, high = part * size, min(part * size + size - 1, WIDTH - GRAM)
                    a, b = max(low, near), min(high, far)
                    key = _digest(low.to_bytes(2, "little") + r["bytes"][far - low : far + WIDTH - high])
                    outer = r["bytes"][far - b : far - a + WIDTH]
                    rows.append((key, outer, b - a + 1, r["id"], r["digest"], r["anchor"] - b, r["anchor"], r["copies"], _digest(a.to_bytes(2, "little") + outer)))
            if rows:
                yield _span_batch(rows, "outer")

    return spans.mapInArrow(compute, SPANS.replace("crowd long", "outer binary"))


def _range(first: str = "first", starts: str = "starts") -> list[Column]:
    return [F.col("id"), F.col("digest"), F.col(first).alias("low"), (F.col(first) + F.col(starts) - 1 + WIDTH).cast("int").alias("high")]


def _crowded_repeats(spans: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """(ranges, spans): the repeats found while crowds of over `MOST_SPANS` spans are halved, and the small crowds left to sort.

    A part alone with its key has no repeat; parts equal in all they cover repeat as a whole; a part in a small
    crowd is sorted; the others are halved again, down to single windows, whose key is all they cover.
    """
    ranges, small, level = [], [], 0
    crowded = spans.filter(F.col("crowd") > MOST_SPANS)
    while not crowded.isEmpty():
        level += 1
        parts = materialise(_halves(crowded, level), f"halves-{level}")
        kinds = parts.groupBy("key", "outer").agg(F.count("*").alias("equal"))
        crowds = kinds.groupBy("key").agg(F.sum("equal").alias("crowd")).filter("crowd > 1")
        kinds = kinds.filter("equal > 1").select("key", "outer", F.lit(True).alias("whole"))
        met = materialise(parts.join(crowds, "key").join(kinds, ["key", "outer"], "left"), f"crowds-{level}")
        ranges.append(met.filter("whole").select(*_range()))
        # One of each kind goes on; the others are equal to it.
        one = met.filter("whole is null").drop("outer", "whole")
        kept = met.filter("whole").groupBy("key", "outer").agg(F.min(F.struct("bytes", "starts", "id", "digest", "first", "anchor", F.lit(2).cast("long").alias("copies"), "crowd")).alias("one")).select("key", "one.*")
        rest = one.unionByName(kept)
        small.append(rest.filter(F.col("crowd") <= MOST_SPANS))
        if 1 << level > WIDTH - GRAM:  # parts of single windows: those of one key are equal, and found
            break
        # Single windows go on too: above the last level their key is less than they cover.
        crowded = rest.filter(F.col("crowd") > MOST_SPANS)
    return ranges, small


def _sorted_repeats(spans: DataFrame) -> DataFrame:
    """(id, digest, low, high): the repeats that two-stage sorting finds among the spans of each key."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for row in batch.to_pylist():
                if size >= SORT_BYTES and row["key"] != held[-1]["key"]:
                    yield from flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row["bytes"])
        if held:
            yield from flush(held)

    def flush(held: list[dict]) -> Iterator[pa.RecordBatch]:
        out = []
        found = repeated_starts([r["bytes"] for r in held], [r["starts"] for r in held], WIDTH)
        for r, twice in zip(held, found):
            if r["copies"] == 1 and twice.any():
                edges = np.flatnonzero(np.diff(twice.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                out += [(r["id"], r["digest"], r["first"] + a, r["first"] + b - 1 + WIDTH) for a, b in edges.tolist()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), [pa.int64(), pa.int64(), pa.int32(), pa.int32()])], names=["id", "digest", "low", "high"])

    together = spans.select("key", "bytes", "starts", "id", "digest", "first", "copies").repartition("key").sortWithinPartitions("key")
    return together.mapInArrow(compute, "id long, digest long, low int, high int")


def repeated_ranges(keyed: DataFrame) -> DataFrame:
    """(id, digest, low, high): byte ranges whose union is what must go, for (id, digest, text)."""
    anchors = materialise(anchor_rows(keyed), "anchors")
    kinds = anchors.groupBy("hash", "span").agg(F.count("*").alias("copies"), F.min(F.struct("id", "digest", "first", "last", "anchor")).alias("member"))
    kinds = materialise(kinds, "span-kinds")
    shared = kinds.groupBy("hash").agg(F.count("*").alias("kinds"), F.sum("copies").alias("all")).filter("all > 1").drop("all")
    kinds = materialise(kinds.join(shared, "hash"), "shared-spans")
    equal = anchors.join(kinds.filter("copies > 1").select("hash", "span"), ["hash", "span"]).select("id", "digest", F.col("first").alias("low"), (F.col("last") + WIDTH).alias("high"))
    contested = kinds.filter("kinds > 1").select("hash", "copies", "kinds", "member.*")
    spans = materialise(_cut(keyed, contested), "contested-spans")
    ranges, small = _crowded_repeats(spans)
    to_sort = spans.filter(F.col("crowd") <= MOST_SPANS)
    for more in small:
        to_sort = to_sort.unionByName(more)
    found = equal.union(_sorted_repeats(to_sort))
    for more in ranges:
        found = found.union(more)
    return found


def _windows(keyed: DataFrame, contested: DataFrame) -> DataFrame:
    """(window, known, id, digest, at): the digest of each window of words of the contested spans."""
    needed = contested.groupBy("id", "digest").agg(F.collect_list(F.struct("first", "last", "known")).alias("spans"))
    joined = split_by_sieve(keyed, contested, "id", "digest")[0].dropDuplicates(["id", "digest"]).join(needed, ["id", "digest"])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, offsets = word_codes(*buffer_of(batch.column("text")))
            for k, (ident, digest, spans) in enumerate(zip(batch.column("id").to_pylist(), batch.column("digest").to_pylist(), batch.column("spans").to_pylist())):
                text = codes[offsets[k] : offsets[k + 1]].tobytes()
                places = [(at, s["known"]) for s in spans for at in range(s["first"], s["last"] + 1)]
                for j in range(0, len(places), 100_000):
                    at, known = zip(*places[j : j + 100_000])
                    found = pa.array([_digest(text[8 * a : 8 * (a + WORDS)]) for a in at], pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [found, pa.array(known), pa.array([ident] * len(at), pa.int64()), pa.array([digest] * len(at), pa.int64()), pa.array(at, pa.int32())], names=["window", "known", "id", "digest", "at"]
                    )

    return joined.select("id", "digest", "text", "spans").mapInArrow(compute, "window binary, known boolean, id long, digest long, at int")


WORD_SPANS = "hash long, codes binary, starts int, known boolean, id long, digest long, first int, anchor int"


def _cut_words(keyed: DataFrame, contested: DataFrame) -> DataFrame:
    """The codes of the words of the contested spans, one row for each."""
    needed = contested.groupBy("id", "digest").agg(F.collect_list(F.struct("hash", "first", "last", "anchor", "known")).alias("spans"))
    joined = split_by_sieve(keyed, contested, "id", "digest")[0].dropDuplicates(["id", "digest"]).join(needed, ["id", "digest"])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, offsets = word_codes(*buffer_of(batch.column("text")))
            for k, (ident, digest, spans) in enumerate(zip(batch.column("id").to_pylist(), batch.column("digest").to_pylist(), batch.column("spans").to_pylist())):
                text = codes[offsets[k] : offsets[k + 1]].tobytes()
                for j in range(0, len(spans), 10_000):
                    rows = [(s["hash"], text[8 * s["first"] : 8 * (s["last"] + WORDS)], s["last"] - s["first"] + 1, s["known"], ident, digest, s["first"], s["anchor"]) for s in spans[j : j + 10_000]]
                    kinds = [pa.int64(), pa.binary(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in WORD_SPANS.split(", ")])

    return joined.select("id", "digest", "text", "spans").mapInArrow(compute, WORD_SPANS)


def _compared(spans: DataFrame) -> DataFrame:
    """(id, digest, low, high): the windows of words that spans of one hash have in common, in two documents or with a known one."""
    farthest = WORDS - WORD_GRAM
    factors = np.random.default_rng(1).integers(0, 1 << 64, (2, farthest + WORDS), np.uint64) | np.uint64(1)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if len(held) >= 4000 and row[0] != held[-1][0]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    def flush(held: list[tuple]) -> pa.RecordBatch:
        group, raws, starts, known, ids, digests, first, anchor = zip(*held)
        group, starts, known, first, anchor = (np.array(x) for x in (group, starts, known, first, anchor))
        numbers: dict = {}
        doc = np.array([numbers.setdefault(x, len(numbers)) for x in zip(ids, digests)])
        far = anchor - first
        near = far - starts + 1
        around = np.zeros((len(held), farthest + WORDS), np.uint64)  # the anchors stand in one column
        for k, (raw, f) in enumerate(zip(raws, far.tolist())):
            around[k, farthest - f : farthest - f + len(raw) // 8] = np.frombuffer(raw, np.uint64)
        with np.errstate(over="ignore"):
            sums = [np.cumsum(np.pad(around * f, ((0, 0), (1, 0))), axis=1) for f in factors]
            hit = np.zeros((len(held), farthest + 3), np.int8)
            for d in range(farthest + 1):
                at = np.flatnonzero((near <= d) & (d <= far))
                if len(at) < 2:
                    continue
                a = farthest - d
                keys = [group[at], *(x[at, a + WORDS] - x[at, a] for x in sums)]
                order = np.lexsort(keys)
                at = at[order]
                new = np.flatnonzero(np.append(True, np.any([x[order][1:] != x[order][:-1] for x in keys], axis=0)))
                twice = (np.minimum.reduceat(doc[at], new) != np.maximum.reduceat(doc[at], new)) | np.maximum.reduceat(known[at], new)
                hit[at, d + 1] = np.repeat(twice, np.diff(np.append(new, len(at)))) & ~known[at]
        edges = np.diff(hit, axis=1)
        k, low = np.nonzero(edges == 1)
        high = np.nonzero(edges == -1)[1]  # distances low .. high - 1
        columns = [np.array(ids)[k], np.array(digests)[k], (anchor[k] - high + 1).astype(np.int32), (anchor[k] - low + WORDS).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["id", "digest", "low", "high"])

    return spans.repartition("hash").sortWithinPartitions("hash").mapInArrow(compute, "id long, digest long, low int, high int")


def repeated_passages(keyed: DataFrame) -> DataFrame:
    """(id, digest, n): the words in passages of `WORDS` words and more that stand in another document too, where there are any.

    Rows equal in id and text are one document here.
    """
    several = ((F.min("id") != F.max("id")) | (F.min("digest") != F.max("digest"))).alias("several")
    anchors = materialise(anchor_rows(keyed, words=True), "passage-anchors")
    shared = anchors.groupBy("hash").agg(several).filter("several").select("hash")
    met = materialise(split_by_sieve(anchors, shared, "hash")[0], "passage-spans")
    discard(anchors)
    kinds = materialise(met.groupBy("hash", "span").agg(several, F.min("id").alias("least"), F.count("*").alias("copies")), "passage-kinds")
    # A kind of several documents is found as a whole, and its least document's stand for it; of the others all places go on, which are in one document.
    crowds = kinds.groupBy("hash").agg(F.count("*").alias("kinds"), F.sum(F.when(F.col("several"), 1).otherwise(F.col("copies"))).alias("crowd"))
    marked = kinds.join(crowds, "hash").filter("several or kinds > 1").drop("copies")
    spans = materialise(met.join(marked, ["hash", "span"]).drop("span"), "passage-marked")
    contested = spans.filter("kinds > 1 and (not several or id = least)").withColumn("known", F.col("several"))
    found = spans.filter("several").select("id", "digest", F.col("first").alias("low"), (F.col("last") + WORDS).alias("high"))
    found = found.union(_compared(_cut_words(keyed, contested.filter(F.col("crowd") <= MOST_SPANS))))
    crowded = contested.filter(F.col("crowd") > MOST_SPANS)
    held = [met, kinds, spans]
    if not crowded.isEmpty():
        windows = materialise(_windows(keyed, crowded), "passage-windows")
        held.append(windows)
        twice = windows.groupBy("window").agg(several, F.max("known").alias("met")).filter("several or met").select("window")
        found = found.union(windows.filter("not known").join(twice, "window").select("id", "digest", F.col("at").alias("low"), (F.col("at") + WORDS).alias("high")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = []
            for ranges in batch.column("ranges"):
                r = np.sort(ranges.values.to_numpy(zero_copy_only=False))
                low, high = r >> 32, np.maximum.accumulate(r & 0xFFFFFFFF)
                n.append(int((high - np.maximum(low, np.append(0, high[:-1]))).clip(0).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), pa.array(n, pa.int64())], names=["id", "digest", "n"])

    ranges = found.groupBy("id", "digest").agg(F.collect_list(F.shiftleft(F.col("low").cast("long"), 32) + F.col("high")).alias("ranges"))
    out = materialise(ranges.mapInArrow(count, "id long, digest long, n long"), "passages")
    discard(*held)
    return out


def _joined(ranges: list[dict] | None) -> Iterator[tuple[int, int]]:
    """The union of ranges, as ranges that do not touch."""
    low, high = -1, -1
    for r in sorted((r["low"], r["high"]) for r in ranges or ()):
        if r[0] > high:
            if high >= 0:
                yield low, high
            low = r[0]
        high = max(high, r[1])
    if high >= 0:
        yield low, high


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (binary: the bytes left, in order), n_passage_words.

    Every byte covered by `WIDTH` bytes that also start anywhere else, the same document included, goes; all is
    judged on the input. Null texts are empty. Repeated rows stand for two places, so a repeated long text goes
    from both; null ids are kept; an empty table gives no rows; other columns are ignored. n_passage_words are the
    words in passages of `WORDS` words and more that another document has too; passages of under `WIDTH` bytes are
    counted there, and stay.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    passages = repeated_passages(keyed)
    place = F.struct("low", "high")
    ranges = repeated_ranges(keyed).select("id", "digest", place.alias("gone"), F.lit(None).cast("long").alias("n"))
    ranges = ranges.union(passages.select("id", "digest", F.lit(None).cast("struct<low:int,high:int>"), "n"))
    merged = materialise(ranges.groupBy("id", "digest").agg(F.collect_set("gone").alias("ranges"), F.max("n").alias("n")), "ranges")
    discard(passages)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for ident, raw, found, n in zip(batch.column("id").to_pylist(), utf8(batch.column("text")), batch.column("ranges").to_pylist(), batch.column("n").to_pylist()):
                kept, at, spans = [], 0, 0
                for low, high in _joined(found):
                    kept.append(raw[at:low])
                    at, spans = high, spans + 1
                kept.append(raw[at:])
                left = b"".join(kept)
                ids.append(None if ident == _NO_ID else ident)
                out.append((len(raw), len(raw) - len(left), spans, left, n or 0))
            kinds = [pa.int64()] * 3 + [pa.binary(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names=["id", "n_bytes", "n_removed", "n_spans", "kept", "n_passage_words"])

    touched, untouched = split_by_sieve(keyed, merged, "id", "digest")
    part = touched.join(merged, ["id", "digest"], "left").select("id", "text", "ranges", "n")
    cut_rows = part.mapInArrow(cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passage_words long")
    size, zero = F.octet_length("text").cast("long"), F.lit(0).cast("long")
    whole = untouched.select(F.nullif("id", F.lit(_NO_ID)).alias("id"), size.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.encode("text", "utf-8").alias("kept"), zero.alias("n_passage_words"))
    return cut_rows.union(whole).withColumnRenamed("id", id_col)
