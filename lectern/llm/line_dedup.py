"""Line dedup: repeated runs of lines, from a suffix order over line ids built by distributed prefix doubling.

The corpus is one sequence of line ids, document after document in id order, with a break after each. Doubling
names every stretch of 2^k lines by the first place where it stands: the names of level k + 1 are those of the
pairs (name of the first half, name of the second half). A place whose name occurs once has no repeat of that
length and drops out, so the levels shrink. A stretch of any length L is known by the names of the two stretches
of 2^k <= L lines that begin and end it, which is the common prefix of L lines that its suffixes share.

A run of consecutive lines with `MIN_WORDS` words or more that also stands at an earlier place is a later copy,
and its lines are deleted. Every such run is the union of its shortest sufficient blocks, forward from each line
and backward from each line, so those blocks decide, and levels up to log2(MIN_WORDS) are enough for any run.
Before the doubling, lines that stand once in the corpus part the sequence, and documents without a block between
such lines drop out. Blank lines are not part of the sequence and stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import fresh, small_batches, split_by_sieve, utf8, with_rank
from lectern.session import discard, materialise

MIN_WORDS = 50
#: A place is rank of the document * 2^PLACE_BITS + index of the line.
PLACE_BITS = 28
_NO_ID = -(1 << 63)


def _blocks(words: np.ndarray, least: int) -> np.ndarray:
    """(start, length) of the shortest runs of at least so many words, forward from and backward to each line."""
    upto = np.concatenate([[0], np.cumsum(words)])
    n = len(words)
    ends = np.searchsorted(upto, upto[:-1] + least)  # forward: the first end that suffices
    forward = np.stack([np.arange(n), ends - np.arange(n)], 1)[ends <= n]
    starts = np.searchsorted(upto, upto[1:] - least, "right") - 1  # backward: the last start that suffices
    backward = np.stack([starts, np.arange(1, n + 1) - starts], 1)[upto[1:] >= least]
    return np.unique(np.concatenate([forward, backward]), axis=0)


def _lists(kind: pa.DataType, parts: list[np.ndarray]) -> pa.ListArray:
    """A list column from one array per row."""
    upto = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(upto), pa.array(np.concatenate(parts) if parts else np.empty(0), kind))


def line_sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, number, words, h1, h2): for each text, of its lines with words the number, size and two halves of a hash."""
    small_batches(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            number, words, hashes = [], [], []
            for raw in utf8(batch.column("text")):
                lines = raw.split(b"\n")
                sizes = np.array([len(x.split()) for x in lines], np.int32)
                number.append(np.flatnonzero(sizes).astype(np.int32))
                words.append(sizes[sizes > 0])
                hashes.append(np.frombuffer(b"".join(xxh3_128_digest(x) for x, n in zip(lines, sizes.tolist()) if n), "<i8").reshape(-1, 2))
            columns = [_lists(pa.int32(), number), _lists(pa.int32(), words), _lists(pa.int64(), [h[:, 0] for h in hashes]), _lists(pa.int64(), [h[:, 1] for h in hashes])]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), *columns], names=["id", "digest", "number", "words", "h1", "h2"])

    text = F.col(f"`{text_col}`")
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    return rows.mapInArrow(compute, "id long, digest long, number array<int>, words array<int>, h1 array<long>, h2 array<long>")


def candidate_blocks(sequences: DataFrame, min_words: int) -> DataFrame:
    """(id, digest, at, number, h1, h2, start, length): documents with a block of lines that all stand elsewhere too.

    Lines that stand once in the corpus end a run; only blocks inside the runs between can repeat. at is the
    place of a line among the document's lines with words.
    """
    lines = sequences.select("id", "digest", F.posexplode(F.arrays_zip("number", "words", "h1", "h2")).alias("at", "x")).select("id", "digest", "at", "x.*")
    twice = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1").select("h1", "h2")
    repeated = lines.join(twice, ["h1", "h2"]).groupBy("id", "digest").agg(F.array_sort(F.collect_set(F.struct("at", "number", "words", "h1", "h2"))).alias("lines"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, columns = [], [[] for _ in range(6)]
            lists = batch.column("lines")
            flat, offsets = lists.flatten(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            at, number, words, h1, h2 = (flat.field(k).to_numpy() for k in range(5))
            for row, (a, b) in enumerate(zip(offsets, offsets[1:])):
                cuts = [0, *(np.flatnonzero(np.diff(at[a:b]) != 1) + 1).tolist(), b - a]
                blocks = [_blocks(words[a + x : a + y], min_words) + [at[a + x], 0] for x, y in zip(cuts, cuts[1:])]
                found = np.concatenate(blocks)
                if len(found):
                    kept.append(row)
                    for c, x in zip(columns, (at[a:b], number[a:b], h1[a:b], h2[a:b], found[:, 0], found[:, 1])):
                        c.append(x)
            if kept:
                whole = batch.take(pa.array(kept))
                out = [_lists(k, c) for k, c in zip([pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()], columns)]
                yield pa.RecordBatch.from_arrays([whole.column("id"), whole.column("digest"), *out], names=["id", "digest", "at", "number", "h1", "h2", "start", "length"])

    return repeated.mapInArrow(compute, "id long, digest long, at array<int>, number array<int>, h1 array<long>, h2 array<long>, start array<int>, length array<int>")


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, digest, deleted): for documents with later copies, the numbers of their deleted lines (from 0)."""
    sequences = materialise(line_sequences(docs, id_col, text_col), "line-sequences")
    candidates = materialise(candidate_blocks(sequences, min_words), "line-candidates")
    ranks = with_rank(candidates.select("id", "digest"), "id", "digest")
    placed = materialise(candidates.join(ranks, ["id", "digest"]).withColumn("base", F.shiftleft("rank", PLACE_BITS)), "line-places")
    discard(sequences, candidates)
    lines = placed.select("base", F.explode(F.arrays_zip("at", "h1", "h2")).alias("x")).select((F.col("base") + F.col("x.at")).alias("place"), "x.h1", "x.h2")
    blocks = placed.select("base", F.explode(F.arrays_zip("start", "length")).alias("b")).select((F.col("base") + F.col("b.start")).alias("place"), F.col("b.length").alias("length"))

    level, size = materialise(_name(lines, ["h1", "h2"]), "level-1"), 1
    copies, held = None, [placed, level]
    while True:
        here = blocks.filter((F.col("length") >= size) & (F.col("length") < 2 * size))
        first = here.join(level, "place").withColumnRenamed("name", "first")
        last = level.select((F.col("place")).alias("last_place"), F.col("name").alias("last"))
        both = first.withColumn("last_place", F.col("place") + F.col("length") - size).join(last, "last_place")
        both = materialise(both.select("place", "length", "first", "last"), f"blocks-{size}")
        earliest = both.groupBy("length", "first", "last").agg(F.min("place").alias("earliest"))
        held.append(both)
        later = both.join(earliest, ["length", "first", "last"]).filter("place > earliest").select("place", "length")
        copies = later if copies is None else copies.union(later)
        if 2 * size > min_words:
            break
        halves = level.select((F.col("place") - size).alias("place"), F.col("name").alias("second"))
        pairs = level.join(halves, "place")
        level, size = materialise(_name(pairs, ["name", "second"]), f"level-{2 * size}"), 2 * size
        held.append(level)
    covered = copies.select(F.explode(F.sequence(F.col("place"), F.col("place") + F.col("length") - 1)).alias("place")).distinct()
    deleted = covered.groupBy(F.shiftright("place", PLACE_BITS).alias("rank")).agg(F.collect_set((F.col("place") % (1 << PLACE_BITS)).cast("int")).alias("gone"))
    numbered = placed.join(deleted, "rank").withColumn("numbers", F.map_from_arrays("at", "number"))
    out = numbered.select("id", "digest", F.array_sort(F.transform("gone", lambda i: F.element_at("numbers", i))).alias("deleted"))
    out = materialise(out, "deleted-lines")
    discard(*held)
    return out


def _name(rows: DataFrame, key: list[str]) -> DataFrame:
    """(place, name) of the rows whose key occurs twice or more; the name is the first place that has the key."""
    classes = rows.groupBy(*key).agg(F.min("place").alias("first_place"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return rows.join(classes, key).select("place", F.col("first_place").alias("name"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with the later copies of repeated runs of lines deleted from its text, and n_lines, n_deleted.

    Documents come in the order of their ids; rows equal in id and text are one document and share one result.
    Null texts stay null; a null id comes before all others; blank lines stay; a text that loses all its lines
    becomes empty; an empty table gives no rows. Columns named n_lines or n_deleted, in any case, are replaced, others stay.
    Only the texts that may lose a line are shuffled, to meet the numbers of their lines.
    """
    ident, digest, deleted = fresh(docs, "id_key", "digest_key", "deleted_key")
    found = repeated_lines(docs, id_col, text_col, min_words)
    found = found.select(F.col("id").alias(ident), F.col("digest").alias(digest), F.col("deleted").alias(deleted))
    text = F.col(f"`{text_col}`")
    keyed = docs.withColumns({ident: F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)), digest: F.xxhash64(text)})
    touched, whole = split_by_sieve(keyed, found, ident, digest)
    lines = F.split(text, "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), deleted)
    kept = F.when(F.col(deleted).isNull(), text).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines")
    others = [c for c in docs.columns if c.lower() not in ("n_lines", "n_deleted")]
    met = touched.join(found.hint("merge"), [ident, digest], "left")
    met = met.select(*[F.col(f"`{c}`") if c != text_col else kept.alias(c) for c in others], n_lines, F.coalesce(F.size(deleted), F.lit(0)).cast("long").alias("n_deleted"))
    return met.unionByName(whole.select(*[F.col(f"`{c}`") for c in others], n_lines, F.lit(0).cast("long").alias("n_deleted")))
