"""Phrase collocations from generalised suffix automata.

A task reads its texts in shards. The words of a shard, in pieces that no phrase crosses, make one generalised suffix
automaton of bounded depth: a state is a set of end positions, which all the phrases of the state share, its link
leads to the state of the longest suffix with more end positions, and its count is the number of end positions. The
automaton is built by refinement: two positions are in one class of depth k if their last k words agree, so the
classes of all depths are the link tree. Phrases of a state with their counts are what leaves the shard, and Spark
adds the counts of all shards.

Depths are counted one after another. A phrase of k words is found 100 times only if both its parts of k - 1 words
are, so the phrases that were frequent mark a sieve of bounded size, and a shard leaves out what the sieve rules out.
What passes it by chance is counted like the rest and falls at the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import small_batches
from lectern.session import materialise

#: Bytes of text in one shard's automaton.
SHARD = 4 << 20
#: Bits of a sieve: a power of two, eight for each frequent phrase, between these bounds.
SIEVE_BITS = (1 << 16, 1 << 27)
#: Buckets that a language's phrases are dealt to before its best are chosen.
BUCKETS = 64
#: Languages whose totals are broadcast; more are joined.
FEW_LANGUAGES = 10_000

# Signs that end a piece, and signs that part words.
_ENDS, _BLANKS = b".,;:!?\n\v\f\r", b" \t"


def _byte_classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(_BLANKS)], out[list(_ENDS)] = 1, 2
    return out


_CLASS = _byte_classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def parts_of(text: bytes, size: int, overlap: int) -> Iterator[tuple[bytes, int]]:
    """(part, words that an earlier part has counted) of a long text: cut behind the end of a piece, or, in a piece
    longer than `size`, before a word, and then with the `overlap` words before it again."""
    at, before = 0, 0
    while len(text) - at > size:
        window = text[at : at + size]
        cut = max(window.rfind(bytes([b])) for b in _ENDS) + 1
        if cut:
            yield window[:cut], before
            at, before = at + cut, 0
            continue
        cut = at + max(window.rfind(b" "), window.rfind(b"\t")) + 1
        start, words = cut, 0
        while start > at and words < overlap:
            body = text[at:start].rstrip(_BLANKS)
            start = at + max(body.rfind(b" "), body.rfind(b"\t")) + 1
            words += bool(body)
        if start <= at:  # a word, or a few, as long as a part: take in more of the text
            size *= 2
            continue
        yield text[at:cut], before
        at, before = start, words
    yield text[at:], before


def mixed(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes."""
    x = first * np.uint64(0x9E3779B97F4A7C15) ^ second
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.cast(pa.string()).to_numpy(zero_copy_only=False).astype(object), categorize=False)


class Automaton:
    """The generalised suffix automaton of a shard, down to a depth.

    `words` has the word id of each position, `room` how many words of its piece stand up to it. `deepen` refines the
    classes by one word and keeps the positions that `allowed` admits. Class arrays are aligned with `ends`, the end
    positions that have a phrase of the present depth.
    """

    def __init__(self, words: np.ndarray, room: np.ndarray):
        self.words, self.room, self.depth = words, room, 1
        self.ends, self.classes = np.arange(len(words)), words.astype(np.int64)
        self.count = np.bincount(self.classes, minlength=int(words.max()) + 1 if len(words) else 0)

    def deepen(self, allowed: np.ndarray | None = None) -> None:
        """To phrases of one word more; `allowed` says of each end position whether its longer phrase may be frequent."""
        k = self.depth
        longer = self.room[self.ends] > k
        if allowed is not None:
            longer &= allowed
        self.ends, link = self.ends[longer], self.classes[longer]
        pairs = link * np.int64(len(self.words) + 1) + self.words[self.ends - k]
        distinct, self.classes = np.unique(pairs, return_inverse=True)
        self.count = np.bincount(self.classes, minlength=len(distinct))
        self.link, self.depth = distinct // (len(self.words) + 1), k + 1

    def states(self, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(an end position, the number of end positions that are to be counted) of each class of the present depth."""
        first = np.full(len(self.count), -1, np.int64)
        first[self.classes] = self.ends
        n = np.bincount(self.classes, weights=counted[self.ends], minlength=len(self.count)).astype(np.int64)
        kept = n > 0
        return first[kept], n[kept]


class _Shard:
    """The words of some texts of one or more languages."""

    def __init__(self, texts: list[bytes], langs: list[str], before: list[int]):
        buffer = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        classes = _CLASS[buffer]
        inside = classes == 0
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        starts, ends = edge[0::2], edge[1::2]
        lengths = ends - starts
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(buffer[inside]))]).dictionary_encode()
        self.dictionary = words.dictionary.cast(pa.large_string()) if len(starts) else pa.array([], pa.large_string())
        upto = np.concatenate([[0], np.cumsum(classes == 2)])
        piece = upto[starts]
        number = np.arange(len(starts))
        fresh = np.diff(piece, prepend=-1) != 0
        self.room = number - np.maximum.accumulate(np.where(fresh, number, 0)) + 1
        text_ends = np.cumsum([len(t) + 1 for t in texts])
        text = np.searchsorted(text_ends, starts, "right")
        self.langs, which = np.unique(np.array(langs, object).astype(str), return_inverse=True)
        self.lang = which[text]
        first = np.searchsorted(text, np.arange(len(texts)))
        self.counted = number - first[text] >= np.array(before)[text]
        # A word of another language is another word.
        ids = words.indices.to_numpy(zero_copy_only=False).astype(np.int64) if len(starts) else np.empty(0, np.int64)
        self.pairs, self.ids = np.unique(self.lang * np.int64(max(1, len(self.dictionary))) + ids, return_inverse=True)
        self.of_pair = self.pairs % max(1, len(self.dictionary))

    def hashes(self) -> np.ndarray:
        """The hash of the word, with its language, at each position."""
        by_word = word_hashes(self.dictionary)[self.of_pair]
        by_lang = word_hashes(pa.array(self.langs))[self.pairs // max(1, len(self.dictionary))]
        return mixed(by_lang, by_word)[self.ids]

    def phrases(self, ends: np.ndarray, k: int) -> pa.Array:
        columns = [self.dictionary.take(pa.array(self.of_pair[self.ids[ends - i]])) for i in range(k - 1, -1, -1)]
        return columns[0] if k == 1 else pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()))


def _shards(batches: Iterator[pa.RecordBatch], depth: int, limit: int) -> Iterator[_Shard]:
    texts, langs, before, size = [], [], [], 0
    for batch in batches:
        for text, lang in zip(batch.column("text").cast(pa.large_binary()), batch.column("lang").to_pylist(), strict=True):
            for part, done in parts_of(text.as_py(), limit, depth - 1):
                texts.append(part)
                langs.append(lang)
                before.append(done)
                size += len(part)
                if size >= limit:
                    yield _Shard(texts, langs, before)
                    texts, langs, before, size = [], [], [], 0
    if texts:
        yield _Shard(texts, langs, before)


def _passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(len(bits) * 8 - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counts(source: DataFrame, depth: int, sieves: list, shard_bytes: int) -> DataFrame:
    """(lang, phrase, n) of the phrases of `depth` words that the sieves of lesser depths let pass, one row a shard, and
    at depth 1 a row without phrase with the number of all words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, depth, shard_bytes):
            if not len(shard.ids):
                continue
            automaton = Automaton(shard.ids, shard.room)
            hashes = shard.hashes() if depth > 1 else None
            words, alive = hashes, np.ones(len(shard.ids), bool)
            for k in range(1, depth):
                bits = np.frombuffer(sieves[k - 1].value, np.uint8)
                frequent = np.zeros(len(shard.ids), bool)
                frequent[automaton.ends] = _passes(bits, hashes[automaton.ends])
                alive = frequent & alive
                # Of a longer phrase both the part that ends here and the one that ends a word before must be frequent.
                both = alive & np.concatenate([[False], alive[:-1]])
                longer = hashes.copy()
                longer[1:] = mixed(hashes[:-1], words[1:])
                automaton.deepen(both[automaton.ends])
                alive = np.zeros(len(shard.ids), bool)
                alive[automaton.ends] = True
                hashes = longer
            ends, n = automaton.states(shard.counted)
            lang = pa.array(shard.langs[shard.lang[ends]], pa.string())
            rows = pa.RecordBatch.from_arrays([lang, shard.phrases(ends, depth).cast(pa.string()), pa.array(n)], ["lang", "phrase", "n"])
            yield from (rows.slice(i, 50_000) for i in range(0, len(rows), 50_000))
            if depth == 1:
                total = np.bincount(shard.lang, weights=shard.counted, minlength=len(shard.langs)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(shard.langs, pa.string()), pa.nulls(len(total), pa.string()), pa.array(total)], ["lang", "phrase", "n"])

    return source.mapInArrow(work, "lang string, phrase string, n long")


def phrase_hash(langs: pa.Array, phrases: pa.Array, depth: int) -> np.ndarray:
    """The hash by which a shard looks a phrase of `depth` words up in a sieve."""
    words = pc.split_pattern(phrases, " ").flatten()
    coded = words.dictionary_encode()
    by_word = word_hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)].reshape(-1, depth)
    coded = langs.dictionary_encode()
    by_lang = word_hashes(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    single = [mixed(by_lang, by_word[:, k]) for k in range(depth)]
    out = single[0]
    for x in single[1:]:
        out = mixed(out, x)
    return out


def _sieve(frequent: DataFrame, depth: int, bits: int):
    """The phrases as bits, broadcast: `bits` / 8 bytes, whatever their number."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                slot = phrase_hash(batch.column("lang"), batch.column("phrase"), depth) & np.uint64(bits - 1)
                yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array(np.left_shift(np.uint64(1), slot & np.uint64(63)).view(np.int64))], ["word", "mask"])

    words = frequent.select("lang", "phrase").mapInArrow(slots, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    filled = words.toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[filled["word"].to_numpy(np.int64)] = filled["mask"].to_numpy(np.int64)
    return frequent.sparkSession.sparkContext.broadcast(out.tobytes())


def frequent_phrases(docs: DataFrame, most: int = 5, least: int = 100, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, n) of all phrases of 1 to `most` words that occur `least` times, and (lang, n) of all words.

    A null text is empty, a null language is `und`. Both results are written tables.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    sieves, found, totals = [], [], None
    for depth in range(1, most + 1):
        counted = _counts(source, depth, sieves, shard_bytes).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        level = materialise(counted.filter((F.col("n") >= least) | F.col("phrase").isNull()), f"phrases-{depth}")
        if depth == 1:
            totals, level_rows = level.filter("phrase is null").select("lang", "n"), level.filter("phrase is not null")
        else:
            level_rows = level
        found.append(level_rows.withColumn("words", F.lit(depth)))
        number = level_rows.count()
        if not number:
            break
        if depth < most:
            low, high = SIEVE_BITS
            sieves.append(_sieve(level_rows, depth, min(high, max(low, 1 << (8 * number - 1).bit_length()))))
    for s in sieves:
        s.unpersist()
    out = found[0]
    for level in found[1:]:
        out = out.union(level)
    return out.select("lang", "phrase", "words", "n"), totals


def _words(phrase: Column, begin: int, length: int) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), begin, length), " ")


def collocations(docs: DataFrame, most: int = 5, least: int = 100, top: int = 2000, text_col: str = "text", lang_col: str = "lang", shard_bytes: int = SHARD) -> DataFrame:
    """The `top` phrases of each language by association, without those that a longer phrase subsumes.

    A phrase of 2 to `most` words is a candidate if it occurs a >= `least` times within pieces, overlaps included. Cut
    after its first k words it has l and r, the counts of both parts, and the score floor(1000 a n / (l r)), n being
    the number of all words of its language; the cut of least score counts, of equal scores the first. A candidate
    falls if it lies in a longer phrase that occurs as often. Products are exact up to 38 digits.

    Returns lang, rank, phrase, a, l, r, n, score. Texts are lower-cased in A-Z, and only there. A null text is empty,
    a null language is `und`; repeated rows count as often as they come; other columns are ignored; an empty table
    gives no rows.
    """
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(BUCKETS))
    frequent, totals = frequent_phrases(docs, most, least, text_col, lang_col, shard_bytes)
    candidates = frequent.filter("words > 1")
    # A phrase has no more end positions than its suffix link, and as many only if both are of one state; the same for prefixes.
    # So a phrase falls if one that is a word longer has its count, and then every one in between has it too.
    shorter = F.explode(F.array(_words(F.col("phrase"), 1, F.col("words") - 1), _words(F.col("phrase"), 2, F.col("words") - 1)))
    longer = candidates.filter("words > 2").select("lang", "n", shorter.alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    kept = candidates.join(longer, ["lang", "phrase"], "left").filter("longer is null or longer < n").select("lang", "phrase", "words", F.col("n").alias("a"))
    cut = F.explode(F.expr("sequence(1, words - 1)"))
    cuts = kept.select("*", cut.alias("k")).select("*", _words(F.col("phrase"), 1, F.col("k")).alias("head"), _words(F.col("phrase"), F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    counts = frequent.select("lang", "phrase", "n")
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"]).join(counts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    if totals.count() <= FEW_LANGUAGES:
        cuts = cuts.join(F.broadcast(totals), "lang")
    else:  # dealt by bucket too, since one language may hold most phrases
        copies = totals.select("lang", "n", F.explode(F.expr(f"sequence(0L, {BUCKETS - 1}L)")).alias("bucket"))
        cuts = cuts.withColumn("bucket", bucket).join(copies, ["lang", "bucket"]).drop("bucket")
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    score = F.call_function("div", (wide["a"] * wide["n"]) * F.lit(1000).cast("decimal(4,0)"), wide["l"] * wide["r"])
    scored = cuts.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    scored = scored.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each bucket first, so no task sorts a whole language.
    first = scored.withColumn("bucket", bucket).withColumn("place", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).filter(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
