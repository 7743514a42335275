"""LM scoring by cross-entropy difference of two n-gram models over one vocabulary of hashed words.

Tokens are runs of letters, digits and bytes from 0x80 on (A-Z lower-cased) and single other signs; blanks part
them. A target model counts documents that are labelled good, a background model every document of the corpus.
Both share vocabulary, smoothing and inventory of contexts, and a document's score is the mean of its tokens'
losses, target minus background: the lower, the closer to the target.

A model has two parts.

- Short contexts: words and pairs of words, hashed into `WORDS` and `PAIRS` slots, whose sums (a fixed number)
  reach the driver and go to every task.
- Long contexts: three words, then the word after them, for every token of every text. Their counts grow with the
  corpus and stay in Spark: chunks of texts send each of their n-grams once, with its number there, to the bucket of
  its context, which sums them and sends two weights for each back to every chunk that asked. The contexts are dealt
  by hash into `PASSES` lots that go one after the other, so that but one lot's n-grams are on disk at a time. A
  caller may set `SPARSE` to keep but one in so many contexts, by hash; a token after any other has its short one alone.

With c the count of an n-gram, n that of its context and u the number of words seen after it, a long context says
((c - D) + D u p) / n, where p is what the short context says.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import buffer_of, slices, slots_for, small_batches, split_by_sieve, texts_of
from lectern.session import discard, materialise

WORDS, PAIRS = 1 << 16, 1 << 18
#: One in so many contexts of three words is in the inventory: all of them.
SPARSE = 1
#: Lots of contexts, counted one after the other: each token's n-gram is 16 bytes, several times its text.
PASSES = 4
#: Bytes of text in a chunk (a longer document is one alone), within which an n-gram is sent once.
CHUNK = 2 << 20
#: Tokens of a lot that a bucket meets, and the least number of buckets, of `LEAST_TOKENS` each, that a lot is dealt into.
BUCKET_TOKENS, LEAST_BUCKETS, LEAST_TOKENS = 1 << 20, 64, 1 << 16
#: Weight of a pair's last word alone, in counts, and what a long n-gram's count is discounted by.
BACK_OFF, DISCOUNT = 50.0, 0.75

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * _M2
    return h ^ h >> np.uint64(29)


def _byte_kinds() -> tuple[np.ndarray, np.ndarray]:
    """(lower-cased byte, kind) of each byte; kinds: 0 blank, 1 of a word, 2 a sign of its own."""
    lower, kind = np.arange(256, dtype=np.uint64), np.full(256, 2, np.int8)
    lower[65:91] += np.uint64(32)
    kind[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 95]] = 1
    kind[[9, 10, 11, 12, 13, 32]] = 0
    return lower, kind


_LOWER, _KIND = _byte_kinds()


def tokens_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens of a run of texts, number of tokens of each text)."""
    kind = _KIND[raw]
    inner = np.zeros(len(raw), bool)  # goes on with the token of the byte before
    inner[1:] = (kind[1:] == 1) & (kind[:-1] == 1)
    inner[offsets[:-1][offsets[:-1] < len(raw)]] = False
    start = np.flatnonzero((kind > 0) & ~inner)
    if not len(start):
        return np.empty(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    used = np.flatnonzero(kind > 0)
    place = np.cumsum(kind > 0) - 1  # of a byte among those used
    first = place[start]
    into = np.arange(len(used)) - np.repeat(first, np.diff(np.append(first, len(used))))
    with np.errstate(over="ignore"):
        parts = _mix((_LOWER[raw[used]] + np.uint64(1) + into.astype(np.uint64) * np.uint64(259)) * _M1)
        hashes = _mix(np.add.reduceat(parts, first))
    return hashes, np.diff(np.searchsorted(start, offsets)).astype(np.int64)


def contexts_of(tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the last token, of the last three tokens, of those and the token itself) for each token; texts begin with nothing."""
    into = np.arange(len(tokens)) - np.repeat(np.cumsum(n) - n, n)
    back = []
    for k in (1, 2, 3):
        earlier = np.zeros(len(tokens), np.uint64)
        earlier[k:] = tokens[:-k]
        earlier[into < k] = 0
        back.append(earlier)
    with np.errstate(over="ignore"):
        context = _mix((back[2] * _M1 + back[1]) * _M1 + back[0])
        return back[0], context, _mix(context * _M1 + tokens)


def _slots(tokens: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The slots of each token, of its pair and of the token before it."""
    with np.errstate(over="ignore"):
        pair = _mix(last * _M1 + tokens) % np.uint64(PAIRS)
    return (tokens % np.uint64(WORDS)).astype(np.int64), pair.astype(np.int64), (last % np.uint64(WORDS)).astype(np.int64)


def targets_of(labels: DataFrame, id_col: str) -> DataFrame:
    """(id): the labelled documents of which the target model is made, all that are good."""
    return labels.filter("quality = 1").select(F.col(f"`{id_col}`").cast("long").alias("id")).filter("id is not null").distinct()


def _marked(docs: DataFrame, targets: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, good): the targets grow with the corpus, so they are joined; texts that cannot be one's are not shuffled."""
    rows = texts_of(docs, id_col, text=text_col).withColumnRenamed(id_col, "id").withColumn("id", F.col("id").cast("long"))
    touched, others = split_by_sieve(rows, targets, "id", slots=slots_for(targets.count()))
    met = touched.join(targets.withColumn("good", F.lit(True)), "id", "left").select("id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    return met.union(others.select("id", "text", F.lit(False)))


#: A chunk of texts in a row: each text's id, whether it is a target's, where its bytes end, and the bytes of all, compressed.
CHUNKS = "ids array<long>, good array<boolean>, ends array<long>, body binary"
#: Small row groups, since a reader holds one whole.
_CHUNK_FILES = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "1"}


def chunks_of(marked: DataFrame) -> DataFrame:
    """(chunk, ids, good, ends, body): the texts in chunks that later steps find again, whatever tasks they run in."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            held.append((batch.column("id"), batch.column("good"), *buffer_of(batch.column("text"))))
            size += len(held[-1][2])
            if size >= CHUNK:
                yield _chunk(held)
                held, size = [], 0
        if held:
            yield _chunk(held)

    return marked.mapInArrow(pack, CHUNKS).withColumn("chunk", F.monotonically_increasing_id())


def _chunk(held: list[tuple]) -> pa.RecordBatch:
    ids, good, raw, offsets = zip(*held)
    ends = np.cumsum(np.concatenate([np.diff(x) for x in offsets]))
    row = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (pa.concat_arrays(ids), pa.concat_arrays(good), pa.array(ends))]
    body = pa.compress(np.concatenate(raw).tobytes(), codec="zstd", asbytes=True)
    return pa.RecordBatch.from_arrays([*row, pa.array([body], pa.binary())], names=["ids", "good", "ends", "body"])


def _texts(row: pa.RecordBatch | pa.Table, at: int = 0) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, good, tokens, tokens of each text) of the chunk in a row."""
    ids, good, ends = (row.column(name)[at].values for name in ("ids", "good", "ends"))
    ends = ends.to_numpy()
    raw = np.frombuffer(pa.decompress(row.column("body")[at].as_py(), int(ends[-1]), codec="zstd"), np.uint8)
    offsets, tokens, n, first = np.concatenate([[0], ends]), [], [], 0
    while first < len(ends):  # about 256 KB at a time, for the cache's sake
        upto = max(first + 1, int(np.searchsorted(offsets, offsets[first] + (1 << 18), "right")) - 1)
        part = tokens_of(raw[offsets[first] : offsets[upto]], offsets[first : upto + 1] - offsets[first])
        tokens.append(part[0])
        n.append(part[1])
        first = upto
    return ids, good.to_numpy(zero_copy_only=False), np.concatenate(tokens), np.concatenate(n)


def fit_short(chunks: DataFrame) -> np.ndarray:
    """Counts of the short contexts, target and background: slots of words, of pairs, of words that a pair begins with."""
    size = 2 * WORDS + PAIRS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, size), np.int64)
        for batch in batches:
            for k in range(len(batch)):
                _, good, tokens, n = _texts(batch, k)
                word, pair, before = _slots(tokens, contexts_of(tokens, n)[0])
                for m, at in enumerate((np.repeat(good, n), slice(None))):
                    for base, slots in ((0, word), (WORDS, pair), (WORDS + PAIRS, before)):
                        found = np.bincount(slots[at])
                        sums[m, base : base + len(found)] += found
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["slot", "target", "background"])

    counts = np.zeros((2, size))
    counted = chunks.select("ids", "good", "ends", "body").mapInArrow(count, "slot int, target long, background long")
    summed = counted.groupBy("slot").agg(F.sum("target").alias("target"), F.sum("background").alias("background"))
    for batch in summed.toArrow().to_batches():  # a fixed number of slots
        at = batch.column("slot").to_numpy()
        counts[0, at], counts[1, at] = batch.column("target").to_numpy(), batch.column("background").to_numpy()
    return counts


def _short(counts: np.ndarray, word: np.ndarray, pair: np.ndarray, before: np.ndarray) -> np.ndarray:
    """What one model's short contexts say of each token."""
    words, pairs, begins = np.split(counts, [WORDS, WORDS + PAIRS])
    alone = (words[word] + 1) / (words.sum() + WORDS)
    return np.minimum((pairs[pair] + BACK_OFF * alone) / (begins[before] + BACK_OFF), 1.0)


def _lot(context: np.ndarray, gram: np.ndarray, lot: int, lots: int, buckets: int, sparse: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, firsts, bucket of each first): the tokens after one lot's contexts, by bucket and n-gram, and where each n-gram begins among them."""
    slot = (context >> np.uint64(20)) % np.uint64(lots * buckets)
    at = np.flatnonzero((slot // np.uint64(buckets) == lot) & (context % np.uint64(sparse) == 0))
    at = at[np.argsort(gram[at])]
    slot = (slot[at] % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
    order = np.argsort(slot, kind="stable")
    at, slot = at[order], slot[order].astype(np.int32)
    new = np.ones(len(at), bool)
    new[1:] = (gram[at[1:]] != gram[at[:-1]]) | (slot[1:] != slot[:-1])
    first = np.flatnonzero(new)
    return at, first, slot[first]


GRAMS = "bucket int, chunk long, context array<long>, gram array<long>, n array<int>, good array<int>"


def grams_of(chunks: DataFrame, lot: int, lots: int, buckets: int) -> DataFrame:
    """A row for each chunk and bucket: the chunk's n-grams of the lot, each once, their contexts and numbers, all texts' and targets'."""
    sparse = SPARSE

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                _, good, tokens, n = _texts(batch, k)
                _, context, gram = contexts_of(tokens, n)
                at, first, bucket = _lot(context, gram, lot, lots, buckets, sparse)
                if not len(at):
                    continue
                begin = np.flatnonzero(np.diff(bucket, prepend=-1))
                numbers = np.diff(np.append(first, len(at))), np.add.reduceat(np.repeat(good, n)[at].astype(np.int32), first)
                upto = pa.array(np.append(begin, len(first)).astype(np.int32))
                values = [x[at[first]].view(np.int64) for x in (context, gram)] + [x.astype(np.int32) for x in numbers]
                chunk = np.full(len(begin), batch.column("chunk")[k].as_py(), np.int64)
                lists = [pa.ListArray.from_arrays(upto, pa.array(x)) for x in values]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[begin]), pa.array(chunk), *lists], names=[c.split()[0] for c in GRAMS.split(", ")])

    return chunks.mapInArrow(compute, GRAMS)


WEIGHTS = "bucket int, chunk long, own_t array<float>, low_t array<float>, own_b array<float>, low_b array<float>"


def _weigh(rows: pa.Table) -> pa.Table:
    """A bucket's n-grams with the weights that the long contexts give: of the n-gram itself, and of what the short context says.

    A context that a model never saw says what the short one says.
    """
    context, gram, n, good = (pa.compute.list_flatten(rows[name]).to_numpy() for name in ("context", "gram", "n", "good"))
    grams, which = np.unique(gram, return_inverse=True)
    home = np.empty_like(grams)
    home[which] = context
    contexts, home = np.unique(home, return_inverse=True)
    weights = []
    for numbers in (good, n):
        c = np.bincount(which, numbers, len(grams))
        of, seen = np.bincount(home, c, len(contexts))[home], np.bincount(home, c > 0, len(contexts))[home]
        with np.errstate(divide="ignore", invalid="ignore"):
            weights += [np.where(of > 0, np.maximum(c - DISCOUNT, 0) / of, 0.0), np.where(of > 0, DISCOUNT * seen / of, 1.0)]
    upto = pa.array(np.cumsum([0, *pa.compute.list_value_length(rows["gram"]).to_pylist()]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(upto, pa.array(x.astype(np.float32)[which])) for x in weights]
    return pa.Table.from_arrays([rows["bucket"], rows["chunk"], *lists], names=[c.split()[0] for c in WEIGHTS.split(", ")])


SUMS = "chunk long, place int, id long, n_tokens long, target double, background double, n_long long, long_background double"


def _losses(counts: np.ndarray, lot: int, lots: int, buckets: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A chunk's texts and the weights that came for it, to each text's sums of losses over the lot's tokens; the first lot adds those without long contexts."""
    sparse = SPARSE

    def compute(chunk: pa.Table, weights: pa.Table) -> pa.Table:
        ids, _, tokens, n = _texts(chunk)
        last, context, gram = contexts_of(tokens, n)
        at, first, _ = _lot(context, gram, lot, lots, buckets, sparse)
        entry = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(at))))
        weights = weights.sort_by("bucket")
        text = np.repeat(np.arange(len(n)), n)
        others = np.flatnonzero(context % np.uint64(sparse) > 0) if lot == 0 else at[:0]
        sums = []
        for model, name in zip(counts, "tb"):
            own, low = (pa.compute.list_flatten(weights[f"{kind}_{name}"]).to_numpy()[entry].astype(float) for kind in ("own", "low"))
            loss = -np.log(np.minimum(own + low * _short(model, *_slots(tokens[at], last[at])), 1.0))
            alone = -np.log(_short(model, *_slots(tokens[others], last[others])))
            long = np.bincount(text[at], loss, len(n)).astype(float)
            sums.append((long + np.bincount(text[others], alone, len(n)), long))
        values = [np.full(len(n), chunk["chunk"][0].as_py(), np.int64), np.arange(len(n), dtype=np.int32), ids, n, sums[0][0], sums[1][0], np.bincount(text[at], minlength=len(n)), sums[1][1]]
        return pa.Table.from_arrays([pa.array(x) for x in values], names=[c.split()[0] for c in SUMS.split(", ")])

    return compute


def loss_sums(chunks: DataFrame, counts: np.ndarray) -> DataFrame:
    """Each text's sums of losses, lot after lot; what a lot shuffles and writes goes before the next."""
    tokens, parts = int(counts[1, :WORDS].sum()), []
    buckets = max(-(-tokens // (PASSES * BUCKET_TOKENS)), min(LEAST_BUCKETS, -(-tokens // (PASSES * LEAST_TOKENS))), 1)
    for lot in range(PASSES):
        weights = materialise(grams_of(chunks, lot, PASSES, buckets).groupBy("bucket").applyInArrow(_weigh, WEIGHTS), "lm-weights")
        met = chunks.groupBy("chunk").cogroup(weights.groupBy("chunk")).applyInArrow(_losses(counts, lot, PASSES, buckets), SUMS)
        parts.append(materialise(met, "lm-sums"))
        discard(weights)
    return reduce(DataFrame.unionByName, parts)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_tokens, target_loss, background_loss (nats per token), score, n_long, long_loss.

    score is target_loss - background_loss; n_long counts the tokens after long contexts and long_loss is their
    mean background loss, null without any. `labels` (id, quality) marks the target's documents with 1; without
    any, the target model is uniform. Null and empty texts, and texts of blanks, have no tokens and null losses
    and score. Repeated rows and null ids each get a row; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    targets = materialise(targets_of(labels, id_col), "lm-targets")
    chunks = materialise(chunks_of(_marked(docs, targets, id_col, text_col)), "lm-chunks", **_CHUNK_FILES)
    sums = loss_sums(chunks, fit_short(chunks))
    discard(targets, chunks)
    summed = sums.groupBy("chunk", "place", "id", "n_tokens").agg(*[F.sum(c).alias(c) for c in ("target", "background", "n_long", "long_background")])
    n, n_long = (F.nullif(c, F.lit(0)) for c in ("n_tokens", "n_long"))
    target, background = F.col("target") / n, F.col("background") / n
    return summed.select(
        F.col("id").alias(id_col), "n_tokens", target.alias("target_loss"), background.alias("background_loss"),
        (target - background).alias("score"), "n_long", (F.col("long_background") / n_long).alias("long_loss"),
    )
