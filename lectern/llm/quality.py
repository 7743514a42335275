"""Quality rules: hard text rules, then a hashed n-gram likelihood ratio between trusted and raw text.

Tokens (runs of letters and digits, runs of other signs) and pairs of neighbours are hashed into `BUCKETS` buckets. Two multinomials over the buckets, one from trusted
documents and one from the whole raw corpus, give each document the mean of log p_trusted - log p_raw over its
n-grams. A document is kept when it breaks no hard rule and that mean is at least a fixed threshold, so the
verdict on a document depends on nothing but its text and the two models.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import small_batches, texts_of, utf8

BUCKETS = 10_000
#: Trusted documents of which the target model is made, at most: those of the least hashed ids. It bounds what is broadcast.
TRUSTED = 50_000
#: Mean log ratio (nats per n-gram) below which a document goes. Ordinary documents lie near or above 0, junk far below.
THRESHOLD = -0.1
#: Words below which a text fails the hard rules.
MIN_WORDS = 50
#: The trusted model is drawn towards the raw one by this many n-grams for each bucket, so rare buckets say little.
PRIOR = 20

_TOKEN = re.compile(rb"[A-Za-z0-9_\x80-\xff]+|[^A-Za-z0-9_\x80-\xff\s]+")
_SPACE = " \t\n\v\f\r"


def buckets_of(raw: bytes) -> np.ndarray:
    """The bucket of each token and of each pair of neighbouring tokens of one UTF-8 text."""
    tokens = _TOKEN.findall(raw)
    h = np.fromiter(map(zlib.crc32, tokens), np.uint64, len(tokens))
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)
    return (np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def text_rules(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """(word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text with these words."""
    word_chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    repeat = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        seen: dict[tuple, int] = {}
        for w in windows:
            seen[w] = seen.get(w, 0) + 1
        twice = np.array([seen[w] > 1 for w in windows])
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(windows)] |= twice
        repeat = int(covered.sum())
    return word_chars, symbols, len(lines) - len(set(lines)), repeat


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """log p_trusted - log p_raw by bucket.

    The raw model counts the n-grams of all of `docs`; the trusted model those of the documents that `labels`
    (`id_col`, quality) marks 1, up to `TRUSTED` of them. Counts are summed by Spark; only the `BUCKETS` sums
    reach the driver.
    """
    small_batches(docs.sparkSession)
    trusted = labels.filter("quality = 1").select(F.col(f"`{id_col}`").cast("long").alias("id")).filter("id is not null").distinct()
    trusted = trusted.orderBy(F.xxhash64("id"), "id").limit(TRUSTED).withColumn("trusted", F.lit(True))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for raw, good in zip(utf8(batch.column("text")), batch.column("trusted").to_pylist(), strict=True):
                found = np.bincount(buckets_of(raw), minlength=BUCKETS)
                sums[0] += found
                if good:
                    sums[1] += found
        at = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[0][at]), pa.array(sums[1][at])], names=["bucket", "raw", "good"])

    rows = texts_of(docs, id_col, text=text_col).withColumnRenamed(id_col, "id").withColumn("id", F.col("id").cast("long"))
    marked = rows.join(F.broadcast(trusted), "id", "left").select("text", "trusted")
    model = np.zeros((2, BUCKETS))
    for r in marked.mapInArrow(count, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():
        model[:, r["bucket"]] = r["raw"], r["good"]
    return log_ratio(*model)


def log_ratio(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log p_trusted - log p_raw of each bucket; 0 where the raw corpus has none and all over without trusted text."""
    p_raw = raw / max(raw.sum(), 1)
    prior = PRIOR * BUCKETS * bool(good.any())
    p_good = (good + prior * p_raw) / max(good.sum() + prior, 1)
    ratio = np.ones(BUCKETS)
    np.divide(p_good, p_raw, out=ratio, where=(p_raw > 0) & (p_good > 0))
    return np.log(ratio)


def judge_text(raw: bytes, model: np.ndarray, threshold: float, min_words: int) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept) of one UTF-8 text."""
    words = raw.split()
    n = len(words)
    rules = text_rules(raw.decode(), words)
    failed = n < min_words or 100 * rules[3] > 50 * n
    llr = float(model[buckets_of(raw)].mean()) if n else 0.0
    return n, *rules, failed, llr, not failed and llr >= threshold


def accepted(docs: DataFrame, model: np.ndarray, text_col: str = "text", threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text the rules and the ratio accept; no row is moved."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        return pd.Series([judge_text((x or "").encode(), model, threshold, min_words)[-1] for x in texts], dtype=bool)

    return docs.filter(kept(F.col(f"`{text_col}`")))


def score(docs: DataFrame, model: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    Null texts have no words. A text without words has llr 0 and fails the hard rules. Repeated rows and null
    ids each get a row; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [judge_text(raw, model, threshold, min_words) for raw in utf8(batch.column("text"))]
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"])

    rows = texts_of(docs, id_col, text=text_col).withColumnRenamed(id_col, "id").withColumn("id", F.col("id").cast("long"))
    judged = rows.mapInArrow(judge, "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, llr double, kept boolean")
    return judged.withColumnRenamed("id", id_col)
