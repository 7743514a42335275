"""Token-id files: Parquet list columns with dictionary or delta encoding, bounded row groups and page indexes.

A file set holds one row per document in ascending id order over files numbered by `part`:
doc_id, part, offset (ids of earlier documents of the part), n_tokens, ids (list of int32, end id included).
The scalar columns can be read without touching the ids, and page indexes let a range of documents be read
without decoding the rest.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lectern.llm.common import small_batches, texts_of

#: Pieces whose ids a worker remembers; the table is emptied beyond it. Results do not depend on it.
PIECES = 600_000
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
SCHEMA = "doc_id long, part int, offset long, n_tokens long, ids array<int>"


# The normaliser and the pre-tokeniser of the vocabulary that words can be encoded for one by one.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PIECE_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": PIECE_PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Signs that stay as they are in NFC and lower-case one by one: printable ASCII, and composed Latin letters.
_PLAIN = r"!-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F"
_BLANK = r" \t-\r"
_odd = re.compile(rf"[^{_PLAIN}{_BLANK}]|<\|").search
_odd_words = re.compile(rf"[^{_BLANK}]*?(?:[^{_PLAIN}{_BLANK}]|<\|)[^{_BLANK}]*").finditer
_LETTER = r"a-z\u00DF-\u00F6\u00F8-\u024F"
#: The vocabulary's pattern for lower-cased plain signs. Letters come first, which no other branch can begin with.
_pieces_of = re.compile(rf"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s{_LETTER}0-9]+").findall
#: Plain signs and blanks of one byte.
_PLAIN_BYTES = bytes([*range(0x21, 0x7F), *b" \t\n\v\f\r"])


def _byte_signs() -> dict[int, int]:
    """The sign that the pre-tokeniser puts for each byte: its Latin-1 sign if that prints, else the next from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in prints} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in prints)}


_SIGNS = _byte_signs()


class Encoder(dict):
    """Ids of texts, for a vocabulary whose rules never carry anything across ASCII white space.

    Words of plain signs are parted by the vocabulary's own pattern and each piece is merged by the vocabulary's
    model; other words go through the whole tokenizer. The mapping remembers the pieces that came before. A
    vocabulary with other rules, or with added tokens that are no "<|...|>", gets each text whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        model = rules["model"]
        self.by_piece = (
            rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == PRE_TOKENIZER and rules["post_processor"] is None
            and rules["truncation"] is None and rules["padding"] is None and model["type"] == "BPE" and model["dropout"] is None
            and model["unk_token"] is None and not model["continuing_subword_prefix"] and all(re.fullmatch(r"<\|[^\s|]+\|>", t["content"]) for t in rules["added_tokens"])
        )

    def __missing__(self, piece: str) -> bytes:
        found = [t.id for t in self.merge(piece if piece.isascii() else piece.encode().decode("latin-1").translate(_SIGNS))]
        ids = self[piece] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def _whole(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian uint32."""
        if not self.by_piece:
            return self._whole([text])[0]
        if len(self) > PIECES:
            self.clear()
        of, out, at = self.__getitem__, [], 0
        rest = text.encode().translate(None, _PLAIN_BYTES)
        if "<|" in text or rest and _odd(rest.decode()):
            odd = list(_odd_words(text))
            for m, ids in zip(odd, self._whole([m.group() for m in odd]), strict=True):
                out += map(of, _pieces_of(text[at : m.start()].lower()))
                out.append(ids)
                at = m.end()
        out += map(of, _pieces_of(text[at:].lower()))
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", encoding: str = "dictionary") -> None:
    """Encode every whole text of `docs`, append `end_id` to each and write the file set to `path`.

    `vocabulary` is the path of a tokenizers JSON file. `encoding` is "dictionary" or "delta" (binary packed).
    Null and empty texts give the end id alone; repeated rows are written as often as they come; rows with a
    null id come first; an empty table gives an empty file set.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    spark = docs.sparkSession
    small_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, offset = TaskContext.get().partitionId(), 0
        end, encode_text = end_id.to_bytes(4, "little"), encoder(vocabulary).encode
        for batch in batches:
            found = [encode_text(x or "") + end for x in batch.column("text").to_pylist()]
            if not found:
                continue
            n = np.array([len(x) >> 2 for x in found], np.int64)
            upto = np.cumsum(n)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]).astype(np.int32)), pa.array(np.frombuffer(b"".join(found), "<i4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(offset + upto - n), pa.array(n), ids], names=["doc_id", "part", "offset", "n_tokens", "ids"]
            )
            offset += int(upto[-1])

    source = texts_of(docs, id_col, text=text_col).withColumnRenamed(id_col, "doc_id").withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = source.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id")
    (
        ordered.mapInArrow(encode, SCHEMA).write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
        .option("parquet.writer.version", "v2").option("parquet.enable.dictionary", str(encoding == "dictionary").lower()).parquet(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, part; the ids themselves are not read."""
    rows = spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "offset", "n_tokens")
    return _with_start(spark, path, rows)


def _with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    # One row per part: their number is that of the shuffle's partitions, not of the documents.
    sizes = spark.read.schema(SCHEMA).parquet(path).groupBy("part").agg(F.max(F.col("offset") + F.col("n_tokens")).alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("offset")).drop("base", "offset")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids of the documents low <= doc_id < high; the bounds reach the page indexes."""
    rows = spark.read.schema(SCHEMA).parquet(path)
    if low is not None:
        rows = rows.filter(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.filter(F.col("doc_id") < high)
    return _with_start(spark, path, rows).drop("part")


@F.pandas_udf(LongType())
def ids_crc32(ids: pd.Series) -> pd.Series:
    """The unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return pd.Series([zlib.crc32(x.astype("<i4", copy=False)) for x in ids], dtype="int64")
