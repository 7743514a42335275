"""SentencePiece encoding and decoding as a shortest path in a weighted transducer.

The transducer is compiled once per worker from a public model file. Its normaliser rewrites by the model's own
character map, longest match first, trims and joins blanks if the model asks for it, and puts the dummy blank in
front if it asks for that. Its pieces are a trie whose final states emit an id at a cost, and byte fallback arcs
emit the UTF-8 bytes of one character. Composition with an input is lazy: the states of the composed machine are
(position, trie state), made while the input is read, and as that machine is acyclic its path of least total cost
(tropical semiring) is found in one sweep. Of paths of equal cost the one with the longer last piece wins, from
the end on.

Costs are -score in a unigram model, and a character spelled by bytes costs `FALLBACK` more than any piece. A BPE
model holds the order of its merges instead. There a further machine is composed, an acceptor of pairs of pieces:
b may follow a at no cost if merging the characters of a + b ends with just these two, and at infinite cost
otherwise. A sequence is the result of the merges exactly if each of its neighbours are, so one path has a finite
cost and its ids are those of the merges. Every prefix has one such path too, so a position has one state; the
longest arc is tried first, and a position that leads nowhere is not entered again.

No piece goes on after a word into a blank, and none joins a line end, or another character that the model keeps
by itself (often digits), to others. So the path of a text is that of its segments in a row, and a segment that
came before is not searched again.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import small_batches, texts_of

BLANK = "▁"
FALLBACK = 10.0
#: Segments whose ids a worker remembers, and the longest one it does; results do not depend on either.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 64
#: Pairs of pieces of which a worker remembers whether one may follow the other, and ids that are decoded at once.
PAIRS, DECODED = 800_000, 1 << 20


def character_map(blob: bytes) -> dict[str, str]:
    """The rewritings of a model's precompiled character map: a double-array trie, then its targets, each ended by a zero byte."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units, targets, found = struct.unpack_from(f"<{size // 4}I", blob, 4), blob[4 + size :], {}
    base = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
    open_states = [(base(units[0]), b"")]
    while open_states:
        at, prefix = open_states.pop()
        for c in range(1, 256):
            node = at ^ c
            if node >= len(units) or units[node] & 0x800000FF != c:
                continue
            below = node ^ base(units[node])
            if units[node] & 0x100:
                start = units[below] & 0x7FFFFFFF
                found[(prefix + bytes([c])).decode()] = targets[start : targets.index(0, start)].decode()
            open_states.append((below, prefix + bytes([c])))
    return found


class Normaliser:
    """What a model does to a text before its pieces: character map and blanks."""

    def __init__(self, spec):
        self.start: dict = {}
        for source, target in character_map(spec.precompiled_charsmap).items():
            state = self.start
            for c in source:
                state = state.setdefault(c, {})
            state[""] = target
        self.trims, self.prefix = spec.remove_extra_whitespaces, " " if spec.add_dummy_prefix else ""

    def rewrite(self, text: str) -> str:
        out, i = [], 0
        while i < len(text):
            state, j, end, target = self.start, i, i + 1, text[i]
            while j < len(text) and (state := state.get(text[j])) is not None:
                j += 1
                if "" in state:
                    end, target = j, state[""]
            out.append(target)
            i = end
        return "".join(out)

    def __call__(self, text: str) -> str:
        if self.start:
            text = self.rewrite(text)
        return re.sub(" +", " ", text).strip(" ") if self.trims else text


class Transducer:
    """Normaliser, pieces and byte fallback, compiled from a SentencePiece model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = {i: p for i, p in enumerate(model.pieces) if p.type in (1, 4)}
        cost = {i: -p.score for i, p in normal.items()}
        self.unigram = model.trainer_spec.model_type == 1
        self.strings = [p.piece for p in model.pieces]
        self.order = {p.piece: -p.score for p in normal.values()}
        self.pairs: dict[int, bool] = {}
        # A state of the trie: its arcs by character, and the piece that ends there with its cost, or -1.
        self.start: list = [{}, -1, 0.0]
        self.bytes_of: dict[int, bytes] = {}
        self.byte_id = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(p.piece[3:5], 16)])
            elif i in normal:
                self.bytes_of[i] = p.piece.replace(BLANK, " ").encode()
                state = self.start
                for c in p.piece:
                    state = state[0].setdefault(c, [{}, -1, 0.0])
                state[1:] = i, cost[i]
        inner = [p.piece for p in normal.values() if BLANK in p.piece.lstrip(BLANK)]
        if inner or any("\n" in p.piece or "\0" in p.piece for p in normal.values()) or not all(self.byte_id):
            raise ValueError("pieces that cross blanks or line ends, or a model without byte fallback")
        spelled = [self.bytes_of.get(i, b"") for i in range(len(self.strings))]
        self.flat, self.sizes = np.frombuffer(b"".join(spelled), np.uint8), np.array(list(map(len, spelled)), np.int32)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.normalise = Normaliser(model.normalizer_spec)
        self.spelled = max(cost.values()) + FALLBACK
        self.known: dict[str, bytes] = {}
        joined = {c for p in self.order if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in sorted({p for p in self.order if len(p) == 1} - joined - {BLANK}))
        self.segments = re.compile(rf" *[^ \n{alone}]+| +|[\n{alone}]").findall

    def path(self, segment: str) -> list[int]:
        """The ids on the path of least cost through one segment."""
        # A blank is the symbol U+2581; that character itself, like a zero, can only be spelled by its bytes.
        symbols = segment.translate({32: BLANK, ord(BLANK): "\0"})
        out = []
        for i, piece in self.cheapest(symbols) if self.unigram else self.accepted(symbols):
            if piece < len(self.strings):
                out.append(piece)
            else:
                out += [self.byte_id[b] for b in segment[i].encode()]
        return out

    def cheapest(self, symbols: str) -> list[tuple[int, int]]:
        """The arcs (from, piece) of the path of least cost; a character by bytes is a number above all pieces."""
        n, spelled = len(symbols), len(self.strings)
        least, back = [0.0] + [math.inf] * n, [(0, 0)] * (n + 1)
        for i in range(n):
            at, state, j = least[i], self.start, i
            while j < n and (state := state[0].get(symbols[j])) is not None:
                j += 1
                if state[1] >= 0 and at + state[2] < least[j]:
                    least[j], back[j] = at + state[2], (i, state[1])
            if at + self.spelled < least[i + 1]:
                least[i + 1], back[i + 1] = at + self.spelled, (i, spelled)
        out = []
        while n:
            out.append(back[n])
            n = back[n][0]
        return out[::-1]

    def arcs(self, symbols: str, i: int) -> list[tuple[int, int]]:
        """The arcs (to, piece) that leave a position, the longest last."""
        state, out, j = self.start, [], i
        for c in symbols[i:]:
            state = state[0].get(c)
            if state is None:
                break
            j += 1
            if state[1] >= 0:
                out.append((j, state[1]))
        if not out or out[0][0] > i + 1:
            out.insert(0, (i + 1, len(self.strings) + ord(symbols[i])))
        return out

    def accepted(self, symbols: str) -> list[tuple[int, int]]:
        """The arcs (from, piece) of the one path of finite cost under the acceptor of pairs."""
        n, dead, pairs, arcs = len(symbols), set(), self.pairs, self.arcs
        stack = [(0, -1, arcs(symbols, 0))]
        while (at := stack[-1][0]) < n:
            _, before, open_arcs = stack[-1]
            while open_arcs:
                j, piece = open_arcs.pop()
                if j in dead:
                    continue
                fits = pairs.get((before + 1 << 21) + piece)
                if self.follows(before, piece) if fits is None else fits:
                    stack.append((j, piece, arcs(symbols, j) if j < n else ()))
                    break
            else:
                dead.add(at)
                stack.pop()
        return [(a[0], b[1]) for a, b in zip(stack, stack[1:])]

    def follows(self, a: int, b: int) -> bool:
        """Whether the acceptor lets b follow a; a is -1 at the start."""
        ends = [self.string(x) for x in (a, b) if x >= 0]
        found = self.merged("".join(ends)) == ends
        if len(self.pairs) < PAIRS:
            self.pairs[(a + 1 << 21) + b] = found
        return found

    def string(self, piece: int) -> str:
        return self.strings[piece] if piece < len(self.strings) else chr(piece - len(self.strings))

    def merged(self, symbols: str) -> list[str]:
        """What the merges, the first in order and the leftmost of equal ones, make of a few characters."""
        parts, order = list(symbols), self.order
        while joins := [(order[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in order]:
            k = min(joins)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text that is normalised already."""
        if not text:
            return np.empty(0, np.int32)
        out, known = [], self.known
        for s in self.segments(self.normalise.prefix + text):
            ids = known.get(s)
            if ids is None:
                ids = np.array(self.path(s), np.int32).tobytes()
                if len(s) <= REMEMBERED_LENGTH and len(known) < REMEMBERED:
                    known[s] = ids
            out.append(ids)
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        """The normalised text of ids; bytes that are no UTF-8 become U+FFFD."""
        parts = []
        for at in range(0, len(ids), DECODED):
            part = ids[at : at + DECODED]
            n = self.sizes[part]
            upto = np.cumsum(n)
            parts.append(self.flat[np.arange(upto[-1]) + np.repeat(self.starts[part] - (upto - n), n)].tobytes())
        return b"".join(parts).decode("utf-8", "replace")[len(self.normalise.prefix) :]


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_pieces, n_bytes (ids from byte fallback), ids, and the round trip's result.

    `model` is a model file's path. decoded_crc32 is that of the decoded UTF-8 text, exact whether decoding gave
    the normalised text back, which is the text itself if the model's normaliser changes nothing. Null and empty texts give no ids; every other text is encoded whole. Repeated rows and null
    ids each get a row; other columns are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        is_byte = np.zeros(max(machine.bytes_of) + 1, bool)
        is_byte[machine.byte_id] = True
        for batch in batches:
            texts = [machine.normalise(x or "") for x in batch.column("text").to_pylist()]
            found = [machine.encode(x) for x in texts]
            back = [machine.decode(x) for x in found]
            n = np.array([len(x) for x in found], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int32), *found])))
            columns = [
                pa.array(n), pa.array([int(is_byte[x].sum()) for x in found], pa.int64()), pa.array([zlib.crc32(x.encode()) for x in back], pa.int64()),
                pa.array([a == b for a, b in zip(texts, back, strict=True)], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns, ids], names=["id", "n_pieces", "n_bytes", "decoded_crc32", "exact", "ids"])

    rows = texts_of(docs, id_col, text=text_col).withColumnRenamed(id_col, "id").withColumn("id", F.col("id").cast("long"))
    return rows.mapInArrow(compute, "id long, n_pieces long, n_bytes long, decoded_crc32 long, exact boolean, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each row of ids; null and empty ids give the empty text."""
    small_batches(encoded.sparkSession)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for batch in batches:
            texts = [machine.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    rows = encoded.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    return rows.mapInArrow(compute, "id long, text string").withColumnRenamed("id", id_col)
