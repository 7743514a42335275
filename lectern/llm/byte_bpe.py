"""Ids of a byte-level BPE vocabulary for many texts at once.

The vocabulary's own rules part a text into pieces and merge inside a piece only. Here the pieces of a whole block
of texts are found on arrays, each distinct piece is given to the vocabulary once and remembered, and the ids are
put together on arrays again.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Distinct pieces that a worker remembers; later ones are encoded again in each block. Results do not depend on it.
PIECES = 600_000
#: Bytes of texts that are worked on at once; a longer text is cut where a piece begins in any case.
BLOCK = 4 << 20

# Fixed value: the pre-tokeniser of the vocabulary whose pieces can be found on arrays; its pattern is that of the library.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}

_BLANK, _LETTER, _DIGIT, _SIGN, _ODD = range(5)


def _classes() -> np.ndarray:
    """The class of each byte that begins a sign. Signs that are not ASCII or composed Latin letters are odd."""
    out = np.full(256, _ODD, np.uint8)
    for b in range(33, 127):
        out[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SIGN
    out[[9, 10, 11, 12, 13, 32]] = _BLANK
    out[[0xC3, 0xC4, 0xC5]] = _LETTER
    return out


def _byte_signs() -> dict[int, int]:
    """The sign that stands for each byte in the vocabulary: its Latin-1 sign if that prints, else the next from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in prints} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in prints)}


_CLASS, _SIGNS = _classes(), _byte_signs()
_cut = re.compile(rb"(?<=[a-z]) (?=[a-z])").search


def blocks(text: bytes, size: int = BLOCK) -> list[bytes]:
    """`text` in blocks of about `size` bytes; a block begins at a space between two letters, where a piece begins too."""
    out, at = [], 0
    while len(text) - at > size and (found := _cut(text, at + size)):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


class Vocabulary:
    """A tokenizers JSON file. Texts with odd signs or with what may be an added token go through the library whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.merge, model = self.tokenizer.model.tokenize, rules["model"]
        self.by_piece = (
            rules["normalizer"] is None and rules["pre_tokenizer"] == PRE_TOKENIZER and rules["post_processor"] is None and rules["truncation"] is None and rules["padding"] is None
            and model["type"] == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and all(t["content"].startswith("<|") for t in rules["added_tokens"])
        )
        self.known: dict[bytes, bytes] = {}

    def _whole(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _merged(self, piece: bytes) -> bytes:
        found = [t.id for t in self.merge(piece.decode("latin-1").translate(_SIGNS))]
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(self.known) < PIECES:
            self.known[piece] = ids
        return ids

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts one after another, the number of ids of each)."""
        buffer, lengths = np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        classes = _CLASS[buffer]
        inside = np.flatnonzero((buffer & 0xC0) == 0x80)
        classes[inside] = classes[inside - 1]
        odd = classes == _ODD
        odd[inside] |= (buffer[inside - 1] == 0xC3) & np.isin(buffer[inside], (0x97, 0xB7))  # the signs for times and division
        odd[:-1] |= (buffer[:-1] == ord("<")) & (buffer[1:] == ord("|"))
        upto = np.concatenate([[0], np.cumsum(odd)])
        strange = upto[ends] > upto[ends - lengths] if self.by_piece else np.ones(len(texts), bool)
        if not strange.any():
            return self._by_piece(buffer, classes, ends - lengths)
        kept = np.flatnonzero(~strange)
        flat, counts = self.encode([texts[k] for k in kept]) if len(kept) else (np.empty(0, np.uint32), [])
        parts: list = [None] * len(texts)
        for k, ids in zip(kept, np.split(flat, np.cumsum(counts)[:-1]) if len(kept) else [], strict=True):
            parts[k] = ids
        others = np.flatnonzero(strange)
        for k, ids in zip(others, self._whole([texts[k] for k in others]), strict=True):
            parts[k] = np.frombuffer(ids, "<u4")
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def _by_piece(self, buffer: np.ndarray, classes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(buffer)
        if not n:
            return np.empty(0, np.uint32), np.zeros(len(starts), np.int64)
        edge = np.zeros(n + 1, bool)
        edge[starts] = True
        edge[n] = True
        begins = edge.copy()
        begins[1:n] |= classes[1:] != classes[:-1]
        # The last blank before a sign stands alone, or with that sign if it is a space.
        after = np.flatnonzero(begins[1:n] & ~edge[1:n] & (classes[:-1] == _BLANK)) + 1
        begins[after - 1] = True
        begins[after[buffer[after - 1] == 32]] = False
        # An apostrophe that begins a piece takes one of a few endings with it.
        padded = np.concatenate([buffer, np.zeros(2, np.uint8)])
        mark = np.flatnonzero((buffer == ord("'")) & begins[:n])
        mark = mark[~edge[mark + 1]]
        one, two = padded[mark + 1], padded[mark + 2]
        single = np.isin(one, list(b"stmd"))
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        double &= ~edge[np.minimum(mark + 2, n)]
        begins[mark[single | double] + 1] = False
        begins[mark[single] + 2] = True
        begins[mark[double] + 3] = True
        offsets = np.flatnonzero(begins)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buffer)]).dictionary_encode()
        ids = [self.known.get(p) or self._merged(p) for p in pieces.dictionary.to_pylist()]
        of = pieces.indices.to_numpy(zero_copy_only=False)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        first, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(ids), "<u4")
        each = sizes[of]
        upto = np.cumsum(each)
        out = flat[np.arange(upto[-1]) + np.repeat(first[of] - (upto - each), each)]
        before = np.concatenate([[0], upto])[np.searchsorted(offsets, np.append(starts, n))]
        return out, np.diff(before)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
