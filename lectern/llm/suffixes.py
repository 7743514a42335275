"""Two-stage sorting of the suffixes of a small text, and what of it stands twice."""

from __future__ import annotations

import numpy as np


def two_stage_order(text: bytes, wanted: np.ndarray, depth: int) -> list[int]:
    """The places marked in `wanted`, and those their order is induced from, sorted by their next `depth` bytes.

    Suffixes smaller than their successors are sorted directly. One that is larger than its successor gets its
    place from it: scanning the order from the least suffix up, each suffix met puts its predecessor, if that is
    of the larger kind, at the end of what its first byte's bucket holds so far.
    """
    n = len(text)
    t = np.frombuffer(text, np.uint8).astype(np.int16)
    step = np.append(np.sign(np.diff(t)), -1) if n else np.empty(0, np.int64)
    at = np.where(step != 0, np.arange(n), n)
    decided = np.minimum.accumulate(at[::-1])[::-1]  # equal bytes go on to the first that differ
    smaller = step[decided] > 0 if n else np.empty(0, bool)
    # A larger suffix needs its successors up to the next directly sorted one.
    next_direct = np.minimum.accumulate(np.where(smaller, np.arange(n), n)[::-1])[::-1]
    from_ = np.flatnonzero(wanted)
    marks = np.zeros(n + 2, np.int64)
    np.add.at(marks, from_, 1)
    np.add.at(marks, np.minimum(next_direct[from_], n) + 1, -1)
    needed = np.cumsum(marks)[:n] > 0
    direct = sorted(np.flatnonzero(needed & smaller).tolist(), key=lambda i: text[i : i + depth])
    induced = (needed & ~smaller).tolist()
    larger: list[list[int]] = [[] for _ in range(256)]
    straight: list[list[int]] = [[] for _ in range(256)]
    for i in direct:
        straight[text[i]].append(i)
    if n and induced[n - 1]:
        larger[text[n - 1]].append(n - 1)
    order = []
    for c in range(256):
        for bucket in (larger[c], straight[c]):
            for i in bucket:  # a bucket may grow while it is scanned
                if i and induced[i - 1]:
                    larger[text[i - 1]].append(i - 1)
            order += bucket
    return order


def common_prefixes(text: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """Whether each place of `order` and the next have `depth` bytes in common."""
    t = np.frombuffer(text, np.uint8)
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    for k in (depth - 1, depth // 2, 0):
        same &= t[a + k] == t[b + k]
    for k in np.flatnonzero(same).tolist():
        x, y = int(a[k]), int(b[k])
        same[k] = text[x : x + depth] == text[y : y + depth]
    return same


def repeated_starts(pieces: list[bytes], starts: list[int], depth: int) -> list[np.ndarray]:
    """For each piece, which of its first `starts` places begin `depth` bytes that begin at another such place too."""
    text = b"".join(pieces)
    begin = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
    wanted = np.zeros(len(text), bool)
    for b, k in zip(begin.tolist(), starts):
        wanted[b : b + k] = True
    order = np.array(two_stage_order(text, wanted, depth), np.int64)
    order = order[wanted[order]] if len(order) else order
    twice = np.zeros(len(text), bool)
    same = common_prefixes(text, order, depth)
    twice[order[:-1][same]] = True
    twice[order[1:][same]] = True
    return [twice[b : b + k] for b, k in zip(begin.tolist(), starts)]
