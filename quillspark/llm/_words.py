"""Words of many documents at once, as numpy arrays over an Arrow batch.

A word is a run of bytes other than 0x20 and 0x09-0x0D. All of these are ASCII,
so cutting the UTF-8 bytes cuts the characters alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: White space for str.split() that does not end a word here.
OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0  -     　]")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

U = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93
_POWERS: dict[int, np.ndarray] = {}


def split_words(text: str) -> list[str]:
    return WORD.findall(text) if OTHER_SPACE.search(text) else text.split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length()) if n > 1 else 1 << 16
        have = np.full(size, base, U)
        have[0] = 1
        have = np.cumprod(have, dtype=U)
        _POWERS[base] = have
    return have[:n]


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """out[i] = sum of values[j] * base**j for j < i, modulo 2**64."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(base, len(values)), dtype=U, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of the values in [start, end) that does not depend on where they stand."""
    inverse = pow(base, -1, 1 << 64)
    raw = (prefix[end] - prefix[start]) * powers(inverse, len(prefix))[start]
    return mix(raw + (end - start).astype(U) * U(0xA0761D6478BD642F))


@dataclass
class Words:
    """The words of all documents of a batch, one after another."""

    hashes: np.ndarray  # of each word
    first: np.ndarray  # index of each document's first word; one entry more than documents
    doc: np.ndarray  # document of each word

    def prefix(self) -> np.ndarray:
        return prefix_sums(self.hashes, _WORD_BASE)


def sequence_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span_hash(prefix, start, end, _WORD_BASE)


def batch_words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of an Arrow string array; null counts as no words."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    raw = np.frombuffer(data, np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    offsets = offsets - lo
    if lower:
        raw = _LOWER[raw]
    inside = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)  # a document starts here
    edge[offsets] = True
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    prefix = prefix_sums(raw.astype(U) + U(1), _BYTE_BASE)
    hashes = span_hash(prefix, starts, ends, _BYTE_BASE)
    first = np.searchsorted(starts, offsets)
    return Words(hashes, first, np.repeat(np.arange(len(texts)), np.diff(first)))
