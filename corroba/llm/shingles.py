"""Distinct word shingles of whole texts as sorted 64-bit hashes, computed with numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. A text with
fewer words than a shingle has is one shingle, the whole sequence; one without
words has none. Word hashes come from prefix sums of a polynomial modulo 2^64
over a random value for every byte, so a text is read once without a loop over
its words; long texts are read in pieces that end at white space.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

from corroba.llm.common import mix64

#: Bytes that are hashed at once; a longer single word is taken whole.
PIECE = 1 << 20
WORDS = 5

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15 | 1)
_Q = _U(0xD6E8FEB86659FD93)
_INVERSE = _U(pow(int(_P), -1, 1 << 64))

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUE = mix64((np.arange(1, 257, dtype=_U) * _U(0xA24BAED4963EE407)))[_LOWER]
_VALUE[_IS_SPACE] = 0

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_powers: dict[str, np.ndarray] = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        with np.errstate(over="ignore"):
            factors = np.full(max(n, 2 * len(have)), base, _U)
            factors[0] = 1
            _powers[kind] = have = np.multiply.accumulate(factors)
    return have


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word of ``data``, in order."""
    parts, at = [], 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            m = _SPACE.search(data, end)
            end = m.end() if m else len(data)
        parts.append(_piece(data[at:end]))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, _U)


def _piece(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[raw]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, _U)
        np.cumsum(_VALUE[raw] * _power("up", _P, len(raw))[: len(raw)], out=sums[1:])
        value = (sums[ends] - sums[starts]) * _power("down", _INVERSE, len(raw) + 1)[starts]
        return mix64(value + (ends - starts).astype(_U) * _Q)


def shingle_set(text: str | bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    if not text:
        return np.zeros(0, _U)
    w = word_hashes(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text)
    if not len(w):
        return w
    size = min(words, len(w))
    with np.errstate(over="ignore"):
        h = np.full(len(w) - size + 1, _U(size), _U)
        for i in range(size):
            h = h * _Q + w[i : len(w) - size + 1 + i]
        return np.unique(mix64(h))


def set_digest(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted distinct arrays share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))
