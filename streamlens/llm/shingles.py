"""Sets of hashed word shingles, computed over the bytes of many texts at once.

Words are runs of bytes that are not ASCII white space, with A-Z in lower case. A word's hash is
a polynomial of its bytes, a shingle's hash a combination of its words' hashes, both modulo 2^64
and mixed; equal shingles have equal hashes, and others differ but for chances of about
2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
WORDS = 5


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    return _mixed((np.arange(n, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15) + U(seed))


with np.errstate(over="ignore"):
    _LETTER = _numbers(256, 11)
    _LETTER[[9, 10, 11, 12, 13, 32]] = 0
    _LETTER[65:91] = _LETTER[97:123]
    _PLACE = _numbers(WORDS, 12) | U(1)
    _RATIO = 0x9E3779B97F4A7C15 | 1
    _INVERSE = pow(_RATIO, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int, ratio: int) -> np.ndarray:
    out = np.full(n, ratio, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def text_slices(texts: pa.Array, max_bytes: int = 1 << 20) -> Iterator[list[bytes]]:
    """The texts as bytes, in lists of about ``max_bytes``; a null is empty."""
    held, size = [], 0
    for text in texts:
        raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
        if held and size + len(raw) > max_bytes:
            yield held
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield held


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    A text of fewer words is one shingle of all its words; one without words has none.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = [np.empty(0, U)] * len(texts)
    if not len(data):
        return none
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = bounds[:-1][sizes > 0]
    begins[edges] |= inside[edges]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return none
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(_LETTER[data] * _powers(len(data), _RATIO), starts)
        hashes = _mixed(sums * _powers(len(data), _INVERSE)[starts])
        first = np.searchsorted(starts, bounds)
        count = max(0, len(hashes) - words + 1)
        windows = np.zeros(count, U)
        for k in range(words):
            windows += hashes[k : k + count] * _PLACE[k]
        windows = _mixed(windows)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(windows[a : b - words + 1]))
            elif b > a:
                out.append(_mixed((hashes[a:b] * _PLACE[: b - a]).sum(keepdims=True) + U(b - a)))
            else:
                out.append(none[0])
    return out


def digest(hashes: np.ndarray) -> bytes:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        a = _mixed(hashes).sum(dtype=U)
        b = _mixed(hashes ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U)
    return a.tobytes() + b.tobytes()


class MinHash:
    """Signatures of ``n`` 16-bit values; equal values at a place are likely as sets are alike."""

    def __init__(self, n: int = 128):
        self.factor, self.shift = _numbers(n, 21) | U(1), _numbers(n, 22)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            least = np.full(len(self.factor), ~U(0))
            for at in range(0, len(hashes), 1024):
                made = hashes[at : at + 1024, None] * self.factor + self.shift
                np.minimum(least, made.min(0), out=least)
            return (_mixed(least) & U(0xFFFF)).astype(">u2")
