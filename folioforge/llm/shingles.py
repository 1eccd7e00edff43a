"""Word shingles and MinHash signatures of one text, vectorised with numpy over its UTF-8 bytes.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D after A-Z were lower-cased, the
pattern ``[^\\x20\\x09-\\x0D]+``.  A word's 64-bit hash is a polynomial of its bytes, taken for all
words of the text at once from one running sum; a shingle's hash mixes the hashes of its words.
All arithmetic is modulo 2**64, so results are the same on every machine.
"""

from __future__ import annotations

import numpy as np

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_IS_SPACE = bytes(int(c in SPACES) for c in range(256))
_RNG = np.random.Generator(np.random.PCG64(0x5EED))
_BASE = int(_RNG.integers(1, 2**62)) * 2 + 1
_BACK = pow(_BASE, -1, 2**64)
_ODD = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)
_STEP = 1024


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _BACK, dtype=np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets at which words start and end."""
    space = np.ones(len(raw) + 2, dtype=np.int8)
    space[1:-1] = np.frombuffer(raw.translate(_IS_SPACE), dtype=np.int8)
    at = np.flatnonzero(space[1:] != space[:-1])
    return at[::2], at[1::2]


def word_hashes(text: str) -> np.ndarray:
    """The 64-bit hash of each word of the text, in order."""
    raw = text.encode("utf-8").translate(_LOWER)
    start, end = word_bounds(raw)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.multiply(np.frombuffer(raw, dtype=np.uint8), up[: len(raw)], out=total[1:])
    np.cumsum(total, out=total)
    return _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's ``width``-word shingles; of its whole word sequence if
    it has fewer words; empty if it has none."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for k in range(width):
        out += words[k : len(words) - width + 1 + k] * _ODD[k]
    out = np.sort(_mix(out + np.uint64(width)))
    return out[np.append(True, out[1:] != out[:-1])]


class MinHash:
    """``symbols`` minima of b = 16 bits each, as uint16."""

    def __init__(self, symbols: int, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mask = rng.integers(0, 2**32, (symbols, 1), dtype=np.uint32)
        self.odd = rng.integers(0, 2**31, (symbols, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.buffer = np.empty((symbols, _STEP), dtype=np.uint32)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.mask), 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(x), _STEP):  # a bounded working set however long the text
            part = x[at : at + _STEP]
            b = self.buffer[:, : len(part)]
            np.bitwise_xor(part, self.mask, out=b)
            np.multiply(b, self.odd, out=b)
            np.minimum(low, b.min(axis=1), out=low)
        return (_mix(low.astype(np.uint64)) & np.uint64(0xFFFF)).astype(np.uint16)
