"""Words and word n-grams of whole Arrow batches as numpy arrays, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are taken in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words, after lowering: ASCII letters and digits and all beyond ASCII; or all but white space.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
SOLID = np.ones(256, bool)
SOLID[0x20] = SOLID[0x09:0x0E] = False

_ROOT = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Odd multipliers of the places in an n-gram.
_PLACES = np.cumprod(np.full(64, 0xD6E8FEB86659FD93, np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of a string column; a null counts as an empty text."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), ends


def groups(offsets: np.ndarray, size: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    low, n = 0, len(offsets) - 1
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1))
        yield low, high
        low = high


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, root in enumerate((_ROOT, pow(_ROOT, -1, 1 << 64))):
            _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, root, np.uint64))])
    return _powers[0], _powers[1]


class Words:
    """Words of texts low..high: starts and ends in text, doc (from 0), codes (64-bit), first (of each doc, and the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, low: int, high: int, solid: np.ndarray) -> None:
        base = offsets[low]
        self.text = LOWER[data[base : offsets[high]]]
        at = offsets[low : high + 1] - base
        n = len(self.text)
        inside = solid[self.text]
        before = np.zeros(n + 1, bool)
        before[1:] = inside
        before[at] = False
        after = np.zeros(n + 1, bool)
        after[:n] = inside
        after[at] = False
        self.starts = np.flatnonzero(inside & ~before[:n])
        self.ends = np.flatnonzero(inside & ~after[1:]) + 1
        self.doc = np.searchsorted(at, self.starts, "right") - 1
        self.first = np.searchsorted(self.starts, at, "left")
        up, down = _grown(n + 1)
        summed = np.zeros(n + 1, np.uint64)
        np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * up[:n], out=summed[1:])
        raw = (summed[self.ends] - summed[self.starts]) * down[self.starts]
        self.codes = mix(raw + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))

    def grams(self, k: int) -> np.ndarray:
        """Codes of all k consecutive words, those that cross into the next text included."""
        n = len(self.codes) - k + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        out = self.codes[:n] * _PLACES[0]
        for j in range(1, k):
            out += self.codes[j : n + j] * _PLACES[j]
        return mix(out + np.uint64(k))

    def within(self, k: int) -> np.ndarray:
        """Which of grams(k) lie in one text."""
        n = max(0, len(self.codes) - k + 1)
        return self.doc[:n] == self.doc[k - 1 : n + k - 1]

    def joined(self, i: int, k: int) -> bytes:
        return b" ".join(self.text[a:b].tobytes() for a, b in zip(self.starts[i : i + k], self.ends[i : i + k], strict=True))
