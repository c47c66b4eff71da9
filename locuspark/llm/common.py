"""What several corpus operators share: scratch tables in the cluster's shared folder, and word arithmetic on bytes.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, as in ``[^\\x20\\x09-\\x0D]+``; ``bytes.split()`` gives
exactly these.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from locuspark.scratch import Scratch, shared_dir  # noqa: F401

#: A row of documents is read through these alone, so other columns, whatever their names, take no part.
DOC = ["doc_id", "text"]


def held_out(doc_id: Column, fold: int) -> Column:
    """True where crc32(doc_id as text) mod 5 is fold. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == fold, F.lit(False))


# ---------------------------------------------------------------------------------------------------------------------
# Word arithmetic. A batch of texts becomes one byte array; a word's 64-bit code is a polynomial in its bytes, computed
# from prefix sums for all words at once, then mixed. Sequences of words are coded by a second polynomial over words.
# ---------------------------------------------------------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2^64
_Q = np.uint64(0xD1342543DE82EF95)


def _inverse(p: int) -> int:
    return pow(int(p), -1, 1 << 64)


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTES = _table(11)
_LOWER_BYTES = _BYTES.copy()
_LOWER_BYTES[65:91] = _BYTES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_SPACES = _SPACE.tobytes()
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(p: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^0..p^n and their inverses, kept per worker and grown when needed."""
    key = int(p)
    if key not in _POWERS or len(_POWERS[key][0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        out = []
        for base in (key, _inverse(key)):
            x = np.empty(size + 1, np.uint64)
            x[0], done = 1, 1
            while done <= size:
                step = min(done, size + 1 - done)
                x[done : done + step] = x[:step] * np.uint64(pow(base, done, 1 << 64))
                done += step
            out.append(x)
        _POWERS[key] = tuple(out)
    return _POWERS[key]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit codes that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(text: bytes, lower: bool = False) -> np.ndarray:
    """One mixed 64-bit code for each word of a text, in order."""
    if not text:
        return np.empty(0, np.uint64)
    b = np.frombuffer(text, np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
    starts, ends = edge[::2], edge[1::2]  # a word begins where a space ends
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers(_P, len(b))
    sums = np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_LOWER_BYTES if lower else _BYTES)[b] * up[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _Q)


#: Bytes whose words are coded at once; a longer word is coded by a digest.
PIECE = (1 << 16) - 1


class Words:
    """The words of several texts, found at once: word k is raw[starts[k]:ends[k]], and text i has words first[i] to first[i + 1]."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join(texts)
        self.bytes = np.frombuffer(self.raw, np.uint8)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.at = np.cumsum(self.sizes + 1) - self.sizes - 1  # where texts begin
        space = np.frombuffer((b" " + self.raw + b" ").translate(_SPACES), np.uint8)
        edge = np.flatnonzero(space[1:] != space[:-1])
        self.starts, self.ends = edge[::2], edge[1::2]
        self.first = np.searchsorted(self.starts, np.append(self.at, len(self.raw) + 1))

    def codes(self) -> np.ndarray:
        """One mixed 64-bit code for each word; equal words have equal codes."""
        starts, ends = self.starts, self.ends
        out, i = np.empty(len(starts), np.uint64), 0
        up, down = _powers(_P, PIECE)
        sums = np.zeros(PIECE + 1, np.uint64)
        while i < len(starts):
            a = starts[i]
            j = int(np.searchsorted(ends, a + PIECE, side="right"))
            if j <= i:
                out[i] = int.from_bytes(blake2b(self.raw[a : ends[i]], digest_size=8).digest(), "little")
                j = i + 1
            else:
                n = ends[j - 1] - a
                np.cumsum(_BYTES[self.bytes[a : a + n]] * up[:n], out=sums[1 : n + 1])
                s, e = starts[i:j] - a, ends[i:j] - a
                out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _Q)
            i = j
        return out


def run_codes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """One mixed code for each run of k consecutive words, by its first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    w = mix(words + np.uint64(salt)) if salt else words
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _Q + w[i : i + n]
    return mix(out)


def as_bytes(column) -> list[bytes]:
    """Texts of an Arrow column as UTF-8; null counts as empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]
