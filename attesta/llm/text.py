"""Vectorised text access over Arrow buffers: slices, tokens and token hashes without Python loops per token."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single document is handled by itself.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(0x5EED)
#: Byte values as random 64-bit numbers, and the same with A-Z folded onto a-z.
BYTE_VALUES = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
FOLDED_VALUES = BYTE_VALUES.copy()
FOLDED_VALUES[65:91] = BYTE_VALUES[97:123]
_P = np.uint64(0x9E3779B97F4A7C1B)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}

SPACES = (9, 10, 11, 12, 13, 32)
#: Byte classes: 0 separates tokens, runs of one other class form a token.
BY_SPACE = np.ones(256, np.uint8)
BY_SPACE[list(SPACES)] = 0
BY_KIND = np.full(256, 2, np.uint8)
BY_KIND[list(SPACES)] = 0
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    BY_KIND[_a:_b] = 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64) over uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = np.full(max(n, SLICE_BYTES + 1), _P if kind == "p" else _P_INV, np.uint64)
        base[0] = 1
        have = np.multiply.accumulate(base)
        if len(have) <= 4 * SLICE_BYTES:
            _powers[kind] = have
    return have[:n]


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One string array without nulls (null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Consecutive row slices of at most ``rows`` rows whose texts hold about ``most`` bytes, each with its texts."""
    if not batch.num_rows:
        return
    texts = strings(batch.column(text))
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        base = size[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(size, base + most, "right"))))
        yield batch.slice(at, to - at), texts.slice(at, to - at)
        at = to


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and each text's start (one more entry at the end)."""
    buffers = texts.buffers()
    off = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[off[0] : off[-1]] if buffers[2] is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def tokens(data: np.ndarray, off: np.ndarray, kinds: np.ndarray = BY_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token starts, ends, and for each document the index of its first token (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    kind = kinds[data]
    new = np.empty(len(data), bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[off[:-1][off[:-1] < len(data)]] = True
    runs = np.flatnonzero(new)
    keep = kind[runs] != 0
    ends = np.append(runs[1:], len(data))[keep]
    starts = runs[keep]
    return starts, ends, np.searchsorted(starts, off)


def token_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """64-bit hashes of the tokens, from one prefix sum over the bytes (a polynomial in an odd base modulo 2**64)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((FOLDED_VALUES if fold else BYTE_VALUES)[data] * _power("p", len(data)), out=total[1:])
    h = (total[ends] - total[starts]) * _power("i", len(data))[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def hash_words(texts: pa.Array, kinds: np.ndarray = BY_SPACE, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, and each document's first token."""
    data, off = raw(texts)
    starts, ends, first = tokens(data, off, kinds)
    return token_hashes(data, starts, ends, fold), first


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles within documents, the word each starts at, and each document's first shingle."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    left = np.repeat(first[1:], np.diff(first))[: len(h)]  # where each word's document ends
    at = np.flatnonzero(np.arange(len(h)) + n <= left)
    return h[at], at, np.searchsorted(at, first)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per-document sums of per-token values (rows may be vectors)."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, dtype=np.float64, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
