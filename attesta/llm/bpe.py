"""Byte-level BPE encoding and decoding with a given rank file.

Two tiers: a minimal perfect hash over the vocabulary resolves a pre-token that is itself a token; any other
pre-token goes through a heap of candidate merges over linked bytes, lowest rank first and leftmost on ties.
Results of whole pre-tokens are remembered per worker within a fixed number of entries.

Null and empty texts give no ids. Special tokens are never produced. Rows are handled one by one, so repeated
rows, ties and extra columns change nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from .frames import mapped
from .text import slices

#: Pre-tokens remembered per worker (about 200 bytes each).
REMEMBERED = 600_000


class PerfectHash:
    """Minimal perfect hash by displacement: every key has a slot of its own in ``0..n-1``, with no free slot."""

    def __init__(self, keys: list[bytes]):
        n = len(keys)
        self.n, self.parts = n, max(1, n // 3)
        shift = np.zeros(self.parts, np.int64)
        groups: list[list[int]] = [[] for _ in range(self.parts)]
        for i, k in enumerate(keys):
            groups[xxhash.xxh3_64_intdigest(k) % self.parts].append(i)
        self.slot_of = np.full(n, -1, np.int64)
        free = np.ones(n, bool)
        order = sorted(range(self.parts), key=lambda g: -len(groups[g]))
        at = 0
        for at, g in enumerate(order):
            if len(groups[g]) < 2:
                break
            d = 1
            while True:
                slots = [xxhash.xxh3_64_intdigest(keys[i], seed=d) % n for i in groups[g]]
                if len(set(slots)) == len(slots) and free[slots].all():
                    break
                d += 1
            shift[g] = d
            free[slots] = False
            self.slot_of[groups[g]] = slots
        spare = iter(np.flatnonzero(free))
        for g in order[at:]:
            if len(groups[g]) == 1:
                slot = int(next(spare))
                shift[g] = -slot - 1
                self.slot_of[groups[g][0]] = slot
        self.shift = shift.tolist()

    def __call__(self, key: bytes) -> int:
        d = self.shift[xxhash.xxh3_64_intdigest(key) % self.parts]
        return -d - 1 if d < 0 else xxhash.xxh3_64_intdigest(key, seed=d) % self.n


class Codec(dict):
    """Maps a pre-token (str) to the bytes of its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.pattern = regex.compile(pattern)
        tokens = sorted(ranks, key=ranks.get)
        self.hash = PerfectHash(tokens)
        self.keys: list[bytes] = [b""] * len(tokens)
        self.ids = [0] * len(tokens)
        for t, slot in zip(tokens, self.hash.slot_of.tolist(), strict=True):
            self.keys[slot], self.ids[slot] = t, ranks[t]
        self.of_byte = [ranks.get(bytes([b]), -1) for b in range(256)]
        if min(self.of_byte) < 0:
            raise ValueError("a byte-level vocabulary has all 256 single bytes")
        self.width = max(ranks.values()) + 1
        #: Rank of the token that two neighbouring tokens merge into, by ``left * width + right``.
        self.pair = {ranks[t[:i]] * self.width + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        named = [b""] * self.width
        for t, r in ranks.items():
            named[r] = t
        self.vocabulary = pa.array(named, pa.binary())

    def whole(self, piece: bytes) -> int | None:
        slot = self.hash(piece)
        return self.ids[slot] if self.keys[slot] == piece else None

    def merge(self, piece: bytes) -> list[int]:
        ids = [self.of_byte[b] for b in piece]
        n, width, pair = len(ids), self.width, self.pair.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r * n + i for i in range(n - 1) if (r := pair(ids[i] * width + ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if ids[i] < 0 or j >= n or pair(ids[i] * width + ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := pair(r * width + ids[k])) is not None:
                    heappush(heap, s * n + i)
            if (p := before[i]) >= 0 and (s := pair(ids[p] * width + r)) is not None:
                heappush(heap, s * n + p)
        return [x for x in ids if x >= 0]

    def __missing__(self, token: str) -> bytes:
        piece = token.encode()
        one = self.whole(piece)
        out = array("I", [one] if one is not None else self.merge(piece)).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(token) < 64:
            self[token] = out
        return out

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))

    def decode(self, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The bytes of all ids, and where each id's bytes end (a 0 first)."""
        out = self.vocabulary.take(pa.array(ids, pa.uint32()))
        off = np.frombuffer(out.buffers()[1], np.int32)[out.offset : out.offset + len(out) + 1]
        data = out.buffers()[2]
        return memoryview(data)[off[0] : off[-1]] if data is not None else memoryview(b""), off - off[0]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, f))}


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, one for each worker (the file is part of the installed tokenizers on every node)."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(read_ranks(path), pattern)
    return _codecs[path, pattern]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>``: the ids of every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for rows, texts in slices(batch, text_col):
                got = [c.encode(t) for t in texts.to_pylist()]
                off = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(got), np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([rows.column(id_col), pa.ListArray.from_arrays(pa.array(off), values)], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return mapped(df.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, bytes binary``: the bytes of every list of ids (null: empty)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            out = [bytes(c.decode(np.asarray(x or [], np.uint32))[0]) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(out, pa.binary())], [id_col, "bytes"])

    kind = df.schema[id_col].dataType.simpleString()
    return mapped(df.select(id_col, ids_col), run, f"`{id_col}` {kind}, bytes binary")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every text; ``id_col, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids``.

    Both directions run in one pass, so the ids of a corpus are never written or shuffled just to be checked.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for batch in batches:
            for rows, texts in slices(batch, text_col):
                got = [c.encode(t) for t in texts.to_pylist()]
                n = np.array([len(x) // 4 for x in got], np.int64)
                data, ends = c.decode(np.frombuffer(b"".join(got), np.uint32))
                cut = ends[np.concatenate([[0], np.cumsum(n)])]
                ids = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.frombuffer(b"".join(got), np.int32)))] * with_ids
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(id_col),
                        pa.array(n),
                        pa.array([hashlib.sha256(x).hexdigest() for x in got]),
                        pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(cut[:-1], cut[1:], strict=True)]),
                        *ids,
                    ],
                    [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids,
                )

    kind = df.schema[id_col].dataType.simpleString()
    return mapped(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


__all__ = ["Codec", "PerfectHash", "codec", "decode", "encode", "read_ranks", "round_trip"]
