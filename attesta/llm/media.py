"""Media columns: payloads cut at content-defined places, stored once per distinct chunk, and rebuilt from chunk lists.

A payload is the text's UTF-8 bytes (null: none) with zero bytes up to a positive multiple of 64. A rolling gear hash
over its bytes places the cuts: a chunk ends where the top ``mask_bits`` bits of the hash are zero, not before
``least`` and not after ``most`` bytes. A chunk is stored as one zstd frame; the stored form of a document is the
frames of its chunks in order. Frames are deduplicated by their payload digest, written to a table bucketed by digest in
the warehouse, joined back to the ordered chunk lists and decoded; features and digests come from what was read back.
A document whose rebuilt bytes differ from its payload fails the query.

Equal payloads are rebuilt once and their results joined back to all rows, so a large group of copies costs one. A
chunk in more than one in ``HOT`` of all list rows (there are fewer than ``HOT`` such chunks, so their frames are bounded)
is joined by broadcast. The store's table is dropped once the results are written to the shared folder.
Empty texts have one chunk of 64 zero bytes. Repeated rows give repeated results. Very long texts are longer lists
of chunks. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.session import cut

from .frames import mapped, released
from .text import raw, slices

BLOCK = 64
#: A chunk that is in more than this part of the list rows is joined by broadcast.
HOT = 1000
#: Digests that a task remembers having sent (about 70 bytes each).
SENT = 200_000
GEAR = np.random.default_rng(0x6EA2).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: ``h = 2 h + gear[byte]`` modulo 2**16, so it looks back 16 bytes."""
    h = GEAR[data].astype(np.uint16)
    for k in (1, 2, 4, 8):
        if len(h) > k:
            h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    return h


def cuts(data: np.ndarray, mask_bits: int = 13, least: int = 2048, most: int = 65536) -> list[int]:
    """Where the chunks of one payload end."""
    if len(data) <= least:
        return [len(data)]
    h = gear(data)
    # the top bits of the 16 depend on all 16 bytes, the low bits on few
    spots = np.flatnonzero(h >> np.uint16(16 - mask_bits) == 0) + 1
    out, at = [], 0
    while len(data) - at > least:
        k = int(np.searchsorted(spots, at + least))
        to = min(at + most, int(spots[k]) if k < len(spots) else len(data), len(data))
        out.append(to)
        at = to
    if at < len(data):
        out.append(len(data))
    return out


def payloads(texts: pa.Array) -> Iterator[tuple[int, bytes]]:
    """Unpadded size and padded bytes of each text."""
    data, off = raw(texts)
    whole = data.tobytes()
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        n = b - a
        yield n, whole[a:b] + bytes(max(BLOCK, -(-n // BLOCK) * BLOCK) - n)


def chunked(docs: DataFrame, frames: bool, text_col: str = "text", level: int = 3) -> DataFrame:
    """One row per chunk: ``payload_md, n_bytes, n_seq, seq, digest`` and, if asked for, the stored ``frame``."""
    names = ["payload_md", "n_bytes", "n_seq", "seq", "digest"] + ["frame"] * frames

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=level, write_checksum=False)
        sent: set[bytes] = set()  # frames that this task has sent lately need not be sent again
        for batch in batches:
            for _, texts in slices(batch, text_col):
                cols = [[] for _ in names]
                for n, p in payloads(texts):
                    md, at = hashlib.sha256(p).digest(), 0
                    ends = cuts(np.frombuffer(p, np.uint8))
                    for seq, to in enumerate(ends):
                        piece = p[at:to]
                        digest = hashlib.sha256(piece).digest()[:20]
                        at = to
                        if frames:
                            if digest in sent:
                                continue
                            if len(sent) >= SENT:
                                sent.clear()
                            sent.add(digest)
                        for c, v in zip(cols, (md, n, len(ends), seq, digest) + ((pack.compress(piece),) if frames else ()), strict=True):
                            c.append(v)
                types = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=False)], names)

    schema = "payload_md binary, n_bytes bigint, n_seq int, seq int, digest binary" + ", frame binary" * frames
    return mapped(docs.select(text_col), run, schema)


def store(docs: DataFrame, buckets: int, text_col: str = "text") -> str:
    """Write every distinct chunk once to a table bucketed by digest; the table's name."""
    spark = docs.sparkSession
    name = f"attesta_chunks_{uuid.uuid4().hex}"
    once = chunked(docs, True, text_col).select("digest", "frame").repartition(buckets, "digest").dropDuplicates(["digest"])
    released(spark, lambda: once.write.bucketBy(buckets, "digest").option("compression", "uncompressed").format("parquet").saveAsTable(name))
    return name


def rebuilt(docs: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``payload_md, n_bytes, n_seq, frames``: each distinct payload with its ordered stored frames.

    A payload of one chunk is complete as soon as its digest is joined; only longer lists are brought together.
    """
    table = docs.sparkSession.table(name)
    lists = cut(chunked(docs, False, text_col).select("payload_md", "n_bytes", "n_seq", "seq", "digest").distinct())
    key = ["payload_md", "n_bytes", "n_seq"]
    total = lists.count()
    often = [r["digest"] for r in lists.groupBy("digest").count().where(F.col("count") > max(HOT, total // HOT)).collect()]  # fewer than HOT
    if often:
        hot = F.col("digest").isin(*map(F.lit, often))
        frames = F.broadcast(table.where(hot))
        rest, some = lists.where(~hot), lists.where(hot)
        met = [(rest.where(w).hint("merge").join(table, "digest", "left")).unionByName(some.where(w).join(frames, "digest", "left")) for w in ("n_seq = 1", "n_seq > 1")]
        return collected(*met, key)
    one = lists.where("n_seq = 1").hint("merge").join(table, "digest", "left")
    many = lists.where("n_seq > 1").hint("merge").join(table, "digest", "left")
    return collected(one, many, key)


def collected(one: DataFrame, many: DataFrame, key: list[str]) -> DataFrame:
    parts = F.struct("seq", "frame")
    return one.select(*key, F.array(parts).alias("frames")).union(many.groupBy(*key).agg(F.sort_array(F.collect_list(parts)).alias("frames")))


def described(p: bytes) -> str:
    """Plain statistics of the samples, as text."""
    x = np.frombuffer(p, np.uint8)
    share = np.bincount(x >> 4, minlength=16)
    return f"mean={x.mean():.4f};std={x.std():.4f};peak={int(x.max())};hist=" + ",".join(map(str, share.tolist()))


def features(parts: DataFrame) -> DataFrame:
    """Decode the stored frames of each payload, verify it, and describe both forms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            cols = [[] for _ in names]
            for md, n, n_seq, frames in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                media = [f["frame"] for f in frames]
                if len(media) != n_seq or None in media:
                    raise ValueError(f"payload {md.hex()}: a chunk is missing from the store")
                p = b"".join(map(unpack.decompress, media))
                if hashlib.sha256(p).digest() != md:
                    raise ValueError(f"payload {md.hex()}: the rebuilt bytes differ")
                stored = b"".join(media)
                row = (md, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), described(p), n_seq)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    names = ["payload_md", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
    schema = "payload_md binary, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, n_chunks int"
    return mapped(parts.select("payload_md", "n_bytes", "n_seq", "frames"), run, schema)


def members(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, payload_md, n_bytes`` of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, text_col):
                got = [(hashlib.sha256(p).digest(), n) for n, p in payloads(texts)]
                yield pa.RecordBatch.from_arrays([rows.column(id_col), pa.array([x[0] for x in got], pa.binary()), pa.array([x[1] for x in got], pa.int64())], [id_col, "payload_md", "n_bytes"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, payload_md binary, n_bytes bigint")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store all payloads, read them back once per distinct payload, and describe them; one row per input row."""
    spark = docs.sparkSession
    size = docs.select(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (64 << 20)))
    name = store(docs, buckets, text_col)
    out = cut(members(docs, id_col, text_col).join(features(rebuilt(docs, name, text_col)), ["payload_md", "n_bytes"]).drop("payload_md"))
    spark.sql(f"DROP TABLE {name}")
    return out
