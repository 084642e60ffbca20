"""N-gram Jaccard join: MinHash bands propose, full n-gram sets decide.

A text is the set of its runs of ``n`` words (words are what ASCII white space separates; a text of fewer words is one
n-gram of all of them). Two documents are linked if the Jaccard similarity of their sets is at least ``threshold``.

1. One pass makes a digest of each set and its band hashes; band and row counts come from :func:`plan_bands` for the
   target recall at the threshold. Documents of equal sets become one class member with a multiplicity.
2. Members that share a band hash are connected, through the smallest member of a salted bucket, so a bucket of any
   size gives as many edges as it has members. Connected components of these edges are the candidate groups.
3. Groups are dealt out in tiles of bounded rows and n-grams. A group of several tiles is first split by size, as sets can be
   linked only if neither is larger than the other over the threshold: only tiles of one size class or of two next
   to each other meet. Each pair of tiles is one task that reads full n-gram
   sets and counts intersections for all its pairs at once. It returns counts and a spanning forest, never pairs.
4. Components of the verified forest are the classes.

A member is known by the digest of its set, never by a key; its text is fetched by key and text together, so that keys
with several texts, and rows without a key, take part like any other.

Result: one row per input row with ``class_id`` (the smallest key of the class; null if none of its rows has one) and
``n_links`` (rows linked to it, the copies of its own set included). Null, empty and white-space texts have no n-grams:
they link to nothing, not even each other, and their class is their key. Repeated rows count as copies. Very long texts
are sets of many n-grams, handled alone. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.session import cut

from .components import components
from .frames import free, mapped
from .text import hash_words, mix, shingles, slices

#: Rows and n-grams of one tile.
TILE_ROWS, TILE_GRAMS = 1024, 2 << 20
#: A bucket's members are first connected within so many parts.
SALTS = 32
#: Texts handled at once: a text's number and an n-gram's hash share 64 bits.
KEEP_BITS = np.uint64(12)
ROWS = 1 << int(KEEP_BITS)


def plan_bands(threshold: float, recall: float, most: int = 140) -> tuple[int, int]:
    """Bands and rows per band: the most rows for which ``bands`` reach the recall at the threshold within ``most`` hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams (52-bit hashes, sorted) of each of at most ``ROWS`` texts, and each text's first one."""
    words, first = hash_words(texts)
    grams, _, at = shingles(words, first, n)
    few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < n))
    doc = np.repeat(np.arange(len(first) - 1), np.diff(at))
    if len(few):
        h = np.array([mix(np.bitwise_xor.reduce(mix(words[first[k] : first[k + 1]] + np.arange(first[k + 1] - first[k], dtype=np.uint64))[None], axis=1))[0] for k in few], np.uint64)
        grams, doc = np.concatenate([grams, h]), np.concatenate([doc, few])
    key = np.sort(doc.astype(np.uint64) << (np.uint64(64) - KEEP_BITS) | grams >> KEEP_BITS)
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    edges = np.append(np.searchsorted(key, np.arange(len(first) - 1, dtype=np.uint64) << (np.uint64(64) - KEEP_BITS)), len(key))
    return key & np.uint64((1 << 52) - 1), edges


_seeds = np.random.default_rng(0xBA4D)
_FLIP = _seeds.integers(0, 1 << 52, 4096, dtype=np.uint64)
_TIMES = _seeds.integers(0, 1 << 63, 4096, dtype=np.uint64) | np.uint64(1)


def band_hashes(grams: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash per text and band over its ``rows`` minima; only texts with n-grams."""
    has = np.flatnonzero(np.diff(first))
    out = np.zeros((len(has), bands), np.uint64)
    if not len(has):
        return out
    for k in range(bands * rows):
        low = np.minimum.reduceat(((grams ^ _FLIP[k]) * _TIMES[k]) >> np.uint64(24), first[has])
        b = k // rows
        out[:, b] = mix(out[:, b] * np.uint64(0x9E3779B97F4A7C15) + low + np.uint64(b + 1))
    return out


def digests(grams: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each set."""
    size = np.diff(first).astype(np.uint64)
    out = []
    for k in (1, 2):
        total = np.zeros(len(grams) + 1, np.uint64)
        np.cumsum(mix(grams * np.uint64(2) + np.uint64(k)), out=total[1:])
        out.append(mix(total[first[1:]] - total[first[:-1]] + size))
    return out[0], out[1]


def binary(digest: tuple[np.ndarray, np.ndarray], mask: np.ndarray | None = None) -> pa.Array:
    return pa.array([x.tobytes() for x in np.stack(digest, axis=1)], pa.binary(), mask=mask)


def rows_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``key, text_hash, text``: the first two tell rows apart that are not repeats."""
    return docs.select(F.col(id_col).alias("key"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def signatures(docs: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """``key, text_hash, member, node, n_grams, bands`` of every row: the set's digest and half of it (no n-grams: null)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "text_hash", "member", "node", "n_grams", "bands"]
        for batch in batches:
            for part, texts in slices(batch, "text", rows=ROWS):
                grams, first = gram_sets(texts, n)
                size = np.diff(first)
                digest = digests(grams, first)
                bh = band_hashes(grams, first, bands, rows).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)), pa.array(bh.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("text_hash"), binary(digest, size == 0), pa.array(digest[0].view(np.int64), mask=size == 0), pa.array(size.astype(np.int64)), lists], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(rows_of(docs, id_col, text_col), run, f"key {kind}, text_hash bigint, member binary, node bigint, n_grams bigint, bands array<bigint>")


def bucket_edges(rows: DataFrame) -> DataFrame:
    """``a, b`` from ``h, rep``: the members of each bucket tied to its smallest one by way of salted parts."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int"))
    part = salted.groupBy("h", "salt").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("n"))
    whole = part.groupBy("h").agg(F.min("low").alias("a"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"))
    inner = salted.join(part.where("n > 1"), ["h", "salt"]).where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    outer = part.join(whole.where("parts > 1"), "h").where("low <> a").select("a", F.col("low").alias("b"))
    return inner.union(outer).distinct()


def pair_links(sets: list[np.ndarray], sides: np.ndarray, weight: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each set (weighted by the partners' multiplicity) and the smallest index of its linked group.

    ``sides``: 0 for pairs within the tile; else 1 and 2, and only pairs between the two count.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), size)
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    start = np.concatenate([[0], np.cumsum(df)])[:-1]
    for d in range(2, 7):  # rare n-grams: add one for each pair that shares one
        cols = np.flatnonzero(df == d)
        if len(cols):
            who = owner[order[start[cols][:, None] + np.arange(d)]]
            for i in range(d):
                for j in range(i + 1, d):
                    common += np.bincount(who[:, i] * n + who[:, j], minlength=n * n).reshape(n, n).astype(np.float32)
    wide = np.flatnonzero(df >= 7)
    for at in range(0, len(wide), 2048):  # frequent ones: a product of incidence blocks
        cols = wide[at : at + 2048]
        number = np.full(len(df), -1)
        number[cols] = np.arange(len(cols))
        use = number[column] >= 0
        block = np.zeros((n, len(cols)), np.float32)
        block[owner[use], number[column[use]]] = 1
        common += np.triu(block @ block.T, 1)
    common = common + common.T
    linked = common >= threshold * (size[:, None] + size[None, :] - common) - 1e-6
    linked &= common > 0
    np.fill_diagonal(linked, False)
    if sides.any():
        linked &= sides[:, None] != sides[None, :]
    label = np.arange(n)
    while True:
        low = np.where(linked, label[None, :], n).min(axis=1, initial=n)
        new = np.minimum(label, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return linked @ weight, label
        label = new


def verify(tiled: DataFrame, threshold: float) -> DataFrame:
    """``member, low, links`` of each member of each pair of tiles; ``low`` is a member that it is linked to, or itself."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []

        def close():
            if len(held) > 1:
                sets = [np.frombuffer(r[5], np.uint64) for r in held]
                i, j = held[0][1], held[0][2]
                sides = np.zeros(len(held), np.int8) if i == j else np.array([1 if r[3] == i else 2 for r in held], np.int8)
                links, low = pair_links(sets, sides, np.array([r[6] for r in held], np.int64), threshold)
                for r, n, k in zip(held, links.tolist(), low.tolist(), strict=True):
                    if n:
                        out.append((r[4], held[k][4], int(n)))
            held.clear()

        def flush():
            rows = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], ["member", "low", "links"])
            out.clear()
            return rows

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if held and held[0][:3] != row[:3]:
                    close()
                held.append(row)
                if len(out) >= 4096:
                    yield flush()
        close()
        if out:
            yield flush()

    dealt = tiled.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "member")
    return mapped(dealt.select("group", "i", "j", "tile", "member", "grams", "copies"), run, "member binary, low binary, links bigint")


#: Tiles of one size class are numbered within so many.
CLASS = 1 << 20


def tiles(groups: DataFrame, threshold: float) -> DataFrame:
    """``groups (group, member, n_grams, ...)`` with ``tile`` and the ``others`` that it is to meet (itself included)."""
    step = math.log(1 / threshold) * (1 + 1e-9) if threshold < 1 else 1e-9  # two sets that may be linked are at most one class apart
    counted = (F.count(F.lit(1)) / F.lit(TILE_ROWS), F.sum("n_grams") / F.lit(TILE_GRAMS))
    many = F.ceil(F.greatest(*counted)).cast("int")
    whole = groups.groupBy("group").agg(many.alias("whole"))
    sized = groups.join(whole, "group").withColumn("class", F.when(F.col("whole") > 1, F.floor(F.log("n_grams") / F.lit(step)).cast("int")).otherwise(0))
    by_class = sized.groupBy("group", "class").agg(many.alias("n")).groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("class", "n"))).alias("tiles"))
    own = F.element_at("tiles", F.col("class"))
    met = F.flatten(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.transform(F.sequence(F.lit(1), F.coalesce(F.element_at("tiles", F.col("class") + d), F.lit(0))), lambda k: (F.col("class") + d) * CLASS + k)))
    out = sized.join(by_class, "group").withColumn("tile", F.col("class") * CLASS + F.pmod(F.xxhash64("member"), own).cast("int") + 1)
    return out.withColumn("others", F.filter(met, lambda x: x % CLASS > 0)).drop("whole", "class", "tiles")


def classed(docs: DataFrame, n: int, threshold: float, recall: float, id_col: str, text_col: str) -> DataFrame:
    """``key, text_hash, member, links, top`` of every row: rows linked to it, and the first row of its class (by key, rows without one last)."""
    sig = cut(signatures(docs, n, *plan_bands(threshold, recall), id_col, text_col))
    first = F.struct(F.col("key").isNull().alias("unknown"), "key", "text_hash")
    members = cut(sig.where("member IS NOT NULL").groupBy("member").agg(F.any_value("node").alias("node"), F.any_value("n_grams").alias("n_grams"), F.min(first).alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("bands").alias("bands")))
    # two sets with the same half of a digest share a node here, which only adds candidates
    candidates = components(bucket_edges(members.select(F.col("node").alias("rep"), F.explode("bands").alias("h"))))
    active = tiles(candidates.withColumnRenamed("label", "group").join(members.select("member", "node", "n_grams", "copies", "rep"), "node"), threshold)

    def to_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["group", "tile", "others", "member", "copies", "grams"]
        for batch in batches:
            for part, texts in slices(batch, "text", rows=ROWS):
                grams, first = gram_sets(texts, n)
                grams = np.ascontiguousarray(grams)
                sets = [grams[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:-1]), pa.array(sets, pa.binary())], names)

    texts = rows_of(docs, id_col, text_col)
    wanted = active.select("group", "tile", "others", "member", "copies", F.col("rep.key").alias("rep_key"), F.col("rep.text_hash").alias("rep_hash"))
    found = wanted.join(texts, F.col("rep_key").eqNullSafe(F.col("key")) & (F.col("rep_hash") == F.col("text_hash"))).select("group", "tile", "others", "member", "copies", "text")
    sets = mapped(found, to_sets, "group bigint, tile int, others array<int>, member binary, copies bigint, grams binary").dropDuplicates(["member"])
    tiled = sets.withColumn("other", F.explode("others")).select("group", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "member", "grams", "copies")
    checked = cut(verify(tiled, threshold))
    labels = components(checked.where("low <> member"), "member", "low").withColumnRenamed("node", "member")
    links = checked.groupBy("member").agg(F.sum("links").alias("links"))
    joined = labels.join(members.select("member", "rep"), "member")
    tops = joined.groupBy("label").agg(F.min("rep").alias("top"))
    in_class = labels.join(links, "member", "left").join(tops, "label").select("member", "links", "top")
    per_set = members.select("member", "rep", "copies").join(in_class, "member", "left")
    per_set = per_set.select("member", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("top", "rep").alias("top"))
    return sig.select("key", "text_hash", "member").join(per_set, "member", "left")


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, class_id, n_links`` for every row of ``docs``."""
    found = classed(docs, n, threshold, recall, id_col, text_col)
    class_id = F.when(F.col("member").isNull(), F.col("key")).otherwise(F.col("top.key"))
    return found.select(F.col("key").alias(id_col), class_id.alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each class of ``docs`` (the smallest key, rows without one last) and all rows without n-grams, repeats once, with all their columns."""
    key, text_hash = free(docs.columns, "kept_key"), free(docs.columns, "kept_hash")
    found = classed(docs, n, threshold, recall, id_col, text_col)
    first = F.col("member").isNull() | F.col("top.key").eqNullSafe(F.col("key")) & (F.col("top.text_hash") == F.col("text_hash"))
    kept = found.where(first).select(F.col("key").alias(key), F.col("text_hash").alias(text_hash)).distinct()
    hashed = docs.withColumn(text_hash + "_", F.xxhash64(text_col))
    out = hashed.join(kept, F.col(key).eqNullSafe(F.col(id_col)) & (F.col(text_hash) == F.col(text_hash + "_")), "left_semi")
    return out.dropDuplicates([id_col, text_hash + "_"]).select(*docs.columns)


__all__ = ["band_hashes", "gram_sets", "join", "keep_one", "pair_links", "plan_bands"]
