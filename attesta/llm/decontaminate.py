"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Words are runs of letters and digits, upper-case A-Z folded. One pass over the documents finds the item n-grams that
occur and cuts a passage around each (as word hashes), wide enough for the longest item with that n-gram. A passage meets
every item that it shares an n-gram with, however common that n-gram is, so whether an edited copy is found does not
depend on the rest of the corpus. An item fewer of whose words occur in the passage than the threshold asks for cannot
reach it and is not aligned; all others are, over the whole passage, a long one in overlapping stretches that are wide
enough for any alignment that reaches the threshold. ``score`` is the alignment score over
that of the whole item, 1 for an exact copy; pairs of at least ``threshold`` are reported with the words they span.

The items are a query set, taken in blocks of bounded size against all documents, so the lookup sent to workers never
outgrows ``BLOCK_WORDS``. Items of fewer than ``n`` words have no n-gram: they are found where all their words occur
in a row. Null and empty items, and those without a word, are never found; neither are
documents without a key or text. Equal items are aligned once and reported for each id. Repeated documents give one row for
each (key, item). Ties between passages go to the first. Very long texts are handled in passages. An empty table on either side gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.session import cut

from .frames import mapped
from .text import hash_words, shingles, slices
from .toxicity import WORDS

#: Item words in one block (about 40 bytes each in the lookup that workers get).
BLOCK_WORDS = 4 << 20
#: Item words compared with a passage at once, cells of an alignment's row, and words of a passage beyond which it is aligned in stretches.
AT_ONCE, CELLS, STRETCH = 1 << 20, 1 << 18, 4096
#: Smith-Waterman: gain of a match, costs of a mismatch and of a skipped word.
MATCH, MISMATCH, GAP = 2, 1, 1


def words_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item, words`` (64-bit hashes, little-endian) of every item."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, text_col):
                words, first = hash_words(texts, WORDS, fold=True)
                yield pa.RecordBatch.from_arrays([rows.column(id_col), pa.array([words[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["item", "words"])

    return mapped(df.select(id_col, text_col), run, f"item {df.schema[id_col].dataType.simpleString()}, words binary")


def align(item: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment score of the item with each row of ``many`` (padded with 0), and where it ends in the row and the item.

    Rows may have an item each (rows of ``item``, padded with 1).
    """
    p, w = many.shape
    step = np.arange(w + 1, dtype=np.int32) * GAP
    row = np.zeros((p, w + 1), np.int32)
    best, end, top = np.zeros(p, np.int32), np.zeros(p, np.int64), np.zeros(p, np.int64)
    for i, x in enumerate(np.atleast_2d(item).T):
        new = np.zeros_like(row)
        new[:, 1:] = np.where(many == x[:, None], MATCH, -MISMATCH) + row[:, :-1]
        np.maximum(new, row - GAP, out=new)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + step, axis=1) - step  # skipped words of the row
        at = new.argmax(axis=1)
        score = new[np.arange(p), at]
        more = score > best
        best[more], end[more], top[more] = score[more], at[more], i + 1
        row = new
    return best, end, top


class Items:
    """Items as words ``words[first[i]:first[i+1]]``; their sorted n-grams, the longest item and (``owner``) all items of each;
    and by number of words the sorted hashes of shorter items, with the item of each."""

    def __init__(self, table: pa.Table, n: int):
        self.md = table.column("md").to_pylist()
        raw = table.column("words").to_pylist()
        self.words = np.frombuffer(b"".join(raw), np.uint64)
        self.first = np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])])
        size = np.diff(self.first)
        self.short = {}
        for k in sorted(set(size[size < n].tolist()) - {0}):
            own = np.flatnonzero(size == k)
            h = shingles(self.words[np.concatenate([np.arange(self.first[i], self.first[i + 1]) for i in own])], np.arange(len(own) + 1) * k, k)[0]
            order = np.argsort(h)
            self.short[k] = h[order], own[order]
        g, _, first = shingles(self.words, self.first, n)
        item = np.repeat(np.arange(len(raw), dtype=np.int32), np.diff(first))
        order = np.argsort(g, kind="stable")
        g, self.owner = g[order], item[order]
        self.grams, begin = np.unique(g, return_index=True)
        self.begin = np.append(begin, len(g))
        self.reach = np.maximum.reduceat(np.diff(self.first)[self.owner], begin) if len(begin) else begin

    def likely(self, places: np.ndarray, passage: np.ndarray, threshold: float) -> Iterator[int]:
        """Items with one of the n-grams ``places`` so many of whose words occur in the passage that they may reach the threshold."""
        own = np.unique(np.concatenate([self.owner[self.begin[k] : self.begin[k + 1]] for k in np.unique(places).tolist()]))
        size = np.diff(self.first)[own]
        known = np.unique(passage)
        part = (np.cumsum(size) - size) // AT_ONCE
        for piece in np.split(np.arange(len(own)), np.flatnonzero(np.diff(part)) + 1):
            n = size[piece]
            begin = np.cumsum(n) - n
            w = self.words[np.arange(n.sum()) + np.repeat(self.first[own[piece]] - begin, n)]
            held = known[np.minimum(np.searchsorted(known, w), len(known) - 1)] == w
            yield from own[piece[MATCH * np.add.reduceat(held, begin, dtype=np.int64) / (MATCH * n) >= threshold]].tolist()


def padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), fill, np.uint64)
    for k, x in enumerate(rows):
        out[k, : len(x)] = x
    return out


def aligned(docs: DataFrame, items: Items, n: int, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """``key, md, score, start_word, end_word`` for each passage and item that reach the threshold."""
    flags = np.zeros(1 << 20, bool)
    flags[(items.grams >> np.uint64(44)).astype(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast((items, np.packbits(flags)))

    def scored(pairs: list[tuple[int, int, int, int]], words: np.ndarray) -> Iterator[tuple[int, str, float, int, int]]:
        """Rows of the pairs (document, passage's first word and end, item) that reach the threshold; words count from the passage."""
        items = shared.value[0]
        pairs.sort(key=lambda x: (x[2] - x[1], x[3]))
        while pairs:
            wide = pairs[-1][2] - pairs[-1][1]
            k = max(1, min(64, CELLS // wide))
            part, pairs[-k:] = pairs[-k:], []
            own = [items.words[items.first[i] : items.first[i + 1]] for *_, i in part]
            many = padded([words[a:b] for _, a, b, _ in part], 0)
            score, end, top = align(padded(own, 1), many)
            for r, (d, a, _, i) in enumerate(part):
                if (s := score[r] / (MATCH * len(own[r]))) >= threshold:
                    back = align(own[r][: top[r]][::-1], many[r : r + 1, : end[r]][:, ::-1])[1][0]
                    yield d, items.md[i], float(s), int(a + end[r] - back), int(a + end[r])

    def whole(items: Items, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, str, float, int, int]]:
        """The first place of each short item in each document."""
        for k, (known, own) in items.short.items():
            g, at, gfirst = shingles(words, first, k)
            place = np.minimum(np.searchsorted(known, g), len(known) - 1)
            hit = np.flatnonzero(known[place] == g)
            doc = np.searchsorted(gfirst, hit, "right") - 1
            _, one = np.unique(doc * len(known) + place[hit], return_index=True)
            for j in one.tolist():
                a = int(at[hit[j]])
                yield int(doc[j]), items.md[own[place[hit[j]]]], 1.0, a, a + k

    def pieces(d: int, a: int, b: int, i: int) -> Iterator[tuple[int, int, int, int]]:
        """A long passage in stretches: an alignment that reaches the threshold spans at most three times the item."""
        first = shared.value[0].first
        long = int(first[i + 1] - first[i])
        overlap = (1 + MATCH) * long
        step = max(STRETCH, overlap)
        if b - a <= 2 * step:
            yield d, a, b, i
            return
        for low in range(a, b - overlap, step):
            yield d, low, min(b, low + step + overlap), i

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, bits = shared.value
        known, wide, may = items.grams, items.reach, np.unpackbits(bits).astype(bool)
        for batch in batches:
            for rows, texts in slices(batch, text_col):
                words, first = hash_words(texts, WORDS, fold=True)
                out = list(whole(items, words, first))
                g, at, gfirst = shingles(words, first, n)
                hit = np.flatnonzero(may[(g >> np.uint64(44)).astype(np.int64)])
                if len(hit):
                    place = np.minimum(np.searchsorted(known, g[hit]), len(known) - 1)
                    good = known[place] == g[hit]
                    hit, place = hit[good], place[good]
                if len(hit):
                    doc = np.searchsorted(gfirst, hit, "right") - 1
                    low = np.maximum(at[hit] - wide[place], first[doc])
                    high = np.minimum(at[hit] + n + wide[place], first[doc + 1])
                    top = np.maximum.accumulate(high)
                    new = np.concatenate([[True], (low[1:] > top[:-1]) | (doc[1:] != doc[:-1])])
                    begin = np.flatnonzero(new)
                    end = np.append(begin[1:], len(hit))
                    start = np.minimum.reduceat(low, begin).tolist()
                    stop = np.maximum.reduceat(high, begin).tolist()
                    pairs = []
                    for d, a, b, x, y in zip(doc[begin].tolist(), start, stop, begin.tolist(), end.tolist(), strict=True):
                        for i in items.likely(place[x:y], words[a:b], threshold):
                            pairs += pieces(d, a, b, i)
                        if len(pairs) >= 4096:
                            out += scored(pairs, words)
                            pairs = []
                    out += scored(pairs, words)
                if out:
                    d = np.array([o[0] for o in out])
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(id_col).take(pa.array(d)), pa.array([o[1] for o in out]), pa.array([o[2] for o in out]), *(pa.array(np.array([o[k] for o in out]) - first[d]) for k in (3, 4))],
                        ["key", "md", "score", "start_word", "end_word"],
                    )

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.where(F.col(id_col).isNotNull()).select(id_col, text_col), run, f"key {kind}, md string, score double, start_word bigint, end_word bigint")


def find(docs: DataFrame, items: DataFrame, n: int = 4, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id_col, item_id, score, start_word, end_word``: the best aligned passage of each document and item that reach the threshold."""
    spark = docs.sparkSession
    of_item = cut(words_of(items, item_id, item_text).where(F.octet_length("words") > 0).withColumn("md", F.sha2("words", 256)))
    once = of_item.groupBy("md").agg(F.any_value("words").alias("words"))
    total = once.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    blocks = max(1, -(-total // (8 * BLOCK_WORDS)))
    found = None
    for b in range(blocks):
        block = once.where(F.pmod(F.xxhash64("md"), F.lit(blocks)) == b)
        table = block.toArrow()
        if not table.num_rows:
            continue
        part = cut(aligned(docs, Items(table, n), n, threshold, id_col, text_col))
        found = part if found is None else found.union(part)
    if found is None:
        kind, item_kind = (d.schema[c].dataType.simpleString() for d, c in ((docs, id_col), (items, item_id)))
        return spark.createDataFrame([], f"`{id_col}` {kind}, `{item_id}` {item_kind}, score double, start_word bigint, end_word bigint")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("key", "md").orderBy(F.desc("score"), "start_word", "end_word"))).where("rank = 1")
    return best.join(of_item.select("md", F.col("item").alias(item_id)).distinct(), "md").select(F.col("key").alias(id_col), item_id, "score", "start_word", "end_word")


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = 4, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    gone = find(docs, items, n, threshold, id_col, text_col, item_id, item_text).select(id_col).distinct()
    return docs.join(gone, id_col, "left_anti")
