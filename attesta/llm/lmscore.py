"""Language-model scoring of whole texts with a causal self-attention model over subword ids.

Words are runs of bytes other than ASCII white space, A-Z lower-cased; each text ends with an end token. A word is split
into subwords of a public vocabulary (longest match first, single bytes always match); an id also says whether it
begins a word, so ids and words determine each other.

The network of :mod:`attention` is trained on executors. Every document outside the held-out fold gives all its windows,
to one of the rounds; each task takes a pass of Adam over its own from the round's start, and weighted sums of
parameters, added up by Spark, make the next start. Small corpora are gone through several times, until about
``PASS_IDS`` ids were seen. The network's size does not grow with the corpus.

The model's probability of the next word in its context is a mixture of two distributions over all words and the end:
the network's (the product over the word's subwords and the beginning of another word after it, given that one
begins here) and the relative frequency of the word in the whole training fold. So a text's probability is a product of
conditional probabilities that sum to at most one. The weight of the counts is the one of ``WEIGHTS`` under which all of
the training fold is likeliest, each word's own occurrence left out of its count. ``score`` is the model's log10
probability, ``network_score`` the network's alone, ``base_score`` that of the smoothed unigram
``(c + 0.5) / (N + 0.5 (V + 1))``.

Texts become ids once, in one pass that also counts words by block (``BLOCK`` bytes of consecutive texts of a task); no
table of all words is ever sent anywhere: each block asks once for each of its words, counts are added up by word, and
come back to the block.

Null and empty texts are one end token. Very long texts and words are handled in pieces of bounded size. Repeated rows get
equal scores, up to rounding. Unknown words have count 0. With an empty training fold the untrained network alone scores, the base score
is 0. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from attesta.session import cut

from . import attention
from .bpe import read_ranks
from .frames import bucket, mapped
from .lookup import Lookup
from .text import BY_SPACE, _power, mix, raw, slices, tokens

#: Bytes of text in a block; distinct words in a row of a block's counts; ids that training draws windows from, and ids (or bytes) handled at once.
BLOCK, LISTED, DRAWN, AT_ONCE = 16 << 20, 1 << 16, 1 << 20, 1 << 17
#: Pieces of the vocabulary, the bytes of the longest, and of words that are split by another way than side by side.
PIECES, LONGEST, LONG_WORD = 2047, 8, 64
HALF = PIECES + 1
VOCABULARY = 2 * HALF
END = VOCABULARY - 1
#: Ids that training sees at least, in several passes if need be, and the most passes.
PASS_IDS, PASSES = 12 << 20, 12
#: Weights that the counts may get.
WEIGHTS = (0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.7)
_VALUES = np.random.default_rng(0x1D5).integers(0, 1 << 63, VOCABULARY, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


class Subwords:
    """Longest-match subwords from the lowest ranks of a public vocabulary, by walking a trie of bytes for many words at once."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        found = dict.fromkeys(bytes([b]) for b in range(256) if b not in (9, 10, 11, 12, 13, 32) and not 65 <= b <= 90)
        for t in sorted(ranks, key=ranks.get):
            t = t[1:] if t[:1] == b" " else t
            if len(found) < PIECES and 1 < len(t) <= LONGEST and not any(65 <= b <= 90 or b in (9, 10, 11, 12, 13, 32) for b in t):
                found.setdefault(t)
        self.pieces = sorted(found)
        nodes: dict[bytes, int] = {b"": 1}  # 0: no piece begins so
        for t in self.pieces:
            for n in range(1, len(t) + 1):
                nodes.setdefault(t[:n], len(nodes) + 1)
        after, self.accepts = np.zeros((len(nodes) + 1, 256), np.int16), np.full(len(nodes) + 1, -1, np.int32)
        for t, k in nodes.items():
            if t:
                after[nodes[t[:-1]], t[-1]] = k
        for i, t in enumerate(self.pieces):
            self.accepts[nodes[t]] = i
        after[:, 65:91] = after[:, 97:123]  # A-Z are read as a-z
        self.after = after.ravel()

    def longest(self, data: np.ndarray, at: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The longest piece at each place that ends by its end, and its size."""
        piece, size = np.zeros(len(at), np.int32), np.zeros(len(at), np.int64)
        walk, node, pos = np.arange(len(at)), np.ones(len(at), np.int64), at
        for n in range(1, LONGEST + 1):
            node = self.after.take(node * 256 + data.take(pos)).astype(np.int64)
            go = np.flatnonzero(node)
            if len(go) < len(node):
                walk, node, pos = walk.take(go), node.take(go), pos.take(go)
            got = self.accepts.take(node)
            has = np.flatnonzero(got >= 0)
            piece[walk.take(has)], size[walk.take(has)] = got.take(has), n
            pos = pos + 1
            go = np.flatnonzero(pos < ends.take(walk))
            if not len(go):
                break
            walk, node, pos = walk.take(go), node.take(go), pos.take(go)
        return piece, size

    def split(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words ``data[starts[i]:ends[i]]`` in order, and the number of each word's ids."""
        count = np.zeros(len(starts), np.int64)
        short = np.flatnonzero(ends - starts <= LONG_WORD)
        live, at, stop, rounds = short, starts[short], ends[short], []
        while len(live):
            piece, size = self.longest(data, at, stop)
            rounds.append((live, piece))
            at = at + size
            go = np.flatnonzero(at < stop)
            live, at, stop = live.take(go), at.take(go), stop.take(go)
        for live, _ in rounds:
            count[live] += 1
        long = []
        for w in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            found, a, b = [], int(starts[w]), int(ends[w])
            for low in range(a, b, AT_ONCE):  # pieces at every place, then those that follow one another
                high = min(b, low + AT_ONCE)
                place = np.arange(low, high)
                piece, size = self.longest(data, place, np.full(len(place), b))
                piece, size = piece.tolist(), size.tolist()
                while a < high:
                    found.append(piece[a - low])
                    a += size[a - low]
            count[w] = len(found)
            long.append((w, found))
        first = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        for k, (live, piece) in enumerate(rounds):
            out[first.take(live) + k] = piece + (HALF if k == 0 else 0)
        for w, found in long:
            out[first[w] : first[w] + len(found)] = found
            out[first[w]] += HALF
        return out, count


_subwords: dict[str, Subwords] = {}


def subwords(path: str) -> Subwords:
    if path not in _subwords:
        _subwords[path] = Subwords(path)
    return _subwords[path]


def id_stream(sub: Subwords, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts, an end after each, and each text's first id."""
    data, off = raw(texts)
    starts, ends, first = tokens(data, off, BY_SPACE)
    ids, count = sub.split(data, starts, ends)
    bounds = np.concatenate([[0], np.cumsum(count)])[first] + np.arange(len(first))  # with the ends of the texts before
    out = np.full(int(bounds[-1]), END, np.int32)
    is_end = np.zeros(len(out), bool)
    is_end[bounds[1:] - 1] = True
    out[~is_end] = ids
    return out, bounds


def word_hashes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each token (a word or an end) of a stream begins, and its hash."""
    begin = np.flatnonzero(ids >= HALF)
    to = np.append(begin[1:], len(ids))
    total = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum(_VALUES.take(ids) * _power("p", len(ids)), out=total[1:])
    h = (total.take(to) - total.take(begin)) * _power("i", len(ids)).take(begin)
    return begin, mix(h + (to - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def streams(rows: pa.RecordBatch | pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive rows of about ``AT_ONCE`` ids with their ids (from a binary column of 16 bits each) and each row's first."""
    for batch in rows.to_batches() if isinstance(rows, pa.Table) else [rows]:
        column = batch.column("ids").cast(pa.large_binary())
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        at = 0
        while at < len(column):
            to = max(at + 1, int(np.searchsorted(off, off[at] + 2 * AT_ONCE, "right")) - 1)
            data = np.frombuffer(column.buffers()[2], np.uint8)[off[at] : off[to]].tobytes()
            yield batch.slice(at, to - at), np.frombuffer(data, np.int16).astype(np.int32), (off[at : to + 1] - off[at]) // 2
            at = to


def encoded(docs: DataFrame, path: str, held: str, id_col: str, text_col: str) -> DataFrame:
    """``block, no, key, held, ids, h, n``: a row for each document with its ids, then for each block the hashes of its
    words and how often each is in its training rows; in block -1 a task's counts of ids in training rows."""
    names = ["block", "no", "key", "held", "ids", "h", "n"]
    kind = docs.schema[id_col].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sub, task = subwords(path), TaskContext.get().partitionId()
        types = [pa.int64(), pa.int64(), to_arrow_type(kind), pa.bool_(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        total = np.zeros(VOCABULARY, np.int64)
        block, no, size, words = task << 24, 0, 0, []

        def lists(block: int, h: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(h), LISTED):
                row = [[block], [None], [None], [None], [None], [h[k : k + LISTED].view(np.int64)], [n[k : k + LISTED]]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names)

        def added(parts) -> tuple[np.ndarray, np.ndarray]:
            h, n = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            order = np.argsort(h)
            h = h[order]
            heads = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[heads], np.add.reduceat(n[order], heads)

        for batch in batches:
            for rows, texts in slices(batch, text_col):
                ids, first = id_stream(sub, texts)
                learnt = ~rows.column(held).to_numpy(zero_copy_only=False)
                begin, h = word_hashes(ids)
                own = np.repeat(learnt, np.diff(np.searchsorted(begin, first)))
                word = ids.take(begin) != END
                if word.any():
                    words.append(added([(h[word], own[word].astype(np.int64))]))
                    if len(words) > 12:
                        words = [added(words)]
                total += np.bincount(ids[np.repeat(learnt, np.diff(first))], minlength=VOCABULARY)
                column = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(2 * first), pa.py_buffer(ids.astype(np.int16))]).cast(pa.binary())
                none = [pa.nulls(len(rows), t) for t in types[5:]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), block)), pa.array(np.arange(no, no + len(rows))), rows.column(id_col), rows.column(held), column, *none], names)
                no += len(rows)
                size += int(first[-1]) * 2
                if size >= BLOCK and words:
                    yield from lists(block, *added(words))
                    block, size, words = block + 1, 0, []
        if words:
            yield from lists(block, *added(words))
        some = np.flatnonzero(total)
        yield from lists(-1, some, total[some])

    schema = f"block bigint, no bigint, key {kind.simpleString()}, held boolean, ids binary, h array<bigint>, n array<bigint>"
    return mapped(docs.select(id_col, text_col, held), run, schema)


def train(rows: DataFrame, counts: np.ndarray, rounds: int = 3) -> attention.Net:
    """A network trained by rounds of local passes and averaged parameters, each over its own part of ``rows (block, no, ids)``."""
    spark = rows.sparkSession
    net = attention.fresh(counts, END)
    if not counts.any():
        return net
    of = F.pmod(F.xxhash64("block", "no"), F.lit(rounds))
    again = rounds * min(PASSES, max(1, round(PASS_IDS / counts.sum())))
    for k in range(again):
        shared = spark.sparkContext.broadcast(net)

        def run(batches: Iterable[pa.RecordBatch], k=k, again=again, shared=shared) -> Iterator[pa.RecordBatch]:
            def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                held, size = [], 0
                for batch in batches:
                    for _, ids, first in streams(batch):
                        held.append((ids, first))
                        size += len(ids)
                        if size >= DRAWN:
                            yield joined(held)
                            held, size = [], 0
                if held:
                    yield joined(held)

            new, n = attention.fit(shared.value, parts(), rate=0.02 * (1 - k / again) + 0.002, seed=k)
            if n:
                x = np.append(new.flat * np.float64(n), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(x), dtype=np.int32)), pa.array(x)], ["at", "x"])

        # few tasks with longer passes: each sends a whole vector, and these are added up by place, never all in one task
        part = rows.where(of == k % rounds).select("ids")
        fewer = part.coalesce(max(1, part.rdd.getNumPartitions() // 4))
        got = mapped(fewer, run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        if got.num_rows:
            total = np.zeros(got.num_rows)
            total[got.column("at").to_numpy()] = got.column("x").to_numpy()
            net = net.having((total[:-1] / total[-1]).astype(np.float32))
        shared.unpersist()
    return net


def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    base = np.cumsum([0, *(len(ids) for ids, _ in parts)])
    return np.concatenate([ids for ids, _ in parts]), np.concatenate([[0], *(first[1:] + b for (_, first), b in zip(parts, base[:-1], strict=True))])


def network_tokens(net: attention.Net, ids: np.ndarray, first: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Natural log probability of each token (those that begin at ``begin``) among all words and the end, by the network alone."""
    logp, begins = attention.score(net, ids, first)
    out = np.add.reduceat(logp, begin).astype(np.float64) if len(begin) else np.zeros(0)
    out -= begins.take(begin)
    word = np.flatnonzero(ids.take(begin) != END)  # a token follows each of these
    out[word] += begins.take(begin.take(word + 1))
    return out


def mixed(network: np.ndarray, probability: np.ndarray, frequency: np.ndarray, weight: float) -> np.ndarray:
    """log10 of the mixture of probabilities; the network's are given as natural logarithms and as they are."""
    x = probability * np.float32(1 - weight)
    x += frequency * np.float32(weight)
    tiny = np.flatnonzero(x < 1e-30)  # long words that were never seen: too little for a float
    out = np.log(np.maximum(x, np.float32(1e-30), out=x), out=x).astype(np.float64)  # numpy's log10 takes four times as long
    with np.errstate(divide="ignore"):  # words of count 0 have the network's share alone
        out[tiny] = np.logaddexp(network[tiny] + math.log1p(-weight), np.log(frequency[tiny]) + math.log(weight))
    out /= math.log(10)
    return out


def score(docs: DataFrame, path: str, folds: int = 5, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, network_score`` for every row."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), (bucket(id_col, folds) == held_out).alias("held"))
    stored = cut(encoded(rows, path, "held", "key", "text"))
    texts = stored.where("ids IS NOT NULL")
    listed = stored.where("h IS NOT NULL").select("block", F.inline(F.arrays_zip("h", "n")))
    ids = listed.where("block = -1").groupBy("h").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(VOCABULARY, np.int64)
    counts[[r["h"] for r in ids]] = [r["n"] for r in ids]
    net = train(texts.where("NOT held").select("block", "no", "ids"), counts)

    asked = listed.where("block >= 0")
    of = Window.partitionBy("h")  # one shuffle: a word's blocks are few, and a join would send them twice
    answers = cut(asked.select("block", "h", F.sum("n").over(of).alias("c"), (F.col("block") == F.min("block").over(of)).alias("owns")))
    n_words, v_words = answers.where("owns AND c > 0").agg(F.sum("c"), F.count(F.lit(1))).first()
    n_docs = int(counts[END])
    total, distinct = (n_words or 0) + n_docs, v_words + (n_docs > 0)
    bottom = total + 0.5 * (distinct + 1)
    shared = spark.sparkContext.broadcast(net)

    names = ["key", "held", "n_tokens", "n_known", "base", "network", "scores", "without"]
    types = [to_arrow_type(kind), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lookup, known = Lookup(right.column("h").to_numpy().view(np.uint64)), np.append(right.column("c").to_numpy(), n_docs)  # the last: the end
        logs = np.log10((known + 0.5) / bottom)  # once for each distinct word
        shares, less = (known / max(total, 1)).astype(np.float32), (np.maximum(known - 1, 0) / max(total - 1, 1)).astype(np.float32)
        out = []
        for part, ids, first in streams(left):
            begin, h = word_hashes(ids)
            place = np.full(len(begin), len(known) - 1)
            word = np.flatnonzero(ids.take(begin) != END)
            place[word] = lookup.find(h.take(word))
            network = network_tokens(shared.value, ids, first, begin)
            at = np.searchsorted(begin, first)

            def by_text(x: np.ndarray, at=at) -> np.ndarray:
                return np.add.reduceat(x, at[:-1])

            base = by_text(logs.take(place))
            probability, share, others = np.exp(network.astype(np.float32)), shares.take(place), less.take(place)
            scores, without = np.zeros((len(first) - 1, len(WEIGHTS))), np.zeros((len(first) - 1, len(WEIGHTS)))
            learnt = np.repeat(~part.column("held").to_numpy(zero_copy_only=False), np.diff(at))
            for k, w in enumerate(WEIGHTS if total else ()):
                scores[:, k] = by_text(mixed(network, probability, share, w))
                if total > 1:  # what the text itself has added to the counts is left out, a word at a time
                    without[:, k] = by_text(mixed(network, probability, others, w) * learnt)
            lists = (pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(WEIGHTS)), pa.array(x.ravel())) for x in (scores, without))
            columns = (part.column("key"), part.column("held"), np.diff(at), by_text((known.take(place) > 0).astype(np.int64)), base, by_text(network) / math.log(10), *lists)
            out.append(pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names))
        schema = pa.schema(list(zip(names, types, strict=True)))
        return pa.Table.from_batches(out, schema) if out else schema.empty_table()

    spec = f"key {kind.simpleString()}, held boolean, n_tokens bigint, n_known bigint, base double, network double, scores array<double>, without array<double>"
    scored = cut(texts.select("block", "key", "held", "ids").groupBy("block").cogroup(answers.select("block", "h", "c").groupBy("block")).applyInArrow(run, spec))
    tried = scored.agg(*(F.sum(F.col("without")[k]).alias(str(k)) for k in range(len(WEIGHTS)))).first()
    best = max(range(len(WEIGHTS)), key=lambda k: tried[k] if tried[k] is not None else 0.0)
    return scored.select(
        F.col("key").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"),
        (F.col("scores")[best] if total else F.col("network")).alias("score"), F.col("network").alias("network_score"),
    )
