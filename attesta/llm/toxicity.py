"""Toxicity: noisy-channel deobfuscation, then a classifier over the restored words.

Restoring. A token is read as a lattice: each sign may stand for itself, for letters it imitates (leetspeak), for
nothing, or for another copy of the letter before it (repetition: runs of three or more, and four doubled letters in a row);
runs of single characters between spaces, dots,
dashes or stars are one token whose separators may be dropped (spacing); such a run that is longer than any word is
parted into words where the model finds that cheaper. A Viterbi search takes the cheapest path
under a character trigram model of the corpus plus channel costs, over the whole token however long. A plain token has one path and is only lower-cased.

Scoring. Restored words feed a hashed word n-gram logistic regression with FTRL updates, learnt from labelled rows
outside the held-out fold, about ``max_train`` at most (the lowest crc32 of the key). The character model counts all rows
outside that fold; its 32**3 cells do not grow with the corpus.

A text is restored by itself: what else is in the table does not matter to it. Null and empty texts get the score of the bias alone. With no labels every score is 0.5. Ties in the search go to
the first candidate in lattice order. Very long texts and tokens take time in proportion. Repeated rows get equal scores; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bucket, mapped
from .ftrl import Ftrl, sigmoid
from .langid import symbols
from .quality import labelled
from .text import mix, raw, slices, strings, token_hashes, tokens

#: Letters that signs imitate. Fixed values.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "{": "c", "€": "e", "£": "l", "¡": "i", "&": "a", "#": "h", "%": "x", "?": "", "*": "aeiou", "^": "a", "¥": "y", "§": "s",
}
#: Costs in nats of channel events.
IMITATION, DROP, DROP_DIGIT, REPEAT, DOUBLE, KEEP_SIGN = 1.0, 2.5, 8.0, 0.7, 1.5, 9.0
CELLS = 32
SPACED = regex.compile(r"(?<![\p{L}\p{N}@$!])[\p{L}\p{N}@$!]([ .\-_*]{1,2})(?:[\p{L}\p{N}@$!]\1){2,}[\p{L}\p{N}@$!](?![\p{L}\p{N}@$!])")
#: Letters of a spaced run beyond which it may be several words.
WORD = 24


def points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and each text's first one."""
    data, off = raw(texts)
    place = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[off]  # bytes that start a code point
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), place


_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """A symbol for each code point: 0 for what is no letter, 1-26 for a-z, 27 for any other letter."""
    if not _kinds:
        _kinds.append(np.minimum(symbols(), 27))
    return _kinds[0]


def cells(texts: pa.Array) -> np.ndarray:
    """Trigram cells (0 boundary, 1-26 letters, 27 any other letter) of all characters in the texts, lower-cased."""
    found, place = points(texts)
    if not len(found):
        return np.zeros(0, np.int64)
    s = np.zeros(len(found) + len(place), np.int32)
    s[np.arange(len(found)) + np.repeat(np.arange(len(place) - 1), np.diff(place))] = kinds()[found]
    a = np.concatenate([[0], s[:-1]])
    b = np.concatenate([[0], a[:-1]]) * (a != 0)
    return ((b * CELLS + a) * CELLS + s)[(s != 0) | (a != 0)]


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Costs (negative log probabilities) of all trigram cells, interpolated with bigrams and single characters."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS**3, np.int64)
        for batch in batches:
            for _, texts in slices(batch, text_col):
                total += np.bincount(cells(texts), minlength=CELLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    got = mapped(docs.select(text_col), run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(CELLS**3)
    n[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    n = n.reshape(CELLS, CELLS, CELLS)
    one = (n.sum((0, 1)) + 0.5) / (n.sum() + 0.5 * CELLS)
    two = (n.sum(0) + 4 * one) / (n.sum((0, 2))[:, None] + 4)
    three = (n + 4 * two[None]) / (n.sum(2)[:, :, None] + 4)
    return -np.log(three)


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


class Restorer(dict):
    """Maps a token to its restored form; remembers a bounded number of odd tokens."""

    def __init__(self, costs: np.ndarray, remembered: int = 200_000):
        super().__init__()
        self.costs = costs.tolist()
        self.remembered = remembered

    def __missing__(self, token: str) -> str:
        out = self.viterbi(token.lower())
        if len(self) >= self.remembered:
            self.clear()
        if len(token) <= 64:
            self[token] = out
        return out

    def viterbi(self, token: str) -> str:
        """The cheapest reading of a lower-cased token. State: the last two symbols and the last letter read; a reading is a chain of its signs."""
        costs = self.costs
        best: dict[tuple[int, int, str], tuple[float, tuple | None]] = {(0, 0, ""): (0.0, None)}
        again = repeats(token)
        for at, c in enumerate(token):
            sym = symbol(c)
            after: dict[tuple[int, int, str], tuple[float, tuple | None]] = {}

            def put(state, cost, out, after=after):
                if state not in after or cost < after[state][0]:
                    after[state] = (cost, out)

            for (a, b, last), (cost, out) in best.items():
                if sym:
                    put((b, sym, c), cost + costs[a][b][sym], (out, c))
                    if c == last and at in again:
                        put((a, b, last), cost + again[at], out)
                else:
                    for x in IMITATES.get(c, ""):
                        k = ord(x) - 96
                        put((b, k, x), cost + IMITATION + costs[a][b][k], (out, x))
                        if x == last and at in again:
                            put((a, b, last), cost + IMITATION + again[at], out)
                    put((a, b, last), cost + (DROP_DIGIT if c.isalnum() else DROP), out)
                    if b:
                        put((0, 0, ""), cost + costs[a][b][0] + (KEEP_SIGN if c.isalnum() else DROP), (out, c))
                    else:
                        put((0, 0, ""), cost + (KEEP_SIGN if c.isalnum() else DROP), (out, c))
            best = after
        return spelled(min(((cost + (costs[a][b][0] if b else 0.0), out) for (a, b, _), (cost, out) in best.items()), key=lambda x: x[0])[1])

    def parted(self, word: str) -> tuple[float, str]:
        """The cheapest way to read letters as a word, or as several if they are more than any word has; its cost and the words."""
        costs, may_break = self.costs, sum(map(str.isalpha, word)) > WORD
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for c in word:
            k, after = symbol(c), {}
            for (a, b), (cost, out) in best.items():
                ways = [((b, k), cost + costs[a][b][k], (out, c))] if k else [((a, b), cost, (out, c))]
                if k and b and may_break:
                    ways.append(((0, k), cost + costs[a][b][0] + costs[0][0][k], ((out, " "), c)))
                for state, total, chain in ways:
                    if state not in after or total < after[state][0]:
                        after[state] = (total, chain)
            best = after
        cost, out = min(((cost + costs[a][b][0], out) for (a, b), (cost, out) in best.items()), key=lambda x: x[0])
        return cost, spelled(out)


def spelled(chain: tuple | None) -> str:
    out = []
    while chain is not None:
        chain, c = chain
        out.append(c)
    return "".join(reversed(out))


_SIGNS = frozenset("0123456789@$!|+(<{€£¡&#%*^¥§")
LONG_RUN = regex.compile(r"(.)\1\1+", regex.S)
DOUBLED = regex.compile(r"(?:(\p{L})\1){4,}")  # three in a row occur in plain words
_REPEATED = regex.compile(r"(\p{L})\1\1|(\p{L})\2(\p{L})\3(\p{L})\4(\p{L})\5", regex.I)


def repeats(token: str) -> dict[int, float]:
    """Places that may be another copy of the letter before, and what that costs."""
    out = {k: DOUBLE for m in DOUBLED.finditer(token) for k in range(m.start() + 1, m.end(), 2)}
    return out | {k: REPEAT for m in LONG_RUN.finditer(token) for k in range(m.start() + 1, m.end())}


def squeeze(spaced: str) -> str:
    return regex.sub(r"[ .\-_*]{1,2}(?=[\p{L}\p{N}@$!*])", "", spaced)


def odd_texts(low: pa.Array) -> np.ndarray:
    """Which lower-cased texts may hold a token to be restored: signs, repeated letters, spaced runs."""
    spaced = pc.match_substring_regex(low, r"(^|[^\pL\pN])[\pL\pN@$!][ .\-_*]{1,2}[\pL\pN@$!][ .\-_*]{1,2}[\pL\pN@$!]").to_numpy(zero_copy_only=False)
    found, place = points(low)
    if not len(found):
        return spaced
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in _SIGNS]] = True
    mark = table[found]
    same = (found[1:] == found[:-1]) & (kinds()[found[1:]] > 0)
    mark[2:] |= same[1:] & same[:-1]
    mark[7:] |= same[6:] & same[4:-2] & same[2:-4] & same[:-6]
    total = np.concatenate([[0], np.cumsum(mark)])
    return spaced | (total[place[1:]] > total[place[:-1]])


def restored(texts: pa.Array, restorer: Restorer) -> pa.Array:
    """Whole texts with odd tokens restored, lower-cased."""
    low = pc.utf8_lower(texts)
    odd = np.flatnonzero(odd_texts(low))
    if not len(odd):
        return low
    out = low.to_pylist()
    for k in odd.tolist():
        t = SPACED.sub(lambda m: unspaced(m[0], restorer), out[k])
        out[k] = " ".join([restorer[w] if is_odd(w) else w for w in t.split()])
    return pa.array(out, pa.large_string())


def is_odd(word: str) -> bool:
    if word.isascii() and word.isalpha():
        return _REPEATED.search(word) is not None
    return (not _SIGNS.isdisjoint(word) or _REPEATED.search(word) is not None) and any(map(str.isalpha, word))


def unspaced(span: str, restorer: Restorer) -> str:
    """One word (or several, if it is too long for one) where the model finds that likelier than single letters, else the span itself."""
    letters = squeeze(span)
    if len(set(letters)) < 3:
        return span
    word = restorer[letters] if is_odd(letters) else letters
    known = [symbol(c) for c in word if c.isalpha()]
    if len(known) < 4:
        return span
    joined, words = restorer.parted(word)
    c = restorer.costs
    apart = sum(c[0][0][k] + c[0][k][0] for k in known)
    return words if joined < apart else span


WORDS = np.zeros(256, np.uint8)
WORDS[48:58] = WORDS[65:91] = WORDS[97:123] = WORDS[128:] = 1


#: Inflected and compound forms share the beginnings of words: these many bytes of a longer word are features too.
BEGINNINGS = (4, 5, 6, 7, 8)


def slots(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all words and of their beginnings, and each document's first slot."""
    data, off = raw(texts)
    starts, ends, first = tokens(data, off, WORDS)
    cols = [token_hashes(data, starts, ends, fold=True)]
    cols += [mix(token_hashes(data, starts, np.minimum(starts + k, ends), fold=True) + np.uint64(k)) for k in BEGINNINGS]
    return (np.stack(cols, axis=1) >> np.uint64(64 - bits)).astype(np.int64).ravel(), first * len(cols)


#: Length of a document's feature vector.
SCALE = 8.0


def vectors(found: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse vectors of unit direction: document, slot and value, by ``log(1 + count)``."""
    key = np.repeat(np.arange(len(first) - 1), np.diff(first)) << bits | found
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    value = np.log1p(np.diff(np.append(at, len(key))))
    doc = key[at] >> bits
    norm = np.sqrt(np.bincount(doc, value * value, len(first) - 1))
    return doc, key[at] & ((1 << bits) - 1), SCALE * value / norm[doc]


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    costs: np.ndarray


def train(docs: DataFrame, labels: DataFrame, bits: int = 18, folds: int = 4, held_out: int = 2, max_train: int = 12000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    costs = character_model(docs.where(bucket(id_col, folds) != held_out), text_col)
    rows = sorted(((r.y, r.text or "") for r in labelled(docs, labels, "toxic", folds, held_out, max_train, id_col, text_col).toLocalIterator()), key=lambda r: (r[1], r[0]))
    data, ys, restorer = [], [], Restorer(costs)
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        found, first = slots(restored(strings(pa.array([t for _, t in part])), restorer), bits)
        doc, slot, value = vectors(found, first, bits)
        edges = np.searchsorted(doc, np.arange(len(part) + 1))
        for k, (y, _) in enumerate(part):
            own = slice(edges[k], edges[k + 1])
            data.append((slot[own].astype(np.int32), value[own].astype(np.float32)))
            ys.append(y)
    m = Ftrl(1 << bits, alpha=0.3, l1=1.0, l2=1.0).fit(data, np.array(ys))
    return Model(*m.model(), costs)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, predicted`` for every row."""
    bits = int(np.log2(len(model.weights)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.costs)
        for batch in batches:
            for rows, texts in slices(batch, text_col):
                doc, slot, value = vectors(*slots(restored(texts, restorer), bits), bits)
                s = sigmoid(np.bincount(doc, model.weights[slot] * value, len(texts)) + model.bias)
                yield pa.RecordBatch.from_arrays([rows.column(id_col), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, score double, predicted int")
