"""Language identification with interpolated Kneser-Ney character models, one per language.

Texts are read as lower-cased letters; anything else is a word boundary, and contexts do not reach over it. A
symbol has 6 bits, so a 4-gram is a 24-bit hash and a table has at most 2**24 entries per language however large
the corpus is. Grams of all languages lie in one sorted hash array with a column of log probabilities for each
language; other grams back off to trigram and context tables. Languages are taken ``AT_ONCE`` to such an array, arrays
of ``SENT`` bytes or so to a pass over the texts: any number of languages is handled. A text gets the language of the lowest
cross-entropy per symbol.

Scores are calibrated on about ``calibrate`` rows (the lowest crc32 of the key, at most a tenth of all) that the counts
do not include, as is the cross-entropy beyond which ``rejected`` is true; languages with fewer than 20 such rows share
one limit, taken over all languages' rows.

Null texts and texts without letters get ``und``, score 0 and ``rejected``. With nothing to learn from every row is
``und``. Rows with a null language are not learnt from. Ties go to the first language in name order. Very long texts
are read whole. Repeated rows get equal results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bucket, mapped
from .text import raw, slices, strings

ORDER, BITS = 4, 6
WIDTH = 1 << BITS
#: Languages of one array, and bytes of arrays that are sent to workers for one pass.
AT_ONCE, SENT = 64, 1 << 30

_symbols: list[np.ndarray] = []


def symbols() -> np.ndarray:
    """A symbol for each code point: 0 for what is no letter, 1-26 for a-z, 27-63 for other letters."""
    if not _symbols:
        table = np.zeros(0x110000, np.uint8)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                table[cp] = low - 96 if 97 <= low <= 122 else 27 + low % 37
        _symbols.append(table)
    return _symbols[0]


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """4-gram codes of all symbols (letters, and the end of each word), and each document's first code."""
    data, off = raw(texts)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
    lead = (data & 0xC0) != 0x80  # bytes that start a code point
    place = np.concatenate([[0], np.cumsum(lead)])[off]
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    s = np.zeros(len(points) + len(off), np.int32)  # a boundary after each text
    docs = np.repeat(np.arange(len(off) - 1), np.diff(place))
    s[np.arange(len(points)) + docs] = symbols()[points]
    first = place + np.arange(len(off))
    a = np.concatenate([[0], s[:-1]]).astype(np.int32)
    b = np.concatenate([[0], a[:-1]]).astype(np.int32) * (a != 0)
    c = np.concatenate([[0], b[:-1]]).astype(np.int32) * (b != 0)
    keep = np.flatnonzero((s != 0) | (a != 0))
    code = (((c << BITS | b) << BITS | a) << BITS | s)[keep]
    return code, np.searchsorted(keep, first)


def counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``lang, code, n``: 4-gram counts of every language over all rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def merged(parts):
            codes, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return codes, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64)

        for batch in batches:
            for rows, texts in slices(batch, text_col):
                code, first = grams(texts)
                names = rows.column(lang_col).dictionary_encode()
                which = np.repeat(names.indices.fill_null(-1).to_numpy(zero_copy_only=False), np.diff(first))
                for k, lang in enumerate(names.dictionary.to_pylist()):
                    parts = held.setdefault(lang, [])
                    parts.append(np.unique(code[which == k], return_counts=True))
                    if len(parts) > 16:
                        parts[:] = [merged(parts)]
        for lang, parts in held.items():
            codes, n = merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int32)), pa.array(n)], ["lang", "code", "n"])

    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias(lang_col), text_col)
    return mapped(known, run, "lang string, code int, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    langs: list[str]
    keys: np.ndarray  # sorted 4-gram codes of all languages
    table: np.ndarray  # log probabilities of these, a column for each language
    tri: np.ndarray  # log probabilities of trigrams, dense
    gamma: np.ndarray  # log weights that a 3-symbol context gives to its trigrams, dense

    @property
    def size(self) -> int:
        return self.keys.nbytes + self.table.nbytes + self.tri.nbytes + self.gamma.nbytes

    def logp(self, codes: np.ndarray) -> np.ndarray:
        """Log probabilities of 4-gram codes, a column for each language."""
        at = np.minimum(np.searchsorted(self.keys, codes), max(0, len(self.keys) - 1))
        found = self.keys[at] == codes if len(self.keys) else np.zeros(len(codes), bool)
        out = self.gamma[codes >> BITS] + self.tri[codes & ((1 << 3 * BITS) - 1)]
        out[found] = self.table[at[found]]
        return out


def smoothed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interpolated Kneser-Ney: probabilities of all trigrams, weights of all 3-symbol contexts, probabilities of ``codes``."""
    lower = np.full(WIDTH, 1 / WIDTH)  # order 0, by symbol
    kinds = {ORDER: (codes, n.astype(np.float64))}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols to the left
        above = kinds[k + 1][0]
        kinds[k] = tuple(map(np.asarray, np.unique(above & ((1 << BITS * k) - 1), return_counts=True)))
    for k in range(1, ORDER + 1):
        c, m = kinds[k]
        ones, twos = (m == 1).sum(), (m == 2).sum()
        d = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        context = c >> BITS
        total = np.bincount(context, m, 1 << BITS * (k - 1))
        types = np.bincount(context, minlength=1 << BITS * (k - 1))
        weight = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
        if k == ORDER:
            return lower, weight, np.maximum(m - d, 0) / total[context] + weight[context] * lower[c & ((1 << BITS * (k - 1)) - 1)]
        full = np.repeat(weight, WIDTH) * np.tile(lower, WIDTH) if k > 1 else weight[0] * lower
        if k > 1:  # the lower order of (context, symbol) drops the context's first symbol
            idx = np.arange(1 << BITS * k)
            full = weight[idx >> BITS] * lower[idx & ((1 << BITS * (k - 1)) - 1)]
        full[c] += np.maximum(m - d, 0) / total[context]
        lower = full
    raise AssertionError


@dataclass
class Models:
    """Arrays of at most ``AT_ONCE`` languages each, in name order; how sharp scores are, and each language's limit."""

    parts: list[Model]
    sharpness: float = 8.0
    limit: dict[str, float] = field(default_factory=dict)  # cross-entropy beyond which a text is rejected

    @property
    def langs(self) -> list[str]:
        return [x for m in self.parts for x in m.langs]

    def passes(self) -> list[list[Model]]:
        """The arrays by pass."""
        out, size = [], SENT
        for m in self.parts:
            if size + m.size > SENT:
                out.append([])
                size = 0
            out[-1].append(m)
            size += m.size
        return out


def fit(rows: Iterable[tuple[str, np.ndarray, np.ndarray]]) -> Models:
    """From ``(lang, codes, counts)`` of each language."""
    every = sorted(rows, key=lambda r: r[0])
    parts = []
    for at in range(0, len(every), AT_ONCE):
        by = every[at : at + AT_ONCE]
        keys = np.unique(np.concatenate([c for _, c, _ in by]))
        size = 1 << 3 * BITS
        m = Model([x for x, _, _ in by], keys, np.zeros((len(keys), len(by)), np.float32), np.zeros((size, len(by)), np.float32), np.zeros((size, len(by)), np.float32))
        for k, (_, codes, n) in enumerate(by):
            order = np.argsort(codes)
            tri, gamma, p = smoothed(codes[order], n[order])
            m.tri[:, k], m.gamma[:, k] = np.log(tri), np.log(gamma)
            m.table[:, k] = m.gamma[keys >> BITS, k] + m.tri[keys & (size - 1), k]
            m.table[np.searchsorted(keys, codes[order]), k] = np.log(p)
        parts.append(m)
    return Models(parts)


def entropies(model: Model, texts: pa.Array, lookup: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per symbol of each text under each language, and the number of symbols."""
    code, first = grams(texts)
    n = np.diff(first)
    if lookup is None:
        kinds, back = np.unique(code, return_inverse=True)
        values = model.logp(kinds)
    else:  # the sorted array's positions, spread over all codes once per worker
        back = lookup[code]
        missing = np.flatnonzero(back < 0)
        values = model.table
        if len(missing):
            kinds, own = np.unique(code[missing], return_inverse=True)
            values = np.concatenate([values, model.logp(kinds)])
            back = back.copy()
            back[missing] = len(model.table) + own
    out = np.zeros((len(n), len(model.langs)))
    for k in range(len(model.langs)):
        total = np.concatenate([[0], np.cumsum(values[:, k][back], dtype=np.float64)])
        out[:, k] = -(total[first[1:]] - total[first[:-1]])
    return out / np.maximum(1, n)[:, None], n


def posterior(ce: np.ndarray, sharpness: float) -> np.ndarray:
    e = np.exp(-(ce - ce.min(axis=1, keepdims=True)) * sharpness)
    return e / e.sum(axis=1, keepdims=True)


def calibrated(models: Models, rows: list[tuple[str, str]]) -> Models:
    """Set the sharpness of scores and each language's limit from ``(lang, text)`` rows that were not counted."""
    langs = models.langs
    if rows and langs:
        texts = strings(pa.array([t for _, t in rows], pa.string()))
        found = [entropies(m, texts) for m in models.parts]
        ce, n = np.concatenate([x for x, _ in found], axis=1), found[0][1]
        want = np.array([langs.index(x) if x in langs else -1 for x, _ in rows])
        use = (want >= 0) & (n > 0)
        ce, want = ce[use], want[use]
        if len(ce):
            fit = {s: np.log(np.maximum(posterior(ce, s)[np.arange(len(ce)), want], 1e-9)).mean() for s in (1, 2, 4, 8, 16, 32)}
            models.sharpness = float(max(fit, key=fit.get))
            every = ce[np.arange(len(ce)), want]
            shared = limit_of(every)
            models.limit = {x: limit_of(every[want == k]) if (want == k).sum() >= 20 else shared for k, x in enumerate(langs)}
    return models


def limit_of(ce: np.ndarray) -> float:
    return float(np.quantile(ce, 0.995) * 1.1)


def train(docs: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", calibrate: int = 1000) -> Models:
    """A model from all rows of ``docs`` with a language, some of them (about ``calibrate``, at most a tenth) kept for calibration."""
    known = docs.where(F.col(lang_col).isNotNull())
    share = min(0.1, calibrate / max(1, known.count()))
    apart = bucket(id_col, 1 << 32) < int((1 << 32) * share)
    got = counts(known.where(~apart), lang_col, text_col).toArrow()
    by = []
    names = got.column("lang").combine_chunks().dictionary_encode()
    index, codes, n = names.indices.to_numpy(zero_copy_only=False), got.column("code").to_numpy(), got.column("n").to_numpy()
    for k, lang in enumerate(names.dictionary.to_pylist()):
        by.append((lang, codes[index == k], n[index == k]))
    return calibrated(fit(by), [(str(r[0]), r[1]) for r in known.where(apart).select(lang_col, text_col).collect() if r[1]])


def predict(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score, cross_entropy, rejected`` for every row.

    Each pass over the texts brings the best language so far, its cross-entropy and the log of all languages' weights.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(float("inf")).alias("ce"), F.lit(float("-inf")).alias("z"))
    sharpness = models.sharpness
    passes = models.passes()
    for number, parts in enumerate(passes):
        shared, last = docs.sparkSession.sparkContext.broadcast(parts), number == len(passes) - 1

        def run(batches: Iterable[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            lookups = []
            for m in shared.value:
                lookups.append(np.full(1 << ORDER * BITS, -1, np.int32))
                lookups[-1][m.keys] = np.arange(len(m.keys), dtype=np.int32)
            for batch in batches:
                for rows, texts in slices(batch, "text"):
                    best, low, z = (rows.column(k) for k in ("lang", "ce", "z"))
                    low, z = low.to_numpy().copy(), z.to_numpy().copy()
                    for m, lookup in zip(shared.value, lookups, strict=True):
                        ce, n = entropies(m, texts, lookup)
                        at = ce.argmin(axis=1)
                        own = ce[np.arange(len(at)), at]
                        better = (n > 0) & (own < low)
                        best = pc.if_else(pa.array(better), pa.array(m.langs, pa.string()).take(pa.array(at)), best)
                        z = np.where(n > 0, np.logaddexp(z, np.logaddexp.reduce(-sharpness * ce, axis=1)), z)
                        low = np.where(better, own, low)
                    text = pa.nulls(len(rows), pa.string()) if last else rows.column("text")
                    yield pa.RecordBatch.from_arrays([rows.column("id"), text, best, pa.array(low), pa.array(z)], ["id", "text", "lang", "ce", "z"])

        found = mapped(found, run, f"id {kind}, text string, lang string, ce double, z double")
    limits = F.create_map(*(x for k, v in models.limit.items() for x in (F.lit(k), F.lit(v)))) if models.limit else None
    some = F.col("lang").isNotNull()
    over = F.col("ce") > F.element_at(limits, F.col("lang")) if limits is not None else F.lit(False)
    return found.select(
        F.col("id").alias(id_col), F.coalesce("lang", F.lit("und")).alias("lang_pred"), F.when(some, F.least(F.lit(1.0), F.exp(-F.col("ce") * sharpness - F.col("z")))).otherwise(0.0).alias("score"),
        F.when(some, F.col("ce")).alias("cross_entropy"), (~some | F.coalesce(over, F.lit(False))).alias("rejected"),
    )
