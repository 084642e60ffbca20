"""Quality classifier: hashed word n-gram logistic regression with FTRL updates, scored as sparse dot products.

Tokens are runs of letters and digits or runs of other signs; unigrams and bigrams hash into ``2**bits`` slots.
A feature's value is its share of the document's n-grams, times ``SCALE``, so length alone says nothing.

Learning reads only labelled rows outside the held-out fold, at most about ``max_train`` of them (the lowest crc32 of
the key, so the choice does not depend on order); everything is scored. Null and empty texts get the score of the
bias alone, 0 to 1. Rows with a null or missing label, and keys labelled in two ways, are not learnt from. With no
rows to learn from every score is 0.5. Repeated rows get equal scores; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import bucket, mapped, sampled
from .ftrl import Ftrl, sigmoid
from .text import BY_KIND, hash_words, mix, slices, strings, sums

SCALE = 16.0


#: A bigram of one token twice also counts under a slot of its own, whatever the token: a back-off for repetition.
TWICE = np.uint64(0x7E9EA7)


def features(words: np.ndarray, first: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all unigrams, bigrams and repetitions in document order, and each document's first slot."""
    n = np.diff(first)
    shift = np.uint64(64 - bits)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(len(first), np.int64)
    out = np.zeros((len(words), 3), np.int64)
    keep = np.ones((len(words), 3), bool)
    out[:, 0] = words >> shift
    out[:-1, 1] = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) >> shift
    out[:, 2] = mix(np.array([TWICE]))[0] >> shift
    keep[-1, 2] = False
    keep[:-1, 2] = words[1:] == words[:-1]
    keep[first[1:][n > 0] - 1, 1:] = False  # nothing reaches over a document's end
    return out[keep], np.concatenate([[0], np.cumsum(keep.sum(1))])[first]


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int, max_train: int, id_col: str, text_col: str) -> DataFrame:
    """``y, text`` of about ``max_train`` labelled rows outside the held-out fold."""
    known = labels.where(F.col(label).isNotNull()).groupBy(id_col).agg(F.min(label).alias("y"), F.max(label).alias("y2")).where("y = y2").select(id_col, "y")
    chosen = sampled(known.where(bucket(id_col, folds) != held_out), id_col, max_train)
    return F.broadcast(chosen).join(docs.select(id_col, text_col), id_col).select(F.col("y").cast("double"), F.col(text_col).alias("text"))


def learn(rows: Iterable[tuple[float, str | None]], bits: int, tokens: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], **ftrl) -> tuple[np.ndarray, float]:
    rows = sorted(rows, key=lambda r: (r[1] or "", r[0]))
    data, ys = [], []
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        slots, first = features(*tokens(strings(pa.array([t for _, t in part], pa.string()))), bits)
        for k, (y, _) in enumerate(part):
            own, count = np.unique(slots[first[k] : first[k + 1]], return_counts=True)
            data.append((own, count * (SCALE / max(1, first[k + 1] - first[k]))))
            ys.append(y)
    return Ftrl(1 << bits, **ftrl).fit(data, np.array(ys)).model()


def scored(slots: np.ndarray, first: np.ndarray, model: tuple[np.ndarray, float]) -> np.ndarray:
    weights, bias = model
    return sigmoid(sums(weights[slots], first) * SCALE / np.maximum(1, np.diff(first)) + bias)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return hash_words(texts, BY_KIND)


def train(docs: DataFrame, labels: DataFrame, bits: int = 18, folds: int = 5, held_out: int = 0, max_train: int = 6000, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Weights and bias learnt from ``labels.quality``."""
    rows = labelled(docs, labels, "quality", folds, held_out, max_train, id_col, text_col)
    return learn(((r.y, r.text) for r in rows.toLocalIterator()), bits, tokens, alpha=1.0, l1=0.1, l2=0.1)


def score(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, predicted`` for every row."""
    bits = int(np.log2(len(model[0])))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, text_col):
                s = scored(*features(*tokens(texts), bits), model)
                yield pa.RecordBatch.from_arrays([rows.column(id_col), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, score double, predicted int")


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    bits = int(np.log2(len(model[0])))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in slices(batch, text_col):
                yield rows.filter(pa.array(scored(*features(*tokens(texts), bits), model) >= threshold))

    return mapped(docs, run, docs.schema)
