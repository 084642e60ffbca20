"""The language model: network, subwords, counts and scores against slow versions."""

import random
import zlib
from collections import Counter
from itertools import product
from math import log, log10

import numpy as np
import pyarrow as pa
import pytest

from attesta.llm import attention, lmscore
from attesta.llm.lookup import Lookup
from attesta.llm.queries import RANKS
from attesta.llm.text import strings

rng = random.Random(9)
VOCABULARY = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(600)]


def prose(n, r):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def net_of(v, seed=0):
    g = np.random.default_rng(seed)
    return attention.fresh(g.integers(0, 50, v), v - 1)


def test_network_is_a_causal_distribution():
    net = net_of(2000)
    g = np.random.default_rng(0)
    first, ids = np.array([0, 100, 100, 130]), g.integers(0, 2000, 130).astype(np.int32)
    one, _ = attention.score(net, ids, first)
    other = ids.copy()
    other[60:100] = 0
    two, _ = attention.score(net, other, first)
    assert np.allclose(one[:60], two[:60], atol=1e-5) and np.allclose(one[100:], two[100:], atol=1e-5) and not np.allclose(one[61:100], two[61:100])
    own = attention.Windows(ids, first, net.start)
    inputs, places, use = own.batch(slice(0, len(own)))
    assert (np.bincount(places[use], minlength=130) == 1).all()
    z = attention.hidden(net, inputs[:1])[:1]
    p, begins = attention.log_probabilities(net, np.repeat(z, 2000, 0), np.arange(2000))
    assert abs(np.exp(p.astype(np.float64)).sum() - 1) < 1e-4
    assert abs(np.exp(p[1000:].astype(np.float64)).sum() - np.exp(float(begins[0]))) < 1e-4


def test_gradients():
    net = net_of(1400, 1)
    net = net.having(net.flat.astype(np.float64))
    g = np.random.default_rng(0)
    ids, to, use = g.integers(0, 1400, (3, attention.W)), g.integers(0, 1400, (3, attention.S)), g.random((3, attention.S)) < 0.8
    _, grads = attention.gradients(net, ids, to, use)
    grads, at = attention.views(grads), attention.views(np.arange(attention.SIZE))
    for name, x in grads.items():
        spot = int(at[name].ravel()[np.argmax(np.abs(x))])
        moved = []
        for e in (1e-5, -1e-5):
            flat = net.flat.copy()
            flat[spot] += e
            moved.append(attention.gradients(net.having(flat), ids, to, use)[0])
        assert abs(np.abs(x).max() - abs(moved[0] - moved[1]) / 2e-5) < 1e-7, name


def test_training_lowers_the_loss():
    ids = np.tile(np.random.default_rng(0).integers(0, 60, 12), 400).astype(np.int32)
    first = np.arange(0, len(ids) + 1, 120)
    net = attention.fresh(np.bincount(ids, minlength=64), 63)
    new, n = attention.fit(net, [(ids, first)], rate=0.02)
    assert n == len(first[:-1]) * 5 and attention.score(new, ids, first)[0].mean() > attention.score(net, ids, first)[0].mean() + 1


def test_lookup():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000, dtype=np.uint64))
    assert (Lookup(keys).find(keys[::-1]) == np.arange(len(keys))[::-1]).all()
    assert Lookup(keys[:100]).find(keys[100:200]).tolist() == [-1] * 100 and Lookup(keys[:0]).find(keys[:2]).tolist() == [-1, -1]


def slow_split(sub, word):
    known, out = {t: i for i, t in enumerate(sub.pieces)}, []
    while word:
        n = max(k for k in range(1, lmscore.LONGEST + 1) if word[:k] in known)
        out.append(known[word[:n]] + lmscore.HALF * (not out))
        word = word[n:]
    return out


def test_subwords(monkeypatch):
    sub = lmscore.subwords(RANKS)
    texts = ["Thinking naïve 日本 x", None, "", " \t", "A" * 70 + "b" * 300 + " end", "the " * 9]
    want = [[i for w in (t or "").encode().lower().split() for i in slow_split(sub, w)] + [lmscore.END] for t in texts]
    for pieces in (1 << 20, 7):
        monkeypatch.setattr(lmscore, "AT_ONCE", pieces)
        ids, first = lmscore.id_stream(sub, strings(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == want
    begin, h = lmscore.word_hashes(ids)
    words = [w for t in texts for w in [*(t or "").encode().lower().split(), b"\n"]]
    assert len(begin) == len(words) and len(set(zip(words, h.tolist(), strict=True))) == len(set(words)) == len(set(h.tolist()))


def test_words_are_a_distribution(monkeypatch):
    monkeypatch.setattr(lmscore, "HALF", 4)
    monkeypatch.setattr(lmscore, "END", 7)
    net = net_of(8)
    context = [5, 1, 6]
    words = [(7,)] + [(b, *c) for b in (4, 5, 6) for n in (0, 1) for c in product(range(4), repeat=n)]
    total = 0.0
    for w in words:
        ids = np.array([*context, *w] + [7] * (w != (7,)), np.int32)
        begin = np.flatnonzero(ids >= 4)
        total += np.exp(lmscore.network_tokens(net, ids, np.array([0, len(ids)]), begin)[2])
    longer = 0.0  # words of more subwords: the mass of what they begin with
    for w in ((b, x, y) for b in (4, 5, 6) for x in range(4) for y in range(4)):
        ids = np.array([*context, *w], np.int32)
        p, begins = attention.score(net, ids, np.array([0, len(ids)]))
        longer += np.exp(p[3:].sum() - begins[3])
    assert total + longer == pytest.approx(1, abs=1e-4)
    share = np.array([0.5, 0.25, 0.25, 0.0])
    network = np.array([0.1, 0.2, 0.3, 0.4])
    assert (10 ** lmscore.mixed(np.log(network), network, share, 0.3)).sum() == pytest.approx(1, abs=1e-6)


def test_scores_equal_slow_ones(spark, monkeypatch):
    r = random.Random(3)
    texts = [prose(r.randint(1, 60), r).title() for _ in range(120)] + [None, "", "Only Here Once", "w " * 5000, "w " * 5000, "Zebra" * 400]
    words = [[w.lower() for w in (t or "").split()] for t in texts]
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))]
    count, ends = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws), held.count(False)
    n, v = sum(count.values()) + ends, len(count) + 1
    monkeypatch.setattr(lmscore, "BLOCK", 3000)
    monkeypatch.setattr(lmscore, "LISTED", 50)
    monkeypatch.setattr(lmscore, "train", lambda rows, counts: attention.fresh(counts, lmscore.END))
    got = {x.doc_id: x for x in lmscore.score(docs_of(spark, texts), RANKS).collect()}
    sub = lmscore.subwords(RANKS)
    ids = [[i for w in ws for i in slow_split(sub, w.encode())] + [lmscore.END] for ws in words]
    net = attention.fresh(np.bincount([i for x, h in zip(ids, held, strict=True) if not h for i in x], minlength=lmscore.VOCABULARY), lmscore.END)
    network = []
    for x in ids:
        p, begins = (y.astype(np.float64) for y in attention.score(net, np.array(x, np.int32), np.array([0, len(x)])))
        at = [k for k, i in enumerate(x) if i >= lmscore.HALF]
        network.append([sum(p[a:b]) - begins[a] + (begins[b] if b < len(x) else 0) for a, b in zip(at, [*at[1:], len(x)], strict=True)])

    def mix(k, w, less=0):
        cs = [count[x] for x in words[k]] + [ends]
        # a probability too small for a float stays a logarithm
        return sum((a + log(1 - w)) / log(10) if c <= less and a < -600 else log10((1 - w) * np.exp(a) + w * max(0, c - less) / (n - less)) for a, c in zip(network[k], cs, strict=True))

    best = max(lmscore.WEIGHTS, key=lambda w: sum(mix(k, w, 1) for k in range(len(texts)) if not held[k]))
    assert len(got) == len(texts)
    for k, ws in enumerate(words):
        cs, x = [count[w] for w in ws] + [ends], got[k]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[k], len(cs), sum(c > 0 for c in cs), n)
        assert x.base_score == pytest.approx(sum(log10((c + 0.5) / (n + 0.5 * (v + 1))) for c in cs), rel=1e-9)
        assert x.network_score == pytest.approx(sum(network[k]) / log(10), rel=1e-4)
        assert x.score == pytest.approx(mix(k, best), rel=1e-4)


def test_learns_from_every_training_row(spark, monkeypatch):
    r = random.Random(5)
    docs = docs_of(spark, [prose(20, r) for _ in range(60)])
    seen, train = [], lmscore.train
    monkeypatch.setattr(lmscore, "train", lambda rows, counts: seen.append((rows.count(), counts.sum(), rows.agg({"ids": "count"}).first()[0], sum(len(x.ids) for x in rows.collect()) // 2)) or train(rows, counts))
    monkeypatch.setattr(lmscore, "BLOCK", 2000)
    monkeypatch.setattr(lmscore, "PASS_IDS", 1)
    assert lmscore.score(docs, RANKS).count() == 60
    rows = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(60))
    assert seen[0][0] == rows and seen[0][1] == seen[0][3]


def test_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "PASS_IDS", 1)
    assert lmscore.score(docs_of(spark, []), RANKS).collect() == []
    none = docs_of(spark, ["one two", None]).selectExpr("CAST(NULL AS bigint) doc_id", "text")  # crc32 of no key is 0: nothing is held out
    got = lmscore.score(none, RANKS).collect()
    assert len(got) == 2 and all(not x.held_out and x.score < 0 for x in got)
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    got = lmscore.score(spark.createDataFrame([(i, "one two") for i in held], "doc_id long, text string"), RANKS).collect()
    assert [(x.held_out, x.train_tokens, x.n_known, x.base_score) for x in got] == [(True, 0, 0, 0.0)] * 3 and all(x.score == x.network_score < 0 for x in got)


def test_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = [x for x in lmscore.score(docs, RANKS).collect() if x.held_out]
    base = sum(x.base_score for x in held)
    assert sum(x.network_score for x in held) > base and sum(x.score for x in held) > 0.99 * base


def test_words_are_sent_once(spark, monkeypatch):
    """The words of blocks are counted and given back in one shuffle, without a join with themselves."""
    plans, kept = [], lmscore.cut
    monkeypatch.setattr(lmscore, "cut", lambda df: plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString())) or kept(df))
    docs = spark.createDataFrame([(k, "a b c " * (k + 1)) for k in range(10)], "doc_id bigint, text string")
    rows = lmscore.score(docs, RANKS).collect()
    learnt = [r for r in rows if not r.held_out]
    assert {r.train_tokens for r in rows} == {sum(r.n_tokens for r in learnt)} and all(r.n_known == r.n_tokens for r in rows)
    counted = [plan for columns, plan in plans if "owns" in columns]
    assert counted and not any("Join" in plan for plan in counted)


def test_positions_that_are_not_scored_change_nothing():
    """Whatever stands at places that are not scored, loss and gradient are the same, and those of the mean over the others."""
    rng = np.random.default_rng(5)
    counts = rng.integers(1, 50, lmscore.VOCABULARY)
    net = attention.fresh(counts, lmscore.END)
    ids = rng.integers(0, lmscore.VOCABULARY, (5, attention.W))
    to, use = rng.integers(0, lmscore.VOCABULARY, (5, attention.S)), rng.random((5, attention.S)) < 0.6
    loss, grad = attention.gradients(net, ids, to, use)
    other, same = attention.gradients(net, ids, np.where(use, to, 0), use)
    assert abs(loss - other) < 1e-5 and np.allclose(grad, same, atol=1e-6)
    z = attention.hidden(net, ids)
    some = np.flatnonzero(use.ravel())
    assert abs(loss + attention.log_probabilities(net, z[some], to.ravel()[some])[0].mean()) < 1e-4


def test_words_never_seen_mix_without_warnings():
    """A word of count 0 whose network probability is too small for a float: the mixture stays a finite logarithm, and no log of 0 is taken."""
    network = np.array([-800.0, -2.0])
    with np.errstate(divide="raise", invalid="raise"):
        got = lmscore.mixed(network, np.exp(network).astype(np.float32), np.array([0, 0.25], np.float32), 0.1)
    assert got == pytest.approx([(-800 + log(0.9)) / log(10), log10(0.9 * np.exp(-2) + 0.025)], rel=1e-6)


def test_training_needs_no_losses():
    """The gradient is the same where the loss, which training does not read, is not computed, and Adam's step is that of the formula."""
    net, g = net_of(1400, 2), np.random.default_rng(3)
    ids, to, use = g.integers(0, 1400, (4, attention.W)), g.integers(0, 1400, (4, attention.S)), g.random((4, attention.S)) < 0.7
    loss, grad = attention.gradients(net, ids, to, use)
    none, same = attention.gradients(net, ids, to, use, losses=False)
    assert loss > 0 == none and (grad == same).all()
    ids = g.integers(0, 1400, 100).astype(np.int32)
    new, _ = attention.fit(net, [(ids, np.array([0, 100]))], rate=0.02)  # five windows: one batch
    own = attention.Windows(ids, np.array([0, 100]), net.start)
    inputs, places, use = own.batch(slice(None))
    _, grad = attention.gradients(net, inputs, ids.take(np.where(use, places, 0)), use)
    assert np.allclose(new.flat, net.flat - 0.02 * grad / (np.abs(grad) + 1e-6), atol=2e-4)
