"""Operators over one document at a time: tokens, languages, media, quality, toxicity, licences, on small tables and odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from attesta.llm import bpe, langid, licenses, media, quality, toxicity
from attesta.llm.ftrl import Ftrl, sigmoid
from attesta.llm.queries import RANKS
from attesta.llm.text import BY_KIND, BY_SPACE, hash_words, shingles, slices, strings

PATTERN = public_tokenizers.PATTERN
ODD = [None, "", " \n\t", "a", "Ünïcödé — “quotes” 日本語 😀\x1c\x85x", "word " * 30000, "x" * 5000, "same text here", "same text here"]


def table(spark, texts, extra="score double, predicted int, key string, lang string"):
    return spark.createDataFrame([(i, t, 0.5, 7, "k", "en") for i, t in enumerate(texts)], f"doc_id long, text string, {extra}")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_text_helpers():
    texts = pa.array(["a b  c", "", None, "c a b"], pa.string())
    batch = pa.RecordBatch.from_arrays([texts], ["text"])
    parts = list(slices(batch, "text", most=4))
    assert sum(len(t) for _, t in parts) == 4
    words, first = hash_words(strings(texts))
    assert np.diff(first).tolist() == [3, 0, 0, 3] and words[0] == words[4] and words[2] == words[3]
    assert hash_words(strings(pa.array(["ab!?c"])), BY_KIND)[1].tolist() == [0, 3]
    g, at, gfirst = shingles(words, first, 2)
    assert gfirst.tolist() == [0, 2, 2, 2, 4] and at.tolist() == [0, 1, 3, 4] and g[0] == g[3]
    assert hash_words(strings(pa.array(["Ab"])), BY_SPACE, fold=True)[0] == hash_words(strings(pa.array(["aB"])), BY_SPACE, fold=True)[0]


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(2000)]
    h = bpe.PerfectHash(keys)
    assert sorted(map(h, keys)) == list(range(2000))


def test_bpe_equals_tiktoken(spark):
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rng = random.Random(3)
    fuzz = ["".join(rng.choice("abc é日😀'sS 12\n\t.,!-") for _ in range(rng.randint(0, 80))) for _ in range(200)]
    docs = table(spark, ODD + fuzz + ["<|endoftext|>"])
    got = by_id(bpe.round_trip(docs, RANKS, PATTERN, with_ids=True))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for i, t in texts.items():
        ids = enc.encode_ordinary(t)
        assert got[i].ids == ids and got[i].n_tokens == len(ids), t
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    back = by_id(bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN))
    assert all(bytes(back[i].bytes) == t.encode() for i, t in texts.items())
    assert bpe.round_trip(docs.limit(0), RANKS, PATTERN).collect() == []


def test_language(spark):
    rng = random.Random(1)
    en, fr = "the and that with this have from they".split(), "été où même être français leçon avec pour".split()
    rows = [(i, " ".join(rng.choices(en if i % 2 else fr, k=12)), "en" if i % 2 else "fr") for i in range(120)]
    rows += [(200, None, "en"), (201, "123 !!", "en"), (202, "THE AND THAT", None), (203, "où même", None), (204, "", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id % 3 <> 0"))
    got = by_id(langid.predict(docs, model))
    assert len(got) == len(rows) and all(got[i].lang_pred == lang for i, _, lang in rows if i < 200)
    assert [got[i].lang_pred for i in range(200, 205)] == ["und", "und", "en", "fr", "und"] and got[200].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())
    none = by_id(langid.predict(docs, langid.train(docs.limit(0))))
    assert {r.lang_pred for r in none.values()} == {"und"} and langid.predict(docs.limit(0), model).collect() == []


def slow_kneser_ney(text):
    """Interpolated Kneser-Ney over the letters of a text by its definition: log probability of a symbol after up to three."""
    table = langid.symbols()
    s = [int(table[ord(c)]) for c in text]
    rows = []
    for at, x in enumerate([*s, 0]):
        before = []
        for y in reversed(s[max(0, at - 3) : at]):
            if not y:
                break
            before.insert(0, y)
        if x or before:
            rows.append((*[0] * (3 - len(before)), *before, x))
    counts = {4: Counter(rows)}
    for k in (3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def p(context, x):
        k = len(context) + 1
        m = counts[k]
        one, two = (sum(v == j for v in m.values()) for j in (1, 2))
        d = min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5
        total, types = sum(v for g, v in m.items() if g[:-1] == context), sum(g[:-1] == context for g in m)
        lower = p(context[1:], x) if context else 1 / langid.WIDTH
        return (max(m.get((*context, x), 0) - d, 0) + d * types * lower) / total if total else lower

    return rows, lambda g: math.log(p(g[:3], g[3]))


def test_kneser_ney_equals_its_definition():
    text = "the cat sat on the mat and the rat ran at that, où était l'été"
    rows, logp = slow_kneser_ney(text)
    code, first = langid.grams(strings(pa.array([text])))
    assert code.tolist() == [((a * 64 + b) * 64 + c) * 64 + d for a, b, c, d in rows] and first.tolist() == [0, len(rows)]
    m = langid.fit([("x", *np.unique(code, return_counts=True))]).parts[0]
    for g in {*rows, (20, 8, 5, 26), (0, 20, 8, 1), (0, 0, 0, 26), (26, 26, 26, 1), (1, 20, 0, 0)} - {(1, 20, 0, 0)}:
        assert m.logp(np.array([((g[0] * 64 + g[1]) * 64 + g[2]) * 64 + g[3]], np.int32))[0, 0] == pytest.approx(logp(g), abs=1e-4)


def test_many_languages(spark, monkeypatch):
    r = random.Random(8)
    letters = "abcdefghijklmnopqrst"
    rows = [(i, " ".join("".join(r.choice(letters[k : k + 4]) for _ in range(5)) for _ in range(20)), f"l{k:02}") for i, k in enumerate(list(range(16)) * 12)]
    docs = spark.createDataFrame([*rows, (900, "zzz qqq", None), (901, None, "l00")], "doc_id long, text string, lang string")
    want = by_id(langid.predict(docs, langid.train(docs)))
    monkeypatch.setattr(langid, "AT_ONCE", 5)
    monkeypatch.setattr(langid, "SENT", 1 << 24)
    models = langid.train(docs)
    assert [len(m.langs) for m in models.parts] == [5, 5, 5, 1] and len(models.passes()) > 1
    got = by_id(langid.predict(docs, models))
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) > 0.95 * len(rows)
    for i, x in got.items():
        assert (x.lang_pred, x.rejected) == (want[i].lang_pred, want[i].rejected) and x.score == pytest.approx(want[i].score, abs=1e-6)
    assert got[900].rejected and got[901].lang_pred == "und"


def test_equal_languages_go_to_the_first_name(spark):
    docs = spark.createDataFrame([(i, "one two three", x) for i, x in enumerate("ba" * 30)], "doc_id long, text string, lang string")
    codes = np.unique(langid.grams(strings(pa.array(["one two three"])))[0], return_counts=True)
    got = by_id(langid.predict(docs, langid.fit([("b", *codes), ("a", *codes)])))
    assert {x.lang_pred for x in got.values()} == {"a"} and got[0].score == pytest.approx(0.5)


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(0)
    codes, n = np.unique((rng.integers(0, 5, (4000, 4)) * [64**3, 64**2, 64, 1]).sum(1).astype(np.int32), return_counts=True)
    m = langid.fit([("x", codes, n)]).parts[0]
    contexts = np.unique(codes >> 6)[:20]
    for c in contexts:
        assert abs(np.exp(m.logp((c << 6) + np.arange(64)).astype(np.float64)).sum() - 1) < 1e-4
    assert abs(np.exp(m.logp(np.int32(60 << 18 | 60 << 12 | 60 << 6) + np.arange(64, dtype=np.int32)).astype(np.float64)).sum() - 1) < 1e-4


def slow_cuts(p, least=2048, most=65536):
    out, at, h = [], 0, 0
    for k, x in enumerate(p, 1):
        h = (2 * h + int(media.GEAR[x])) % (1 << 16)
        if len(p) - at > least and (k - at >= least and h >> 3 == 0 or k - at == most):
            out.append(k)
            at = k
    return out if out[-1:] == [len(p)] else [*out, len(p)]


def test_chunks_that_many_payloads_share(spark, monkeypatch):
    r = random.Random(12)
    head = "".join(r.choice("abcdefgh ") for _ in range(60000))
    texts = [head + str(k) * 50 for k in range(30)]
    monkeypatch.setattr(media, "HOT", 20)
    tables = {t.name for t in spark.catalog.listTables()}
    got = by_id(media.round_trip(table(spark, texts)))
    assert all(got[k].payload_sha256 == hashlib.sha256(t.encode() + bytes(-len(t.encode()) % 64)).hexdigest() for k, t in enumerate(texts))
    assert {t.name for t in spark.catalog.listTables()} == tables


def test_media(spark):
    rng = random.Random(2)
    big = "".join(rng.choice("abcdefgh \n") for _ in range(200000))
    docs = table(spark, [*ODD, big, big, big[1000:]])
    got = by_id(media.round_trip(docs))
    for r in docs.collect():
        b = (r.text or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        g = got[r.doc_id]
        assert (g.n_bytes, g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        ends = slow_cuts(p)
        frames = b"".join(zstandard.ZstdCompressor(level=3, write_checksum=False).compress(p[x:y]) for x, y in zip([0, *ends[:-1]], ends, strict=True))
        assert (g.n_chunks, g.media_bytes, g.media_sha256) == (len(ends), len(frames), hashlib.sha256(frames).hexdigest())
        share = Counter(x >> 4 for x in p)
        assert g.feature.endswith(f"peak={max(p)};hist=" + ",".join(str(share[k]) for k in range(16))) and g.feature.startswith(f"mean={sum(p) / len(p):.4f};")
    a, b = got[7], got[8]
    assert (a.media_sha256, a.media_bytes, a.feature) == (b.media_sha256, b.media_bytes, b.feature)
    assert got[9].n_chunks > 3 and media.round_trip(docs.limit(0)).collect() == []


def test_cuts_are_content_defined():
    data = np.random.default_rng(5).integers(0, 256, 400000, dtype=np.uint8)
    a = media.cuts(data)
    b = media.cuts(data[777:])
    assert a[-1] == len(data) and max(np.diff([0, *a])) <= 65536 and len(set(a) & {x + 777 for x in b}) > len(a) // 2
    slow = 0
    h = []
    for x in data[:500]:
        slow = (2 * slow + int(media.GEAR[x])) % (1 << 16)
        h.append(slow)
    assert media.gear(data[:500]).tolist() == h


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    good = [" ".join(word() for _ in range(30)) + "." for _ in range(150)]
    bad = [" ".join(word() + "$$$" for _ in range(30)) for _ in range(75)] + [" ".join([word()] * 30) for _ in range(75)]
    docs = table(spark, [*good, *bad, *ODD])
    labels = labels_of(spark, [(i, int(i < 150), 0) for i in range(300)] + [(0, 0, 0), (301, None, None), (999, 1, 1)])
    model = quality.train(docs, labels)
    got = by_id(quality.score(docs, model))
    held = [i for i in range(1, 300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == (i < 150) for i in held]) > 0.9
    assert len(got) == 300 + len(ODD) and all(0 <= r.score <= 1 for r in got.values()) and got[307].score == got[308].score
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}
    none = by_id(quality.score(docs, quality.train(docs, labels.limit(0))))
    assert {r.score for r in none.values()} == {0.5}


def test_quality_scores_equal_slow_ones():
    texts = ["a b!! a", "", "one one one two", "x" * 40 + " ?"]
    weights, bias = np.random.default_rng(4).normal(size=1 << 12).astype(np.float32), 0.3
    got = quality.scored(*quality.features(*quality.tokens(strings(pa.array(texts))), 12), (weights, bias))
    for t, x in zip(texts, got.tolist(), strict=True):
        words = [int(hash_words(strings(pa.array([w])), BY_KIND)[0][0]) for w in __import__("re").findall(r"[0-9A-Za-z]+|[^\s0-9A-Za-z]+", t)]
        slots = [w >> 52 for w in words]
        for a, b in zip(words[:-1], words[1:], strict=True):
            slots.append(int(quality.mix(np.array([(a * 0x9E3779B97F4A7C15 + b) % 2**64], np.uint64))[0]) >> 52)
            if a == b:
                slots.append(int(quality.mix(np.array([quality.TWICE]))[0]) >> 52)
        z = sum(float(weights[k]) for k in slots) * quality.SCALE / max(1, len(slots)) + bias
        assert x == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-5)


def test_ftrl_learns_a_rule():
    rng = np.random.default_rng(1)
    rows = [(np.unique(rng.integers(0, 50, 6)), None) for _ in range(400)]
    rows = [(i, np.ones(len(i))) for i, _ in rows]
    y = np.array([float(7 in i or 9 in i) for i, _ in rows])
    w, b = Ftrl(50, l1=0.1).fit(rows, y, epochs=8).model()
    p = np.array([sigmoid(w[i] @ x + b) for i, x in rows])
    assert ((p > 0.5) == y).mean() > 0.97


CORPUS = "the stupid plan was an idiotic moron thing idiot said and worthless trash came from disgusting people with scum"


def test_toxicity_restores_and_scores(spark):
    rng = random.Random(6)
    fine = "the plan was an open thing that came from people with hope and said more about their house garden water".split()
    vile = ["idiot", "moron", "stupid", "worthless"]
    texts = [" ".join(rng.choices(fine, k=20)) for _ in range(200)] + [" ".join(rng.choices(fine, k=10) + [rng.choice(vile)] + rng.choices(fine, k=9)) for _ in range(200)]
    hidden = ["the 1d10t said more", "the s t u p i d plan", "such a m-o-r-o-n thing", "w0rthl3ss people", "stuuuuupid house"]
    docs = table(spark, [*texts, *hidden, *ODD])
    model = toxicity.train(docs, labels_of(spark, [(i, 1, int(i >= 200)) for i in range(400)]))
    got = by_id(toxicity.score(docs, model))
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == (i >= 200) for i in held]) > 0.95
    assert [got[400 + k].predicted for k in range(len(hidden))] == [1] * len(hidden)
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    r = toxicity.Restorer(model.costs)
    same = pa.array(["the plan, a house", "a a a a a", "19.37.233.111 ab@cd.ef1"], pa.large_string())
    assert toxicity.restored(same, r).to_pylist()[:2] == same.to_pylist()[:2]
    assert {x.score for x in toxicity.score(docs, toxicity.train(docs, labels_of(spark, []))).collect()} == {0.5}


def every_reading(token, costs):
    """All paths through a token's lattice: cost and what is read."""
    again = toxicity.repeats(token)

    def walk(at, a, b, last, cost, out):
        if at == len(token):
            yield cost + (costs[a][b][0] if b else 0.0), out
            return
        c = token[at]
        letters = [(c, 0.0)] if toxicity.symbol(c) else [(x, toxicity.IMITATION) for x in toxicity.IMITATES.get(c, "")]
        for x, price in letters:
            k = toxicity.symbol(x)
            yield from walk(at + 1, b, k, x, cost + price + costs[a][b][k], out + x)
            if x == last and at in again:
                yield from walk(at + 1, a, b, last, cost + price + again[at], out)
        if not toxicity.symbol(c):
            digit = c.isalnum()
            yield from walk(at + 1, a, b, last, cost + (toxicity.DROP_DIGIT if digit else toxicity.DROP), out)
            yield from walk(at + 1, 0, 0, "", cost + (costs[a][b][0] if b else 0.0) + (toxicity.KEEP_SIGN if digit else toxicity.DROP), out + c)

    return walk(0, 0, 0, "", 0.0, "")


def test_viterbi_finds_the_cheapest_of_all_readings():
    costs = np.random.default_rng(1).uniform(0.5, 6, (32, 32, 32))
    r, g = toxicity.Restorer(costs), random.Random(2)
    for _ in range(60):
        token = "".join(g.choice("abs10@$*é.") for _ in range(g.randint(1, 7))) + g.choice(["", "ooo", "sssttt", "aabbccaa"])
        every = list(every_reading(token, costs))
        least = min(c for c, _ in every)
        assert r.viterbi(token) in {out for c, out in every if c < least + 1e-9}, token


def test_long_and_foreign_tokens():
    words = ["worthless", "plan", "house"]
    texts = strings(pa.array([" ".join(random.Random(1).choices([*words, "café", "thé"], k=4000))]))
    n = np.bincount(toxicity.cells(texts), minlength=32**3).reshape(32, 32, 32)
    assert n[:, :, 27].sum() == texts[0].as_py().count("é") and n[0, 0, 27] == 0
    one = (n.sum((0, 1)) + 0.5) / (n.sum() + 16)
    two = (n.sum(0) + 4 * one) / (n.sum((0, 2))[:, None] + 4)
    r = toxicity.Restorer(-np.log((n + 4 * two[None]) / (n.sum(2)[:, :, None] + 4)))
    read = lambda t: toxicity.restored(strings(pa.array([t])), r)[0].as_py()
    assert read("w o r t h l e s s") == "worthless" and read(" ".join("worthless" * 8)) == " ".join(["worthless"] * 8)
    assert read("wwoorrtthhlleessss") == "worthless" and read("w0rthl3ss" * 12) == "worthless" * 12
    assert read("caféééé") == read("caféééé pl4n").split()[0] and read("bookkeeper 1etter").startswith("bookkeeper ")
    assert len(read("x1" * 20000)) > 0


def test_licences(spark):
    rows = [
        (0, "a/b/c.txt", "code\nLicensed under the Apache License, Version 2.0.\nmore code here, and then some that takes several lines"), (1, "a/b/d.txt", "nothing"), (2, "a/LICENSE", "Released under the MIT License."),
        (3, "a/x/y/z.txt", "nothing"), (4, "q/w.txt", None), (5, None, "nothing"), (6, "a/x/LICENSE", "unknown terms"), (7, "top.txt", ""),
        (8, "a/m/n.txt", "Long story. This work is licensed under the GNU General Public License, version 3. The end of it."), (9, "a/b/e.txt", "a licensed driver of version two"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumn("license", F.lit("x"))
    got = by_id(licenses.inherit(licenses.scan(docs, F.col("path"))))
    assert licenses.inherit(licenses.scan(docs.union(docs), F.col("path"))).count() == 2 * len(rows)
    assert {i: (r.license, r.origin) for i, r in got.items()} == {
        0: ("Apache-2.0", "own"), 1: ("MIT", "inherited"), 2: ("MIT", "own"), 3: ("MIT", "inherited"), 4: (None, "none"), 5: (None, "none"), 6: ("MIT", "inherited"), 7: (None, "none"), 8: ("GPL-3.0", "own"), 9: ("MIT", "inherited"),
    }
    assert got[0].line == 2 and licenses.inherit(licenses.scan(docs.limit(0), F.col("path"))).collect() == []


def test_licence_files_and_titles(spark):
    warranty = "\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."
    two, three = (licenses.TEMPLATES[f"BSD-{k}-Clause"][0].replace(": 1.", ":\n\n1.").replace(" 2.", "\n\n2.").replace(" 3.", "\n\n3.") for k in (2, 3))
    texts = [
        ("BSD-2-Clause", "Copyright (c) 2001, A. Body\n\n" + two + warranty), ("BSD-3-Clause", "Copyright (c) 2001, A. Body\n\n" + three + warranty), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\nEveryone may copy this text."),
        ("Apache-2.0", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nand so on"), ("MIT", "MIT License\n\nCopyright (c) 2001 A. Body"), (None, "License"), (None, "Mind the license of the mill."),
        ("MIT", "short words. Released under the MIT License."), (None, "long " * 50000),
    ]
    docs = spark.createDataFrame([(i, f"{i}/x.txt", t) for i, (_, t) in enumerate(texts)] + [(20, "7/y.txt", "nothing"), (21, "7/z/y.txt", "nothing")], "doc_id long, path string, text string")
    got = by_id(licenses.inherit(licenses.scan(docs, F.col("path"))))
    assert [got[i].license for i in range(len(texts))] == [x for x, _ in texts]
    assert {(got[i].license, got[i].origin) for i in (20, 21)} == {("MIT", "inherited")}  # the notice is most of 7/x.txt


def test_inheritance_equals_a_walk_up(spark):
    r = random.Random(5)
    dirs = ["", "a", "a/b", "a/b/c", "d", "d/e", "f/g/h"]
    rows = []
    for i in range(150):
        d = r.choice(dirs)
        own = r.random() < 0.2
        rows.append((i, (d + "/" if d else "") + f"n{r.randrange(400)}", r.choice(["X", "Y"]) if own else None, round(r.uniform(0.6, 1), 3) if own else None, 1 if own else None, own and r.random() < 0.5))
    found = spark.createDataFrame(rows, "id long, path string, own string, own_score double, line int, is_file boolean")
    files = {}
    for _, p, own, score, _, is_file in rows:
        if is_file:
            d = p.rpartition("/")[0]
            files[d] = min(files.get(d, (9, "", "")), (-score, p, own))
    for i, x in by_id(licenses.inherit(found)).items():
        _, p, own, score, _, _ = rows[i]
        d, near = p.rpartition("/")[0], None
        while own is None and near is None:
            near = files.get(d)
            if not d:
                break
            d = d.rpartition("/")[0]
        assert (x.license, x.score, x.origin) == ((own, score, "own") if own else (near[2], -near[0], "inherited") if near else (None, None, "none"))


def test_best_equals_the_cosine_of_all_templates():
    r = random.Random(3)
    words = sorted({t for texts in licenses.TEMPLATES.values() for x in texts for t in licenses.terms(x)})
    s = licenses.Scanner({t: r.randrange(900) for t in words}, 1000, 0.6)
    for _ in range(300):
        name = r.choice(list(licenses.TEMPLATES))
        own = r.choice(licenses.TEMPLATES[name]).split()
        unit = " ".join(w for w in own if r.random() < 0.8) + " " + " ".join(r.choices(["x", "the", "license", "of"], k=r.randrange(4)))
        v, best = s.vector(unit), None
        for (n, w), least in zip(s.templates, s.least, strict=True):
            cosine = sum(x * w.get(t, 0) for t, x in v.items())
            if cosine >= least and (best is None or cosine > best[0] + 1e-12):
                best = (cosine, n)
        got = s.best(unit)
        assert (got is None) == (best is None) and (got is None or got[0] == pytest.approx(best[0]))


def wrapped(text, width, mark):
    lines = [mark]
    for w in text.split():
        lines = [*lines, mark + " " + w] if len(lines[-1]) + len(w) > width else [*lines[:-1], lines[-1] + " " + w]
    return "\n".join(lines)


def test_licences_of_wrapped_notices(spark):
    code = "\nimport os\n" + "\n".join(f"def f{k}(x): return os.path.join(x, str({k}))" for k in range(60))
    notices = ["MIT", "AGPL-3.0", "ISC", "MPL-2.0", "GPL-2.0"]
    rows = [(k, f"{k}/f.py", "#!/usr/bin/env python\n" + wrapped(licenses.TEMPLATES[n][0], 78, "#") + code) for k, n in enumerate(notices)]
    rows += [(10 + k, f"{10 + k}/g.py", f"plain words number {k} of a text" + code) for k in range(40)]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).withColumnRenamed("id", "doc_id"))
    assert [got[k].own for k in range(len(notices))] == notices and all(got[k].line == 2 and got[k].own_score > 0.9 for k in range(len(notices)))
    assert all(got[10 + k].own is None for k in range(40))


def test_best_run_equals_all_runs():
    r = random.Random(3)
    words = sorted({t for texts in licenses.TEMPLATES.values() for x in texts for t in licenses.terms(x)})
    scanner = licenses.Scanner({t: r.randrange(900) for t in words}, 1000, 0.6)
    for name in ("MIT", "AGPL-3.0", "Apache-2.0"):
        own = licenses.TEMPLATES[name][0].lower().replace(",", "").split()
        text = [*(r.choice(["x", "y", "the", "of", "software"]) for _ in range(50)), *own, *(r.choice(["x", "z", "license"]) for _ in range(60))]
        pieces = [[t for w in text[k : k + 7] for t in licenses.terms(w)] for k in range(0, len(text), 7)]
        every = [scanner.best(" ".join(t for p in pieces[i : j + 1] for t in p)) for i in range(len(pieces)) for j in range(i + 1, len(pieces)) if sum(map(len, pieces[i + 1 : j])) <= scanner.longest]
        assert scanner.best_run(pieces)[0] == pytest.approx(max(s for s, _ in filter(None, every)))


@pytest.mark.parametrize("name", [n for n in licenses.TEMPLATES])
def test_heavy_terms_are_no_shortcut(name):
    vocabulary = {t for texts in licenses.TEMPLATES.values() for x in texts for t in licenses.terms(x)}
    s = licenses.Scanner({t: len(t) for t in vocabulary}, 1000, 0.6)
    for text in licenses.TEMPLATES[name]:
        light = " ".join(t for t in licenses.terms(text) if t not in s.heavy)
        v, w = s.vector(light), s.vector(text)
        assert sum(v.get(t, 0) * x for t, x in w.items()) < (0.6 if len(w) > 3 else licenses.TITLE)
        assert s.best(text)[1] == name
