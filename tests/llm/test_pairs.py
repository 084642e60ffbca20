"""Operators over pairs of documents against brute force, and the pipeline's stages."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from attesta.llm import decontaminate, jaccard, passages, queries
from attesta.llm.components import components

rng = random.Random(9)
VOCABULARY = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(600)]


def prose(n, r):
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def docs_of(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def edited(text, k, r):
    w = text.split()
    for _ in range(k):
        w[r.randrange(len(w))] = "zzz" + str(r.random())
    return " ".join(w)


def corpus(r):
    base = [prose(r.randint(30, 200), r) for _ in range(25)]
    texts = list(base)
    for b in base[:12]:
        texts += [edited(b, k, r) for k in (0, 1, 1, 3)]
    return [*texts, None, "", " \n ", "", "ab", "ab", "ab cd ef", "ab cd ef", "w " * 3000, "w " * 3000]


def sets(text):
    w = [x for x in re.split(r"[ \t\n\v\f\r]+", text or "") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def classes(texts):
    s = [sets(t) for t in texts]
    links, low = Counter(), list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]):
                links[i] += 1
                links[j] += 1
                a, b = low[i], low[j]
                low = [min(a, b) if x in (a, b) else x for x in low]
    return {i: (low[i], links[i]) for i in range(len(s))}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (101, 100), (50, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(41), 50]}, 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_bands():
    b, r = jaccard.plan_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**r) ** b >= 0.999 and b * r <= 140


def test_jaccard_equals_brute_force(spark):
    texts = corpus(random.Random(1))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs_of(spark, texts)).collect()}
    assert got == classes(texts)
    assert jaccard.join(docs_of(spark, [])).collect() == []


def test_tiles_agree_with_one_tile(spark, monkeypatch):
    r = random.Random(2)
    base = prose(120, r)
    texts = [edited(base, k % 4, r) for k in range(60)]
    monkeypatch.setattr(jaccard, "TILE_ROWS", 8)
    got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard.join(docs_of(spark, texts)).collect()}
    assert got == classes(texts)


def test_keep_one(spark):
    texts = corpus(random.Random(3))
    docs = docs_of(spark, texts)
    kept = jaccard.keep_one(docs.union(docs.limit(5)))
    want = classes(texts)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (c, _) in want.items() if c == i)


def test_tiles_by_size(spark, monkeypatch):
    r = random.Random(14)
    base = prose(400, r).split()
    texts = [" ".join(base[: 60 + 7 * k]) for k in range(45)] + [edited(" ".join(base[:200]), k % 3, r) for k in range(15)]
    monkeypatch.setattr(jaccard, "TILE_ROWS", 4)
    got = {x.doc_id: (x.class_id, x.n_links) for x in jaccard.join(docs_of(spark, texts)).collect()}
    assert got == classes(texts)


def test_keys_with_several_texts(spark):
    r = random.Random(15)
    a, b, c = prose(60, r), prose(60, r), prose(60, r)
    rows = [(1, a), (1, b), (5, a + " tail"), (6, b + " tail"), (None, a), (None, c), (None, c + " tail"), (None, "x"), (9, None), (9, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(x.doc_id), str(x.class_id), x.n_links) for x in jaccard.join(docs).collect())
    want = [("1", "1", 2), ("1", "1", 1), ("5", "1", 2), ("6", "1", 1), ("None", "1", 2), ("None", "None", 1), ("None", "None", 1), ("None", "None", 0), *[("9", "9", 0)] * 3]
    assert got == sorted(want)
    kept = sorted((str(x.doc_id), x.text or "") for x in jaccard.keep_one(docs).collect())
    winner = [x for x in kept if x[1].startswith(c)]
    assert len(winner) == 1 and sorted(x for x in kept if x not in winner) == sorted([("1", a), ("1", b), ("None", "x"), ("9", ""), ("9", "")])


def test_more_rows_than_a_slice_numbers(spark, monkeypatch):
    r = random.Random(16)
    texts = [prose(12, r) for _ in range(40)] * 2
    monkeypatch.setattr(jaccard, "ROWS", 7)
    assert {x.doc_id: (x.class_id, x.n_links) for x in jaccard.join(docs_of(spark, texts)).collect()} == classes(texts)


def slow_windows(h, least):
    out = set()
    for c in range(len(h)):
        left = c
        while left and h[left - 1] > h[c]:
            left -= 1
        right = c
        while right + 1 < len(h) and h[right + 1] >= h[c]:
            right += 1
        if right - left + 1 >= least:
            out.add((left, c, right))
    return out


def test_compact_windows_equal_the_tree():
    g = np.random.default_rng(3)
    parts = [g.integers(0, 1 << 62, n, dtype=np.uint64) << np.uint64(1) for n in (0, 5, 60, 1, 200)]
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    got = set(zip(*(x.tolist() for x in passages.compact_windows(np.concatenate(parts), first, 6)), strict=True))
    want = {(l + f, c + f, r + f) for p, f in zip(parts, first, strict=False) for l, c, r in slow_windows(p.tolist(), 6)}
    assert got == want


def repeats(texts, n=50):
    """Words of each text inside an n-word run that an earlier text has too."""
    seen, found = {}, defaultdict(set)
    split = [re.split(r"[ \t\n\v\f\r]+", (t or "").strip(" \t\n\v\f\r")) for t in texts]
    for i, w in enumerate(split):
        for k in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[k : k + n]), i) < i:
                found[i].update(range(k, k + n))
    return found


def passage_corpus(r):
    shared = [prose(70, r), prose(55, r), prose(200, r)]
    texts = [prose(80, r) + " " + shared[k % 3] + " " + prose(60, r) for k in range(9)]
    texts += [prose(40, r) + " " + edited(shared[2], 4, r) + " " + prose(30, r), shared[0], prose(300, r), prose(45, r) + " " + " ".join(shared[0].split()[:40])]
    return [*texts, None, "", "tiny", "w " * 500, "w " * 400]


def test_passages(spark):
    texts = passage_corpus(random.Random(5))
    rows = passages.find(docs_of(spark, texts)).collect()
    got = defaultdict(set)
    for x in rows:
        assert x.source_id < x.doc_id and x.end_word - x.start_word >= 50 and x.similarity >= 0.8
        got[x.doc_id].update(range(x.start_word, x.end_word))
    for i, words in repeats(texts).items():
        assert words <= got[i]
    assert 9 in got and 11 not in got and 12 not in got
    assert passages.find(docs_of(spark, [])).collect() == []


def in_tasks(spark, *parts):
    """Rows ``doc_id, text`` in one task a part, in the order given."""
    rdd = spark.sparkContext.parallelize(list(parts), len(parts)).flatMap(lambda part: part)
    return spark.createDataFrame(rdd, "doc_id long, text string")


def test_passages_out_of_key_order(spark):
    r = random.Random(21)
    shared = prose(80, r)
    rows = [(k, prose(60, r) + " " + shared + " " + prose(60, r)) for k in (1, 9, 5, 7)]
    docs = in_tasks(spark, rows[:1], rows[1:])
    got = {(x.doc_id, x.source_id) for x in passages.find(docs).collect()}
    assert {(5, 1), (7, 1), (9, 1)} <= got
    left = {x.doc_id: x.text for x in passages.cut_out(docs).collect()}
    assert [k for k, t in left.items() if shared in t] == [1]


def test_passage_twice_in_a_later_document(spark):
    r = random.Random(22)
    shared = prose(80, r)
    texts = [prose(60, r) + " " + shared + " " + prose(60, r), prose(60, r) + " " + shared + " " + prose(2000, r) + " " + shared + " " + prose(60, r)]
    docs = in_tasks(spark, *([row] for row in enumerate(texts)))
    starts = {x.start_word for x in passages.find(docs).collect() if x.doc_id == 1}
    assert starts == {60, 2140}
    assert [shared in x.text for x in passages.cut_out(docs).orderBy("doc_id").collect()] == [True, False]


def test_passages_around_a_frequent_line(spark):
    r = random.Random(23)
    line = prose(30, r)
    passages_of = [prose(15, r) + " " + line + " " + prose(15, r) for _ in range(12)]
    texts = [prose(80, r) + " " + line + " " + prose(80, r) for _ in range(30)]
    texts += [prose(80, r) + " " + passages_of[k % 12] + " " + prose(80, r) for k in range(36)]
    got = defaultdict(set)
    for x in passages.find(docs_of(spark, texts)).collect():
        got[x.doc_id].update(range(x.start_word, x.end_word))
    want = repeats(texts)
    assert len(want) == 24 and all(words <= got[i] for i, words in want.items())


def similar_passages(texts, n=50):
    """Texts with a passage of ``n`` words or more that an earlier text has with a few edits: (text, first word, end) by plain search."""
    split = [(t or "").split() for t in texts]
    grams = [[tuple(w[k : k + 5]) for k in range(len(w) - 4)] for w in split]
    found = []
    for i, own in enumerate(grams):
        for k in range(0, len(own) - n + 5, 5):
            want = set(own[k : k + n - 4])
            for other in grams[:i]:
                at = [m for m, g in enumerate(other) if g in want]
                low = at[0] if at else 0
                if any(len(want & set(other[m : m + n - 4])) >= 0.8 * len(want | set(other[m : m + n - 4])) for m in sorted({max(0, x - d) for x in at for d in (0, 5, 10)} | {low})):
                    found.append((i, k, k + n))
                    break
    return found


def test_similar_passages_are_found(spark):
    r = random.Random(31)
    base = [prose(60, r) for _ in range(12)]
    texts = [prose(40, r) + " " + edited(base[k % 12], (k // 12) % 3, r) + " " + prose(40, r) for k in range(72)]
    got = defaultdict(set)
    for x in passages.find(docs_of(spark, texts)).collect():
        got[x.doc_id].update(range(x.start_word, x.end_word))
    want = similar_passages(texts)
    hit = sum(len(got[i] & set(range(s, e))) >= 0.8 * (e - s) for i, s, e in want)
    assert len(want) > 60 and hit >= 0.9 * len(want)


def test_copies_of_one_text_in_one_task(spark, monkeypatch):
    r = random.Random(33)
    shared = prose(120, r)
    texts = [prose(20, r) + " " + shared + " " + prose(20, r) for _ in range(30)]
    monkeypatch.setattr(passages, "COMBINE", 4)
    rows = in_tasks(spark, list(enumerate(texts))[::-1])
    found = passages.find(rows).collect()
    got = defaultdict(set)
    for x in found:
        assert x.source_id < x.doc_id
        got[x.doc_id].update(range(x.start_word, x.end_word))
    assert all(set(range(20, 140)) <= got[k] for k in range(1, 30)) and 0 not in got
    assert len(found) < 30 * 6  # tied to a few, not to all


def test_repeated_words(spark):
    texts = ["the " * 90 + "and " * 80, "x y z " * 40 + "the " * 60 + "and " * 60 + "of " * 70, "of " * 60 + "a b c d " * 20, "a b c d " * 30]
    got = defaultdict(set)
    for x in passages.find(docs_of(spark, texts)).collect():
        got[x.doc_id].update(range(x.start_word, x.end_word))
    assert all(words <= got[i] for i, words in repeats(texts).items()) and set(got) == {1, 2, 3}


def test_equal_runs_of_shingles():
    g = np.random.default_rng(2)
    a = g.integers(0, 1 << 32, 80, dtype=np.uint32)
    assert len(set(passages.runs_of(a, 46).tolist())) == 35 and (passages.runs_of(a[5:60], 46) == passages.runs_of(a, 46)[5:15]).all()
    assert [x[:4] for x in passages.shared_runs(a[10:70], a, 46, 0.8)] == [(0, 59, 10, 69)]
    assert passages.shared_runs(a[:40], a, 46, 0.8) == []


def test_minima_beside_a_window():
    g = np.random.default_rng(3)
    h, first = g.integers(0, 1 << 62, 90, dtype=np.uint64) << np.uint64(1), np.array([0, 40, 90])
    tree = passages.Tree(h, first)
    c = np.array([0, 4, 5, 39, 40, 44, 45, 84, 85, 89])
    for at, got in zip(c.tolist(), tree.beside(c, 5).tolist(), strict=True):
        low, high = (0, 40) if at < 40 else (40, 90)
        want = [passages.mix(np.array([x.min()]) + np.uint64(1))[0] >> np.uint64(48) if len(x) == 5 else 0 for x in (h[max(low, at - 5) : at], h[at + 1 : min(high, at + 6)])]
        assert got == int(want[0]) << 16 | int(want[1])


def test_cut_out(spark):
    texts = passage_corpus(random.Random(5))
    docs = docs_of(spark, texts)
    out = passages.cut_out(docs)
    left = {r.doc_id: r.text for r in out.collect()}
    assert out.columns == docs.columns and 10 not in left  # all of it was a repeat
    assert left[0] == texts[0] and left[11] == texts[11] and left[13] is None and left[14] == ""
    again = sorted(left)
    assert not any(repeats([left[i] for i in again]).values())
    assert all(set((left[i] or "").split()) <= set((texts[i] or "").split()) for i in left)
    assert all(r.n_chars == len(r.text or "") for r in out.collect())


def slow_align(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 1, new[j - 1] - 1))
        best, row = max(best, *new), new
    return best


def test_alignment_equals_the_recurrence():
    g = np.random.default_rng(4)
    for _ in range(30):
        a, many = g.integers(1, 6, 12).astype(np.uint64), g.integers(1, 6, (5, 20)).astype(np.uint64)
        score, end, _ = decontaminate.align(a, many)
        assert score.tolist() == [slow_align(a.tolist(), m.tolist()) for m in many] and (end <= 20).all()


def test_decontamination(spark):
    r = random.Random(8)
    items = [prose(40, r) for _ in range(6)] + ["too short", None, ""]
    items.append(items[0])
    texts = [prose(100, r) + " " + items[0] + " " + prose(50, r), prose(30, r) + " " + edited(items[1], 5, r) + " " + prose(30, r), items[2].upper() + "!", prose(200, r), None, "", "too short", prose(50, r)]
    texts += [prose(20, r) + ". " + items[3] + "." for _ in range(40)]
    docs = docs_of(spark, texts)
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontaminate.find(docs, table).collect()}
    want = {(0, 0), (0, 9), (1, 1), (2, 2), (6, 6), *((8 + k, 3) for k in range(40))}
    assert set(got) == want and got[0, 0].score == 1.0 and got[2, 2].score == 1.0 and 0.5 <= got[1, 1].score < 1
    assert (got[0, 0].start_word, got[0, 0].end_word) == (100, 140)
    assert {x.doc_id for x in decontaminate.drop_contaminated(docs, table).collect()} == set(range(len(texts))) - {d for d, _ in want}
    assert decontaminate.find(docs, table.limit(0)).collect() == [] and decontaminate.find(docs.limit(0), table).collect() == []


def test_edited_copies_among_many_exact_ones(spark):
    r = random.Random(12)
    item, other = prose(40, r), prose(40, r)
    fifth = " ".join("zzz" + str(k) if k % 5 == 4 else w for k, w in enumerate(item.split()))
    half = " ".join(w if k < 24 else "zzz" + str(k) for k, w in enumerate(other.split()))
    texts = [*[item] * 20, fifth, *[half] * 30, *[other] * 3, prose(100, r)]
    docs = docs_of(spark, [prose(30, r) + " " + t + " " + prose(30, r) for t in texts])
    table = spark.createDataFrame([(0, item), (1, other)], "item_id long, text string")
    got = {(x.doc_id, x.item_id): (x.score, x.start_word) for x in decontaminate.find(docs, table).collect()}
    assert set(got) == {*((k, 0) for k in range(21)), *((k, 1) for k in range(21, 54))}
    assert got[20, 0] == (0.7125, 30) and got[21, 1] == (0.6, 30)


def test_short_items_and_long_passages(spark, monkeypatch):
    r = random.Random(18)
    item = prose(30, r)
    far = " ".join(w + (" zzz" * 3 if k % 9 == 8 else "") for k, w in enumerate(item.split()))
    texts = [" ".join(" ".join(item.split()[k % 27 : k % 27 + 4]) + " " + prose(6, r) for k in range(600)) + " " + far + " " + prose(5, r)]
    texts += ["Exact Match here", "exact, match", "exact no match", "match " * 5000, None]
    table = spark.createDataFrame([(0, item), (1, "exact match"), (2, "MATCH!"), (3, "..."), (4, None)], "item_id long, text string")
    want = {(x.doc_id, x.item_id): x for x in decontaminate.find(docs_of(spark, texts), table).collect()}
    assert set(want) == {(0, 0), (1, 1), (1, 2), (2, 1), (2, 2), (3, 2), (4, 2)} and (want[1, 1].start_word, want[1, 1].end_word) == (0, 2)
    monkeypatch.setattr(decontaminate, "STRETCH", 16)
    got = {(x.doc_id, x.item_id): x for x in decontaminate.find(docs_of(spark, texts), table).collect()}
    assert got == want and want[0, 0].score > 0.6


def test_blocks_of_items(spark, monkeypatch):
    r = random.Random(8)
    items = [prose(30, r) for _ in range(12)]
    docs = docs_of(spark, [prose(20, r) + " " + t for t in items])
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.find(docs, table).collect()} == {(i, i) for i in range(12)}


SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    before, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF).cache()
        assert after.columns == docs.columns, name
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
        before = after
        counts.append(after.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    texts = [r.text for r in before.orderBy("doc_id").collect()]
    assert not any(repeats(texts).values())
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in t for i in items for t in texts)
    last = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in before.select("doc_id").collect()} and all(len(r.ids) == r.n_tokens for r in last)


def test_pipeline_on_odd_rows(spark):
    texts = [None, "", "a", "a", "word " * 400]
    docs = docs_of(spark, texts)
    assert corpus_pipeline.one_of_each_group(spark, docs, SF).count() == 4
    assert corpus_pipeline.passages_once(spark, docs, SF).count() == 5
    assert corpus_pipeline.no_benchmark(spark, docs, SF).count() == 5
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    clash = docs.withColumns({c: F.lit("x") for c in ("key", "text_hash", "spans", "kept_key", "score", "member", "ids")}).withColumn("doc_id", F.when(F.col("doc_id") != 2, F.col("doc_id")))
    twice = clash.union(clash)
    rows = lambda df: sorted((str(r.doc_id), str(r.text)) for r in df.collect())
    every = rows(twice)
    for stage in (corpus_pipeline.good_quality, corpus_pipeline.passages_once, corpus_pipeline.no_benchmark):
        assert stage(spark, twice, SF).columns == clash.columns
    assert rows(corpus_pipeline.passages_once(spark, twice, SF)) == every and rows(corpus_pipeline.no_benchmark(spark, twice, SF)) == every
    kept = corpus_pipeline.one_of_each_group(spark, twice, SF)
    assert kept.columns == clash.columns and rows(kept) == sorted(set(every) - {("None", "a")})
    assert corpus_pipeline.token_ids(spark, twice, SF).count() == 10


def test_queries_are_registered():
    names = list(queries.queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
