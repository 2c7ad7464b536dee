import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import jaccard


def brute(rows, words, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    low = list(range(len(rows)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                low[find(i)] = find(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)] = min(ids.get(find(i), d), d)
    return sorted(((d, len(sets[i]), ids.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=220):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "Straße", "ΑΒ"]
    passage = [r.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(n):
        kind = r.random()
        if i and kind < 0.55:  # a near or exact copy, chains of copies too
            w = (rows[r.randrange(len(rows))][1] or "").split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocab)
            if r.random() < 0.2:
                w += [r.choice(vocab)]
        else:
            w = [r.choice(vocab) for _ in range(int(2 ** r.uniform(0, 9)))]
            if r.random() < 0.3:
                w += passage
        rows.append((i, r.choice([" ", "  ", "\n"]).join(w)))
    return rows + [(1000, None), (1001, ""), (1002, " \n"), (None, rows[3][1]), (5, rows[5][1]), (1003, "Two words"), (1004, "two WORDS"), (1005, "a b c")]


@pytest.mark.parametrize("words,percent,seed,block", [(3, 90, 1, 256), (5, 80, 2, 256), (3, 90, 3, 4), (5, 80, 4, 3)])
def test_as_brute_force(spark, monkeypatch, words, percent, seed, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = corpus(seed)
    frame = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, component string").repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component) for r in jaccard.classes(frame, words, percent).collect()), key=str)
    assert got == brute(rows, words, percent)


def test_similar_sets_always_share_a_signature():
    r = np.random.default_rng(4)
    for percent, words in ((80, 3), (80, 5), (90, 3)):
        allocation = jaccard.Allocation(percent, words)
        assert 0 < allocation.deletes.sum() < len(allocation.deletes) or words == 5
        for size in (10, 11, 19, 25, 40, 63, 100, 250, 800, 3000):
            for _ in range(25):
                base = r.integers(0, 1 << 62, size * 2).astype(np.uint64)
                differ = int((2 * size) * (100 - percent) / (100 + percent))
                gone = int(r.integers(0, differ + 1))
                a, b = base[:size], np.concatenate([base[gone:size], base[size : size + int(r.integers(0, differ - gone + 1))]])
                common = size - gone
                if 100 * common < percent * (size + len(b) - common):
                    continue
                row = np.concatenate([np.zeros(len(a), np.int64), np.ones(len(b), np.int64)])
                of, sig = allocation.signatures(row, np.concatenate([a, b]), np.array([len(a), len(b)]))
                assert np.intersect1d(sig[of == 0], sig[of == 1]).size or set(a) == set(b)


def test_bitmaps_bound_differences():
    r = np.random.default_rng(5)
    for size in (1, 200, 256, 257, 5000, 30000):
        x = r.integers(0, 1 << 62, size * 2).astype(np.uint64)
        a, b = x[:size], x[size // 3 : size // 3 + size]
        maps = jaccard.parities(np.concatenate([a, b, a]), np.array([len(a), len(b), len(a)]))
        f = jaccard.folded(maps)
        gap = int(np.bitwise_count(f[0] ^ f[1]).sum())
        assert gap <= 2 * (size // 3) and (f[0] == f[2]).all() and gap >= 0.4 * (size // 3)
    small, large = jaccard.parities(x[:1100], np.array([200, 900]))
    assert jaccard.folded([small, large]).shape == (2, 8)


def test_sets_that_share_an_id_stay_apart(spark):
    rows = corpus(6, 120)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component) for r in jaccard.classes(frame, 3, 90, id_bits=5).collect()), key=str)
    assert got == brute(rows, 3, 90)


def test_a_very_long_text_and_many_equal_rows_without_an_id(spark):
    r = random.Random(7)
    long = [f"w{r.randrange(5000)}" for _ in range(150_000)]
    near = [w if r.random() < 0.99 else "x" for w in long]
    rows = [(1, " ".join(long)), (2, " ".join(near)), (3, " ".join(long[:5000]))] + [(None, "the same text every time")] * 300
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(x.doc_id, x.component) for x in jaccard.classes(frame, 5, 80).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (None, None)}
    kept = jaccard.representatives(frame.withColumn("own", frame.doc_id)).collect()
    assert sorted((x.doc_id for x in kept), key=str) == [1, 3, None]


def test_rows_of_shared_signatures_by_brute_force():
    r = np.random.default_rng(9)
    for _ in range(50):
        rows = sorted((int(a), int(b)) for a, b in zip(r.integers(0, 12, 60), r.integers(0, 5, 60), strict=True))
        cuts = sorted(r.integers(0, 61, 12).tolist())
        batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows[a:b]], pa.int64()), pa.array([x[1] for x in rows[a:b]], pa.int64())], ["sig", "set_id"]) for a, b in zip([0, *cuts], [*cuts, 60], strict=True)]
        got = [(s, i) for out in jaccard._shared(batches) for s, i in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
        several = {s for s, _ in rows if len({i for t, i in rows if t == s}) > 1}
        assert got == sorted({x for x in rows if x[0] in several})


def test_empty(spark):
    assert jaccard.op3_jaccard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
