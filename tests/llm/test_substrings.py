import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import substrings


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()) if len(t) else 0
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, length, n=60):
    r = random.Random(seed)

    def prose(k):
        return "".join(r.choice("abcdé ") for _ in range(k))

    passages = [prose(r.randint(length - 60, length * 2)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [prose(r.randint(0, length * 2))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            parts += [p[r.randint(0, 20) :], prose(r.randint(0, length))]
        rows.append((i, "".join(parts)))
    for i in range(12):  # copies and near copies
        t = rows[r.randrange(n)][1]
        k = r.randrange(len(t) + 1)
        rows.append((100 + i, t if i % 3 == 0 else t[:k] + "#" + t[k:]))
    rows += [(200, None), (201, ""), (202, "a" * (length * 3)), (203, ("xyz" * length)), (204, prose(length)), (None, rows[2][1]), (2, rows[2][1]), (5, "other " * 3), (206, "a" * (length + 1))]
    return rows


@pytest.mark.parametrize("length,hot,seed", [(64, 20000, 1), (64, 3, 2), (200, 20000, 3), (200, 2, 4)])
def test_as_brute_force(spark, length, hot, seed):
    rows = corpus(seed, length)
    frame = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, n_spans string").repartition(5)
    got = substrings.without_repeats(frame, length, hot=hot, texts=True).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str) == brute(rows, length)
    assert all(r.kept is None for r in got if r.doc_id == 200)


def test_every_window_has_an_anchor():
    r = np.random.default_rng(1)
    data = r.integers(97, 100, 3000).astype(np.uint8)
    offsets = np.array([0, 100, 700, 700, 2500, 3000])
    at = substrings.anchors(data, offsets, 200)
    for a, b in zip(offsets[:-1], offsets[1:]):
        for s in range(a, b - 199):
            assert ((at >= s) & (at <= s + 168)).any()


def test_empty(spark):
    assert substrings.op2_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0
