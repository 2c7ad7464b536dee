import math

import numpy as np
import pytest

from tidemark.llm import embeddings


def brute(rows):
    ok = {}
    for n, (i, v, l) in enumerate(rows):
        if i is not None and l is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[n] = (np.array(v, np.float32).astype(float), l)
    links = {n: set() for n in range(len(rows))}
    for a in ok:
        for b in ok:
            if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] / (np.linalg.norm(ok[a][0]) * np.linalg.norm(ok[b][0])) >= 0.98:
                links[a].add(b)
                links[b].add(a)
    out = []
    for n in links:
        seen, todo = {n}, [n]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[m][0] for m in seen]
        low = min(ids) if None not in ids else None
        out.append((rows[n][0], len(links[n]), low, None if rows[n][0] is None else rows[n][0] == low))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [512, 8])
def test_as_brute_force(spark, block):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + r.normal(size=24) * 0.12).tolist(), i % 3) for i in range(150)]
    rows += [(500 + i, centres[0].tolist(), 1) for i in range(30)] + [(600, (3 * centres[0]).tolist(), 1)]
    rows += [(700, None, 1), (701, [], 1), (702, [0.0] * 24, 1), (703, [float("nan"), 1.0], 1), (704, [None, 1.0], 1), (705, [float("inf"), 1.0], 1), (706, centres[0].tolist(), None)]
    rows += [(None, centres[0].tolist(), 1), (800, [1.0], 2), (801, [2.0], 2), (802, [1.0, 1.0], 2), (803, [1.0, 1.1], 2), (500, centres[0].tolist(), 1)]
    frame = spark.createDataFrame([(*x, "z") for x in rows], "vec_id long, embedding array<float>, label int, n_links string").repartition(5)
    got = sorted((tuple(x) for x in embeddings.near_duplicates(frame, block=block).collect()), key=str)
    assert got == brute(rows)


def test_recall_on_a_spread_sample():
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 64))
    y = x + r.normal(size=x.shape) * 0.2  # cosine about 0.98
    h = embeddings.CrossPolytope(64)
    cos = (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    hit = (h.buckets(x)[:, :, None] == h.buckets(y)[:, None, :]).any((1, 2))
    assert hit[cos >= 0.98].mean() > 0.99


def test_empty(spark):
    assert embeddings.op10_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
