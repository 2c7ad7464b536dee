import random
import re
from pathlib import Path

import pyarrow as pa
import pytest

from tidemark.llm import common


@pytest.mark.parametrize("limit", [50_000, 20])
def test_components_by_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "FOREST_EDGES", limit)
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7)]
    low = {}

    def find(x):
        low.setdefault(x, x)
        while low[x] != x:
            x = low[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            low[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {x.node: x.component for x in common.components(frame).collect()}
    assert got == {x: find(x) for x in list(low)}
    assert common.components(frame.limit(0)).count() == 0


def held():
    return int(re.search(r"Pss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) // 1024


def test_workers_give_memory_back():
    kept = []

    def run(batches):
        for batch in batches:
            blocks = [b"x" * 100_000 for _ in range(2000)]  # of the heap, not mapped by themselves
            kept.append(blocks[-1])  # so the heap can't shrink from its end
            yield batch

    before = held()
    assert sum(b.num_rows for b in common.lean(run)(iter([pa.record_batch({"x": [1, 2]})] * 2))) == 4
    assert held() - before < 60
