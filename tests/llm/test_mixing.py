import random
from collections import Counter

import duckdb

from tidemark.llm import mixing

ROWS = [(i, " ".join(["w"] * (i % 50 + (400 if i % 97 == 0 else 0))), ["a", "b", "c", None][i % 4 if i % 3 else 0]) for i in range(900)]
ROWS += [(1, None, "a"), (None, "null id here", "b"), (2000, "x y", "tiny"), (5, "w w w w w", "b"), (5, "w w w w w", "b")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, source string, size string").repartition(4)


def test_targets_bounds_and_reruns(spark):
    got = mixing.op8_mixing(frame(spark)).collect()
    assert len(got) == len(ROWS)
    assert Counter(got) == Counter(mixing.op8_mixing(frame(spark).repartition(7)).collect())
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        s = by.setdefault(r.source, [0, 0, r.source_size, r.target])
        s[0] += r.size
        s[1] += r.taken
    total = sum(s[2] for s in by.values())
    assert abs(sum(s[3] for s in by.values()) - 1.5 * total) < 1e-6 * total
    for source, (size, taken, source_size, target) in by.items():
        assert size == source_size and target <= 2 * size
        assert source == "tiny" or abs(taken - target) <= 0.1 * target + 500


def test_reruns_agree_for_rows_without_an_id_of_their_own(spark):
    rows = [(r, f"{'w ' * (i % 23)}t{i}", "ab"[i % 2]) for i in range(200) for r in (7, None)] + [(7, None, "a"), (7, "", "a")]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        docs = spark.createDataFrame([(*r, i % 1) for i, r in enumerate(rows)], "doc_id long, text string, source string, extra int").repartition(seed + 2)
        got = Counter((r.doc_id, r.text, r.source, r.mix__copies) for r in mixing.with_copies(docs).collect())
        want = want or got
        assert got == want


def test_targets_by_brute_force(spark):
    for seed in range(4):
        r = random.Random(seed)
        sizes = {s: r.choice([0, 1, 10, 500, 4000]) + r.randrange(100) for s in "abcdefg"[: 2 + seed]} | {None: 60}
        names = sorted(k for k in sizes if k is not None) + [None]
        weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
        target, rest = dict.fromkeys(names, 0.0), 1.5 * sum(sizes.values())
        free = set(names)
        while free and rest > 1e-9:  # give shares, take back what is above twice the size, give that again
            for s in free:
                target[s] += rest * weight[s] / sum(weight[x] for x in free)
            rest = sum(max(0.0, target[s] - 2 * sizes[s]) for s in free)
            full = {s for s in free if target[s] >= 2 * sizes[s]}
            for s in full:
                target[s] = 2.0 * sizes[s]
            free -= full
        frame_ = spark.createDataFrame(list(sizes.items()), "source string, size long")
        for row in mixing.source_targets(frame_).collect():
            assert abs(row.target - target[row.source]) < 1e-6 * (1 + target[row.source]), (seed, row)


def test_as_sql(spark):
    rows = [r for r in ROWS if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    got = sorted(tuple(r) for r in mixing.op8_mixing(frame(spark, rows)).select("doc_id", "size", "source_size", "target", "taken").collect())
    documents = frame(spark, rows).toPandas()  # noqa: F841
    want = sorted(duckdb.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.OP8_SQL})").fetchall())
    assert got == want


def test_rows_as_often_as_taken(spark):
    docs = frame(spark)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    want = Counter()
    for r in mixing.with_copies(docs).collect():
        want[r.doc_id, r.text, r.source] += r.mix__copies
    assert Counter((r.doc_id, r.text, r.source) for r in out.collect()) == +want


def test_empty(spark):
    assert mixing.op8_mixing(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [])).count() == 0
