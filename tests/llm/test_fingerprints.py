import hashlib
import random

import duckdb
from pyspark.sql import functions as F

from tidemark.llm import fingerprints as fp

TEXTS = [(5, "alpha beta\n\ngamma\n \n\ndelta"), (9000, None), (1, ""), (2, "x" * 9), (None, "null id"), (7, "word " * 3000 + "\nend"), (123456, "a\x1eb\n\n\x1ec"), (8192, "é\U0001f600" * 50)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, next_text string").repartition(3)


def test_edits_by_brute_force(spark):
    got = {r.doc_id: r for r in fp.op7_fingerprints(frame(spark, TEXTS)).collect()}
    order = sorted(TEXTS, key=lambda r: -1 if r[0] is None else r[0])
    assert len(got) == len(TEXTS)
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t or "", u or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + u[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint == r.edited_fingerprint) == (t == edited)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_next_of_repeated_sparse_and_null_ids(spark, monkeypatch):
    r = random.Random(1)
    ids = [None] * 40 + [7] * 60 + list(range(200)) + [r.randrange(-(1 << 63), 1 << 63) for _ in range(200)] + [(1 << 63) - 1, -(1 << 63)]
    rows = [(i, f"text {r.randrange(150)}") for i in ids]
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, hashlib.sha256(x[1].encode()).hexdigest()))
    want = sorted(((i, t, u) for (i, t), (_, u) in zip(order, order[1:] + order[:1])), key=str)
    for hot, most in ((20_000, 10), (10, 10), (10, 0)):
        monkeypatch.setattr(fp, "HOT", hot)
        monkeypatch.setattr(fp, "BROADCAST_HOT", most)
        assert sorted(((x.doc_id, x.text, x.next_text) for x in fp.with_next(frame(spark, rows)).collect()), key=str) == want


def test_likeness_around_100_characters(spark):
    words = [f"word{i:02d}" for i in range(40)]
    rows = []
    for n in range(12, 19):  # 83 to 132 characters, followed by an empty text, then by themselves with a word more
        rows += [(10 * n, " ".join(words[:n])), (10 * n + 1, ""), (10 * n + 2, " ".join(words[:n])), (10 * n + 3, " ".join(words[:5] + ["more"] + words[5:n]))]
    got = {r.doc_id: r for r in fp.op7_fingerprints(frame(spark, rows)).collect()}
    for n in range(12, 19):
        assert got[10 * n].near_edited > 0.35 and got[10 * n].near_next == 0 and got[10 * n + 1].near_edited == 1
        assert got[10 * n + 2].near_next > 0.5


def test_as_sql(spark):
    rows = [x for x in TEXTS if x[0] is not None] + [(i, " ".join(f"w{i % 7 * j % 11}s" for j in range(i)) + "\n\n" * (i % 3) + "x" * (i * 5)) for i in range(20, 60)]
    documents = frame(spark, rows).toPandas()  # noqa: F841
    got = sorted(tuple(r) for r in fp.op7_fingerprints(frame(spark, rows)).collect())
    assert got == sorted(duckdb.sql(fp.OP7_SQL).fetchall())


def test_lossless_cuts_and_located_edits(spark):
    rows = [(0, "a b\nc\n\nd e\nf"), (1, "a b\nc\n\nd X\nf"), (2, "a b\nc\n \nd e\nf"), (3, "a b\nc\n\nd e\nf")]
    t = frame(spark, rows).withColumn("root", fp.root(F.col("text"))).withColumn("tree", fp.tree(F.col("text"))).withColumn("back", F.array_join(F.flatten(F.transform(fp.sections(F.col("text")), fp.paragraphs)), ""))
    got = {r.doc_id: r for r in t.collect()}
    assert all(r.back == r.text for r in got.values())
    assert got[0].root == got[3].root and len({r.root for r in got.values()}) == 3
    pairs = t.alias("x").join(t.alias("y"), F.expr("x.doc_id = 0")).select("y.doc_id", fp.first_difference(F.col("x.tree"), F.col("y.tree")).alias("d"))
    places = {r.doc_id: r.d and tuple(r.d) for r in pairs.collect()}
    assert places == {0: None, 1: (1, 0), 2: (0, 2), 3: None}


def test_single_repeated_and_empty(spark):
    one = fp.op7_fingerprints(frame(spark, [(1, "abcdefgh")])).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert fp.op7_fingerprints(frame(spark, [(1, "abcd"), (1, "abcd")])).count() == 2
    assert fp.op7_fingerprints(frame(spark, [])).count() == 0
