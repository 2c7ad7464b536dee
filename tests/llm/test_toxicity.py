import numpy as np

from tidemark.llm import toxicity

CLEAN = ["the cat sat on the mat", "a fine day for a long walk", "reading books is quiet work", "", "trees and rivers"]
BAD = ["idiot", "moron", "idiot moron"]


def table(spark, n=400):
    rows = [(i, f"{CLEAN[i % 5]} word{i % 37} you {BAD[i // 4 % 3] if i % 4 == 0 else 'friend'}", "x") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic string")


def test_held_out_accuracy_and_ordered_grades(spark):
    docs = table(spark)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.op1_toxicity(docs, labels).collect()}
    held = [got[i] for i in range(200, 400)]
    assert all(r.toxic == (r.doc_id % 4 == 0) for r in held)
    assert all(0 <= r.severity <= 2 and r.grade in (0, 1, 2) for r in held)
    assert np.mean([r.severity for r in held if r.doc_id % 12 == 8]) > np.mean([r.severity for r in held if r.doc_id % 12 in (0, 4)])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "idiot"), (1, None), (5, "x" * 50000 + " idiot")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.severity for r in toxicity.op1_toxicity(docs, none).collect()] == [0.0] * 5
    assert toxicity.op1_toxicity(docs.limit(0), none).count() == 0
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train(table(spark), labels)
    got = toxicity.severity(docs, model).collect()
    alone = float(toxicity._sigmoid(-model.cuts).sum())  # of the thresholds, for a row without a weighed feature
    assert [round(r.severity - alone, 9) for r in got if r.doc_id in (1, 2)] == [0, 0, 0]
    assert {r.doc_id: r.toxic for r in got if r.doc_id in (None, 5)} == {None: True, 5: True}


def test_features_by_brute_force():
    text = "Ab, ab lowérX\nzz"
    data = np.frombuffer(text.encode(), np.uint8)
    row, feature = toxicity.features(data, np.array([0, len(data)]))
    assert len(row) == 3 * 4 and (feature[:3] == feature[3:6]).all()
    half = np.array([0, 6, 6, len(data)])
    row, _ = toxicity.features(data, half)
    assert row.tolist() == [0] * 6 + [2] * 6
    long = [b"x" * 300 + b"a", b"x" * 300 + b"b", b"x" * 300 + b"a"]
    data = np.frombuffer(b" ".join(long), np.uint8)
    _, feature = toxicity.features(data, np.array([0, len(data)]))
    assert feature[0] == feature[6] != feature[3] and feature[1] == feature[4]


def test_slopes_by_differences():
    r = np.random.default_rng(3)
    margin, cuts, grade = r.normal(size=30), np.array([-0.4, 0.3, 1.1]), r.integers(0, 4, 30)

    def loss(m, c):
        p = np.concatenate([np.ones((30, 1)), 1 / (1 + np.exp(-(m[:, None] - c))), np.zeros((30, 1))], axis=1)
        return -np.log(p[np.arange(30), grade] - p[np.arange(30), grade + 1])

    by_margin, by_cut = toxicity.OrdinalModel.slopes(margin, cuts, grade)
    assert np.allclose(by_margin, (loss(margin + 1e-6, cuts) - loss(margin - 1e-6, cuts)) / 2e-6, atol=1e-5)
    for k in range(3):
        d = np.eye(3)[k] * 1e-6
        assert np.allclose(by_cut[:, k], (loss(margin, cuts + d) - loss(margin, cuts - d)) / 2e-6, atol=1e-5)


def test_fit_is_a_minimum_and_scores_are_its_expected_grade(spark):
    r = np.random.default_rng(4)
    rows = [(np.unique(r.integers(0, 40, 12)), 0) for _ in range(300)]
    rows = [(f, int((f < 4).sum() > 0) + int((f < 4).sum() > 2)) for f, _ in rows]
    row = np.concatenate([np.full(len(f), i) for i, (f, _) in enumerate(rows)])
    feature, grade = np.concatenate([f for f, _ in rows]), np.array([g for _, g in rows])
    model = toxicity.OrdinalModel.fit(row, feature, grade, l1=1e-3)
    share = np.bincount(grade > 0, minlength=2) / 300
    weigh = 0.5 / share[(grade > 0).astype(int)] / 300

    def total(w, c):
        p = np.concatenate([np.ones((300, 1)), 1 / (1 + np.exp(-(np.bincount(row, weights=w[feature], minlength=300)[:, None] - c))), np.zeros((300, 1))], axis=1)
        return -(np.log(np.maximum(p[np.arange(300), grade] - p[np.arange(300), grade + 1], 1e-12)) * weigh).sum() + 1e-3 * np.abs(w).sum()

    best = total(model.weights, model.cuts)
    for _ in range(100):
        w = model.weights.copy()
        w[:40] += r.normal(size=40) * 0.02
        assert total(w, model.cuts + r.normal(size=2) * 0.02) >= best - 2e-5
    docs = spark.createDataFrame([(1, "you idiot"), (2, None), (3, "a"), (3, "a")], "doc_id long, text string")
    weights = np.zeros(1 << toxicity.BITS)
    _, found = toxicity.distinct(np.frombuffer(b"idiot", np.uint8), np.array([0, 5]))
    weights[found] = 0.7
    got = sorted((x.doc_id, x.severity) for x in toxicity.severity(docs, toxicity.OrdinalModel(weights, np.array([0.5, 1.0]))).collect())
    base = sum(1 / (1 + np.exp(c)) for c in (0.5, 1.0))
    assert np.allclose([s for _, s in got], [sum(1 / (1 + np.exp(c - 0.7 * len(found))) for c in (0.5, 1.0)), base, base, base])
