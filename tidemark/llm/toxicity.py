"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

Features are hashed: each distinct word of a text (letters, digits and marks of any script, A-Z lowered) as
a whole, its first four and its first five bytes; a run without spaces, as in Chinese, is one word. One weight vector is shared by all thresholds:
P(grade >= k) = sigmoid(w x - b_k), b_1 < b_2 < ...; the result is the expected grade, the sum of these.
The weights have an L1 penalty, so that a text of 20 000 words is not judged by the noise of its words.

The labels say only toxic or not, so the order above that is made here: grade 0 is not toxic, and toxic
rows are split into grades 1 and 2 at the median rate (share of a row's distinct features, so that length
doesn't count) of features that a first fit of one threshold weighs as toxic. Grade 2 is thus "toxic in
more of its words", not a judgement that the labels hold.

Training takes at most `most` labelled rows, those with the least hash of their id (a documented bound),
and only their features go to the driver; all rows are scored. Cases: null or empty text, and text without
any weighed feature, has what the thresholds alone give, the same for all of them; rows without a label are
scored alike, rows repeated score alike, labels with a null are left out, of different labels of one id the
greatest counts; with no labelled row, or labels of one kind only, every severity is 0; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_text
from tidemark.llm.lexing import hashes

BITS = 18


def _in_word() -> np.ndarray:
    table = np.zeros(256, bool)
    table[128:] = True
    for c in b"abcdefghijklmnopqrstuvwxyz0123456789_'":
        table[c] = True
    return table


IN_WORD = _in_word()
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word, in order of rows; not yet distinct."""
    b = LOWER[data]
    inside = IN_WORD[b]
    edge = np.zeros(len(b) + 1, bool)
    edge[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    at = np.flatnonzero(begin)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    stop = np.append(inside[:-1] & (~inside[1:] | edge[1:-1]), inside[-1])
    end = np.flatnonzero(stop) + 1
    size = end - at
    padded = np.concatenate([b, np.zeros(8, np.uint8)]).astype(np.uint64)
    with np.errstate(over="ignore"):
        five = np.zeros(len(at), np.uint64)
        for i in range(5):
            five |= np.where(size > i, padded[at + i], np.uint64(0)) << np.uint64(8 * i)
        four = five & np.uint64(0xFFFFFFFF)
        whole = hashes(b, at, end)
        mix = np.uint64(0x9E3779B97F4A7C15)
        kinds = [((x + np.uint64(k)) * mix) ^ (x >> np.uint64(31)) for k, x in ((1, whole), (2, four), (3, five))]
        found = np.stack([(k * mix) >> np.uint64(64 - BITS) for k in kinds], axis=1).astype(np.int64)
    row = np.searchsorted(offsets, at, "right") - 1
    return np.repeat(row, 3), found.ravel()


def distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row, feature = features(data, offsets)
    key = np.unique(row << BITS | feature)
    return key >> BITS, key & (1 << BITS) - 1


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class OrdinalModel:
    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    @staticmethod
    def slopes(margin: np.ndarray, cuts: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row's log loss, - log P(grade): the derivatives by its margin and by each cut."""
        k = np.arange(len(cuts))
        p = _sigmoid(margin[:, None] - cuts)
        above, below = k == grade[:, None], k + 1 == grade[:, None]
        by_margin = np.where(above, p, 0).sum(1) - np.where(below, 1 - p, 0).sum(1)
        full = np.concatenate([np.ones((len(grade), 1)), p, np.zeros((len(grade), 1))], axis=1)
        inside = np.maximum(full[np.arange(len(grade)), grade] - full[np.arange(len(grade)), grade + 1], 1e-9)
        density = p * (1 - p) / inside[:, None]
        return by_margin, np.where(below, density, 0) - np.where(above, density, 0)

    @classmethod
    def fit(cls, row: np.ndarray, feature: np.ndarray, grade: np.ndarray, l1: float = 4e-4, rounds: int = 300, least: int = 5) -> OrdinalModel:
        """Accelerated proximal gradient on the mean log loss of the thresholds' link, classes weighed alike. row: ascending, from 0; features of fewer than `least` rows are left out.

        Most weights end at 0: between looks at all features, only those are stepped that have a weight or
        whose slope comes near the penalty.
        """
        n, grades = len(grade), int(grade.max()) + 1 if len(grade) else 1
        if n == 0 or grades == 1:
            return cls(np.zeros(1 << BITS), np.zeros(0))
        share = np.bincount(grade > 0, minlength=2) / n
        weigh = (0.5 / share[(grade > 0).astype(int)] if share.min() > 0 else np.ones(n)) / n
        common = np.bincount(feature, minlength=1 << BITS) >= least
        row, feature = row[common[feature]], feature[common[feature]]
        used, feature = np.unique(feature, return_inverse=True)
        w, cuts, step = np.zeros(len(used)), np.linspace(0.5, 1.5, grades - 1), 0.5
        apart = 1e-3 * np.arange(grades - 1)
        for _ in range(12):
            by_margin, _ = cls.slopes(np.bincount(row, weights=w[feature], minlength=n), cuts, grade)
            g = np.bincount(feature, weights=(by_margin * weigh)[row], minlength=len(used))
            active = (w != 0) | (np.abs(g) > 0.7 * l1)
            number = np.cumsum(active) - 1
            mine = active[feature]
            r, f = row[mine], number[feature[mine]]
            x, before, t = w[active], w, 1.0
            ahead_x, ahead_c = x.copy(), cuts.copy()
            for _ in range(rounds):
                by_margin, by_cut = cls.slopes(np.bincount(r, weights=ahead_x[f], minlength=n), ahead_c, grade)
                new = ahead_x - step * np.bincount(f, weights=(by_margin * weigh)[r], minlength=len(x))
                new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
                new_c = np.maximum.accumulate(ahead_c - step * (by_cut * weigh[:, None]).sum(0) + apart)
                t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
                ahead_x, ahead_c = new + (t - 1) / t_new * (new - x), np.maximum.accumulate(new_c + (t - 1) / t_new * (new_c - cuts))
                moved = max(np.abs(new - x).max(initial=0), np.abs(new_c - cuts).max())
                x, cuts, t = new, new_c, t_new
                if moved < 1e-5:
                    break
            w = np.zeros(len(used))
            w[active] = x
            if np.abs(w - before).max(initial=0) < 1e-3:
                break
        whole = np.zeros(1 << BITS)
        whole[used] = w
        return cls(whole, cuts)

    def passed(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """P(grade >= k) for each row and threshold."""
        return _sigmoid(np.bincount(row, weights=self.weights[feature], minlength=n)[:, None] - self.cuts)


def train(docs: DataFrame, labels: DataFrame, most: int = 6000) -> OrdinalModel:
    sample = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # `most` rows of two numbers: small enough to broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.withColumnRenamed("toxic", "toxic__")), "doc_id").where("text is not null")
    rows = texts.groupBy("doc_id").agg(F.min("toxic__").alias("toxic__"), F.min("text").alias("text"))

    def features_of(data: np.ndarray, offsets: np.ndarray) -> dict:
        row, feature = distinct(data, offsets)
        stops = np.searchsorted(row, np.arange(len(offsets)))
        return {"features": pa.ListArray.from_arrays(pa.array(stops, pa.int32()), pa.array(feature.astype(np.int32)))}

    rows = map_text(rows, ["doc_id", "toxic__"], "text", lambda: features_of, "features array<int>").orderBy("doc_id").toArrow()
    toxic = rows.column("toxic__").to_numpy(zero_copy_only=False).astype(np.int64)
    lists = rows.column("features").combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row, feature = np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    grade = (toxic > 0).astype(np.int64)
    first = OrdinalModel.fit(row, feature, grade)
    terms = np.bincount(row, weights=(first.weights[feature] > 0.05).astype(float), minlength=len(grade)) / np.maximum(size, 1)
    if grade.any() and not grade.all():
        grade[(grade > 0) & (terms > np.median(terms[grade > 0]))] = 2
        return OrdinalModel.fit(row, feature, grade)
    return first


def severity(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic): the expected grade, the chance of any, the likeliest grade, and whether p_toxic is a half or more."""
    used = np.flatnonzero(model.weights)
    values, cuts = model.weights[used], model.cuts

    def make():
        weights = np.zeros(1 << BITS)
        weights[used] = values
        mine = OrdinalModel(weights, cuts)

        def work(data: np.ndarray, offsets: np.ndarray) -> dict:
            n = len(offsets) - 1
            row, feature = features(data, offsets)
            live = weights[feature] != 0
            key = np.unique(row[live] << BITS | feature[live])
            p = mine.passed(key >> BITS, key & (1 << BITS) - 1, n)
            chance = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], axis=1)
            any_ = p[:, 0] if p.shape[1] else np.zeros(n)
            return {"severity": p.sum(1), "p_toxic": any_, "grade": np.argmax(chance[:, :-1] - chance[:, 1:], axis=1).astype(np.int32), "toxic": any_ >= 0.5}

        return work

    return map_text(docs, [key], text, make, "severity double, p_toxic double, grade int, toxic boolean")


def op1_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return severity(docs, train(docs, labels))
