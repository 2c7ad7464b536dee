"""Queries that use all of each row and all rows, against plain Python."""

import unicodedata

import pytest

from tidemark.plans.catalog import QUERIES


@pytest.fixture
def run(spark, tmp_path):
    def call(name, rows):
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
        return sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect())

    return call


def test_all_names_are_paired(run):
    low, high = ["Adams", "Baker", "Clark", "Davis", "Evans"], ["Moore", "Nolan", "Zebra"]
    rows = [(1, " ".join(high + low), "en", "a"), (2, "Adams Baker Clark Davis Moore", "en", "a"), (3, "Adams", "en", "a")]
    want = [(1, a, b) for a in low for b in high] + [(2, a, "Moore") for a in low[:4]]
    assert run("j6_pairs_within_documents", rows) == sorted(want)


TEXTS = [(1, "x" * 5000, "en", "a"), (2, "y" * 70 + " cafe\u0301 \u212b", "fr", "b"), (3, "", "en", "c"), (4, "z" * 59 + "e\u0301", "fr", "d")]


def test_whole_texts_are_joined(run):
    want = [(i, "".join(f"{len(x)}:{x}" for x in (source, lang, str(i), text))) for i, text, lang, source in TEXTS]
    assert run("p1_canonical_join", TEXTS) == sorted(want)


def test_whole_texts_are_normalized(run):
    assert run("p2_normalize_key", TEXTS) == sorted((i, unicodedata.normalize("NFC", text + "e\u0301")) for i, text, _, _ in TEXTS)


def test_sources_of_all_documents(run):
    assert run("u1_union", TEXTS) == [("a",), ("b",), ("c",), ("d",), ("en",), ("fr",)]
