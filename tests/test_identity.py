import uuid

import pytest
from pyspark.sql import functions as F

from tidemark.functions import fingerprints as fp
from tidemark.functions import identity as ident


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_document_ids(spark):
    """Version 2, the coordinates and the normal key, each with its length, in the fixed name space."""
    for key, name in (("guide/intro.md", "1:210:rt-primary6:user-a8:tenant-a4:docs14:guide/intro.md"), ("cafe\u0301.md", "1:210:rt-primary6:user-a8:tenant-a4:docs7:caf\u00e9.md")):
        got = one(spark, ident.document_id("rt-primary", "user-a", "tenant-a", "docs", ident.normalize_key(F.lit(key))))
        assert got == str(uuid.uuid5(uuid.UUID(ident.NAMESPACE), name))


@pytest.mark.parametrize("parts,joined", [((), ""), (("",), "0:"), (("a", "b:c"), "1:a3:b:c"), (("é",), "1:é"), (("\U0001f600x",), "2:\U0001f600x")])
def test_netstrings(spark, parts, joined):
    assert one(spark, ident.netstring(*parts)) == joined


def test_uuid5_as_the_library(spark):
    space = uuid.UUID(ident.NAMESPACE)
    names = [f"name {i} é" for i in range(300)]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", ident.uuid5(ident.NAMESPACE, F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(space, r.n)) for r in rows)


def test_keys(spark):
    rows = spark.createDataFrame([("café",), ("",), (None,), ("a\0b",), ("plain",), ("é",)], "k string")
    got = [r.k for r in rows.select(ident.normalize_key(F.col("k")).alias("k")).collect()]
    assert got == ["café", None, None, None, "plain", "é"]


@pytest.mark.parametrize("key,ok", [("a", True), ("A.b_c-9", True), ("-a", False), ("", False), ("a" * 129, False), ("a\n", False), ("é", False), (None, False)])
def test_runtime_keys(spark, key, ok):
    assert one(spark, ident.valid_runtime_key(F.lit(key).cast("string"))) is ok
    if ok:
        assert ident.require_runtime_key(key) == key
    else:
        with pytest.raises((ValueError, TypeError)) as e:
            ident.require_runtime_key(key)
        assert not key or key not in str(e.value)


def test_fingerprints(spark):
    assert one(spark, fp.content_fp(F.lit("x"))) != one(spark, fp.content_fp(F.encode(F.lit("x"), "UTF-8"), binary=True))
    assert fp.exact_content("x") != fp.exact_content(b"x") and len(fp.exact_content("")) == 32
    assert one(spark, fp.optional_fp(F.lit(None).cast("string"))) != one(spark, fp.optional_fp(F.lit("")))
    none, some = F.lit(None).cast("array<string>"), F.array().cast("array<string>")
    assert one(spark, fp.annotations_fp(F.lit(None).cast("string"), none)) != one(spark, fp.annotations_fp(F.lit(None).cast("string"), some))
    ab, ba = (F.array(*(F.lit(x) for x in s)) for s in ("ab", "ba"))
    assert one(spark, fp.annotations_fp(F.lit(None).cast("string"), ab)) == one(spark, fp.annotations_fp(F.lit(None).cast("string"), ba))


def test_canonical_json():
    assert fp.canonical_json({"b": 1.0, "a": "é"}) == '{"a":"\\u00e9","b":1.0}'
    for bad in ({1: 2}, {"a": [{2: 3}]}):
        with pytest.raises(TypeError):
            fp.canonical_json(bad)
    with pytest.raises(ValueError):
        fp.canonical_json(float("nan"))


def test_node_sets_and_weights(spark):
    cases = [(None, True), ([], True), (["a", "b"], True), (["a", "a"], False), ([" "], False), (["a\0"], False), ([None], False)]
    rows = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(cases)], "i int, n array<string>").select("i", fp.valid_node_set(F.col("n")).alias("ok")).collect()
    assert {r.i: r.ok for r in rows} == {i: ok for i, (_, ok) in enumerate(cases)}
    assert one(spark, fp.normal_weight(F.lit(float("inf")))) is None and one(spark, fp.normal_weight(F.lit(3))) == 3.0
    assert -(1 << 63) <= fp.advisory_key("scope") < 1 << 63
