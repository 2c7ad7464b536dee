import enum

import pytest
from pyspark.sql import functions as F

from tidemark.functions import modelargs as ma

KINDS = {"temperature": "generation", "topP": "generation", "maxTokens": "generation", "extraBody": "nested", "custom": "nested", "api-key": "excluded", "clientSecret": "excluded",
         "HTTPProxy": "excluded", "log_level_x": "excluded", "requestTimeout": "excluded", "weirdKey": "refused", "myToken": "refused", "n": "generation", "N": "generation"}


def test_kinds_in_both_forms(spark):
    rows = spark.createDataFrame([(k,) for k in KINDS], "k string").select("k", ma.kind_column(F.col("k")).alias("kind")).collect()
    assert {r.k: r.kind for r in rows} == KINDS
    for name, kind in KINDS.items():
        if kind == "refused":
            with pytest.raises(ValueError):
                ma.kind(name)
        else:
            assert ma.kind(name) == kind


class Level(enum.Enum):
    HIGH = "high"


def test_canonical_form():
    args = {"temperature": 0.5, "api_key": "s", "extra_body": {"headers": {"a": 1}, "mode": Level.HIGH, "list": [{"timeout": 1}, {"x": 2}]}, "opts": {"api_key": "s"}, "tools": [{"url": "https://a"}]}
    assert ma.canonical(args) == {"temperature": 0.5, "extra_body": {"mode": "high", "list": [{"x": 2}]}, "tools": [{"url": "https://a"}]}
    assert ma.canonical(None) == ma.canonical({}) == ma.canonical({"api_key": "x"}) == {}
    assert ma.canonical({"custom": {}}) == {"custom": {}}
    for bad, error in (({"custom": "https://host"}, ValueError), ({"custom": float("inf")}, ValueError), ({1: 2}, TypeError), ([], TypeError), ({"custom": object()}, TypeError)):
        with pytest.raises(error):
            ma.canonical(bad)
