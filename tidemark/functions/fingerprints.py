"""Fingerprints of content, annotations, labels and weights.

Two families that must not be mixed in one tracking table: `native` (SHA-256, generated code) and `exact`
(BLAKE2b-128, canonical JSON), which gives the digests that other tools of this kind write, through
Arrow-batched Python.
"""

from __future__ import annotations

import hashlib
import json
import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemark.functions.identity import netstring


def content_fp(content: Column, binary: bool = False) -> Column:
    """Of text or bytes; the same bytes as text and as binary differ."""
    return F.sha2(F.concat(F.unhex(F.lit("6200" if binary else "7300")), content if binary else F.encode(content, "UTF-8")), 256)


def stored_fp(content: Column, content_bytes: Column) -> Column:
    """Of a document that is either text or, where there are bytes, these."""
    return F.when(content_bytes.isNotNull(), content_fp(content_bytes, binary=True)).otherwise(content_fp(content))


def optional_fp(value: Column) -> Column:
    """Of a nullable scalar; null differs from every value."""
    return F.sha2(F.coalesce(F.concat(F.lit("v"), value.cast("string")), F.lit("n")), 256)


def annotations_fp(metadata: Column, node_set: Column) -> Column:
    """Of external metadata (canonical JSON text) and the node set, whose order does not matter; null sets differ from empty ones."""
    nodes = F.coalesce(F.concat(F.lit("s"), F.array_join(F.transform(F.array_sort(node_set), lambda n: netstring(n)), "")), F.lit("n"))
    return F.sha2(netstring(F.coalesce(F.concat(F.lit("v"), metadata), F.lit("n")), nodes), 256)


def blake2b(data: bytes, size: int = 16) -> str:
    return hashlib.blake2b(data, digest_size=size).hexdigest()


def exact_content(value: str | bytes) -> str:
    if isinstance(value, str):
        return blake2b(b"s\0" + value.encode())
    if isinstance(value, bytes):
        return blake2b(b"b\0" + value)
    raise TypeError("content must be text or bytes")


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces, ASCII; only string keys, no NaN or infinity."""

    def check(x: object) -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                if not isinstance(k, str):
                    raise TypeError("keys of JSON objects must be strings")
                check(v)
        elif isinstance(x, (list, tuple)):
            for v in x:
                check(v)

    check(value)
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def exact_json(value: object) -> str:
    return blake2b(canonical_json(value).encode())


@F.pandas_udf(StringType())
def exact_content_fp(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else exact_content(t))


@F.pandas_udf(StringType())
def canonical_json_text(texts: pd.Series) -> pd.Series:
    """JSON text in canonical form; null for null. Numbers keep their kind (1.0 stays 1.0)."""
    return texts.map(lambda t: None if t is None else canonical_json(json.loads(t)))


@F.pandas_udf(StringType())
def exact_json_fp(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else exact_json(json.loads(t)))


@F.pandas_udf(StringType())
def canonical_object_text(texts: pd.Series) -> pd.Series:
    """JSON objects in canonical form; what is none, or has NaN or infinity, is an error. Null for null."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        value = json.loads(t)
        if not isinstance(value, dict):
            raise TypeError("external metadata must be a JSON object")
        return canonical_json(value)

    return texts.map(one)


def advisory_key(scope: str) -> int:
    """A signed 64-bit lock number of a scope."""
    return int.from_bytes(hashlib.blake2b(scope.encode(), digest_size=8).digest(), "big", signed=True)


def valid_node_set(nodes: Column) -> Column:
    """Null, or unique names that are not blank and hold no NUL."""
    names = F.forall(nodes, lambda n: F.coalesce(n.rlike(r"(?U)\S") & ~n.contains("\0"), F.lit(False)))
    return nodes.isNull() | (names & (F.size(F.array_distinct(nodes)) == F.size(nodes)))


def normal_weight(weight: Column) -> Column:
    """As double, null if not finite."""
    w = weight.cast("double")
    return F.when(~F.isnan(w) & (F.abs(w) < math.inf), w)


def token_ceiling(configured: Column, registered: Column) -> Column:
    """The lesser of two limits, either of which may be unknown."""
    return F.least(configured, registered)
