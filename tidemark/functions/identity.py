"""Stable document identities: netstring names, NFC keys, version-5 UUIDs, scopes and their validation.

Everything but NFC of non-ASCII keys is a built-in expression and stays in generated code.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The name space and version that the identities of documents are derived from.
NAMESPACE = "427dd96a-c6b7-5e1b-b82f-a0fbc923770f"
IDENTITY_VERSION = 2
RECORD_VERSION = 2
RUNTIME_KEY = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,127}$"
USER_SCOPE = "user-tenant-v1"
LOCK_SCOPE = "tidemark"


def _col(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def netstring(*parts: Column | str) -> Column:
    """Injective concatenation: each part with its length in characters before it."""
    if not parts:
        return F.lit("")
    return F.concat(*(F.concat(F.length(_col(p)).cast("string"), F.lit(":"), _col(p)) for p in parts))


@F.pandas_udf(StringType())
def _nfc(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: None if k is None else unicodedata.normalize("NFC", k))


def normalize_key(key: Column) -> Column:
    """NFC; null for keys that are not valid (null, empty, with NUL). All rows pass a Python operator, in which only non-ASCII keys have a value; where all keys are ASCII, `valid_key` does the same in the JVM."""
    return valid_key(F.coalesce(_nfc(F.when(~is_ascii(key), key)), key))


def is_ascii(key: Column) -> Column:
    return key.rlike(r"\A[\x00-\x7F]*\z")


def valid_key(key: Column) -> Column:
    """The key, null if it is not valid."""
    return F.when(key.isNotNull() & (key != "") & ~key.contains("\0"), key)


def uuid5(namespace: str, name: Column) -> Column:
    """Version-5 UUID of a name, lower case."""
    d = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(d, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 1, F.lit(1))
    return F.concat(F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-5"), F.substring(d, 14, 3), F.lit("-"), variant, F.substring(d, 18, 3), F.lit("-"), F.substring(d, 21, 12))


def document_id(runtime_key: Column | str, scope: Column | str, tenant: Column | str, dataset: Column | str, key: Column, version: int = IDENTITY_VERSION, namespace: str = NAMESPACE) -> Column:
    """The content-independent id of a document. The key has to be normal already (normalize_key)."""
    return uuid5(namespace, netstring(str(version), runtime_key, scope, tenant, dataset, key))


def identity_scope(user: Column | str, tenant: Column) -> Column:
    return netstring(USER_SCOPE, user, F.coalesce(tenant, F.lit("none")))


def lock_scope(scope: Column | str, tenant: Column | str, name: Column | str) -> Column:
    return netstring(LOCK_SCOPE, scope, tenant, name)


def valid_runtime_key(key: Column) -> Column:
    return F.coalesce(key.rlike(RUNTIME_KEY) & ~key.contains("\n"), F.lit(False))


def valid_coordinate(value: Column) -> Column:
    return F.coalesce((value != "") & ~value.contains("\0"), F.lit(False))


def require_coordinate(value: object, what: str) -> str:
    """Driver-side check of a tenant, dataset name or scope; the value itself is never in the message."""
    if not isinstance(value, str):
        raise TypeError(f"{what} must be a string")
    if not value or "\0" in value:
        raise ValueError(f"{what} must be a non-empty string without NUL")
    return value


def require_runtime_key(value: object) -> str:
    if not isinstance(value, str):
        raise TypeError("the runtime key must be a string")
    if not re.fullmatch(RUNTIME_KEY[1:-1], value):
        raise ValueError("the runtime key must be 1 to 128 characters of A-Z a-z 0-9 . _ - and begin with a letter or digit")
    return value
