"""Documents from folders and ledgers."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


GLOB = "*.{md,txt}"


def resolved(root: str) -> str:
    """A local root without `..` and symbolic links; another one as it is."""
    if root.startswith("file:"):
        return os.path.realpath("/" + root[5:].lstrip("/"))
    return root if re.match(r"[a-z0-9]+:", root) else os.path.realpath(root)


def folder(spark: SparkSession, root: str, glob: str = GLOB) -> DataFrame:
    """external_key (the path below root, with slashes) and content of every matching file below root."""
    root = resolved(root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.select(document_key(F.col("path"), root).alias("external_key"), F.decode("content", "UTF-8").alias("content"))


def document_key(path: Column, root: str) -> Column:
    """A file's path relative to root, without scheme."""
    plain = F.regexp_replace(path, r"^[a-z0-9]+:(//[^/]*)?", "")
    top = root.split(":", 1)[-1] if "://" in root else root
    top = "/" + top.strip("/") + "/"
    return F.when(F.startswith(plain, F.lit(top)), F.substring(plain, F.lit(len(top) + 1), F.length(plain))).otherwise(plain)


def ledger(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    schema = schema or spark.read.json(path).schema.simpleString()
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")
