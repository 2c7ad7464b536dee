"""Checks of an installation: all problems are gathered, none stops the others."""

from __future__ import annotations

import sys

import pyarrow
import pyspark
from pyspark.sql import SparkSession


def check(spark: SparkSession, root: str, width: int | None = None, vectors=None) -> list[dict]:
    """Findings (severity, check, detail), severity `ok`, `warning` or `critical`."""
    found: list[dict] = []

    def add(severity: str, name: str, detail: str) -> None:
        found.append({"severity": severity, "check": name, "detail": detail})

    add("ok" if pyspark.__version__.split(".")[0] >= "4" else "critical", "spark", pyspark.__version__)
    add("ok" if sys.version_info >= (3, 10) else "critical", "python", sys.version.split()[0])
    add("ok", "arrow", pyarrow.__version__)
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        add("ok" if fs.exists(path) or fs.mkdirs(path) else "critical", "state folder", "can be written")
    except Exception as e:  # noqa: BLE001  a finding, not a failure
        add("critical", "state folder", type(e).__name__)
    add("ok" if spark.conf.get("spark.sql.session.timeZone") == "UTC" else "warning", "time zone", spark.conf.get("spark.sql.session.timeZone"))
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        add("warning", "checkpoints", "spark.checkpoint.dir is not set")
    if vectors is not None and width is not None:
        wrong = vectors.where(f"size(embedding) <> {int(width)}").limit(1).count()
        add("critical" if wrong else "ok", "vector width", f"expected {width}")
    return found


def healthy(findings: list[dict]) -> bool:
    return all(f["severity"] != "critical" for f in findings)
