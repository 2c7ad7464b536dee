"""Reports as files: inventories as JSON lines with a summary, measurements as JSON and Markdown with their environment."""

from __future__ import annotations

import json
import os
import platform
import subprocess
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import paths


def inventory(files: DataFrame) -> DataFrame:
    """(path, size) with category and module."""
    return files.select("path", "size", paths.category(F.col("path")).alias("category"), paths.module(F.col("path")).alias("module"))


def write_inventory(files: DataFrame, target: str) -> str:
    """JSON lines in target/inventory and target/summary.md; the summary, which has one line a category."""
    found = inventory(files)
    found.write.mode("overwrite").json(f"{target}/inventory")
    spark = files.sparkSession
    read = spark.read.schema(found.schema).json(f"{target}/inventory")
    lines = [f"| {r.category} | {r.n_files} | {r.total_size} |" for r in paths.rollup(read, "category").orderBy(F.desc("n_files"), "category").collect()]
    text = "\n".join(["| category | files | bytes |", "| --- | --- | --- |", *lines, ""])
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{target}/summary.md")
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return text


def environment(folder: str = ".") -> dict[str, object]:
    """Versions, processors and the state of the code."""

    def git(*args: str) -> str | None:
        done = subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=False)
        return done.stdout.strip() if done.returncode == 0 else None

    changed = git("status", "--porcelain")
    return {"python": platform.python_version(), "spark": pyspark.__version__, "system": platform.system(), "machine": platform.machine(), "cpus": os.cpu_count(), "commit": git("rev-parse", "HEAD"), "clean": None if changed is None else not changed}


def write_measurements(seconds: dict[str, float], work: dict[str, object], target: str, code: str = ".") -> str:
    """target.json and target.md, on the driver's own file system; the Markdown text."""
    about = environment(code)
    Path(f"{target}.json").write_text(json.dumps({"environment": about, "seconds": seconds, "work": work}, indent=1, sort_keys=True) + "\n", encoding="utf-8")
    rows = [f"| {name} | {value} |" for name, value in seconds.items()]
    text = "\n".join([*(f"- {k}: {v}" for k, v in about.items()), "", "| measured | seconds |", "| --- | --- |", *rows, ""])
    Path(f"{target}.md").write_text(text, encoding="utf-8")
    return text


def corpus(spark: SparkSession, n: int, version: int = 1, changed: int = 0) -> DataFrame:
    """n documents (external_key, content), always the same; the first `changed` name another thing."""
    name = F.when(F.col("id") < changed, F.format_string("Substitute%05d", "id")).otherwise(F.format_string("Subject%05d", "id"))
    text = F.concat(F.lit("Report "), F.col("id").cast("string"), F.lit(", edition "), F.when(F.col("id") < changed, F.lit(version)).otherwise(F.lit(1)).cast("string"), F.lit(": "), name, F.lit(" and CommonSubject."))
    return spark.range(n).select(F.format_string("report-%05d.md", "id").alias("external_key"), text.alias("content"))
