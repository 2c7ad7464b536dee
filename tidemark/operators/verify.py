"""Drift as a query: what is expected against what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MISSING = "expected document is not stored"
UNEXPECTED = "stored document is not expected: foreign data, or left by an interrupted run"
INCOMPLETE = "derivation has not completed for this document"


def issues(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """(kind, data_id, external_key, detail), no row if all is well.

    expected: data_id, external_key, label; stored: data_id, label, complete. A matched document can have two issues.
    """
    e = expected.select("data_id", "external_key", F.col("label").alias("e_label"), F.lit(True).alias("e__"))
    s = stored.select("data_id", F.col("label").alias("s_label"), "complete", F.lit(True).alias("s__"))
    both = e.join(s, "data_id", "full_outer")
    here, there = F.col("e__").isNotNull(), F.col("s__").isNotNull()
    drift = F.format_string("label drifted: expected %s, stored %s", F.coalesce("e_label", F.lit("none")), F.coalesce("s_label", F.lit("none")))

    def issue(kind: str, detail):
        return F.struct(F.lit(kind).alias("kind"), (detail if not isinstance(detail, str) else F.lit(detail)).alias("detail"))

    found = F.array(
        F.when(here & ~there, issue("missing", MISSING)),
        F.when(~here & there, issue("unexpected", UNEXPECTED)),
        F.when(here & there & ~F.col("complete"), issue("incomplete", INCOMPLETE)),
        F.when(here & there & ~F.col("e_label").eqNullSafe(F.col("s_label")), issue("label_mismatch", drift)),
    )
    return both.select("data_id", "external_key", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("i.kind", "data_id", "external_key", "i.detail")


def refuse_duplicates(rows: DataFrame, key: str, what: str) -> None:
    if not rows.groupBy(key).count().where("count > 1").isEmpty():
        raise RuntimeError(f"{what} has duplicate {key} values")


def report(expected: DataFrame, stored: DataFrame, render: int = 1000) -> dict:
    """Counts and the first issues by id; ok means none."""
    refuse_duplicates(expected, "data_id", "the expectation")
    refuse_duplicates(stored, "data_id", "the store")
    found = issues(expected, stored)
    total = found.count()
    first = [r.asDict() for r in found.orderBy("data_id", "kind").limit(render).collect()]
    return {"checked": expected.count(), "issues": total, "ok": total == 0, "first": first}
