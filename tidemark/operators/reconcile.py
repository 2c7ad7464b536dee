"""Reconciliation: desired documents against everything that may be stored, one operation for each key.

`desired`: external_key, content, label, external_metadata, node_set, importance_weight.
`tracking`: external_key, possible (array of records, all that may be stored), has_delete_marker,
may_be_missing. Nothing here runs a Spark action: planning has no side effects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fingerprints as fp
from tidemark.functions.identity import RECORD_VERSION, document_id

FIELDS = ("data_id", "content_fp", "annotations_fp", "metadata_fp", "processing_fp", "weight_fp")
RECORD = "struct<" + ", ".join(f"{f}:string" for f in FIELDS) + ", schema_version:int>"
#: Fields whose change makes derivatives stale.
DERIVING = ("data_id", "content_fp", "annotations_fp", "processing_fp", "schema_version")


def record(data_id: Column, processing_fp: Column | str) -> Column:
    """The tracking record of a desired document (content or content_bytes, label, external_metadata, node_set, importance_weight); every field is non-null."""
    processing = processing_fp if isinstance(processing_fp, Column) else F.lit(processing_fp)
    values = (
        data_id,
        fp.stored_fp(F.col("content"), F.col("content_bytes")),
        fp.annotations_fp(F.col("external_metadata"), F.col("node_set")),
        fp.optional_fp(F.col("label")),
        processing,
        fp.optional_fp(F.col("importance_weight")),
    )
    return F.struct(*(v.alias(f) for v, f in zip(values, FIELDS, strict=True)), F.lit(RECORD_VERSION).alias("schema_version"))


def declared(docs: DataFrame, runtime_key: str, scope: str, tenant: str, dataset: str, processing_fp: Column | str) -> DataFrame:
    """Desired rows: the key, which has to be normal, the id and the record; content is left out, fingerprints stand for it."""
    rows = docs.withColumn("data_id", document_id(runtime_key, scope, tenant, dataset, F.col("external_key")))
    return rows.select("external_key", "data_id", record(F.col("data_id"), processing_fp).alias("desired"))


def differs(desired: Column, possible: Column, missing: Column) -> Column:
    """insert, upsert, replace or delete: how the desired record differs from the possible ones; null if it does not.

    Absent, and nothing known, but perhaps stored: null here; the operation is a delete all the same.
    """
    some = F.size(possible) > 0
    other = F.exists(possible, lambda p: p != desired)
    return (
        F.when(desired.isNull(), F.when(some, "delete"))
        .when(~some, F.when(missing, "insert"))
        .when(other, "replace")
        .when(missing, "upsert")
    )


def weight_differs(desired: Column, possible: Column) -> Column:
    return F.exists(possible, lambda p: p["weight_fp"] != desired["weight_fp"])


def derivatives_safe(desired: Column, possible: Column, missing: Column) -> Column:
    """Whether what was derived from every possible record is right for the desired one."""

    def agrees(p: Column) -> Column:
        out = p[DERIVING[0]] == desired[DERIVING[0]]
        for f in DERIVING[1:]:
            out &= p[f] == desired[f]
        return out

    return ~missing & F.forall(possible, agrees)


def stale_ids(data_id: Column, possible: Column) -> Column:
    """Recorded ids other than the derived one, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(possible, lambda p: p["data_id"]), lambda x: x != data_id)))


def unchanged(desired: Column, possible: Column, missing: Column) -> Column:
    """Nothing to do: every possible record is the desired one and it is surely there."""
    return ~missing & (F.size(possible) > 0) & ~F.exists(possible, lambda p: p != desired)


def operation(desired: Column, possible: Column, missing: Column) -> Column:
    """delete, upsert, replace, recreate, update_metadata or null."""
    diff = differs(desired, possible, missing)
    some = F.size(possible) > 0
    return (
        F.when(desired.isNull(), F.when(some | missing, "delete"))
        .when(diff.isNull(), F.lit(None).cast("string"))
        .when(some & weight_differs(desired, possible), "recreate")
        .when(diff.isin("insert", "upsert"), F.when(missing & some, "replace").otherwise("upsert"))
        .when(derivatives_safe(desired, possible, missing), "update_metadata")
        .otherwise("replace")
    )


def reconcile(desired: DataFrame, tracking: DataFrame, dataset_id: tuple[str, str, str, str]) -> DataFrame:
    """(external_key, data_id, desired, possible, may_be_missing, diff, op, stale_ids) of every key of either side.

    desired: from declared(); dataset_id: (runtime_key, scope, tenant, dataset), for the ids of keys that are
    no longer declared. A key without tracking may be stored by a run that was lost: missing is assumed; so
    is after a delete that was intended.
    """
    both = desired.join(tracking, "external_key", "full_outer")
    possible = F.coalesce("possible", F.array().cast(f"array<{RECORD}>"))
    missing = F.coalesce("may_be_missing", F.lit(True)) | F.coalesce("has_delete_marker", F.lit(False))
    both = both.select("external_key", F.coalesce("data_id", document_id(*dataset_id, F.col("external_key"))).alias("data_id"), "desired", possible.alias("possible"), missing.alias("may_be_missing"))
    d, p, m = F.col("desired"), F.col("possible"), F.col("may_be_missing")
    return both.select("*", differs(d, p, m).alias("diff"), operation(d, p, m).alias("op"), stale_ids(F.col("data_id"), p).alias("stale_ids"))


def dataset_transition(desired: str | None, desired_manager: str | None, previous: list[tuple[str, str]], missing: bool) -> dict:
    """What a change of one dataset's configuration asks for.

    desired: the processing fingerprint, None if no longer declared; managers are `system` or `user`;
    previous: possible (fingerprint, manager). action: delete, insert, upsert, replace or None; lossy: whether
    all children may be missing.
    """
    if desired is None:
        owned = bool(previous) and all(manager == "system" for _, manager in previous)
        return {"action": "delete" if owned else None, "lossy": False}
    if desired_manager == "user":
        return {"action": None, "lossy": False}
    if not previous:
        return {"action": "insert" if missing else None, "lossy": False}
    if any(p != (desired, "system") for p in previous):
        return {"action": "replace", "lossy": True}
    return {"action": "upsert" if missing else None, "lossy": False}


def precommit(tracking: DataFrame, actions: DataFrame) -> DataFrame:
    """Tracking with every intended record added to the possible ones, or a delete marker; nothing is overwritten."""
    intent = actions.where("op is not null").select("external_key", F.col("desired").alias("next"), (F.col("op") == "delete").alias("deletes"))
    both = tracking.join(intent, "external_key", "full_outer")
    possible = F.coalesce("possible", F.array().cast(f"array<{RECORD}>"))
    grown = F.when(F.col("next").isNotNull(), F.array_distinct(F.concat(possible, F.array("next")))).otherwise(possible)
    return both.select(
        "external_key",
        grown.alias("possible"),
        (F.coalesce("has_delete_marker", F.lit(False)) | F.coalesce("deletes", F.lit(False))).alias("has_delete_marker"),
        F.coalesce("may_be_missing", F.lit(True)).alias("may_be_missing"),
    )


def commit(tracking: DataFrame, actions: DataFrame) -> DataFrame:
    """Tracking after the writes: one confirmed record for each desired key acted on, none for a deleted one."""
    done = actions.where("op is not null").select("external_key", F.col("desired").alias("next"), F.lit(True).alias("acted"))
    both = tracking.join(done, "external_key", "full_outer").where("acted is null or next is not null")
    acted = F.col("acted").isNotNull()
    return both.select(
        "external_key",
        F.when(acted, F.array("next")).otherwise(F.col("possible")).alias("possible"),
        F.when(acted, F.lit(False)).otherwise(F.col("has_delete_marker")).alias("has_delete_marker"),
        F.when(acted, F.lit(False)).otherwise(F.col("may_be_missing")).alias("may_be_missing"),
    )


def invalidate_lossy(tracking: DataFrame) -> DataFrame:
    return tracking.withColumn("may_be_missing", F.lit(True))


def possible_records(log: DataFrame) -> DataFrame:
    """Tracking from a log of intents (external_key, record or null for a delete, may_be_missing)."""
    return log.groupBy("external_key").agg(
        F.array_sort(F.collect_set("record")).alias("possible"),
        F.bool_or(F.col("record").isNull()).alias("has_delete_marker"),
        F.bool_or("may_be_missing").alias("may_be_missing"),
    )
