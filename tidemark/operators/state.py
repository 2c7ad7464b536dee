"""State changes as pure functions of DataFrames: the batch plan, upsert, purge, delete, derivation gate.

raw: dataset_id, data_id, content, content_bytes (of documents that are no text), label, external_metadata, node_set, importance_weight, complete.
derivatives: data_id, content_fp, profile_fp.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.fingerprints import stored_fp

PAYLOAD = ("content", "content_bytes", "label", "external_metadata", "node_set", "importance_weight")
DERIVING_OPS = ("upsert", "replace", "recreate")
ADDING_OPS = (*DERIVING_OPS, "update_metadata")


def last_action(actions: DataFrame, key: str = "data_id", order: str = "seq") -> DataFrame:
    """The last action of each id in a batch; of equal last ones the one with the greatest hash, so that it is always the same."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc(F.xxhash64(*actions.columns)))
    return actions.withColumn("n__", F.row_number().over(w)).where("n__ = 1").drop("n__")


def batch_plan(actions: DataFrame) -> DataFrame:
    """(phase, data_id), phases `delete`, `purge`, `add`, run in this order.

    Deletes are deleted and stale ids without those that are added again, and all that are recreated; only
    replaced documents are purged: new ones have nothing to purge, recreated ones are gone already.
    """
    added = actions.where(F.col("op").isin(*ADDING_OPS)).select("data_id").distinct()
    recreated = actions.where("op = 'recreate'").select("data_id")
    gone = actions.where("op = 'delete'").select("data_id").unionByName(actions.select(F.explode("stale_ids").alias("data_id")))
    deletes = gone.join(added, "data_id", "left_anti").unionByName(recreated).distinct()
    purges = actions.where("op = 'replace'").select("data_id").distinct().join(recreated, "data_id", "left_anti")
    return (
        deletes.select(F.lit("delete").alias("phase"), "data_id")
        .unionByName(purges.select(F.lit("purge").alias("phase"), "data_id"))
        .unionByName(added.select(F.lit("add").alias("phase"), "data_id"))
    )


def batch_counters(actions: DataFrame) -> DataFrame:
    ops = ("delete", "recreate", "replace", "update_metadata", "upsert")
    return actions.agg(*(F.count_if(F.col("op") == o).alias(f"n_{o}") for o in ops), F.coalesce(F.bool_or(F.col("op").isin(*DERIVING_OPS)), F.lit(False)).alias("derives"))


def upsert(raw: DataFrame, payload: DataFrame) -> DataFrame:
    """raw after adding payload rows (dataset_id, data_id and the declared fields).

    An existing row keeps its importance weight; it becomes incomplete only if its content changed.
    """
    new = payload.select(F.lit(True).alias("new__"), F.col("dataset_id").alias("dataset__"), F.col("data_id"), *(F.col(c).alias(f"{c}__") for c in PAYLOAD))
    both = raw.withColumn("old__", F.lit(True)).join(new, "data_id", "full_outer")
    is_new, is_old = F.col("new__").isNotNull(), F.col("old__").isNotNull()
    changed = stored_fp(F.col("content"), F.col("content_bytes")) != stored_fp(F.col("content__"), F.col("content_bytes__"))
    fields = [F.when(is_new, F.col(f"{c}__")).otherwise(F.col(c)).alias(c) for c in PAYLOAD if c != "importance_weight"]
    weight = F.when(is_old, F.col("importance_weight")).otherwise(F.col("importance_weight__")).alias("importance_weight")
    complete = F.when(~is_old | (is_new & changed), False).otherwise(F.col("complete")).alias("complete")
    return both.select(F.coalesce("dataset_id", "dataset__").alias("dataset_id"), "data_id", *fields, weight, complete)


def delete(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (raw or derivatives) without those ids; ids that are not there are no error."""
    return rows.join(ids.select("data_id").distinct(), "data_id", "left_anti")


def purge_raw(raw: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows stay, but count as incomplete."""
    hit = ids.select("data_id").distinct().withColumn("hit__", F.lit(True))
    return raw.join(hit, "data_id", "left").withColumn("complete", F.col("complete") & F.col("hit__").isNull()).drop("hit__")


def incomplete(raw: DataFrame) -> DataFrame:
    """What derivation works on: completion alone decides, not the configuration."""
    return raw.where(~F.col("complete"))


def derive(raw: DataFrame, derivatives: DataFrame, profile_fp: Column | str) -> tuple[DataFrame, DataFrame]:
    """(raw, derivatives) after deriving all incomplete rows; older derivatives stay: nothing is purged here."""
    profile = profile_fp if isinstance(profile_fp, Column) else F.lit(profile_fp)
    made = incomplete(raw).select("data_id", stored_fp(F.col("content"), F.col("content_bytes")).alias("content_fp"), profile.alias("profile_fp"))
    return raw.withColumn("complete", F.lit(True)), derivatives.unionByName(made).distinct()


def unconverged(raw: DataFrame, derivatives: DataFrame, profile_fp: str | None = None) -> DataFrame:
    """Ids whose derivatives are absent, stale or of another profile."""
    have = derivatives.groupBy("data_id").agg(F.collect_set("content_fp").alias("fps"), F.collect_set("profile_fp").alias("profiles"))
    rows = raw.select("data_id", "complete", stored_fp(F.col("content"), F.col("content_bytes")).alias("own")).join(have, "data_id", "left")
    right = F.col("complete") & (F.size("fps") == 1) & F.array_contains("fps", F.col("own"))
    if profile_fp is not None:
        right &= F.array_contains("profiles", profile_fp)
    return rows.where(~F.coalesce(right, F.lit(False))).select("data_id")


def has_stale_derivatives(raw: DataFrame, derivatives: DataFrame) -> DataFrame:
    """Ids with a derivative of a content other than their own."""
    own = raw.select("data_id", stored_fp(F.col("content"), F.col("content_bytes")).alias("own"))
    return derivatives.join(own, "data_id").where("content_fp <> own").select("data_id").distinct()


def payload_groups(payload: DataFrame) -> DataFrame:
    """Payloads by the parameters of one store call."""
    return payload.groupBy("node_set", "importance_weight").agg(F.count("*").alias("n"))


def resolved(datasets: DataFrame, asked: DataFrame) -> DataFrame:
    """(name, owner, tenant, dataset_id, n): for each dataset asked for (name, owner, tenant) its id, null if there is none, and how many there are."""
    known = datasets.select(F.col("name").alias("n_"), F.col("owner").alias("o_"), F.col("tenant").alias("t_"), "dataset_id")
    found = asked.select("name", "owner", "tenant").join(known, F.expr("name = n_ and owner = o_ and tenant <=> t_"), "left")
    return found.groupBy("name", "owner", "tenant").agg(F.max("dataset_id").alias("dataset_id"), F.count("dataset_id").alias("n"))


def resolve_dataset(datasets: DataFrame, name: str, owner: str, tenant: str | None) -> str | None:
    """The id of the owner's dataset of that name, None if there is none; more than one is an error."""
    for what, value in (("name", name), ("owner", owner), ("tenant", tenant)):
        if not isinstance(value, str) and not (what == "tenant" and value is None):
            raise TypeError(f"the {what} must be a string")
    asked = datasets.sparkSession.createDataFrame([(name, owner, tenant)], "name string, owner string, tenant string")
    found = resolved(datasets, asked).first()
    if found.n > 1:
        raise RuntimeError("more than one dataset has this name, owner and tenant")
    return found.dataset_id


def list_documents(raw: DataFrame) -> DataFrame:
    return raw.select("data_id", "label", "external_metadata", "complete").orderBy("data_id")
