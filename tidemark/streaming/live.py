"""Continuous synchronisation: a stream of changes, one reconciliation a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.functions.identity import normalize_key
from tidemark.operators.state import last_action
from tidemark.plans.config import Dataset, Processing, Profile
from tidemark.sources import files

CHANGES = "seq long, external_key string, deleted boolean, content string, label string, external_metadata string, node_set array<string>, importance_weight double"


def follow(engine: Engine, dataset: Dataset, changes: DataFrame, checkpoint: str, profile: Profile | None = None, processing: Processing | None = None, trigger: dict | None = None, remember: int | None = None):
    """Starts the query. changes: a stream of CHANGES; within a key the highest seq wins, of equal ones always the same.

    Keys are compared in normal form; changes without a valid key are left out. The declared set is a
    versioned table; a batch reads and writes the rows of its own keys only, and only these are reconciled.
    A batch that is delivered again changes nothing: the same rows win, and a sync of what is stored already
    does nothing. remember: a deletion is forgotten when its seq is so far behind the highest of a batch; by
    default never, so that a change that comes late can't bring a document back.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        store = engine.store(dataset)
        batch = batch.select(*(f.split()[0] for f in CHANGES.split(", "))).withColumn("external_key", normalize_key(F.col("external_key"))).where("external_key is not null")
        batch = batch.persist()
        keys = batch.select("external_key").distinct()
        declared = store.read("declared", CHANGES)
        touched = declared.join(keys, "external_key", "left_semi").select(*batch.columns)
        latest = last_action(touched.unionByName(batch), "external_key", "seq")
        forgotten = keys
        if remember is not None:
            newest = batch.agg(F.max("seq")).first()[0] or 0
            old = declared.where(F.col("deleted") & (F.col("seq") < newest - remember)).select("external_key").join(keys, "external_key", "left_anti")
            forgotten = keys.unionByName(old)
        store.change("declared", CHANGES, "external_key", forgotten, latest)
        now = store.read("declared", CHANGES).join(keys, "external_key", "left_semi")
        engine.sync(dataset, now.where(~F.coalesce(F.col("deleted"), F.lit(False))), profile, processing, keys)
        batch.unpersist()

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def folder_changes(engine: Engine, dataset: Dataset, found: DataFrame, seq: int) -> DataFrame:
    """CHANGES that make the declared set equal to the files found now: new and edited ones, and deletions of those that are gone. found: external_key, content, and what else is declared."""
    names = [f.split()[0] for f in CHANGES.split(", ")]
    types = dict(f.split(" ", 1) for f in CHANGES.split(", "))
    now = found.withColumns({"seq": F.lit(seq), "deleted": F.lit(False)})
    now = now.select(*((F.col(n) if n in now.columns else F.lit(None)).cast(types[n]).alias(n) for n in names)).withColumn("external_key", normalize_key(F.col("external_key")))
    known = engine.store(dataset).read("declared", CHANGES).where(~F.coalesce(F.col("deleted"), F.lit(False)))
    compared = [n for n in names if n not in ("seq", "deleted")]
    edited = now.join(known.select(*compared), [now[n].eqNullSafe(known[n]) for n in compared], "left_anti")
    gone = known.join(now, "external_key", "left_anti").select(*(F.lit(seq).cast("long").alias(n) if n == "seq" else F.lit(True).alias(n) if n == "deleted" else F.col(n) if n == "external_key" else F.lit(None).cast(types[n]).alias(n) for n in names))
    return edited.unionByName(gone)


def watch(engine: Engine, dataset: Dataset, folder: str, seq: int, profile: Profile | None = None, processing: Processing | None = None, glob: str = files.GLOB) -> dict[str, int]:
    """One look at a folder: edits, new files and deletions since the last look are applied. Called again and again with a rising seq it follows the folder; counts of the operations done."""
    store = engine.store(dataset)
    changes = folder_changes(engine, dataset, files.folder(engine.spark, folder, glob), seq).persist()
    keys = changes.select("external_key")
    if keys.isEmpty():
        return {}
    store.change("declared", CHANGES, "external_key", keys, changes)
    now = store.read("declared", CHANGES).join(keys, "external_key", "left_semi").where("not deleted")
    done = engine.sync(dataset, now, profile, processing, keys)
    changes.unpersist()
    return done
