"""Synchronisation: the stored state of a dataset is made equal to the declared documents.

Phases: plan, log of intents, delete, purge, derive, add, commit. The log is written before anything else
changes and never forgets an earlier intent, so a run that stops anywhere is made good by the next one. The
dataset's lock covers all phases. Each table is written once, and only the rows of documents that an
operation touches: derivatives, names and edges before the rows that call them complete, then what is
tracked. Content is never in a message.

The dataset has a record of its own: what its documents were processed with and who manages it, with every
possible one logged before a change, as for documents. Another processing makes all that is tracked
uncertain, so all documents are derived anew; who manages it decides on what `teardown` does.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tidemark.functions import fingerprints as fp
from tidemark.functions.identity import IDENTITY_VERSION, RECORD_VERSION, document_id, is_ascii, lock_scope, netstring, normalize_key, uuid5, valid_key
from tidemark.locks import SHARED
from tidemark.operators import derive as dv
from tidemark.operators import reconcile as rc
from tidemark.operators import state, verify
from tidemark.plans.config import Dataset, Processing, Profile, processing_of
from tidemark.sources.store import VersionedStore

PHASES = ("plan", "precommit", "delete", "purge", "derive", "add", "commit")
#: Tables with rows of documents; hooks of these names are called when the table has been changed.
OF_DOCUMENTS = ("derivatives", "bridge", "edges", "raw")
DESIRED = "external_key string, content string, content_bytes binary, label string, external_metadata string, node_set array<string>, importance_weight double"
RAW = "dataset_id string, data_id string, content string, content_bytes binary, label string, external_metadata string, node_set array<string>, importance_weight double, complete boolean"
DERIVATIVES = "data_id string, content_fp string, profile_fp string"
BRIDGE = "artifact_id string, name string, data_id string"
EDGES = "source string, target string, relationship_name string, data_id string"
TRACKING = f"external_key string, possible array<{rc.RECORD}>, has_delete_marker boolean, may_be_missing boolean"
ACTIONS = f"external_key string, data_id string, desired {rc.RECORD}, op string, stale_ids array<string>"
CONFIGURATION = "processing_fp string, managed_by string"
OID = "6ba7b812-9dad-11d1-80b4-00c04fd430c8"
#: What a state folder was written with; another one is refused.
MANIFEST = {"identity": IDENTITY_VERSION, "record": RECORD_VERSION, "layout": 2}


class DriftError(RuntimeError):
    """The stored tables do not belong together, or not to this dataset."""


class Fault:
    """A hook that raises on the first `times` calls after `after` good ones."""

    def __init__(self, error: Exception, times: int = 1, after: int = 0):
        self.error, self.times, self.after, self.calls = error, times, after, 0

    def __call__(self) -> None:
        self.calls += 1
        if self.after < self.calls <= self.after + self.times:
            raise self.error


class Engine:
    """hooks: phase or table -> function, called when it is done (for fault tests). ops_log: (phase, number of ids) of every attempt.

    vacuum: versions that are not current are deleted when a sync ends; readers that began before then fail.
    """

    def __init__(self, spark: SparkSession, root: str, locks=None, hooks: dict[str, Callable[[], None]] | None = None, vacuum: bool = True):
        self.spark, self.root, self.vacuum = spark, root, vacuum
        self.locks = locks or SHARED
        self.hooks = hooks or {}
        self.ops_log: list[tuple[str, int]] = []

    def store(self, dataset: Dataset) -> VersionedStore:
        names = "/".join(f"{k}={v}" for k, v in (("runtime", dataset.runtime_key), ("scope", dataset.scope), ("tenant", dataset.tenant), ("dataset", dataset.name)))
        return VersionedStore(self.spark, f"{self.root}/{names}")

    def _lock(self, dataset: Dataset):
        scope = self.spark.range(1).select(lock_scope(dataset.scope, dataset.tenant, dataset.name)).first()[0]
        return self.locks.lock(scope)

    def _done(self, phase: str, n: int = 0) -> None:
        self.ops_log.append((phase, n))
        if phase in self.hooks:
            self.hooks[phase]()

    def _own(self, dataset: Dataset, store: VersionedStore) -> None:
        """The folder's manifest: written at first, compared from then on."""
        mine = MANIFEST | dict(zip(("runtime_key", "scope", "tenant", "name"), dataset.identity, strict=True))
        known = store.note("manifest")
        if known is None:
            if store.version("raw"):
                raise DriftError("the state folder holds documents, but no manifest")
            store.note("manifest", json.dumps(mine, sort_keys=True))
        elif json.loads(known) != mine:
            changed = sorted(k for k in mine if json.loads(known).get(k) != mine[k])
            raise DriftError(f"the state folder was written with another {', '.join(changed)}")

    def desired(self, docs: DataFrame) -> DataFrame:
        """Declared rows with all columns, keys and metadata in normal form.

        Refused before anything is written: keys that repeat or aren't valid, rows without content, node sets
        with blank, NUL-bearing or repeated names, weights that aren't finite, metadata that is no JSON object.
        """
        have = {c: F.col(c) for c in docs.columns}
        if "content" in have and isinstance(docs.schema["content"].dataType, BinaryType):
            have["content_bytes"], have["content"] = have["content"], F.lit(None)
        fields = [f.split(" ", 1) for f in DESIRED.split(", ")]
        rows = docs.select(*(have.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields))
        key, nodes, weight = F.col("external_key"), F.col("node_set"), F.col("importance_weight")
        found = rows.agg(
            F.count_if(valid_key(key).isNull() | F.col("content").isNull() & F.col("content_bytes").isNull()).alias("bad"),
            F.count_if(~fp.valid_node_set(nodes)).alias("nodes"),
            F.count_if(weight.isNotNull() & fp.normal_weight(weight).isNull()).alias("weights"),
            F.count_if(~is_ascii(key)).alias("odd"),
            F.count("external_metadata").alias("metadata"),
        ).first()
        if found.bad:
            raise ValueError(f"{found.bad} documents have no valid key or no content")
        if found.nodes:
            raise ValueError(f"{found.nodes} documents have a node set with blank or repeated names")
        if found.weights:
            raise ValueError(f"{found.weights} documents have an importance weight that is not finite")
        if found.odd:
            rows = rows.withColumn("external_key", normalize_key(key))
        if found.metadata:
            rows = rows.withColumn("external_metadata", fp.canonical_object_text(F.col("external_metadata")))
        verify.refuse_duplicates(rows, "external_key", "the declaration")
        return rows

    def plan(self, dataset: Dataset, docs: DataFrame, processing: Processing, keys: DataFrame | None = None) -> DataFrame:
        """The actions a sync would take; nothing is written and no action runs. docs: as from desired(); keys: only these are compared."""
        desired = rc.declared(docs, *dataset.identity, processing.fingerprint)
        tracking = self.store(dataset).read("tracking", TRACKING)
        if keys is not None:
            tracking = tracking.join(keys.select("external_key").distinct(), "external_key", "left_semi")
        return rc.reconcile(desired, tracking, dataset.identity).where("op is not null or size(stale_ids) > 0")

    def _configure(self, dataset: Dataset, store: VersionedStore, processing: Processing) -> dict:
        """Logs the configuration that is meant; for another processing all that is tracked becomes uncertain."""
        before = [(r.processing_fp, r.managed_by) for r in store.read("configuration", CONFIGURATION).collect()]  # a few
        turn = rc.dataset_transition(processing.fingerprint, dataset.managed_by, before, store.state("configuration") is None)
        now = (processing.fingerprint, dataset.managed_by)
        if now not in before:
            store.write("configuration", self.spark.createDataFrame([*before, now], CONFIGURATION))
        if turn["lossy"] and store.state("tracking"):
            store.write("tracking", rc.invalidate_lossy(store.read("tracking", TRACKING)))
        return turn | {"settled": before == [now]}

    def sync(self, dataset: Dataset, docs: DataFrame, profile: Profile | None = None, processing: Processing | None = None, keys: DataFrame | None = None) -> dict[str, int]:
        """Counts of the operations done. keys: documents with other keys are left as they are (docs: those of these keys)."""
        profile = profile or Profile()
        processing = processing or processing_of(profile)
        docs = self.desired(docs)
        with self._lock(dataset):
            store = self.store(dataset)
            self._own(dataset, store)
            if store.version("raw") and not store.version("tracking"):
                raise DriftError("documents are stored, but what was tracked of them is lost: tear the dataset down first")
            turn = self._configure(dataset, store, processing)
            # Written, so that later phases don't plan anew from tables they have changed.
            store.write("actions", self.plan(dataset, docs, processing, None if turn["lossy"] else keys).select("external_key", "data_id", "desired", "op", "stale_ids"))
            actions = store.read("actions", ACTIONS).where("op is not null")
            counts = {r.op: r["count"] for r in actions.groupBy("op").count().collect()}
            self._done("plan", sum(counts.values()))
            if counts:
                touched = actions.select("external_key")
                store.change("tracking", TRACKING, "external_key", touched, rc.precommit(store.read("tracking", TRACKING).join(touched, "external_key", "left_semi"), actions))
                self._done("precommit")
                self._apply(dataset, store, docs, actions, counts, profile, processing)
                store.change("tracking", TRACKING, "external_key", touched, rc.commit(store.read("tracking", TRACKING).join(touched, "external_key", "left_semi"), actions))
            if not turn["settled"]:
                store.write("configuration", self.spark.createDataFrame([(processing.fingerprint, dataset.managed_by)], CONFIGURATION))
            if counts:
                self._done("commit")
            if self.vacuum:
                for name in store.names():
                    store.vacuum(name)
            return counts

    def _apply(self, dataset: Dataset, store: VersionedStore, docs: DataFrame, actions: DataFrame, counts: dict[str, int], profile: Profile, processing: Processing) -> None:
        """The rows of all documents that the actions touch, or that an earlier run left incomplete, as they have to be."""
        steps = state.batch_plan(actions).persist()
        sizes = {r.phase: r["count"] for r in steps.groupBy("phase").count().collect()}
        gone, purged, added = (steps.where(F.col("phase") == p).select("data_id") for p in ("delete", "purge", "add"))
        derives = any(counts.get(op) for op in state.DERIVING_OPS)
        raw = store.read("raw", RAW)
        hit = steps.select("data_id")
        if derives:
            hit = hit.unionByName(state.incomplete(raw).select("data_id"))
        hit = hit.distinct()
        payload = docs.join(actions.where(F.col("op").isin(*state.ADDING_OPS)).select("external_key", "data_id"), "external_key")
        payload = payload.select(self.dataset_id(dataset).alias("dataset_id"), "data_id", *state.PAYLOAD)
        kept = state.purge_raw(state.delete(raw.join(hit, "data_id", "left_semi"), gone), purged)
        rows = state.upsert(kept, payload).persist()
        if derives or sizes.get("delete") or sizes.get("purge"):
            todo = state.incomplete(rows)
            found = {"bridge": self._names(todo, profile), "edges": self._relations(todo, profile)}
            for name, schema in (("derivatives", DERIVATIVES), ("bridge", BRIDGE), ("edges", EDGES)):
                left = store.read(name, schema).join(hit, "data_id", "left_semi")
                left = state.delete(state.delete(left, gone), purged)
                if derives:
                    left = state.derive(rows, left, processing.fingerprint)[1] if name == "derivatives" else left.unionByName(found[name]).distinct()
                store.change(name, schema, "data_id", hit, left)
                if name in self.hooks:
                    self.hooks[name]()
        for phase in ("delete", "purge"):
            self._done(phase, sizes.get(phase, 0))
        self._done("derive")
        store.change("raw", RAW, "data_id", hit, rows.withColumn("complete", F.lit(True)) if derives else rows)
        if "raw" in self.hooks:
            self.hooks["raw"]()
        written = store.read("raw", RAW).select("data_id").join(added, "data_id", "left_semi").count()
        if written != sizes.get("add", 0):
            raise DriftError(f"{sizes.get('add', 0)} documents were to be stored, {written} are")
        self._done("add", written)
        rows.unpersist()
        steps.unpersist()

    def dataset_id(self, dataset: Dataset) -> Column:
        return uuid5(OID, netstring("tidemark-dataset", dataset.scope, dataset.tenant, dataset.name))

    @staticmethod
    def _parts(rows: DataFrame, profile: Profile) -> DataFrame:
        """(data_id, part): the texts, in chunks if the profile has a size for them; bytes are read as UTF-8."""
        text = F.coalesce("content", F.make_valid_utf8(F.col("content_bytes").cast("string")))
        return rows.select("data_id", (F.explode(dv.chunks(text, profile.chunk_size)) if profile.chunk_size else text).alias("part"))

    def _names(self, todo: DataFrame, profile: Profile) -> DataFrame:
        extract = profile.extractor or dv.capitalized
        found = self._parts(todo, profile).select("data_id", F.explode(extract(F.col("part"))).alias("name"))
        return found.select(dv.node_key(F.col("name")).alias("artifact_id"), "name", "data_id").distinct()

    def _relations(self, todo: DataFrame, profile: Profile) -> DataFrame:
        if profile.relations is None:
            return self.spark.createDataFrame([], EDGES)
        found = self._parts(todo, profile).select("data_id", F.explode(profile.relations(F.col("part"))).alias("e"))
        return found.select("e.source", "e.target", "e.relationship_name", "data_id").distinct()

    def documents(self, dataset: Dataset) -> DataFrame:
        return state.list_documents(self.store(dataset).read("raw", RAW))

    def graph(self, dataset: Dataset) -> DataFrame:
        """Nodes that some document refers to, with the number of these."""
        bridge = self.store(dataset).read("bridge", BRIDGE)
        return bridge.groupBy("artifact_id").agg(F.min("name").alias("name"), F.countDistinct("data_id").alias("n_refs"))

    def edges(self, dataset: Dataset) -> DataFrame:
        """Edges that some document holds, with the number of these."""
        found = self.store(dataset).read("edges", EDGES)
        return found.groupBy("source", "target", "relationship_name").agg(F.countDistinct("data_id").alias("n_refs"))

    def verify(self, dataset: Dataset, expected: DataFrame) -> dict:
        """expected: external_key, label."""
        rows = expected.select(normalize_key(F.col("external_key")).alias("external_key"), "label")
        rows = rows.withColumn("data_id", document_id(*dataset.identity, F.col("external_key")))
        with self._lock(dataset):
            return verify.report(rows, self.store(dataset).read("raw", RAW).select("data_id", "label", "complete"))

    def teardown(self, dataset: Dataset) -> bool:
        """Drops what is stored of a dataset that the system manages, as its record says; False, and nothing is done, if its user manages or managed it, or if there is none."""
        with self._lock(dataset):
            store = self.store(dataset)
            before = [(r.processing_fp, r.managed_by) for r in store.read("configuration", CONFIGURATION).collect()]
            if rc.dataset_transition(None, None, before, False)["action"] != "delete":
                return False
            # The record goes last: a teardown that stops is made good by the next one.
            for name in ("edges", "bridge", "derivatives", "raw", "tracking", "actions", "configuration"):
                store.drop(name)
        return True
