"""Helpers that the training-data operators share: tables, checkpoints, Arrow text slices, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a slice at most.
SLICE_ROWS = 60_000
#: Bytes of text that one numpy pass works on; temporaries are some ten times as large.
SLICE_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, as it names it; one of our own where all runs in one process and it names none."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint in the cluster's shared folder (spark.checkpoint.dir)."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Cut as a table in the shared folder, which is half the size of a checkpoint; and its path, for drop()."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours."""
    sc = spark.sparkContext
    folder = sc._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that are done; they stay until the driver collects garbage, which on large heaps can be long."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns free memory to the system. Allocators keep it as long as the worker lives, and that is longer than its task: an executor's workers serve all stages that follow."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker gives memory back when its input ends."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return call


def text_slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of a string or binary array, nulls as empty; a slice holds about `most` bytes or one row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, lo + SLICE_ROWS)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def map_text(df: DataFrame, keep: list[str], text: str, make: Callable, schema: str) -> DataFrame:
    """mapInArrow over slices: make() gives a function of (bytes, offsets) that returns new columns, one value a row; `keep` columns pass through."""
    fields = [(k, df.schema[k].dataType.simpleString()) for k in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for lo, hi, data, offsets in text_slices(texts):
                new = work(data, offsets)
                kept = [batch.column(batch.schema.get_field_index(k)).slice(lo, hi - lo) for k in keep]
                yield pa.RecordBatch.from_arrays([*kept, *(v if isinstance(v, pa.Array) else pa.array(v) for v in new.values())], [*keep, *new])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(lean(run), ", ".join([*(f"`{k}` {t}" for k, t in fields), schema]))


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... lengths[i] values for each i, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's component, by pairs (a, b) of numbers below n."""
    low = np.arange(n)
    while len(a):
        new = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(new, low[a], m)
        np.minimum.at(new, low[b], m)
        new = new[new]
        if (new == low).all():
            break
        low = new
    while (low[low] != low).any():
        low = low[low]
    return low


#: Edges of a partition that is thinned to a spanning forest at once.
FOREST_EDGES = 50_000


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of a partition's edges (u, v): one edge a node at most."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    ends = np.concatenate([np.concatenate([b.column(i).to_numpy() for b in rows]) for i in (0, 1)])
    names, number = np.unique(ends, return_inverse=True)
    low = forest(number[: len(number) // 2], number[len(number) // 2 :], len(names))
    own = np.flatnonzero(low != np.arange(len(names)))
    yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[low[own]])], ["u", "v"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components by alternating large and small stars: (node, component), the component being its least node.

    edges: (a, b) of long, any direction; self-loops and repeats are allowed. Nodes without an edge do not
    appear. Edges are first thinned to spanning forests of some 50 000 at a time, so a dense class does not
    weigh on the rounds. Each round is checkpointed; its work is linear in the edges.
    """
    now = cut(edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v").distinct())
    now = cut(now.coalesce(max(1, -(-now.count() // FOREST_EDGES))).mapInArrow(_thinned, "u long, v long").distinct())
    before = None
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = cut(small.where("u <> v").distinct())
        state = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    pairs = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return pairs.union(roots)
