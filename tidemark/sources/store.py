"""Versioned tables: immutable Parquet versions and a pointer, on any file system that Spark writes.

A version is written whole before the pointer moves, so a reader never sees half of one and a plan may
read the version that it replaces. Old versions stay until `vacuum`.

A table is a base and, beside it, at most one layer of changes: the rows of the keys that changed since, and
a mark for each of these keys. Writing changes costs what changed, not the table; the layer is merged into
the base when it has grown to a share of it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class VersionedStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._context = jvm.org.apache.hadoop.fs.FileContext
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointer(self, name: str):
        return self._path(f"{self.root}/{name}/_CURRENT")

    def state(self, name: str) -> dict | None:
        """The pointer: `base`, `layer` (or None) and `key` (of the layer); None if there is no table."""
        pointer = self._pointer(name)
        if not self._fs.exists(pointer):
            return None
        stream = self._fs.open(pointer)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def version(self, name: str) -> str | None:
        """Names the current state."""
        now = self.state(name)
        return now and ":".join(filter(None, (now["base"], now["layer"])))

    def _layer(self, name: str, now: dict, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, mark__ boolean").parquet(f"{self.root}/{name}/{now['layer']}")

    def read(self, name: str, schema: str) -> DataFrame:
        """The current rows; an empty frame of the schema if there is no table."""
        now = self.state(name)
        if now is None:
            return self.spark.createDataFrame([], schema)
        base = self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{now['base']}")
        if not now["layer"]:
            return base
        layer = self._layer(name, now, schema)
        return base.join(layer.where("mark__").select(now["key"]), now["key"], "left_anti").unionByName(layer.where("not mark__").drop("mark__"))

    def write(self, name: str, frame: DataFrame) -> str:
        """A new base, written by one job, then made the current state by a rename."""
        return self._point(name, {"base": self._files(name, frame), "layer": None, "key": None})

    def change(self, name: str, schema: str, key: str, keys: DataFrame, rows: DataFrame, share: float = 0.25) -> None:
        """The rows of `keys` are `rows` from now on. keys: (key), all different; rows: whole rows, of these keys only.

        Nothing else is written, unless the layer holds more than `share` of the base.
        """
        now = self.state(name)
        columns = StructType.fromDDL(schema).names
        rows = rows.select(*columns)
        if now is None:
            self.write(name, rows)
            return
        new = rows.withColumn("mark__", F.lit(False)).unionByName(keys.select(key).withColumn("mark__", F.lit(True)), allowMissingColumns=True)
        if now["layer"]:
            new = new.unionByName(self._layer(name, now, schema).join(keys.select(key), key, "left_anti"))
        layer = self._files(name, new.select(*columns, "mark__"))
        self._point(name, {"base": now["base"], "layer": layer, "key": key})
        if self._size(name, layer) > share * self._size(name, now["base"]):
            self.write(name, self.read(name, schema))

    def _size(self, name: str, version: str) -> int:
        return self._fs.getContentSummary(self._path(f"{self.root}/{name}/{version}")).getLength()

    def _files(self, name: str, frame: DataFrame) -> str:
        version = f"v-{uuid.uuid4().hex}"
        frame.write.parquet(f"{self.root}/{name}/{version}")
        return version

    def _point(self, name: str, state: dict) -> str:
        temporary = self._path(f"{self.root}/{name}/_{uuid.uuid4().hex}")
        stream = self._fs.create(temporary, True)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        jvm = self.spark.sparkContext._jvm
        overwrite = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        self._context.getFileContext(temporary.toUri() if temporary.toUri().getScheme() else self._path(f"file://{self.root}").toUri()).rename(temporary, self._pointer(name), overwrite)
        return state["base"]

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def vacuum(self, name: str) -> int:
        """Deletes all versions that the current state doesn't name; how many."""
        now, gone = self.state(name) or {}, 0
        folder = self._path(f"{self.root}/{name}")
        for status in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
            if status.isDirectory() and status.getPath().getName() not in (now.get("base"), now.get("layer")):
                self._fs.delete(status.getPath(), True)
                gone += 1
        return gone

    def note(self, name: str, text: str | None = None) -> str | None:
        """A small text file beside the tables: written if a text is given; its text, None if there is none."""
        path = self._path(f"{self.root}/_{name}")
        if text is not None:
            stream = self._fs.create(path, True)
            try:
                stream.write(bytearray(text.encode()))
            finally:
                stream.close()
            return text
        if not self._fs.exists(path):
            return None
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self) -> list[str]:
        """The tables that there are."""
        root = self._path(self.root)
        found = [status.getPath().getName() for status in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(n for n in found if self._fs.exists(self._pointer(n)))
