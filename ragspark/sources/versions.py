"""Keyed tables with a commit log (SRC17, SRC20).

Rows lie in immutable Parquet folders.  Version n of a table is the manifest
``log/<n>.json``, the list of its folders from old to new; it appears whole and
at once, under a name that only one writer can create.  A writer puts its rows
into a folder of its own and then publishes the next version: if another writer
took that number, it reads the new log and tries the one after.  An upsert adds
its folder behind the others, so two writers lose no key of each other; a
writer that fails before publishing leaves a folder that no version names.

Of a key the row of the newest folder counts.  A reader works on one version,
whatever is published meanwhile.  ``compact`` publishes the same rows as one folder.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragspark.sources.scratch import local_path


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema):
        self.spark, self.path, self.keys, self.schema = spark, path.rstrip("/"), list(keys), schema
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._local = self._fs.getScheme() == "file"
        self._fs.mkdirs(self._at("log"))

    def _at(self, *parts: str):
        return self._hadoop.Path("/".join([self.path, *parts]))

    # ------------------------------------------------------------ log
    def latest(self) -> int:
        """The newest version; 0 before the first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("log"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def folders(self, version: int) -> list[str]:
        if version == 0:
            return []
        stream = self._fs.open(self._at("log", f"{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["folders"]
        finally:
            stream.close()

    def _publish(self, version: int, folders: list[str]) -> bool:
        """Creates the manifest, whole or not at all; False if the version exists."""
        text, name = json.dumps({"version": version, "folders": folders}), f"{version:012d}.json"
        draft = f".draft-{uuid.uuid4().hex}"
        if self._local:
            base = local_path(self.path)
            with open(f"{base}/log/{draft}", "w", encoding="utf-8") as f:
                f.write(text)
            try:
                os.link(f"{base}/log/{draft}", f"{base}/log/{name}")      # fails if the name is taken
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(f"{base}/log/{draft}")
        out = self._fs.create(self._at("log", draft), False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.exists(self._at("log", name)) and self._fs.rename(self._at("log", draft), self._at("log", name)):
            return True                      # a rename onto an existing name is refused
        self._fs.delete(self._at("log", draft), False)
        return False

    # ------------------------------------------------------------ writing
    def _write(self, rows: DataFrame) -> str:
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        return folder

    def upsert(self, rows: DataFrame) -> int:
        """Adds ``rows`` (a key at most once); returns the version that has them."""
        folder = self._write(rows.select(*self.schema.fieldNames()))
        while True:
            now = self.latest()
            if self._publish(now + 1, [*self.folders(now), folder]):
                return now + 1

    def compact(self) -> int:
        """The newest version's rows in one folder; what others publish meanwhile stays behind it."""
        seen = self.latest()
        old = self.folders(seen)
        folder = self._write(self.read(seen))
        while True:
            now = self.latest()
            have = self.folders(now)
            if have[:len(old)] != old:       # another compaction came first
                return now
            if self._publish(now + 1, [folder, *have[len(old):]]):
                return now + 1

    # ------------------------------------------------------------ reading
    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the newest if None), fixed at this call."""
        folders = self.folders(self.latest() if version is None else version)
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        parts = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{f}").withColumn("_age", F.lit(i))
                 for i, f in enumerate(folders)]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if len(parts) == 1:
            return rows.drop("_age")
        newest = F.row_number().over(Window.partitionBy(*self.keys).orderBy(F.col("_age").desc()))
        return rows.withColumn("_rn", newest).where(F.col("_rn") == 1).drop("_rn", "_age")
