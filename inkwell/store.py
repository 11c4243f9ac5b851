"""Versioned graph tables in a folder of any Hadoop file system.

A commit writes the tables that changed, then one small manifest that says where each table is. Readers take the newest manifest, so they see a
whole state or the one before, never a mixture; tables that did not change are not written again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from inkwell import schemas
from inkwell.operators.reconcile import duplicate_keys


class DuplicateKeys(ValueError):
    """A table that would break its promise of one row a key."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str = ""):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, path = self._path()
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, str]:
        found = self.versions()
        if not found:
            return {}
        fs, path = self._path(f"manifest-{version or found[-1]:08d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table, empty if there is none yet."""
        where = self.manifest(version).get(name)
        if where is None:
            return self.spark.createDataFrame([], schemas.TABLES[name])
        return self.spark.read.schema(schemas.TABLES[name]).parquet(f"{self.root}/{where}")

    def tables(self) -> dict[str, DataFrame]:
        return {name: self.read(name) for name in self.manifest()}

    def commit(self, changed: dict[str, DataFrame]) -> int:
        """Writes the changed tables, sorted by key within their files, and makes them the current state.

        Keys are checked on what was written; a table with a repeated one fails the commit, and the state stays as it was. The manifest is written aside and then
        renamed, so no reader sees half of it; of two writers that commit at once the second fails.
        """
        version = (self.versions() or [0])[-1] + 1
        manifest = self.manifest()
        for name, df in changed.items():
            columns = [c.split()[0] for c in schemas.TABLES[name].split(", ")]
            where = f"v{version:08d}/{name}"
            df.select(*columns).repartition(*schemas.KEYS[name][:1]).sortWithinPartitions(*schemas.KEYS[name]).write.mode("overwrite").parquet(f"{self.root}/{where}")
            manifest[name] = where
            key = schemas.KEYS[name]
            doubles = duplicate_keys(self.spark.read.schema(schemas.TABLES[name]).parquet(f"{self.root}/{where}").select(*key), key).limit(3).collect()
            if doubles:
                raise DuplicateKeys(f"{name}: {', '.join(str(tuple(r)[:-1]) for r in doubles)}")
        fs, path = self._path(f"manifest-{version:08d}.json")
        _, aside = self._path(f".manifest-{version:08d}-{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if fs.exists(path) or not fs.rename(aside, path):
            fs.delete(aside, False)
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    def forget(self, names: list[str]) -> int:
        """A state without these tables."""
        return self.commit({name: self.spark.createDataFrame([], schemas.TABLES[name]) for name in names})
