"""A versioned Parquet store: each write makes a new version, readers keep theirs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Version of the tables' layout.
LAYOUT = 1


class Store:
    """Tables under a folder, `name/v=N`; the greatest complete N is current.

    A version is complete when its `_SUCCESS` file is there, so a failed write is
    never read.  Old versions stay until `vacuum`.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def versions(self, name: str) -> list[int]:
        fs, place = self._fs(f"{self.root}/{name}")
        if not fs.exists(place):
            return []
        found = []
        for s in fs.listStatus(place):
            folder = s.getPath()
            if folder.getName().startswith("v=") and fs.exists(self._fs(f"{folder}/_SUCCESS")[1]):
                found.append(int(folder.getName()[2:]))
        return sorted(found)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        versions = self.versions(name)
        if not versions:
            raise FileNotFoundError(f"no table {name} in {self.root}")
        return self.spark.read.parquet(f"{self.root}/{name}/v={version or versions[-1]}")

    def exists(self, name: str) -> bool:
        return bool(self.versions(name))

    def replace(self, name: str, rows: DataFrame) -> int:
        """Writes a whole table as a new version."""
        version = (self.versions(name) or [0])[-1] + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v={version}")
        return version

    def append(self, name: str, rows: DataFrame) -> int:
        """Old rows and new ones; columns that one side lacks are null."""
        return self.replace(name, self.read(name).unionByName(rows, allowMissingColumns=True) if self.exists(name) else rows)

    def insert_ignore(self, name: str, rows: DataFrame, *keys: str) -> int:
        """Adds the rows whose key is not there yet, one per key."""
        new = rows.dropDuplicates(list(keys))
        if self.exists(name):
            new = new.join(self.read(name).select(*keys).distinct(), list(keys), "left_anti").select(*rows.columns)
        return self.append(name, new)

    def upsert(self, name: str, rows: DataFrame, *keys: str) -> int:
        """Rows by key: the new ones replace the old."""
        if not self.exists(name):
            return self.replace(name, rows)
        kept = self.read(name).join(rows.select(*keys).distinct(), list(keys), "left_anti")
        return self.replace(name, kept.unionByName(rows, allowMissingColumns=True))

    def delete(self, name: str, dead: DataFrame, *keys: str) -> int:
        old = self.read(name)
        return self.replace(name, old.join(dead.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns))

    def compact(self, name: str, files: int) -> int:
        """The table in so many files."""
        return self.replace(name, self.read(name).repartition(files))

    def vacuum(self, name: str, keep: int = 1) -> int:
        """Deletes all but the latest `keep` versions; gives how many."""
        old = self.versions(name)[:-keep]
        for v in old:
            fs, place = self._fs(f"{self.root}/{name}/v={v}")
            fs.delete(place, True)
        return len(old)

    def reset(self, confirm: bool = False) -> None:
        """Deletes the whole store; only if confirmed."""
        if not confirm:
            raise ValueError("reset deletes the store; pass confirm=True")
        fs, place = self._fs(self.root)
        fs.delete(place, True)

    def statistics(self, name: str) -> dict[str, int]:
        rows = self.read(name)
        return {"rows": rows.count(), "files": len(rows.inputFiles()), "columns": len(rows.columns), "layout": LAYOUT}


def since(rows: DataFrame, column: str, at) -> DataFrame:
    return rows.where(F.col(column) > at)
