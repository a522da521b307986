"""Session, table and scratch helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` under `sf_dir`; a file or a directory of Parquet files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    It is the session's `spark.checkpoint.dir`.  Only where that is unset and the
    master is this machine, as in local tests, a folder of this machine is taken;
    on a cluster its executors could not read each other's files, so there it is
    an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = held or "file://" + tempfile.mkdtemp(prefix="chunkloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_roots: dict[str, object] = {}


def clear_scratch() -> None:
    """Removes all intermediate tables of this process; results that still read them must have been written."""
    for root, context in list(_roots.items()):
        try:
            place = context._jvm.org.apache.hadoop.fs.Path(root)
            place.getFileSystem(context._jvm.org.apache.hadoop.conf.Configuration(context._jsc.hadoopConfiguration()) if context._jsc else context._jvm.org.apache.hadoop.conf.Configuration()).delete(place, True)
        except Exception:  # noqa: BLE001 - the session may be gone, and its folder with it
            pass
        _roots.pop(root, None)


atexit.register(clear_scratch)


class Scratch:
    """Intermediate tables written to the shared folder to cut lineage.

    A written table is read back by any executor, so the loss of one does not
    lose it.  The tables go when the process ends, or by `clear_scratch`, since
    lazy results may read them until then.  `keep` is how many of the latest tables stay readable: an
    iteration needs its last state only.
    """

    def __init__(self, spark: SparkSession, name: str, keep: int | None = None):
        self.spark, self.keep = spark, keep
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        _roots[self.root] = spark.sparkContext

    def cut(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        df.write.mode("overwrite").parquet(path)
        self.paths.append(path)
        if self.keep is not None:
            for old in self.paths[: -self.keep]:
                self._drop(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def _drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def clean_path(path: Column) -> Column:
    """A path without surrounding blanks, backslashes, doubled slashes and a leading `./`; case counts."""
    slashes = F.regexp_replace(F.regexp_replace(F.trim(path), r"\\", "/"), "/{2,}", "/")
    return F.regexp_replace(slashes, r"^(?:\./)+", "")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
