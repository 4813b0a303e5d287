"""Intermediate tables that several results are computed from.

A plan that is used by many results would be computed once per result: each one
prunes other columns, so that Spark cannot reuse its shuffles. Such a plan is
written as Parquet below the shared folder of the cluster and read back. That
also cuts the lineage, and a lost executor costs no more than its own tasks.
"""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, nullcontext

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
# Of statements: the shuffle files of a finished write are no one's any more.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
CODEC = "spark.sql.parquet.compression.codec"


def shared_dir(spark: SparkSession) -> str:
    """Folder named by the session; a temporary one for local masters only."""
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_DIR} has to name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="taktline-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


class Workspace:
    """A fresh folder for the intermediate tables of one run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"
        self._numbers = itertools.count(1)

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write ``df`` and read it back, with the schema it has now; ``by``: a column whose values get folders of their own."""
        # Two models may use one name, and tables are kept from several threads.
        path = f"{self.folder}/{next(self._numbers):03d}-{name}"
        df.write.parquet(path, partitionBy=by)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_alone(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """As ``keep``, and what the write shuffled leaves the disks when it ends. For steps that run one by one."""
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            return self.keep(df, name, by)
        finally:
            self.spark.conf.set(CLEANUP, before)

    @contextmanager
    def compact(self):
        """Within, tables take less disk, and what a step shuffled leaves the disks when it ends, also of steps side by side."""
        own = {CLEANUP: "true", CODEC: "zstd"}
        before = {name: self.spark.conf.get(name) for name in own}
        try:
            for name, value in own.items():
                self.spark.conf.set(name, value)
            yield
        finally:
            for name, value in before.items():
                self.spark.conf.set(name, value)

    def together(self, *steps: Callable[[], object]) -> list:
        """Results of steps that do not need each other; their jobs share the executors.

        A small step then costs no time of its own, and the last tasks of one leave no cores idle. All steps end before
        a failure is raised.
        """
        with ThreadPoolExecutor(max(1, len(steps))) as pool:
            return [f.result() for f in [pool.submit(inheritable_thread_target(self.spark)(step)) for step in steps]]

    def close(self) -> None:
        """Remove the folder; nothing that reads its tables may run afterwards."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Lazy:
    """Keeps nothing: every plan stays as it is and runs no action."""

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        return df

    def compact(self):
        return nullcontext()

    def together(self, *steps: Callable[[], object]) -> list:
        return [step() for step in steps]
