"""Folders of numbered parts that appear whole or not at all: each is written aside and renamed."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Staged:
    """``root/<name>=<n>`` folders in a place that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.spark, self.root, self.name = spark, root.rstrip("/"), name

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def path(self, n: int) -> str:
        return f"{self.root}/{self.name}={n}"

    def numbers(self) -> list[int]:
        files, at = self._at(self.root)
        if not files.exists(at):
            return []
        names = [s.getPath().getName() for s in files.listStatus(at)]
        return sorted(int(x.removeprefix(f"{self.name}=")) for x in names if x.startswith(f"{self.name}="))

    def commit(self, n: int, write: Callable[[str], None]) -> bool:
        """``write`` fills a folder, which then becomes number ``n``; false, with nothing changed, if that is there already.

        What a failed ``write`` leaves has a name that readers pass over, and goes if it can.
        """
        files, target = self._at(self.path(n))
        if files.exists(target):
            return False
        aside = f"{self.root}/_aside-{uuid.uuid4().hex}"
        _, written = self._at(aside)
        try:
            write(aside)
            # rename() would move into a folder that is there: then another run was first.
            done = not files.exists(target) and files.rename(written, target)
        except Exception:
            files.delete(written, True)
            raise
        if not done:
            files.delete(written, True)
        return done


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir`` that goes when the session's JVM ends; a local session without that setting (tests) gets a temporary one."""
    context = spark.sparkContext
    at = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='spanloom-')}"
        context.setCheckpointDir(at)
    path = f"{at}/{name}-{uuid.uuid4().hex}"
    gone = spark._jvm.org.apache.hadoop.fs.Path(path)
    gone.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(gone)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """A table written in the shared folder and read back: lineage ends there."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def held(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """A table worked out once for several readers: written in the shared folder, and gone when they are done."""
    path = shared_folder(df.sparkSession, name)
    try:
        df.write.parquet(path)
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
