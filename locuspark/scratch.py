"""Tables written to the folder that driver and executors share, to cut lineage: what is lost with an executor is read again."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only in local mode, where they are one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or f"file://{_local()}"


_LOCAL: list[tempfile.TemporaryDirectory] = []


def _local() -> str:
    if not _LOCAL:
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="locuspark-"))
    return _LOCAL[0].name


class Scratch:
    """Tables that an operator writes to cut lineage: any executor can read them again after another is lost."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/locuspark-{uuid.uuid4().hex}", []
        atexit.register(self.drop_all)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{len(self.paths)}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in frames:
            self._delete(df._scratch_path)

    def drop_all(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended; the folder's owner clears it
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Let the cleaner remove shuffle files of jobs whose results have been written."""
        gc.collect()
        self.spark._jvm.System.gc()
