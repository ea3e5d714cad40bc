"""What every operator needs from the session: scratch tables in the shared folder, and the package on the executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


@contextmanager
def settings(spark: SparkSession, pairs: dict[str, str]):
    """Session settings for the jobs run inside, put back afterwards."""
    before = {k: spark.conf.get(k, None) for k in pairs}
    try:
        for k, v in pairs.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only where that is unset on one machine (tests) a temporary one.

    On a cluster no machine's own folder will do, so there an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
        found = "file://" + tempfile.mkdtemp(prefix="aerograin-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


class Scratch:
    """Tables written to the shared folder to cut lineage: they outlive lost executors and can be read column by column."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/aerograin/{what}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """`df` written and read again; with `by`, in a folder a value of that column, which can be dropped by itself."""
        path = f"{self.base}/{name}"
        out = df.write.mode("overwrite").option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a table that nothing reads any more."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Put this package on the executors' Python path, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp()), "aerograin.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
