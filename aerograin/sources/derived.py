"""Derived tables: versions behind a pointer, upserts that a lost driver can't harm, exports with checksums, resumable cases."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import schema_problems, write_table

POINTER = "_current"


class Store:
    """A folder of derived tables on any file system that Spark reaches.

    A table is a folder of versions and a small pointer file that names the current one. A version is written whole before the
    pointer is replaced, so a reader or a lost driver sees the old table or the new one, never half of one.
    """

    def __init__(self, spark: SparkSession, base: str, schema_version: int = 1):
        self.spark, self.base, self.schema_version = spark, base.rstrip("/"), schema_version
        self._jvm = spark.sparkContext._jvm
        self.fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _put(self, path: str, text: str) -> None:
        out = self.fs.create(self._path(path), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _get(self, path: str) -> str | None:
        if not self.fs.exists(self._path(path)):
            return None
        got = self.fs.open(self._path(path))
        try:
            return bytes(got.readAllBytes()).decode()
        finally:
            got.close()

    def _point(self, name: str, version: str) -> None:
        """Replace the pointer: the new one is written beside it, the old one is moved aside and kept until the new one stands."""
        at, new, old = f"{self.base}/{name}/{POINTER}", f"{self.base}/{name}/{POINTER}.new", f"{self.base}/{name}/{POINTER}.old"
        self._put(new, json.dumps({"version": version, "schema_version": self.schema_version}))
        self.fs.delete(self._path(old), False)
        if self.fs.exists(self._path(at)):
            self.fs.rename(self._path(at), self._path(old))
        self.fs.rename(self._path(new), self._path(at))

    def current(self, name: str) -> str | None:
        """The folder of the current version; after a crash between two moves the one before it. Another schema version raises."""
        told = self._get(f"{self.base}/{name}/{POINTER}") or self._get(f"{self.base}/{name}/{POINTER}.old")
        if told is None:
            return None
        found = json.loads(told)
        if found["schema_version"] != self.schema_version:
            raise ValueError(f"{name} has schema version {found['schema_version']}, not {self.schema_version}: rebuild it")
        return f"{self.base}/{name}/{found['version']}"

    def read(self, name: str) -> DataFrame:
        path = self.current(name)
        if path is None:
            raise FileNotFoundError(name)
        return self.spark.read.parquet(path)

    def replace(self, name: str, df: DataFrame) -> None:
        """Create or replace a table as a query's result."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.base}/{name}/{version}")
        self._point(name, version)

    def upsert(self, name: str, df: DataFrame, keys: list[str], order: str) -> None:
        """Merge rows by key; of rows with one key the one with the greatest `order` stays."""
        path = self.current(name)
        both = df if path is None else self.spark.read.parquet(path).unionByName(df, allowMissingColumns=True)
        rest = [c for c in both.columns if c not in keys]
        last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_v"))
        self.replace(name, last.select(*keys, *[F.col(f"_v.`{c}`").alias(c) for c in rest]))

    def rebuild(self) -> None:
        """Forget every derived table (raw tables lie elsewhere)."""
        self.fs.delete(self._path(self.base), True)

    def versions(self, name: str) -> list[str]:
        root = self._path(f"{self.base}/{name}")
        return sorted(s.getPath().getName() for s in self.fs.listStatus(root) if s.isDirectory()) if self.fs.exists(root) else []

    def case(self, study: str, case: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The result of one case of a study: made and kept once, read again when the study is resumed."""
        name = f"{study}/{case}"
        if self.current(name) is None:
            self.replace(name, make())
        return self.read(name)


def export(df: DataFrame, path: str, columns: list[str], order: list[str]) -> str:
    """Write a small ordered CSV (one file) and return the SHA-256 of its rows, which a reader can compute again."""
    rows = df.orderBy(*order).coalesce(1)
    write_table(rows, path, columns)
    return checksum(df.sparkSession, path)


def checksum(spark: SparkSession, path: str) -> str:
    """SHA-256 of an export's lines, file by file in the order of their names."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("f"), F.monotonically_increasing_id().alias("i"))
    digest = hashlib.sha256()
    for r in lines.orderBy("f", "i").toLocalIterator():
        digest.update((r["value"] + "\n").encode())
    return digest.hexdigest()


def export_all(spark: SparkSession, sf_dir: str, folder: str, queries: dict, names: list[str]) -> dict[str, str]:
    """Export the named queries, a folder each, and return their checksums: what a manifest lists."""
    out = {}
    for name in names:
        df = queries[name](spark, sf_dir)
        out[name] = export(df, f"{folder}/{name}", df.columns, df.columns)
    return out


def validated(df: DataFrame, wanted: dict[str, str], least_rows: int = 1) -> list[str]:
    """What is wrong with an artifact: columns, types, too few rows."""
    found = schema_problems(df, wanted)
    n = df.limit(least_rows).count()
    return found if n >= least_rows else [*found, f"{n} rows, {least_rows} wanted"]


def run_summary(results: dict[str, DataFrame], settings: str) -> str:
    """A run's summary as Markdown: the settings' hash and each small result as a table (at most 50 rows are shown)."""
    out = ["# Run", "", f"Settings: `{settings}`", ""]
    for name, df in results.items():
        rows = df.limit(50).collect()
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows] + [""]
    return "\n".join(out)


def pinned(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot of a Parquet table: the files that are there now, read by name, whatever is added later."""
    return spark.read.parquet(*sorted(spark.read.parquet(path).inputFiles()))
