"""Readers of reading files, writers of exports, and checks of exported tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_readings(spark: SparkSession, path: str, names: dict[str, str], time: str = "time", pattern: str = "dd.MM.yyyy HH:mm") -> DataFrame:
    """Semicolon CSV with a byte-order mark; header suffixes in brackets are cut; `names` maps headers to columns, `time` is
    parsed without a zone, all others but the first are numbers. A missing header raises ValueError."""
    raw = spark.read.csv(path, sep=";", header=True, encoding="UTF-8")
    heads = {re.sub(r" \(.*$", "", c.lstrip("﻿")).strip(): c for c in raw.columns}
    missing = sorted(set(names) - set(heads))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    out = []
    for i, (head, name) in enumerate(names.items()):
        c = F.col(f"`{heads[head]}`")
        out.append((F.to_timestamp_ntz(c, F.lit(pattern)) if name == time else c if i == 0 else F.expr(f"try_cast(`{heads[head]}` as double)")).alias(name))
    return raw.select(*out)


def read_table(spark: SparkSession, path: str, numbers: list[str]) -> DataFrame:
    """Semicolon CSV with decimal commas."""
    raw = spark.read.csv(path, sep=";", header=True, encoding="UTF-8")
    return raw.withColumns({c: F.regexp_replace(c, ",", ".").cast("double") for c in numbers})


def write_table(df: DataFrame, path: str, columns: list[str], digits: int = 6, mark: bool = False) -> None:
    """Semicolon CSV in the given column order: absent columns are null, arrays are joined by ; and numbers have decimal commas.
    `mark` puts a byte-order mark before the first heading, which spreadsheet programs look for."""
    out = []
    for c in columns:
        if c not in df.columns:
            out.append(F.lit(None).cast("string").alias(c))
            continue
        kind = df.schema[c].dataType
        if isinstance(kind, T.ArrayType):
            out.append(F.array_join(c, ";").alias(c))
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            out.append(F.regexp_replace(F.round(c, digits).cast("string"), r"\.", ",").alias(c))
        else:
            out.append(F.col(c))
    made = df.select(*out)
    if mark:
        made = made.withColumnRenamed(columns[0], "\ufeff" + columns[0])
    made.write.mode("overwrite").csv(path, sep=";", header=True)


def read_sidecars(spark: SparkSession, pattern: str) -> DataFrame:
    """JSON records from many small files, with the file each came from."""
    return spark.read.json(pattern, multiLine=True).withColumn("file", F.input_file_name())


def between(df: DataFrame, time: str, start, end) -> DataFrame:
    """Left-exclusive range scan (start, end]; reaches the file's statistics and partitions."""
    return df.where((F.col(time) > F.lit(start)) & (F.col(time) <= F.lit(end)))


def differences(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Rows of two versions of a summary that differ: absent on a side, or a number off by more than the tolerance."""
    values = [c for c in a.columns if c not in keys]
    x = a.select(*keys, F.struct(*values).alias("x"))
    y = b.select(*keys, F.struct(*values).alias("y"))
    off = F.lit(False)
    for c in values:
        p, q = F.col(f"x.{c}"), F.col(f"y.{c}")
        same = F.abs(p - q) <= tolerance if isinstance(a.schema[c].dataType, T.NumericType) else p == q
        off = off | ~F.coalesce(same, p.isNull() & q.isNull())
    return x.join(y, keys, "full").where(F.col("x").isNull() | F.col("y").isNull() | off)


def schema_problems(df: DataFrame, wanted: dict[str, str]) -> list[str]:
    """Columns that are absent or of another type than `wanted` says."""
    have = dict(df.dtypes)
    return [f"{c}: {have.get(c, 'absent')} for {t}" for c, t in wanted.items() if have.get(c) != t]
