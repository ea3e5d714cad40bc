"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Every document is repeated N times, N ~ Poisson(rate of its source), by inverting the distribution at a number in [0, 1)
that is hashed from the seed and the document (doc_id, text, and which of its equal rows it is): N = how many values of the cumulative distribution are at most that number. A rate over
MOST_RATE is split evenly into several draws, each from a hash of its own: their sum has the same distribution.
A run is repeatable and no state is shared. The repetitions then go to positions drawn by hash: a global shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

SEED = 17
TEMPERATURE = 0.5
EPOCHS = 1.0
#: Values of cumulative distributions that are broadcast at most (8 bytes each).
MOST_BROADCAST = 1 << 20
#: exp(-rate) and the terms after it are far from underflow up to this rate.
MOST_RATE = 500.0


def uniform(*parts: Column) -> Column:
    """52 bits of an MD5 as a number in [0, 1)."""
    key = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def poisson_cdf(rate: Column) -> Column:
    """The cumulative distribution as an array, far enough into the tail that a 52-bit number never passes its end."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    terms = F.transform(F.sequence(F.lit(1), last), lambda k: rate / k.cast("double"))
    state = F.struct(F.exp(-rate).alias("term"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def step(s, ratio):
        term = s["term"] * ratio
        total = s["sum"] + term
        return F.struct(term.alias("term"), total.alias("sum"), F.concat(s["cdf"], F.array(total)).alias("cdf"))

    return F.aggregate(terms, state, step, lambda s: s["cdf"])


def source_rates(docs: DataFrame, temperature: float = TEMPERATURE, epochs: float = EPOCHS, targets: dict[str, float] | None = None) -> DataFrame:
    """source, n_docs, chars, rate: how often each document of a source is repeated on average.

    Targets: given weights by source, else each source's characters to the power `temperature`. rate = epochs * all
    characters * target share / own characters; a source without characters has rate 1. A null source is one source.
    """
    sums = docs.groupBy(F.col("source").cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("bigint")).alias("chars"))
    if targets:
        table = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(float(v)))])
        weight = F.coalesce(F.try_element_at(table, F.coalesce(F.col("source"), F.lit(""))), F.lit(0.0))
    else:
        weight = F.pow(F.col("chars").cast("double"), F.lit(float(temperature)))
    sums = sums.withColumn("weight", weight)
    total = sums.agg(F.sum("weight").alias("all_weight"), F.sum("chars").alias("all_chars"))  # one row
    rate = F.lit(float(epochs)) * F.col("all_chars").cast("double") * (F.col("weight") / F.col("all_weight")) / F.col("chars").cast("double")
    return sums.crossJoin(F.broadcast(total)).select("source", "n_docs", "chars", F.when((F.col("chars") > 0) & (F.col("all_weight") > 0), rate).otherwise(F.lit(1.0)).alias("rate"))


def keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """`docs` with `__mix_key`: what its draws are hashed from. No two rows have one key.

    The key is doc_id and the MD5 of the text. Only rows that share these are numbered, within the task that read them and
    by that task's number: equal rows never meet in one task, however many there are.
    """
    text = F.md5(F.coalesce(F.col("text").cast("string"), F.lit("\\N")).cast("binary"))
    docs = docs.withColumn("__mix_key", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("\\N")), text))
    again = scratch.keep(docs.groupBy(F.xxhash64("__mix_key").alias("__mix_hash")).count().where("count > 1").select("__mix_hash"), "again")
    if again.isEmpty():
        return docs
    other = [F.xxhash64(c) for c, t in docs.dtypes if not t.startswith(("map", "variant")) and "map<" not in t]
    part = docs.withColumns({"__mix_hash": F.xxhash64("__mix_key"), "__mix_part": F.spark_partition_id()})
    part = part.join(again.withColumn("__mix_again", F.lit(True)), "__mix_hash", "left")
    line = Window.partitionBy("__mix_key", "__mix_part").orderBy(*other)
    one = part.where("__mix_again is null")
    more = part.where("__mix_again").withColumn("__mix_key", F.concat_ws(":", "__mix_key", F.col("__mix_part").cast("string"), F.row_number().over(line).cast("string")))
    return one.unionByName(more).drop("__mix_hash", "__mix_part", "__mix_again")


def mix(docs: DataFrame, temperature: float = TEMPERATURE, epochs: float = EPOCHS, targets: dict[str, float] | None = None, seed: int = SEED) -> DataFrame:
    """All columns of `docs`, each row Poisson-repeated, with `copy` (from 0), `n_copies` and `position` (place in [0, 1) of the global shuffle).

    Rows are dealt over the cluster by position and sorted by it within each part, so a reader of the files in order sees the
    mixture. Null texts count no characters; a null doc_id or text is a value like any other; rows that repeat are drawn each
    for itself; an empty table stays empty. Columns of `docs` named copy, n_copies or position are replaced.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    rates = scratch.keep(source_rates(docs, temperature, epochs, targets).select("source", "rate").withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_RATE))), "source_rates")
    rates = scratch.keep(rates.select(F.col("source").alias("__mix_source"), F.col("draws").alias("__mix_draws"), poisson_cdf(F.col("rate") / F.col("draws")).alias("__mix_cdf")), "rates")
    # One row a source: sent to every task while that is small, else joined as any table, where Spark splits a hot source.
    if (rates.agg(F.sum(F.size("__mix_cdf"))).first()[0] or 0) <= MOST_BROADCAST:
        rates = F.broadcast(rates)
    keep = [c for c in docs.columns if c not in ("copy", "n_copies", "position")]
    drawn = keyed(docs.select(*keep), scratch).join(rates, F.col("source").cast("string").eqNullSafe(F.col("__mix_source")))
    drawn = drawn.withColumn("__mix_u", uniform(F.lit(str(seed)), F.col("__mix_key")))
    count = lambda v: F.size(F.filter("__mix_cdf", lambda c: c <= v))
    # transform keeps each further draw's number at one hash.
    further = F.transform(F.sequence(F.lit(2).cast("bigint"), F.col("__mix_draws")), lambda j: uniform(F.lit(f"{seed}/draw"), F.col("__mix_key"), j))
    more = F.aggregate(further, F.lit(0), lambda total, v: total + count(v))
    drawn = drawn.withColumn("n_copies", count(F.col("__mix_u")) + F.when(F.col("__mix_draws") > 1, more).otherwise(F.lit(0)))
    drawn = drawn.where(F.col("n_copies") > 0).select(*keep, "n_copies", "__mix_key", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    return drawn.withColumn("position", uniform(F.lit(f"{seed}/place"), F.col("__mix_key"), F.col("copy"))).drop("__mix_key")


def shuffled(mixed: DataFrame, partitions: int) -> DataFrame:
    """Deal rows over `partitions` by the hash of their position and sort each part by it: the global shuffle, one exchange."""
    return mixed.repartition(partitions, "position").sortWithinPartitions("position", "doc_id", "copy")
