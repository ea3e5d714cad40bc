"""Agreement, error and rank statistics over DataFrames, and the few small-sample tests that run on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, clamped; null for n = 0."""
    p, z2 = k / F.nullif(n, F.lit(0)), z * z
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), mid - half)), F.when(ok, F.least(F.lit(1.0), mid + half))


def agreement(df: DataFrame, keys: list[str], a: str, b: str, classes: int) -> DataFrame:
    """n, n_excluded, agreement, kappa, macro_f1 (a class absent from both counts 1), macro_f1_zero (counts 0) per key.

    Nulls on either side are excluded. One pass: the confusion counts of every key, then closed forms.
    """
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    hit = lambda c: F.count_if(both & c).cast("double")
    aggs = [F.count_if(both).alias("n"), F.count_if(~both).alias("n_excluded"), hit(F.col(a) == F.col(b)).alias("_hit")]
    for c in range(classes):
        aggs += [hit(F.col(a) == c).alias(f"_a{c}"), hit(F.col(b) == c).alias(f"_b{c}"), hit((F.col(a) == c) & (F.col(b) == c)).alias(f"_t{c}")]
    out = (df.groupBy(*keys) if keys else df.groupBy()).agg(*aggs)
    n = F.nullif(F.col("n"), F.lit(0)).cast("double")
    po = F.col("_hit") / n
    pe = sum((F.col(f"_a{c}") * F.col(f"_b{c}") for c in range(1, classes)), F.col("_a0") * F.col("_b0")) / (n * n)
    f1 = lambda c, empty: F.when(F.col(f"_a{c}") + F.col(f"_b{c}") == 0, empty).otherwise(2 * F.col(f"_t{c}") / F.greatest(F.col(f"_a{c}") + F.col(f"_b{c}"), F.lit(1.0)))
    mean = lambda empty: sum((f1(c, empty) for c in range(1, classes)), f1(0, empty)) / classes
    out = out.withColumns({"agreement": po, "_pe": pe})
    kappa = F.when(F.col("_pe") >= 1, 1.0).otherwise(F.try_divide(F.col("agreement") - F.col("_pe"), 1 - F.col("_pe")))
    out = out.withColumns({"kappa": F.when(F.col("n") > 0, kappa), "macro_f1": F.when(F.col("n") > 0, mean(F.lit(1.0))), "macro_f1_zero": F.when(F.col("n") > 0, mean(F.lit(0.0)))})
    return out.select(*keys, "n", "n_excluded", "agreement", "kappa", "macro_f1", "macro_f1_zero")


def spearman(df: DataFrame, keys: list[str], x: str, y: str, name: str = "rho") -> DataFrame:
    """Rank correlation with average ranks for ties, over rows that have both, and n."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy(*keys).orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, c)) - 1) / 2.0

    ranked = both.withColumns({"_rx": rank(x), "_ry": rank(y)})
    return ranked.groupBy(*keys).agg(F.corr("_rx", "_ry").alias(name), F.count(F.lit(1)).alias("n"))


def pair_stats(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """n, bias mean, median, standard deviation, MAD about the median, Pearson r and regression slope, rows with both."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_d", F.col(x) - F.col(y))
    one = both.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_d").alias("bias"), F.percentile("_d", 0.5).alias("bias_median"), F.stddev_samp("_d").alias("bias_sd"), F.corr(x, y).alias("pearson"), F.regr_slope(y, x).alias("slope"))
    mad = both.join(one.select(*keys, "bias_median"), keys).groupBy(*keys).agg(F.percentile(F.abs(F.col("_d") - F.col("bias_median")), 0.5).alias("mad"))
    return one.join(mad, keys)


def holm(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """p_holm: step-down adjusted p-values within each key."""
    w = Window.partitionBy(*keys).orderBy(p)
    m = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    raw = F.least(F.lit(1.0), (m - F.row_number().over(w) + 1) * F.col(p))
    return df.withColumn("_r", raw).withColumn("p_holm", F.max("_r").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_r")


def mcnemar_exact(b: int, c: int) -> float:
    """Two-sided exact test on discordant pairs."""
    n, k = b + c, min(b, c)
    if n == 0:
        return 1.0
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def wilcoxon(differences: list[float]) -> tuple[float, float]:
    """(statistic, two-sided p) of the signed-rank test, normal approximation with tie correction; zeros are dropped."""
    d = sorted((x for x in differences if x), key=abs)
    n = len(d)
    if n == 0:
        return 0.0, 1.0
    ranks, i, ties = [0.0] * n, 0, 0.0
    while i < n:
        j = i
        while j < n and abs(d[j]) == abs(d[i]):
            j += 1
        for k in range(i, j):
            ranks[k] = (i + 1 + j) / 2
        ties += (j - i) ** 3 - (j - i)
        i = j
    plus = sum(r for r, x in zip(ranks, d, strict=True) if x > 0)
    minus = n * (n + 1) / 2 - plus
    t = min(plus, minus)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    if var <= 0:
        return t, 1.0
    return t, math.erfc(abs(t - n * (n + 1) / 4) / math.sqrt(var) / math.sqrt(2))


def mcnemar_p(b: Column, c: Column) -> Column:
    """mcnemar_exact as a Column: the binomial tail from its logarithmic terms."""
    n, k = b + c, F.least(b, c)
    start = F.struct((-n * math.log(2)).cast("double").alias("t"), F.lit(0.0).alias("s"))

    def step(acc, i):
        return F.struct((acc["t"] + F.log((n - i).cast("double")) - F.log((i + 1).cast("double"))).alias("t"), (acc["s"] + F.exp(acc["t"])).alias("s"))

    tail = F.aggregate(F.sequence(F.lit(0).cast("bigint"), k.cast("bigint")), start, step, lambda acc: acc["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def rank_sum_p(n: Column, t: Column) -> Column:
    """P(rank sum <= t), two-sided, of n ranks without ties, from the number of sets of ranks with each sum."""
    most = (n * (n + 1) / 2).cast("int")
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), most))

    def add(ways, r):
        return F.transform(ways, lambda w, s: w + F.when(s >= r, F.coalesce(F.get(ways, s - r), F.lit(0.0))).otherwise(0.0))

    ways = F.aggregate(F.sequence(F.lit(1), n.cast("int")), start, add)
    below = F.aggregate(F.slice(ways, F.lit(1), F.floor(t).cast("int") + 1), F.lit(0.0), lambda s, w: s + w)
    return F.when(n > 0, F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n.cast("double")))).otherwise(1.0)


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution, within 3e-7 (a rational approximation of the error function)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))  # fixed values
    return poly * F.exp(-x * x)


def signed_ranks(df: DataFrame, keys: list[str], d: str) -> DataFrame:
    """n, statistic, p_wilcoxon of the signed-rank test of each key's differences; zeros are dropped.

    Up to 50 differences without ties: exact; else by the normal approximation with tie correction. Ranks come from a window
    over a key's differences: one row a unit (home, day), not one an hour.
    """
    x = df.where(F.abs(F.col(d)) > 1e-12).withColumn("_a", F.round(F.abs(F.col(d)), 9))
    same = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_a"))
    x = x.withColumns({"_c": same, "_r": F.rank().over(Window.partitionBy(*keys).orderBy("_a")) + (same - 1) / 2.0})
    s = x.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(d) > 0, F.col("_r")).otherwise(0.0)).alias("_plus"), F.sum(F.col("_c") * F.col("_c") - 1).alias("_ties"))
    n = F.col("n").cast("double")
    stat = F.least(F.col("_plus"), n * (n + 1) / 2 - F.col("_plus"))
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    p = F.when((F.col("n") <= 50) & (F.col("_ties") == 0), rank_sum_p(F.least(F.col("n"), F.lit(50)), stat)).when(var > 0, normal_tail((stat - n * (n + 1) / 4) / F.sqrt(var))).otherwise(1.0)
    return s.withColumns({"statistic": stat, "p_wilcoxon": p}).select(*keys, "n", "statistic", "p_wilcoxon")


def bootstrap(groups: DataFrame, unit: str, value: str, weight: str, n: int = 1000, seed: int = 42) -> DataFrame:
    """estimate, low, high: percentile interval of sum(value) / sum(weight) resampling whole units, by Poisson weights.

    Each unit's weight in resample r is Poisson(1) drawn from a hash of (seed, r, unit): resamples are columns of one
    aggregate, the units are never collected, and a rerun gives the same interval.
    """
    unitwise = groups.groupBy(unit).agg(F.sum(value).alias("v"), F.sum(weight).alias("w"))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("r").cast("string"), F.col(unit).cast("string"))
    u = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint").cast("double") / 4294967296.0
    cdf, term, total = [], math.exp(-1), 0.0
    for k in range(12):
        total += term
        cdf.append(total)
        term /= k + 1
    copies = sum((F.when(u > c, 1).otherwise(0) for c in cdf[1:]), F.when(u > cdf[0], 1).otherwise(0))
    drawn = unitwise.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("k", copies)
    each = drawn.groupBy("r").agg(F.try_divide(F.sum(F.col("k") * F.col("v")), F.sum(F.col("k") * F.col("w"))).alias("s"))
    whole = unitwise.agg(F.try_divide(F.sum("v"), F.sum("w")).alias("estimate"))
    return each.agg(F.percentile("s", 0.025).alias("low"), F.percentile("s", 0.975).alias("high")).crossJoin(whole)


def f1(p: Column, r: Column) -> Column:
    """Null where precision or recall is null or both are 0."""
    return F.try_divide(2 * p * r, p + r)
