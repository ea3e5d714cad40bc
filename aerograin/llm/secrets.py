"""Secret scans, with DataFrame functions only.

Three kinds are found by pattern (assign, access, hex). A fourth, markov, by two first-order Markov models over characters,
one of random strings and one of ordinary identifiers: a token is a secret where the log-likelihood ratio of the two is
high in sum and on average. Both are counted from labelled strings: ordinary ones are the words of a bounded sample of
documents (SAMPLE_DOCS) outside pattern finds, and names composed of neighbouring words (snake, camel and kebab case,
constants, paths, with numbers and dates); random ones are drawn from hashes in the alphabets of real credentials (hex of
either case, base 64, letters and digits of both or one case, 12 to 40 long). Spans are (start, end) in code points, end exclusive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "markov")

# The patterns of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"

#: A token for the Markov models: a whole run of these, at least 12 long, with a letter and a digit or a capital after a small letter.
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{12})(?:(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])|(?=[A-Z0-9+/_=-]*+[a-z]++(?:[0-9+/_=-]++[a-z]*+)*+[A-Z]))[A-Za-z0-9+/_=-]{12,}+"
LEAST_SUM = 8.0
LEAST_MEAN = 0.45
RANDOM_STRINGS = 6000
SAMPLE_DOCS = 1000
STATES = 63

SPAN = "array<struct<start:int,rank:int,end:int>>"


def let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def state(char: Column) -> Column:
    """0-25 lower case, 26-51 upper case, 52-61 digits, 62 anything else."""
    a = F.ascii(char)
    return F.when((a >= 97) & (a <= 122), a - 97).when((a >= 65) & (a <= 90), a - 39).when((a >= 48) & (a <= 57), a + 4).otherwise(F.lit(STATES - 1))


def matches(text: Column, pattern: str, hint: Column, rank: int, keep=None, group: int | None = None) -> Column:
    """Spans of all matches, leftmost and not overlapping; keep(match, group text) says which stay.

    The text between matches gives their places: no engine function returns them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group is not None else found
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast(SPAN)
    zipped = F.arrays_zip(F.transform(gaps, lambda g: F.length(g)).alias("gap"), F.transform(found, lambda m: F.length(m)).alias("len"), value.alias("value"))
    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc, m):
        begin = acc["at"] + m["gap"]
        end = begin + F.coalesce(m["len"], F.lit(0))
        span = F.array(F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        ok = m["len"].isNotNull()
        if keep is not None:
            ok = ok & keep(m["value"])
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.when(hint, F.aggregate(zipped, start, step, lambda acc: acc["spans"])).otherwise(empty)


def ratio(token: Column, table: Column) -> Column:
    """Log-likelihood ratio (random over ordinary) of a token's transitions, in nats."""
    codes = F.transform(F.split(token, ""), state)
    steps = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda a, b: F.get(table, a * STATES + b))
    return F.aggregate(let(codes, steps), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def composed(one: Column, two: Column) -> Column:
    """A name made of two words, in one of eight ways that their hash picks."""
    a, b, h = F.lower(one), F.lower(two), F.xxhash64(one, two)
    pick = lambda shift, n: F.pmod(F.shiftright(h, shift), F.lit(n))
    number = F.pmod(h, F.element_at(F.array(*[F.lit(10**k) for k in range(1, 9)]), (pick(30, 8) + 1).cast("int"))).cast("string")
    date = lambda gap: F.concat_ws(gap, (pick(8, 40) + 1990).cast("string"), F.lpad((pick(16, 12) + 1).cast("string"), 2, "0"), F.lpad((pick(24, 28) + 1).cast("string"), 2, "0"))
    forms = F.array(F.concat_ws("_", a, b, number), F.concat(a, F.initcap(b), number), F.concat_ws("-", a, b, number), F.concat_ws("_", F.upper(a), F.upper(b), number), F.concat(a, date("")), F.concat_ws("_", a, date("-")), F.concat(F.initcap(a), F.initcap(b)), F.concat_ws("/", a, b, number))
    return F.element_at(forms, (pick(40, 8) + 1).cast("int"))


def random_strings(spark: SparkSession, n: int, seed: str = "") -> DataFrame:
    """label random, s: strings of 12 to 40 characters in six alphabets, from hashes of the seed and their number."""
    i = F.concat(F.lit(seed), F.col("id").cast("string"))
    hex_ = F.substring(F.sha2(F.concat(F.lit("h"), i).cast("binary"), 256), 1, 40)
    b64 = F.substring(F.regexp_replace(F.base64(F.unhex(F.sha2(i.cast("binary"), 512))), r"[\r\n=]", ""), 1, 80)
    plain = F.regexp_replace(b64, "[+/]", "")
    forms = F.array(hex_, F.upper(hex_), b64, plain, F.lower(plain), F.upper(plain))
    made = F.element_at(forms, (F.col("id") % 6 + 1).cast("int"))
    return spark.range(n).select(F.lit("random").alias("label"), F.substring(made, F.lit(1), (F.lit(12) + F.pmod(F.xxhash64(i), F.lit(29))).cast("int")).alias("s"))


def train(docs: DataFrame, sample: int = SAMPLE_DOCS) -> list[float]:
    """The table of log ratios, STATES x STATES: learned from `sample` documents (smallest hashes of doc_id and text, repeated
    rows once) and RANDOM_STRINGS random strings.

    Only transition counts, at most two tables of STATES x STATES, come to the driver. Null texts give nothing; with no
    document the ordinary model is flat.
    """
    spark = docs.sparkSession
    docs = docs.select(F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).alias("draw"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull())
    chosen = docs.select("draw").distinct().orderBy("draw").limit(sample)
    clean = F.regexp_replace("text", f"{ASSIGN}|{ACCESS}|{HEX}", " ")
    texts = docs.join(F.broadcast(chosen), "draw").dropDuplicates(["draw"]).select(clean.alias("text"))
    runs = texts.select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("s")).where(~F.col("s").rlike(TOKEN))
    word = F.col("w")
    pair = F.zip_with(F.slice(word, 1, F.greatest(F.size(word) - 1, F.lit(0))), F.slice(word, 2, F.greatest(F.size(word) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    names = texts.select(F.regexp_extract_all("text", F.lit(r"[A-Za-z]{2,}"), F.lit(0)).alias("w")).select(F.explode(pair).alias("p")).select(composed(F.col("p.a"), F.col("p.b")).alias("s"))
    words = runs.unionByName(names).select(F.lit("ordinary").alias("label"), "s")
    chars = words.unionByName(random_strings(spark, RANDOM_STRINGS)).select("label", F.transform(F.split("s", ""), state).alias("c"))
    pairs = chars.select("label", F.explode(F.zip_with(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), lambda a, b: a * STATES + b)).alias("pair"))
    counts = {k: np.full(STATES * STATES, 0.5) for k in ("ordinary", "random")}
    for r in pairs.groupBy("label", "pair").count().collect():
        counts[r["label"]][r["pair"]] += r["count"]
    log = {k: np.log(c.reshape(STATES, STATES) / c.reshape(STATES, STATES).sum(axis=1, keepdims=True)) for k, c in counts.items()}
    return (log["random"] - log["ordinary"]).ravel().round(6).tolist()


def scan(docs: DataFrame, table: list[float]) -> DataFrame:
    """`docs` with assign, access, hex, markov (each array of (start, rank, end)), base and spans (sorted unions).

    Null texts read as empty. Base spans of different kinds may overlap and all stay; a markov span overlaps none of them.
    Columns of these names are replaced; all others are kept. A text is read whole; rows that repeat give a row each; an
    empty table stays empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    llr = F.col("_llr")
    got = docs.withColumn("_t", text).withColumn("_llr", F.array(*[F.lit(x) for x in table]))
    got = got.withColumn("assign", matches(F.col("_t"), ASSIGN, F.col("_t").rlike(ASSIGN_HINT), 0, lambda v: F.length(v) >= 12, 2))
    got = got.withColumn("access", matches(F.col("_t"), ACCESS, F.col("_t").contains("AKIA"), 1))
    got = got.withColumn("hex", matches(F.col("_t"), HEX, F.col("_t").rlike(HEX), 2))
    likely = lambda v: let(ratio(v, llr), lambda s: (s >= LEAST_SUM) & (s >= LEAST_MEAN * (F.length(v) - 1)))
    got = got.withColumn("markov", matches(F.col("_t"), TOKEN, F.col("_t").rlike(TOKEN), 3, likely))
    got = got.withColumn("base", F.array_sort(F.concat("assign", "access", "hex")))
    free = F.filter("markov", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    got = got.withColumn("markov", free).withColumn("spans", F.array_sort(F.concat("base", "markov")))
    return got.drop("_t", "_llr")


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones joined, replaced by a mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text)))))
