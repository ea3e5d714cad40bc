"""Language identification by a string kernel.

Kernel: the blended spectrum over 1- to 4-grams of bytes, presence only, k(x, z) = |G(x) ∩ G(z)| / sqrt(|G(x)| |G(z)|).
G is kept as hashed bits. Nyström: m landmarks Z drawn from the labelled sample give the map φ(x) = k(x, Z) L^-T with
K(Z, Z) + εI = L L^T. One kernel ridge regression a language on φ; documents are scored in batches, two matrix products each.
The labelled sample is bounded by SAMPLE_PER_LANG documents a language and SAMPLE_MOST in all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch, ship
from .arrays import LOWER, U64, blocks, mix

BITS = 14
GRAMS = (1, 2, 3, 4)
LANDMARKS = 192
SAMPLE_PER_LANG = 600
SAMPLE_MOST = 24_000
RIDGE = 1e-2
UNKNOWN = "und"
SHARPNESS = 6.0

_NOT_LETTERS = r"^\P{L}*$"


def presence(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> np.ndarray:
    """One row of 2^bits flags per document: the hashed n-grams (1 to 4 bytes, A-Z lower-cased) that occur in it."""
    n_docs = len(offsets) - 1
    out = np.zeros((n_docs, 1 << bits), dtype=np.float32)
    low = LOWER[data].astype(np.uint64)
    for n in GRAMS:
        if len(low) < n:
            break
        packed = low[: len(low) - n + 1].copy()
        for j in range(1, n):
            packed |= low[j : len(low) - n + 1 + j] << U64(8 * j)
        slot = (mix(packed | U64(n << 40)) >> U64(64 - bits)).astype(np.int64)
        for d in range(n_docs):
            out[d, slot[offsets[d] : max(offsets[d], offsets[d + 1] - n + 1)]] = 1.0
    return out


@dataclass
class KernelModel:
    """Everything scoring needs; at most LANDMARKS x 2^BITS floats, whatever the corpus."""

    languages: list[str]
    landmarks: np.ndarray  # m x 2^bits, rows already divided by their norm
    weights: np.ndarray  # m x languages, the Nyström map and the ridge solutions in one

    def decisions(self, flags: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(flags.sum(axis=1, dtype=np.float64), 1.0))
        kernel = (flags @ self.landmarks.T) / norm[:, None]
        return kernel @ self.weights


def fit(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """`bits`: packed flags, a row a document; they are unpacked some hundred rows at a time.

    Landmarks: round robin over the languages in the order given. Ties between languages go to the first by name.
    """
    languages = sorted(set(labels))
    where = {g: [i for i, x in enumerate(labels) if x == g] for g in languages}
    chosen: list[int] = []
    while len(chosen) < min(landmarks, len(labels)):
        for g in languages:
            if where[g] and len(chosen) < landmarks:
                chosen.append(where[g].pop(0))

    def unit(rows: np.ndarray) -> np.ndarray:
        flags = np.unpackbits(rows, axis=1).astype(np.float32)
        return flags / np.sqrt(np.maximum(flags.sum(axis=1, keepdims=True), 1.0))

    z = unit(bits[chosen])
    kernel = np.concatenate([(unit(bits[i : i + 256]) @ z.T).astype(np.float64) for i in range(0, len(bits), 256)])
    low = np.linalg.cholesky(kernel[chosen] + 1e-4 * np.eye(len(z)))
    phi = np.linalg.solve(low, kernel.T).T
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    share = np.array([labels.count(g) for g in labels], dtype=np.float64)
    w = len(labels) / (len(languages) * share)  # each language weighs the same
    alpha = np.linalg.solve((phi * w[:, None]).T @ phi + ridge * len(labels) * np.eye(len(z)) / 10, (phi * w[:, None]).T @ y)
    return KernelModel(languages, z, np.linalg.solve(low.T, alpha).astype(np.float32))


def drawn(rows: DataFrame, per_label: int) -> DataFrame:
    """label, draw: the `per_label` smallest distinct draws of every label of `rows` (label, draw: 64 bits, even).

    Only draws under a threshold meet in a task: about `per_label` of each label, as its count tells, whatever the count.
    """
    rows = rows.distinct()
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    spare = 1.0
    while True:
        share = F.least(F.lit(1.0), F.lit(spare * (per_label + 6 * per_label**0.5 + 20)) / F.col("n"))
        under = rows.join(counts.select("label", share.alias("share")), "label").where((F.col("draw").cast("double") / 2.0**64 + 0.5) <= F.col("share"))
        kept = under.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("draw"))).where(F.col("r") <= per_label)
        short = counts.join(kept.groupBy("label").agg(F.count(F.lit(1)).alias("k")), "label", "left").where(F.coalesce("k", F.lit(0)) < F.least("n", F.lit(per_label)))
        if short.isEmpty():  # else by a chance of one in 10^9: more are looked at
            return kept.select("label", "draw")
        spare *= 4


def train(docs: DataFrame, label: str = "lang", per_lang: int = SAMPLE_PER_LANG, landmarks: int = LANDMARKS, most: int = SAMPLE_MOST) -> KernelModel | None:
    """Fit on at most `per_lang` labelled documents of each language (fewer where that makes more than `most` in all).

    They are those with the smallest hashes of (doc_id, text), repeated rows once; null labels and texts without letters
    are not used. Every language has a landmark at least. The sample travels as bits (2 KB a document). No label: None.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "langid")
    docs = docs.select("doc_id", label, "text")
    rows = docs.where(F.col(label).isNotNull() & F.col("text").isNotNull() & ~F.col("text").rlike(_NOT_LETTERS))
    rows = rows.select(F.col(label).cast("string").alias("label"), F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).alias("draw"), F.col("text").cast("string").alias("text"))
    draws = scratch.keep(rows.select("label", "draw"), "draws")
    n_labels = draws.select("label").distinct().count()
    if not n_labels:
        return None
    per_lang, landmarks = max(1, min(per_lang, most // n_labels)), max(landmarks, n_labels)
    chosen = scratch.keep(drawn(draws, per_lang), "chosen")  # at most `most` rows, or one a language
    sample = rows.join(F.broadcast(chosen), ["label", "draw"]).select("draw", "label", "text")

    def encode(batches):
        from aerograin.llm import langid as own

        seen = set()
        for batch, data, offsets in blocks(batches):
            fresh = [k not in seen and not seen.add(k) for k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            bits = np.packbits(own.presence(data, offsets).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.tobytes() for b in bits], pa.binary())], ["draw", "label", "bits"]).filter(pa.array(fresh, pa.bool_()))

    got = sample.mapInArrow(encode, "draw bigint, label string, bits binary").dropDuplicates(["draw", "label"]).collect()
    got.sort(key=lambda r: (r["draw"], r["label"]))
    return fit(np.array([np.frombuffer(r["bits"], np.uint8) for r in got]), [r["label"] for r in got], landmarks)


def tagged(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """All columns of `docs` with lang_pred and score (columns of these names are replaced), from the whole text alone.

    A null text, or one without a letter, is `und` with score 0; so is every document where there is no model. The score is
    the softmax of the decision values, 0 to 1. Rows that repeat are scored alike; an empty table stays empty.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def score(batches):
        from aerograin.llm import langid as own

        m = shared.value
        for batch, data, offsets in blocks(batches, text="__tag_text", size=1 << 18):
            letters = batch.column(len(names) + 1).to_numpy(zero_copy_only=False)
            found, scores = [], np.zeros(batch.num_rows)
            for at in range(0, batch.num_rows, 64):
                to = min(at + 64, batch.num_rows)
                if m is None:
                    found += [own.UNKNOWN] * (to - at)
                    continue
                part = offsets[at : to + 1]
                f = m.decisions(own.presence(data[part[0] : part[-1]], part - part[0]))
                e = np.exp(own.SHARPNESS * (f - f.max(axis=1, keepdims=True)))
                best = f.argmax(axis=1)
                p = e[np.arange(to - at), best] / e.sum(axis=1)
                ok = letters[at:to].astype(bool)
                found += [m.languages[b] if k else own.UNKNOWN for b, k in zip(best, ok, strict=True)]
                scores[at:to] = np.where(ok, p, 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(found, pa.string()), pa.array(scores)], [*names, "lang_pred", "score"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("*", text.alias("__tag_text"), (~text.rlike(_NOT_LETTERS)).alias("__tag_letters")).mapInArrow(score, schema)


def identify(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """doc_id, lang_pred, score of every row: tagged() without the other columns."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return tagged(slim, model).select("doc_id", "lang_pred", "score")
