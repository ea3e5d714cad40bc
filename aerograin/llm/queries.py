"""The registered queries of this subpackage, one an operator, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from . import chroma, ctxmix, langid, mixing, packing, partenum, pii, secrets, textdensity, winnowing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` mixed to square-root-tempered source weights, in global shuffle order."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.shuffled(mixed, shuffle_partitions(spark))


def op2_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings rendered from all `embeddings`, fingerprinted; those with vec_id divisible by 20 searched against all."""
    prints = chroma.fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", chroma.rendered)
    return chroma.search(prints, lambda i: i % 20 == 0)


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all `documents`, and their likeness to an edited text and to the next document."""
    return winnowing.compare(table(spark, sf_dir, "documents"), 4 * shuffle_partitions(spark))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all `pages`."""
    return textdensity.extract(table(spark, sf_dir, "pages"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of `documents` linked by a 5-word shingle Jaccard similarity of 0.75 or more."""
    return partenum.near_groups(table(spark, sf_dir, "documents"))


def vocabulary() -> dict:
    import public_tokenizers

    return {"json_path": public_tokenizers.path("byte_bpe_50k.json"), "rank_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), **vocabulary())


def crc_fold(doc_id, folds: int):
    """crc32 of doc_id as text, modulo `folds`."""
    return F.crc32(doc_id.cast("bigint").cast("string").cast("binary")) % folds


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all `documents`."""
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs.select("doc_id", "text"), secrets.train(docs))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex", "markov")]
    return found.select("doc_id", *counts, F.sha2(secrets.written(F.col("base")).cast("binary"), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all `documents`."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs))
    digest = F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", digest, pii.written(F.concat("base", "added")).alias("spans"), F.size("added").cast("bigint").alias("n_added"))


def op9_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all `documents` by a model of those whose crc32(doc_id) mod 5 is not 1."""
    docs = table(spark, sf_dir, "documents")
    return ctxmix.score(docs, crc_fold(F.col("doc_id"), 5) == 1)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all `documents`; learned from those whose crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(crc_fold(F.col("doc_id"), 4) != 2))
    scored = langid.identify(docs, model)
    return scored.select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_chroma_fingerprints": op2_chroma_fingerprints,
    "op3_winnowing": op3_winnowing,
    "op4_html_main_text": op4_html_main_text,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_secret_scan": op7_secret_scan,
    "op8_personal_data": op8_personal_data,
    "op9_context_mixing": op9_context_mixing,
    "op10_language_id": op10_language_id,
}

SQL = {
    "op1_mix_sources": """
WITH sums AS (
  SELECT source, sum(coalesce(length(text), 0))::BIGINT AS chars FROM documents GROUP BY source),
w AS (SELECT *, pow(chars::DOUBLE, 0.5) AS weight FROM sums),
rates AS (
  SELECT source, CASE WHEN chars > 0 AND (SELECT sum(weight) FROM w) > 0
    THEN (SELECT sum(chars) FROM w)::DOUBLE * (weight / (SELECT sum(weight) FROM w)) / chars::DOUBLE ELSE 1.0 END AS rate
  FROM w),
split AS (SELECT source, greatest(1, ceil(rate / 500))::BIGINT AS draws, rate / greatest(1, ceil(rate / 500)) AS r FROM rates),
terms AS (
  SELECT source, k, CASE WHEN k = 0 THEN exp(-r) ELSE exp(-r + k * ln(r) - lgamma(k + 1)) END AS term
  FROM split, (SELECT unnest(range(0, 800)) AS k) ks
  WHERE k <= ceil(r + 12 * sqrt(r) + 20)),
cdf AS (SELECT source, sum(term) OVER (PARTITION BY source ORDER BY k) AS below FROM terms),
keyed AS (SELECT *, row_number() OVER () AS row_id, coalesce(doc_id::VARCHAR, '\\N') || ':' || md5(coalesce(text, '\\N')) AS key FROM documents),
drawn AS (
  SELECT k.row_id, k.source, ('0x' || substr(md5(CASE WHEN j = 1 THEN '17:' || key ELSE '17/draw:' || key || ':' || j END), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
  FROM (SELECT k.row_id, k.source, k.key, unnest(range(1, s.draws + 1)) AS j FROM keyed k JOIN split s ON k.source IS NOT DISTINCT FROM s.source) k),
counted AS (
  SELECT k.*, n.n_copies::INTEGER AS n_copies
  FROM keyed k JOIN (SELECT row_id, sum((SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM drawn.source AND c.below <= drawn.u)) AS n_copies FROM drawn GROUP BY row_id) n USING (row_id))
SELECT doc_id, text, lang, source, n_chars, n_copies, copy::INTEGER AS copy,
  ('0x' || substr(md5('17/place:' || key || ':' || copy), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS position
FROM (SELECT *, unnest(range(0, n_copies)) AS copy FROM counted WHERE n_copies > 0)
""",
}
