"""From raw documents to packed training sequences, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame. Its result is written as Parquet and read again as the next
one's docs; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerograin.llm import langid, mixing, packing, partenum, secrets
from aerograin.llm.queries import vocabulary
from aerograin.session import Scratch, shuffle_partitions

#: Below this softmax value no language stands out (four languages at random give 0.25).
LEAST_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told: those without a letter, or with no language that stands out, go.

    The model learns from all labelled documents; without any label only documents without a letter go. Null and empty
    texts have no letter. A text is read whole, however long; rows that repeat are judged alike; an empty table stays empty.
    """
    model = langid.train(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = langid.tagged(docs, model)
    return told.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a shingle similarity of 0.75 or more: the one with the smallest doc_id.

    Decided row by row: rows that share or lack a doc_id are documents of their own unless their texts are near copies.
    Rows without a word (null, empty or blank texts) are in no group and all stay; an empty table stays empty.
    """
    return partenum.deduplicated(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by a mark and n_chars counted anew where the text changed.

    A null text stays null, an empty one empty; very long texts are read whole; repeated rows each give one row.
    """
    found = secrets.scan(docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text"), secrets.train(docs))
    found = found.select("_row", (F.size("spans") > 0).alias("_changed"), secrets.redacted(F.col("text"), F.col("spans")).alias("_clean"))
    made = {"text": F.col("_clean"), "n_chars": F.when(F.col("_changed"), F.length("_clean").cast("bigint")).otherwise(F.col("_row.n_chars"))}
    return found.select(*[made[c].alias(c) if c in made else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to square-root-tempered source weights, in global shuffle order.

    A null source is one source; rows that repeat, or lack a doc_id, are drawn each for itself; texts are not read but for
    their length and hash. An empty table stays empty.
    """
    return mixing.shuffled(mixing.mix(docs), shuffle_partitions(spark)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 2048 tokens.

    A null or empty text is one piece, its end id; longer texts are cut; rows that repeat are packed each. An empty table
    gives an empty result.
    """
    return packing.pack(docs, **vocabulary())


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("secret_scan", without_secrets),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

#: SQL has neither the language model nor the join by signatures: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
