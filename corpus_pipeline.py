"""A corpus pipeline of five stages over the documents table.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but
the last return the columns of docs, extra ones too, whatever their names. Empty and null texts leave at the first stage, as
texts without a language; of rows with equal texts the second keeps one. Null ids take part. An empty table gives an empty result.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, jaccard_join, language_id, packing, pii, queries
from tessera.llm.common import checkpoint_folder, documents, drop_folder, fresh, held_out

#: Least score of a language prediction, if held-out rows do not ask for more; the winner of a clear vote has 0.5 or more.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: rejects those without letters and those less sure than nearly all labelled rows.

    The least score comes from labelled rows that the model has not learned from: the winner of two complementary
    machines always has 0.5, whatever the text. With a single language there is no margin, and only letters count.
    """
    apart = held_out("doc_id", 4)
    model = language_id.fit(docs, ~apart)
    least = max(MIN_LANGUAGE_SCORE, language_id.least_score(docs, model, apart))
    lang_pred, score = fresh(docs, "lang_pred", "score")
    marked = language_id.annotate(docs, model, lang_pred=lang_pred, score=score)
    return marked.where((F.col(lang_pred) != "und") & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; n_chars follows the text."""
    masked = pii.sanitise(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in packed sequences."""
    return packing.pack_documents(docs, queries.word_bpe(), queries.CAPACITY, queries.END_ID)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("personal_data", personal_data), ("pack", pack)]

#: The language model of the first stage and the tokenizer of the last are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; each one's rows are a Parquet table in the shared folder before the next reads them."""
    docs, folder = documents(spark, sf_dir), f"{checkpoint_folder(spark)}/pipeline-{uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
            if k:  # the last stage's input stays, as its rows are lazy
                drop_folder(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
