"""Exact length histogram: how many tokens there are, in all and under every context limit.

Documents are encoded once and aggregated by encoded length. Suffix sums over the histogram then give,
for every limit L, the documents of at least L tokens, their tokens, and the total when each document
is truncated at L, so quantiles and truncated totals need no second look at the documents.

Null and empty texts have length 0; repeated rows count each; an empty table gives an empty histogram.
Other columns are not read, so their names may clash with anything.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bpe import encoder
from tessera.llm.bytewords import runs
from tessera.llm.common import map_arrow

#: Lengths summed together at the upper level of the suffix sums.
BLOCK = 512


def encoded_lengths(docs: DataFrame, tokenizer: str, text: str = "text", extra: int = 0) -> DataFrame:
    """One row (length) for each document; extra is added to each, as for an end token."""

    def lengths(batch):
        for run in runs(batch.column(0)):
            _, first = encoder(tokenizer).encode_run(run)
            yield {"length": np.diff(first) + extra}

    return map_arrow(docs.select(F.col(text).cast("string").alias("text")), lengths, T.StructType([T.StructField("length", T.LongType())]))


def length_histogram(lengths: DataFrame) -> DataFrame:
    """(length, n_docs), by a partial and a final aggregate."""
    return lengths.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds to every length: n_tokens, docs_ge, tokens_ge, truncated_total and docs_lt_share.

    The sums run in two levels, within blocks of BLOCK lengths and over the blocks' totals, so no task
    gets more than the longest document's length / BLOCK rows.
    """
    h = histogram.withColumns({"n_tokens": F.col("length") * F.col("n_docs"), "block": F.floor(F.col("length") / BLOCK).cast("long")})
    above = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("d", "t")], F.sum("d").over(Window.partitionBy()).alias("d_all"), F.sum("t").over(Window.partitionBy()).alias("t_all"))
    inside = Window.partitionBy("block").orderBy(F.col("length").desc())
    h = h.join(blocks, "block")
    docs_ge, tokens_ge = F.sum("n_docs").over(inside) + F.col("d_above"), F.sum("n_tokens").over(inside) + F.col("t_above")
    h = h.withColumns({"docs_ge": docs_ge, "tokens_ge": tokens_ge})
    return h.select(
        "length", "n_docs", "n_tokens", "docs_ge", "tokens_ge",
        (F.col("t_all") - F.col("tokens_ge") + F.col("length") * F.col("docs_ge")).alias("truncated_total"),
        ((F.col("d_all") - F.col("docs_ge")) / F.col("d_all")).alias("docs_lt_share"),
    )


def totals_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: total and truncated tokens, and documents longer than it, from the sums alone."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    total = sums.agg(F.coalesce(F.max(F.col("tokens_ge")), F.lit(0)).alias("total"))
    over = sums.alias("s").join(F.broadcast(asked).alias("a"), F.col("s.length") > F.col("a.limit"))
    over = over.groupBy("limit").agg(F.sum("n_docs").alias("n_longer"), F.sum(F.col("n_docs") * (F.col("length") - F.col("limit"))).alias("lost"))
    joined = asked.join(over, "limit", "left").withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one", "left")
    return joined.select("limit", "total", (F.col("total") - F.coalesce("lost", F.lit(0))).alias("truncated"), F.coalesce("n_longer", F.lit(0)).alias("n_longer"))


def quantiles(sums: DataFrame, qs: list[float]) -> DataFrame:
    """For each q the least length that at least a share q of the documents does not exceed."""
    asked = sums.sparkSession.createDataFrame([(float(q),) for q in qs], "q double")
    upto = sums.withColumn("share", F.col("docs_lt_share") + F.col("n_docs") / (F.col("docs_ge") / (1 - F.col("docs_lt_share"))))
    hit = upto.join(F.broadcast(asked), F.col("share") >= F.col("q") - 1e-12)
    return hit.groupBy("q").agg(F.min("length").alias("length"))
