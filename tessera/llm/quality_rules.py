"""Quality rules: statistics of a text, and the frequency of its lines across documents.

Lines are normalised (lower case, blanks collapsed) and hashed. For every host the distinct documents
of each line are counted; lines that more than LINE_DOCUMENTS documents of the host have are
boilerplate and are removed, and a document that keeps less than KEEP_SHARE of its words is depleted
and rejected. Everything is built-in functions.

The counts are partial sums before the shuffle, so a line of any share of all documents costs one row
for each task. Common lines go back to the documents by a broadcast when a count shows that they are
few, else by a shuffled join whose hot lines are spread over SALTS.

Null texts have no words and fail the base rules; null hosts count as one host. Rows with equal id,
host and text count as one document and get the same verdict. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, row_key
from tessera.llm.native import BROADCAST_ROWS, covered, hashed, let, split_words, text_or_empty, window_hashes, with_struct

WORD, BLANKS = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
LINE_DOCUMENTS, KEEP_SHARE, SALTS = 50, 0.5, 32


def repeated_words(words: Column, width: int = 5) -> Column:
    """Number of words in windows of `width` words that the array has twice or more."""

    def flagged(h: Column) -> Column:
        return let(
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: covered(
                F.sort_array(
                    F.transform(
                        F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
                        lambda x: F.struct(x["i"].alias("start"), (x["i"] + width).alias("end")),
                    )
                )
            ),
        )

    unequal = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(flagged(h))
    return let(hashed(words), lambda w: F.when(F.size(w) < width, F.lit(0).cast("long")).otherwise(let(window_hashes(w, width), unequal)))


def statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """doc_id, host, the row's key (k1, k2), n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), text_or_empty(text).alias("text"))
    rows = rows.select("doc_id", "host", "text", *row_key("doc_id", "host", "text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    symbols = F.when(F.col("text").rlike(f"[{SYMBOLS}]"), F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).otherwise(F.lit(0))
    value = let(
        split_words(F.col("text"), BLANKS),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            symbols.cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )
    return with_struct(rows, ["doc_id", "host", "k1", "k2"], value)


def line_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(k1, k2, host, line, words): each document's distinct normalised lines, with the words of all their places."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), text_or_empty(text).alias("text"))
    rows = rows.select("host", "text", *row_key("doc_id", "host", "text"))
    lines = rows.select("k1", "k2", "host", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(WORD))
    words = lines.select("k1", "k2", "host", F.array_remove(F.split("line", BLANKS), "").alias("w"))
    return words.select("k1", "k2", "host", F.xxhash64(F.lower(F.array_join("w", " "))).alias("line"), F.size("w").alias("words"))


def common_lines(lines: DataFrame, most: int = LINE_DOCUMENTS) -> DataFrame:
    """(host, line) of lines that more than `most` distinct documents of a host have."""
    counts = lines.select("host", "line", "k1", "k2").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs"))
    return counts.where(F.col("n_docs") > most).select("host", "line")


def removed_words(lines: DataFrame, common: DataFrame) -> DataFrame:
    """(k1, k2, removed): words of each document that stand in common lines."""
    common = common.select(F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), "line")
    lines = lines.select("k1", "k2", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), "line", "words")
    if common.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        hit = lines.join(F.broadcast(common), ["host", "no_host", "line"], "left_semi")
    else:
        spread = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        hit = lines.withColumn("salt", F.pmod(F.col("k1"), F.lit(SALTS)).cast("int")).join(spread, ["host", "no_host", "line", "salt"], "left_semi")
    return hit.groupBy("k1", "k2").agg(F.sum("words").alias("removed"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", most: int = LINE_DOCUMENTS, keep: float = KEEP_SHARE) -> DataFrame:
    """Statistics of every row with n_removed, base_failed and kept."""
    stats = cut(statistics(docs, doc_id, text, host))  # a few numbers a row, used twice
    lines = line_rows(docs, doc_id, text, host)  # read twice: storing them would cost more than finding them again
    removed = removed_words(lines, common_lines(lines, most))
    # rows with equal keys each put their words into the sum; their share of the words is the same
    copies = stats.groupBy("k1", "k2").agg(F.sum("n_words").alias("all_words"))
    removed = removed.join(copies, ["k1", "k2"]).select("k1", "k2", (F.col("removed") / F.col("all_words")).alias("share"))
    out = stats.join(removed, ["k1", "k2"], "left")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    share = F.coalesce("share", F.lit(0.0))
    return out.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.round(share * F.col("n_words")).cast("long").alias("n_removed"), failed.alias("base_failed"), (~failed & (share <= 1 - keep)).alias("kept"))
