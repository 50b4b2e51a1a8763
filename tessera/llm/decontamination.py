"""Benchmark decontamination by winnowing.

Texts are words; grams are GRAM consecutive words. In each window of WINDOW - GRAM + 1 grams the smallest
gram hash is kept, the leftmost of equal ones, so two texts that share WINDOW words share a kept gram. Documents'
kept grams are joined with the benchmark's; in the documents with a hit, each is extended to the WINDOW-word
windows around it, which must equal an item's by a 64-bit hash of their words. Items shorter than WINDOW words
are one window each and are looked up whole, by a hash for each such length. Everything is built-in functions.

The benchmark's fingerprints and windows are broadcast only when a count shows that they are few; else
the joins shuffle the documents' narrow fingerprint rows. Item ids of a window travel as the number of
their set, so a passage in many items adds one row to a document's hits.

Null texts have no words. Null item ids count as empty strings. Rows with equal id and text get equal
results. Empty documents or benchmarks give results without hits. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh, row_key
from tessera.llm.native import covered, hashed_lower, let, maybe_broadcast, split_words, text_or_empty, window_hashes, window_minima, with_struct

#: What stands between words, with A-Z in them still.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW, GRAM = 10, 5


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words, A-Z in lower case."""
    return hashed_lower(split_words(text, BETWEEN))


def winnowed(words: Column, window: int, gram: int) -> Column:
    """Of a bound array of word hashes: 33 bits of each kept gram's hash, and below them its place (31 bits)."""
    # with the place below the hash, the smallest is also the leftmost of equal ones
    grams = F.transform(window_hashes(words, gram), lambda h, i: F.shiftleft(F.shiftright(h, 31), 31).bitwiseOR(i.cast("long")))
    kept = let(grams, lambda g: F.array_distinct(window_minima(g, window - gram + 1)))
    return F.when(F.size(words) < window, F.expr("cast(array() as array<bigint>)")).otherwise(kept)


def windows_at(words: Column, starts: Column, width: int) -> Column:
    """Array of (start, hash) of the runs of `width` words of a bound array that begin at the given places."""
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.xxhash64(*[F.get(words, s + k) for k in range(width)]).alias("h")))


def whole_windows(words: Column, width: int) -> Column:
    """Array of (start, hash) of all runs of `width` words of a bound array."""
    empty = F.expr("cast(array() as array<struct<start: int, h: bigint>>)")
    return F.when(F.size(words) < width, empty).otherwise(windows_at(words, F.sequence(F.lit(0), F.size(words) - width), width))


def contaminated_words(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans): items with occurring windows, sorted, and the word spans (start, end) they hit."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    rows = rows.select("doc_id", "text", *row_key("doc_id", "text"))
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), word_hashes(text_or_empty(item_text)).alias("words"))
    items = with_struct(items, ["item"], F.struct(F.col("words").alias("w"), F.size("words").alias("n")))
    long_items, short_items = items.where(F.col("n") >= window), items.where((F.col("n") > 0) & (F.col("n") < window))
    lengths = sorted(r["n"] for r in short_items.select("n").distinct().collect())  # below `window` of them

    # the benchmark's windows, each with the set of items that have it
    windows = long_items.select("item", F.explode(whole_windows(F.col("w"), window)).alias("x")).select("item", "x.h", F.lit(window).alias("width"))
    for k in lengths:
        windows = windows.unionByName(short_items.where(F.col("n") == k).select("item", F.explode(whole_windows(F.col("w"), k)).alias("x")).select("item", "x.h", F.lit(k).alias("width")))
    sets = windows.groupBy("h", "width").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("set", F.xxhash64(F.concat_ws("\u0001", "items")))
    by_set = sets.groupBy("set").agg(F.first("items").alias("items"))
    known = maybe_broadcast(sets.select("h", "width", "set"))
    gram_of = lambda c: F.shiftright(c, 31).alias("gram")
    grams = maybe_broadcast(long_items.select(F.explode(winnowed(F.col("w"), window, gram)).alias("x")).select(gram_of("x")).distinct())

    # one pass over the texts: their kept grams, and a null that stands for the document itself
    hashes = word_hashes(F.col("text"))
    value = let(hashes, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.concat(winnowed(w, window, gram), F.array(F.lit(None).cast("bigint"))).alias("x")))
    prints = with_struct(rows, ["doc_id", "k1", "k2"], value).select("doc_id", "k1", "k2", "n_words", F.explode("x").alias("x"))
    prints = prints.select("doc_id", "k1", "k2", "n_words", gram_of("x"), F.col("x").bitwiseAND(F.lit((1 << 31) - 1)).cast("int").alias("place"))
    met = prints.join(grams.withColumn("met", F.lit(True)), "gram", "left").where(F.col("met") | F.col("gram").isNull())
    seen = met.groupBy("doc_id", "k1", "k2", "n_words").agg(F.count(F.when(F.col("gram").isNull(), 1)).alias("rows"), F.collect_set("place").alias("places"))
    seen = cut(seen)
    places = seen.where(F.size("places") > 0).select("k1", "k2", "places")
    # extension, in the documents with a hit: the windows that hold its gram
    around = lambda w: F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(F.greatest(p - (window - gram), F.lit(0)), F.least(p, F.size(w) - window)))))
    near = rows.join(maybe_broadcast(places), ["k1", "k2"])
    near = near.select("k1", "k2", F.explode(let(hashes, lambda w: windows_at(w, around(w), window))).alias("x")).select("k1", "k2", "x.start", "x.h", F.lit(window).alias("width"))
    for k in lengths:
        near = near.unionByName(rows.select("k1", "k2", F.explode(let(hashes, lambda w: whole_windows(w, k))).alias("x")).select("k1", "k2", "x.start", "x.h", F.lit(k).alias("width")))
    hits = near.join(known, ["h", "width"])
    spans = F.collect_set(F.struct("start", (F.col("start") + F.col("width")).alias("end")))
    hits = hits.groupBy("k1", "k2").agg(F.sort_array(spans).alias("spans"), F.collect_set("set").alias("sets"))
    named = hits.select("k1", "k2", F.explode("sets").alias("set")).join(maybe_broadcast(by_set), "set")
    named = named.groupBy("k1", "k2").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    out = seen.join(hits.select("k1", "k2", "spans").join(named, ["k1", "k2"]), ["k1", "k2"], "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))  # rows with equal id and text
    return out.select(
        "doc_id", "k1", "k2", "n_words",
        F.when(F.col("spans").isNull(), F.lit(0).cast("long")).otherwise(covered(F.col("spans"))).alias("n_hit"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start: int, end: int>>)")).alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, all their columns, without those that a benchmark window occurs in."""
    a, b = fresh(docs, "k1", "k2")
    found = contaminated_words(docs, benchmark, doc_id, text).where(F.col("n_hit") > 0).select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    k1, k2 = row_key(F.col(doc_id), text_or_empty(text))
    return docs.withColumns({a: k1, b: k2}).join(found, [a, b], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
