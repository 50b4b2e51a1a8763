"""Personal data: patterns, and terms that disclose what the patterns find.

Patterns find identifiers (e-mail and IP addresses, card and phone numbers) and secrets (long hexadecimal keys). Protected
entities are their distinct values, the parts that many of them share (domain, network, issuer, number's prefix), and the kinds
themselves. A term discloses an entity as far as it determines it: pointwise mutual information between term and entity over
whole documents, divided by the entity's information content, is 1 if the term occurs in no document without the entity and
falls as it does:

    PMI(t; e) = log2(n_te * documents / (n_t * n_e)),  IC(e) = log2(documents / n_e)

n_e and n_te count distinct observations: a document's is what stands within CONTEXT characters of the entity's
places in it, so copies of a passage are one however their documents differ elsewhere. n_t is n_te and the documents
that have the term without the entity. Words that only by chance stand beside an entity are no evidence: a term needs at
least SUPPORT observations, and n_t times the divergence of its rate n_te / n_t from the entity's own rate must exceed
log2(documents) + EVIDENCE bits, which leaves chance the same small hope in a corpus of any size. Such terms are generalised (to the
concept that they disclose) from a disclosure of GENERALISE on and removed from REMOVE on, wherever they stand in any text.
Everything is built-in functions.

Spans are half-open code-point ranges. Null texts are empty. Rows with equal id and text get equal spans; ids
may be null. An empty table gives an empty result. Other columns are not read, or pass through `sanitise`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, fresh, row_key
from tessera.llm.native import let, located, matches, maybe_broadcast, text_or_empty, with_struct

#: The kinds of identifiers in the order of ties, and their patterns. The quantifiers are possessive and
#: runs are entered at their start only, which finds the same matches without trying a run again from inside it.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: What the method protects besides: keys of 32 and more hexadecimal digits that hold a letter and a digit.
SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
TERM = r"\p{L}{3,}"
CONTEXT, SUPPORT, EVIDENCE, GENERALISE, REMOVE = 48, 3, 10, 0.75, 0.9
_SPANS = "array<struct<start: int, rank: int, end: int, kind: string, value: string>>"


def _valid(kind: str, v: Column) -> Column:
    digits = F.regexp_replace(v, "[^0-9]", "")
    if kind == "ip":
        return v.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def identifiers(text: Column) -> Column:
    """Array of (start, rank, end, kind, value) of all identifiers in a text, by start and then kind."""

    def of(kind: str) -> Column:
        spans = F.filter(located(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
        spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["value"].alias("value")))
        needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind)
        none = F.expr(f"cast(array() as {_SPANS})")
        return spans if needs is None else F.when(needs, spans).otherwise(none)

    return F.sort_array(F.concat(*[of(k) for k in KINDS]))


def secrets(text: Column) -> Column:
    """Array of the same of all secrets."""
    found = F.filter(located(text, SECRET), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Fa-f]"))
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), s["end"].alias("end"), F.lit("secret").alias("kind"), s["value"].alias("value")))


def _entities(kind: Column, value: Column) -> Column:
    """Array of the protected entities of an identifier, as concept:value: itself, the part that it may share with others, and its kind."""
    value, digits = F.lower(value), F.regexp_replace(value, "[^0-9]", "")
    part = (
        F.when(kind == "email", F.concat(F.lit("email domain:"), F.substring_index(value, "@", -1)))
        .when(kind == "ip", F.concat(F.lit("ip network:"), F.substring_index(value, ".", 2)))
        .when(kind == "card", F.concat(F.lit("card issuer:"), F.substring(digits, 1, 6)))
        .when(kind == "phone", F.concat(F.lit("phone prefix:"), digits.substr(F.lit(1), F.length(digits) - 4)))
    )
    return F.array_compact(F.array(F.concat_ws(":", kind, value), part, F.concat(kind, F.lit(":"))))


def rendered(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _contexts(text: Column, spans: Column) -> Column:
    """Array of (entity, context) for every entity of every span: the context is a hash of what stands on both sides, cut at whole words."""

    def around(s: Column) -> Column:
        lo = F.greatest(s["start"] - CONTEXT, F.lit(0))
        left = text.substr(lo + 1, s["start"] - lo)
        right = text.substr(s["end"] + 1, F.lit(CONTEXT))
        left = F.when(lo > 0, F.regexp_replace(left, r"\A[\p{L}\p{N}]*+", "")).otherwise(left)
        right = F.when(F.length(right) < CONTEXT, right).otherwise(F.regexp_replace(right, r"[\p{L}\p{N}]*+\z", ""))
        return F.xxhash64(F.lower(left), F.lower(right))

    def both(s: Column) -> Column:
        return let(around(s), lambda c: F.transform(_entities(s["kind"], s["value"]), lambda e: F.struct(e.alias("entity"), c.alias("context"))))

    return F.flatten(F.transform(spans, both))


def found(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, k1, k2, spans, secrets, contexts) of every row, stored, so that texts are searched once."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    rows = rows.select("doc_id", "text", *row_key("doc_id", "text"))
    text_of = F.col("text")
    value = let(
        F.struct(identifiers(text_of).alias("spans"), secrets(text_of).alias("secrets")),
        lambda s: F.struct(s["spans"].alias("spans"), s["secrets"].alias("secrets"), _contexts(text_of, F.concat(s["spans"], s["secrets"])).alias("contexts")),
    )
    return cut(with_struct(rows, ["doc_id", "k1", "k2"], value))


def disclosing(docs: DataFrame, seen: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(k1, k2, start, end, action, concept): all places of terms that disclose an entity; seen is what `found` gave for docs."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    rows = rows.select("text", *row_key("doc_id", "text"))
    words = F.explode(F.array_distinct(F.transform(matches(F.col("text"), TERM), lambda w: F.xxhash64(F.lower(w))))).alias("term")
    holders = seen.select("k1", "k2", F.inline("contexts")).groupBy("k1", "k2", "entity").agg(F.xxhash64(F.sort_array(F.collect_set("context"))).alias("seen"))
    # an entity with fewer observations has no term with SUPPORT of them
    entities = holders.groupBy("entity").agg(F.count_distinct("seen").alias("n_e")).where(F.col("n_e") >= SUPPORT)
    holders = cut(holders.join(maybe_broadcast(cut(entities)), "entity"))
    owners = maybe_broadcast(holders.select("k1", "k2").distinct())
    terms = rows.join(owners, ["k1", "k2"], "left_semi").select("k1", "k2", words)
    pairs = terms.join(holders, ["k1", "k2"]).groupBy("entity", "term").agg(F.max("n_e").alias("n_e"), F.count_distinct("seen").alias("n_te"), F.count(F.lit(1)).alias("n_both"))
    pairs = cut(pairs.where(F.col("n_te") >= SUPPORT))
    candidates = maybe_broadcast(pairs.select("term").distinct())
    counts = rows.select(words).join(candidates, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_rows"))
    documents = F.lit(float(max(2, docs.count())))
    n_t = F.col("n_te") + F.col("n_rows") - F.col("n_both")
    pmi = F.log2(F.col("n_te") * documents / (n_t * F.col("n_e")))
    content = F.greatest(F.log2(documents / F.col("n_e")), F.lit(1e-9))
    rate, chance = F.least(F.col("n_te") / n_t, F.lit(1 - 1e-9)), F.least(F.col("n_e") / documents, F.lit(1 - 1e-9))
    evidence = F.when(rate > chance, n_t * (rate * F.log2(rate / chance) + (1 - rate) * F.log2((1 - rate) / (1 - chance)))).otherwise(0.0)
    judged = pairs.join(counts, "term").where(evidence >= F.log2(documents) + EVIDENCE)
    # of concepts that a term discloses alike the first by name
    judged = judged.groupBy("term").agg(F.min(F.struct((-pmi / content).alias("kept"), F.substring_index("entity", ":", 1).alias("concept"))).alias("most"))
    judged = cut(judged.where(F.col("most.kept") <= -GENERALISE).select("term", F.when(F.col("most.kept") <= -REMOVE, F.lit("")).otherwise(F.col("most.concept")).alias("concept")))
    hit = rows.select("k1", "k2", words).join(maybe_broadcast(judged), "term").groupBy("k1", "k2").agg(F.map_from_entries(F.collect_set(F.struct("term", "concept"))).alias("terms"))
    hit = cut(hit)
    places = F.transform(located(F.col("text"), TERM), lambda x: F.struct(F.element_at("terms", F.xxhash64(F.lower(x["value"]))).alias("concept"), x["start"].alias("start"), x["end"].alias("end")))
    places = F.filter(places, lambda x: x["concept"].isNotNull())  # before they are rows: most terms are no hit
    places = rows.join(hit, ["k1", "k2"]).select("k1", "k2", F.explode(places).alias("t"))
    action = F.when(F.col("t.concept") == "", F.lit("removed")).otherwise(F.lit("generalised"))
    return places.select("k1", "k2", "t.start", "t.end", action.alias("action"), F.col("t.concept").alias("concept")).distinct()


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, k1, k2, base, all): arrays of (start, rank, end, kind, value) by start, of the identifiers and of everything.

    Everything is identifiers, secrets and disclosing terms, whose value is the concept that generalises them. Terms that
    overlap an identifier or a secret are part of it and add nothing.
    """
    seen = found(docs, doc_id, text)
    extra = disclosing(docs, seen, doc_id, text)
    extra = extra.groupBy("k1", "k2").agg(F.collect_set(F.struct("start", F.lit(len(KINDS) + 1).alias("rank"), "end", F.col("action").alias("kind"), F.col("concept").alias("value"))).alias("extra"))
    found_spans = F.when(F.size("secrets") == 0, F.col("spans")).otherwise(F.sort_array(F.concat("spans", "secrets")))
    out = seen.select("doc_id", "k1", "k2", F.col("spans").alias("base"), found_spans.alias("found")).join(extra, ["k1", "k2"], "left")
    own = F.filter("extra", lambda x: ~F.exists("found", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return out.select("doc_id", "k1", "k2", "base", F.when(F.col("extra").isNull(), F.col("found")).otherwise(F.sort_array(F.concat("found", own))).alias("all"))


def masked(text: Column, all_spans: Column) -> Column:
    """The text with each span, or run of overlapping spans, replaced by its kind, or a generalised term's concept, in brackets; removed terms leave nothing."""
    start = F.struct(F.lit(0).alias("upto"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        mark = F.when(s["kind"] == "removed", F.lit("")).when(s["kind"] == "generalised", F.concat(F.lit("["), s["value"], F.lit("]"))).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        inside = s["start"] < acc["upto"]
        return F.struct(
            F.greatest(acc["upto"], s["end"]).alias("upto"),
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], text.substr(acc["upto"] + 1, s["start"] - acc["upto"]), mark)).alias("out"),
        )

    def finish(acc: Column) -> Column:
        return F.concat(acc["out"], text.substr(acc["upto"] + 1, F.greatest(F.length(text) - acc["upto"], F.lit(0))))

    return F.when(F.size(all_spans) == 0, text).otherwise(F.aggregate(all_spans, start, step, finish))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows, all their columns, with identifiers and disclosing terms masked in the text; null texts stay null."""
    a, b, own = fresh(docs, "k1", "k2", "spans")
    which = spans(docs, doc_id, text).where(F.size("all") > 0).select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("all").alias(own)).dropDuplicates([a, b])
    k1, k2 = row_key(F.col(doc_id), text_or_empty(text))
    keyed = docs.withColumns({a: k1, b: k2}).join(which, [a, b], "left")
    masked_text = F.when(F.col(own).isNull(), F.col(text)).otherwise(masked(F.col(text), F.col(own)))
    return keyed.withColumn(text, masked_text).select(*[F.col(f"`{c}`") for c in docs.columns])
