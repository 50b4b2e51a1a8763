"""Best-fit packing of token sequences under several capacities.

Every document is encoded, ended by an end id and, if too long, cut into pieces of the capacity. A bin
has three residual capacities: tokens, documents and attention cost (the sum of squared lengths). The
demand of a piece depends on its length alone, so the exact histogram of lengths, which has at most
`capacity` rows however many documents there are, is all that the planner needs: it runs vector best-fit in
decreasing length over groups of equal bins, each length going to the feasible group that scores best
by the weighted norm of the residual it would leave, or by the weighted dot product of demand and
residual. Pieces then find their slot by their rank among the pieces of the same length; ranks are
counted in salts of a length, so that a length shared by any part of the rows is spread.

Null and empty texts are a lone end id. Repeated rows are packed each. Ids may be null or repeat.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bpe import encoder
from tessera.llm.bytewords import runs
from tessera.llm.common import cut, id_field, map_arrow

#: Rows that one salt of a length has at most, about.
SALT_ROWS = 100_000
#: Weights of the three capacities in a score; tokens are what is scarce.
WEIGHTS = (1.0, 0.05, 0.05)


def encoded_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) for every piece of every document."""
    schema = T.StructType([id_field(docs, doc_id), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    if keep_ids:
        schema = schema.add("ids", T.BinaryType())

    def pieces(batch):
        for run in runs(batch.column(1)):
            ids, first = encoder(tokenizer).encode_run(run)
            row, piece, start, length, crc, kept = [], [], [], [], [], []
            for k in range(run.n):
                own = np.append(ids[first[k] : first[k + 1]], np.uint32(end_id)).astype("<u4")
                for at in range(0, len(own), capacity):
                    some = own[at : at + capacity].tobytes()
                    row.append(run.first + k)
                    piece.append(at // capacity)
                    start.append(at)
                    length.append(len(some) // 4)
                    crc.append(crc32(some))
                    kept.append(some)
            yield {"doc_id": batch.column(0).take(pa.array(row, pa.int64())), "piece": piece, "start": start, "length": length, "ids_crc32": crc} | ({"ids": kept} if keep_ids else {})

    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), pieces, schema)


def plan_bins(counts: dict[int, int], capacity: int = 4096, max_docs: int | None = None, max_attention: int | None = None, rule: str = "norm") -> tuple[np.ndarray, int]:
    """Slots (length, first rank, first bin, pieces a bin, offset in the bin) and the number of bins.

    The pieces of a length with ranks from a slot's first rank on go to its bins in turn, `pieces a bin`
    to each, up to the next slot's first rank.
    """
    caps = np.array([capacity, max_docs or capacity, max_attention or capacity * capacity], float)
    weights = np.array(WEIGHTS) / caps**2
    residual, many, first = np.zeros((1024, 3)), np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    n, bins, slots = 0, 0, []

    def add(left: np.ndarray, count: int, at: int) -> None:
        nonlocal n, residual, many, first
        if count and left.min() >= 1:
            if n == len(many):
                residual, many, first = np.concatenate([residual, np.zeros_like(residual)]), np.append(many, np.zeros_like(many)), np.append(first, np.zeros_like(first))
            residual[n], many[n], first[n] = left, count, at
            n += 1

    for length in sorted(counts, reverse=True):
        demand, todo, rank = np.array([length, 1, length * length], float), counts[length], 0
        if (demand > caps).any():
            raise ValueError(f"a piece of length {length} fits in no bin")
        while todo:
            fits = np.flatnonzero((residual[:n] >= demand).all(1) & (many[:n] > 0))
            if len(fits):
                left = residual[fits]
                score = (weights * (left - demand) ** 2).sum(1) if rule == "norm" else (weights * left * demand).sum(1)
                g = fits[np.argmin(score)]
                have, at, start = residual[g].copy(), int(first[g]), int(many[g])
                many[g] = 0
            else:
                have, at, start = caps.copy(), bins, -1
            per = int((have // demand).min())
            whole = todo // per if start < 0 else min(start, todo // per)
            used = 0
            for some, each in ((whole, per), (1, todo - whole * per)):
                if some and 0 < each <= per and (start < 0 or used + some <= start):
                    slots.append((length, rank, at + used, each, capacity - int(have[0])))
                    rank += some * each
                    todo -= some * each
                    add(have - demand * each, some, at + used)
                    used += some
            if start < 0:
                bins += used
            else:
                add(have, start - used, at + used)
        if n > 4096 and (many[:n] == 0).sum() > n // 2:
            keep = np.flatnonzero(many[:n] > 0)
            residual[: len(keep)], many[: len(keep)], first[: len(keep)] = residual[keep], many[keep], first[keep]
            n = len(keep)
    return np.array(slots, np.int64).reshape(-1, 5), bins


def pack(pieces: DataFrame, capacity: int = 4096, max_docs: int | None = None, max_attention: int | None = None, rule: str = "norm") -> DataFrame:
    """The pieces with sequence_id and offset. `pieces` is read twice: give a frame that is stored."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # `capacity` rows at most
    slots, _ = plan_bins(counts, capacity, max_docs, max_attention, rule)
    salts = max(16, max(counts.values(), default=0) // SALT_ROWS + 1)
    order = [c for c in pieces.columns if c != "length"]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64(*[F.col(c) for c in order if c != "ids"]), F.lit(salts)))
    base = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = base.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("length", "salt").orderBy(*order)
    ranked = salted.withColumn("rank", F.row_number().over(own) - 1).join(base, ["length", "salt"]).withColumn("rank", (F.col("rank") + F.col("base")).cast("long"))
    key = (slots[:, 0] << 44) + slots[:, 1]
    by = np.argsort(key)
    key, slots = key[by], slots[by]
    fields = [*pieces.columns, "rank"]
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batch):
        length, rank = (batch.column(fields.index(c)).to_numpy() for c in ("length", "rank"))
        slot = slots[np.searchsorted(key, (length << 44) + rank, "right") - 1]
        nth = rank - slot[:, 1]
        yield {c: batch.column(k) for k, c in enumerate(fields[:-1])} | {"sequence_id": slot[:, 2] + nth // slot[:, 3], "offset": slot[:, 4] + nth % slot[:, 3] * length}

    return map_arrow(ranked.select(*fields), place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """Encodes, cuts and packs documents; the encoded pieces are stored once for both passes."""
    return pack(cut(encoded_pieces(docs, tokenizer, capacity, end_id, doc_id, text)), capacity, **limits)
