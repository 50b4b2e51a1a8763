"""Document quality by a factorisation machine.

Features of a text: its words, hashed; structure statistics; and its length as metadata. The machine adds
to the linear part every pairwise interaction of features at low rank. By the identity
sum_{i<j} <v_i, v_j> x_i x_j = (|sum_i v_i x_i|^2 - sum_i |v_i|^2 x_i^2) / 2
a text is scored in time linear in its distinct words.

Null and empty texts have no words and get the score of their statistics. Without labelled rows of
both classes every score is the share of label 1 (0.5 without any). Repeated rows are scored each; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bytewords import Run, runs, span_hashes
from tessera.llm.common import id_field, map_arrow

BUCKETS, RANK = 1 << 14, 8
#: Labelled rows that the machine is fitted on, at most (those of the least hashes).
TRAIN_ROWS = 6000
#: Names of the structure statistics and metadata; each is scaled to about 0..1.
STATISTICS = ("symbols", "bangs", "upper", "digits", "blanks", "other", "high", "word_length", "long_words", "lines", "distinct_words", "repeated_lines", "ends_with_sign", "sentence", "n_words", "n_chars")


def _of(*chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in "".join(chars)]] = True
    return table


_KINDS = [_of("#*$%&|<>"), _of("!"), _of("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _of("0123456789"), _of(" \t\n\r"), _of("\"'()[]{}/\\@^_~`+=-:;?"), np.arange(256) >= 0x80]


def features(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a run: for each (document, bucket) the document, the bucket and x, sorted; and the statistics matrix."""
    n, data, off = run.n, run.data, run.offsets
    size = np.maximum(np.diff(off), 1)
    starts, ends, first = run.words()
    doc = np.repeat(np.arange(n), np.diff(first))
    words = np.maximum(np.diff(first), 1)
    stats = np.zeros((n, len(STATISTICS)))

    def sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[edges[1:]] - total[edges[:-1]]

    for k, kind in enumerate(_KINDS):
        stats[:, k] = sums(kind[data], off) / size
    length = ends - starts
    stats[:, 7] = sums(np.minimum(length, 40), first) / words / 20
    stats[:, 8] = sums(length > 20, first) / words
    stats[:, 9] = np.minimum(1, 10 * sums(data == 10, off) / words)
    h = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    key, count = np.unique((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)), return_counts=True)
    of = (key >> np.uint64(40)).astype(np.int64)
    distinct = np.bincount(of, minlength=n)
    stats[:, 10] = distinct / words
    line_starts = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], np.flatnonzero(data[:-1] == 10) + 1])) if len(data) else np.zeros(0, np.int64)
    if len(line_starts):
        line_ends = np.append(line_starts[1:], len(data))
        line_doc = np.searchsorted(off, line_starts, "right") - 1
        lh = span_hashes(data, line_starts, line_ends)
        same = np.unique((line_doc.astype(np.uint64) << np.uint64(40)) | (lh >> np.uint64(24)))
        lines = np.bincount(line_doc, minlength=n)
        stats[:, 11] = 1 - np.bincount((same >> np.uint64(40)).astype(np.int64), minlength=n) / np.maximum(lines, 1)
    if len(starts):
        last = data[ends - 1]
        stats[:, 12] = sums((_KINDS[0] | _KINDS[1])[last], first) / words
        stats[:, 13] = np.minimum(1, 5 * sums(_of(".?!")[last], first) / words)
    stats[:, 14] = np.log1p(np.diff(first)) / 10
    stats[:, 15] = np.log1p(np.diff(off)) / 12
    bucket = ((key & np.uint64((1 << 40) - 1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 14)).astype(np.int64)
    x = np.log1p(count) / np.sqrt(np.maximum(distinct, 1))[of]
    return of, bucket, x.astype(np.float32), stats


class FactorisationMachine:
    """w0, w and v over BUCKETS word features and the statistics after them."""

    def __init__(self, seed: int = 11):
        size = BUCKETS + len(STATISTICS)
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = 0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32)

    def raw(self, of: np.ndarray, at: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The machine's sums, and sum_i v_i x_i, for features (document, feature, x) sorted by document."""
        linear, inner, squares = np.zeros(n), np.zeros((n, RANK)), np.zeros(n)
        if len(of):
            edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            who = of[edge]
            vx = self.v[at] * x[:, None]
            linear[who] = np.add.reduceat(self.w[at] * x, edge)
            inner[who] = np.add.reduceat(vx, edge, axis=0)
            squares[who] = np.add.reduceat((vx * vx).sum(1), edge)
        return self.w0 + linear + ((inner**2).sum(1) - squares) / 2, inner

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 14, rate: float = 0.05, decay: float = 1e-4, seed: int = 5) -> None:
        """AdaGrad on the logistic loss; rows: (features, x) of each document."""
        if len(set(y.tolist())) < 2:
            self.v[:] = 0
        if not len(y):
            return
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.w0 = float(np.log(share / (1 - share)))
        if len(set(y.tolist())) < 2:
            return
        rng = np.random.default_rng(seed)
        g0, gw, gv = 1e-6, np.full_like(self.w, 1e-6), np.full_like(self.v, 1e-6)
        weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), 64):
                some = order[lo : lo + 64]
                at, x = np.concatenate([rows[i][0] for i in some]), np.concatenate([rows[i][1] for i in some])
                of = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
                s, inner = self.raw(of, at, x, len(some))
                err = weight[some] * (1 / (1 + np.exp(-np.clip(s, -30, 30))) - y[some]) / len(some)
                feature, back = np.unique(at, return_inverse=True)
                ex = err[of] * x
                dw = np.bincount(back, ex, len(feature)) + decay * self.w[feature]
                dv = np.zeros((len(feature), RANK))
                np.add.at(dv, back, ex[:, None] * (inner[of] - self.v[at] * x[:, None]))
                dv += decay * self.v[feature]
                g0 += err.sum() ** 2
                self.w0 -= rate * err.sum() / np.sqrt(g0)
                gw[feature] += dw**2
                gv[feature] += dv**2
                self.w[feature] -= rate * dw / np.sqrt(gw[feature])
                self.v[feature] -= rate * dv / np.sqrt(gv[feature])

    def scores(self, run: Run) -> np.ndarray:
        of, at, x, stats = features(run)
        words, inner = self.raw(of, at, x, run.n)
        v, w = self.v[BUCKETS:], self.w[BUCKETS:]
        own = stats @ v
        # both groups of features interact: add the statistics' own part and the cross part
        s = words + stats @ w + ((own**2).sum(1) - (stats**2) @ (v**2).sum(1)) / 2 + (own * inner).sum(1)
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> FactorisationMachine:
    """Learns from at most `rows` labels, those of the least id hashes, and for each from one text, that of the least hash; feature
    values, not texts, go to the driver.

    usable: which labels may be learned from, over columns id and label.
    """
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1))
    known = known.where(usable) if usable is not None else known
    sample = known.distinct().orderBy(F.xxhash64(F.lit(3), "id"), "label").limit(rows)
    joined = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(sample), "id")  # `rows` rows at most
    joined = joined.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one")).select(F.col("one.text").alias("text"), "label")

    def counted(batch):
        for run in runs(batch.column(0)):
            of, at, x, stats = features(run)
            cut = np.searchsorted(of, np.arange(run.n + 1))
            yield {
                "label": batch.column(1).slice(run.first, run.n),
                "at": [at[a:b].astype("<u2").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)],
                "x": [x[a:b].astype("<f4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)],
                "stats": [s.astype("<f4").tobytes() for s in stats],
            }

    schema = T.StructType([T.StructField("label", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("at", "x", "stats")]])
    got = map_arrow(joined, counted, schema).collect()
    got.sort(key=lambda r: (bytes(r["stats"]), bytes(r["at"]), r["label"]))
    machine = FactorisationMachine()
    more = np.arange(BUCKETS, BUCKETS + len(STATISTICS))
    each = [(np.r_[np.frombuffer(r["at"], "<u2").astype(np.int64), more], np.r_[np.frombuffer(r["x"], "<f4"), np.frombuffer(r["stats"], "<f4")]) for r in got]
    machine.fit(each, np.array([r["label"] for r in got], float))
    return machine


def score(docs: DataFrame, machine: FactorisationMachine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) for every row."""
    schema = T.StructType([id_field(docs, doc_id), T.StructField("score", T.DoubleType())])

    def scored(batch):
        for run in runs(batch.column(1)):
            yield {"doc_id": batch.column(0).slice(run.first, run.n), "score": machine.scores(run)}

    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), scored, schema)
