"""Hierarchical language identification by linear support vector machines.

A text's features are its letter bigrams and trigrams (bytes, lower case, one blank for all that is no
letter), hashed into BUCKETS and taken as shares. One-versus-rest machines first choose the language
family; within it, one-versus-one machines for each pair of its languages vote. Every machine is
linear in the shares, so scoring is one gather and one segmented sum over the text's bytes.

The machines are fitted to all labelled rows: those are dealt by a hash of id and text into parts of
about PART rows, each part fits every machine, and a machine is the mean of its parts'.

A text that is null or has no letter is `und` with score 0. Languages are learned from rows whose
language is not null; with none of them, every text is `und`. Repeated rows are scored each; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bytewords import Run, runs
from tessera.llm.common import cut, id_field, map_arrow, releasing

BUCKETS = 1 << 13
#: Training documents of a part, if no language is rare; bytes of features that are sent on at a time.
PART, SENT_BYTES = 1024, 4_000_000
#: Rows that a part has of each rare language: so many, or in all.
RARE, RARE_IN_ALL = 128, 2048
#: Languages that are learned.
MOST_LANGUAGES = 3000
#: Share of rightly predicted rows whose scores count as unsure.
UNSURE = 0.002
#: Bins of scores that are counted at a time.
BINS = 1024

#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "semitic": "ar he mt am",
    "indic": "hi ur bn pa mr gu ne",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def _grams(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """Two bucket numbers for each byte of the run (BUCKETS: none): of the bigram and the trigram that begin there."""
    b = _LETTER[run.data].astype(np.uint32)
    high = np.flatnonzero((run.data[:-1] == 0xC3) & (run.data[1:] >= 0x80) & (run.data[1:] <= 0x9E)) if len(b) else []
    b[np.asarray(high, np.int64) + 1] += 0x20
    pad = np.append(b, [0x20, 0x20]).astype(np.uint32)
    two = pad[:-2] | pad[1:-1] << 8
    three = two | pad[2:] << 16
    out = []
    for g, shift, width in ((two, 11, 2), (three, 7, 3)):
        h = (g * np.uint32(2654435761) ^ g >> shift) * np.uint32(2246822519) >> np.uint32(32 - 12)
        h = h.astype(np.int64) + (BUCKETS // 2 if width == 3 else 0)
        h[(b == 0x20) & (pad[1:-1] == 0x20)] = BUCKETS
        for back in range(1, width):  # no gram runs over the end of a document
            edge = run.offsets[1:] - back
            h[edge[(edge >= run.offsets[:-1]) & (edge >= 0)]] = BUCKETS
        out.append(h)
    return out[0], out[1]


def gram_counts(column: pa.Array):
    """(row, buckets, counts) of every text."""
    for run in runs(column):
        two, three = _grams(run)
        for k in range(run.n):
            s = slice(run.offsets[k], run.offsets[k + 1])
            count = np.bincount(two[s], minlength=BUCKETS + 1)[:BUCKETS] + np.bincount(three[s], minlength=BUCKETS + 1)[:BUCKETS]
            at = np.flatnonzero(count)
            yield run.first + k, at, count[at]


def fit_svms(x: np.ndarray, sides: np.ndarray, groups: list[np.ndarray] | None = None, c: float = 10.0, steps: int = 120) -> np.ndarray:
    """Weights and intercept (last row) of a squared-hinge linear SVM for each column of sides, by accelerated gradient descent.

    sides has 1, -1, or 0 for rows that a machine does not see; both sides weigh the same. Weights are sums of rows, so that
    after the rows' inner products all steps are on the sums' coefficients; machines of a group (numbers) step together over
    the rows that any of them sees. x is scaled in place.
    """
    scale = 1 / np.sqrt(np.maximum(x.mean(0), 1e-7))
    x *= scale
    gram, total = x @ x.T, x.sum(1)
    a, b = np.zeros(sides.shape, np.float32), np.zeros(sides.shape[1], np.float32)
    for group in [np.arange(sides.shape[1])] if groups is None else groups:
        rows = np.flatnonzero(sides[:, group].any(1))
        if len(rows) and len(group):
            a[np.ix_(rows, group)], b[group] = _descend(gram[np.ix_(rows, rows)], total[rows], sides[np.ix_(rows, group)], c, steps)
    return np.vstack([(x.T @ a) * scale[:, None], b])


def _descend(gram: np.ndarray, total: np.ndarray, sides: np.ndarray, c: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of the rows and intercepts; total: the rows' sums of features."""
    share = (0.5 * np.abs(sides) / np.maximum(1, np.where(sides > 0, (sides > 0).sum(0), (sides < 0).sum(0)))).astype(np.float32)
    u = share * total[:, None]
    for _ in range(8):  # the largest curvature, by power iteration
        gu = gram @ u
        norm = np.maximum(np.sqrt(np.maximum((u * gu).sum(0), 0)), 1e-9)
        v, u = gu / norm, share * (gu / norm)
    top = (v * u).sum(0) + 1.0
    rate = (1 / (1 / c + 2 * top)).astype(np.float32)
    a, b = np.zeros_like(share), np.zeros(sides.shape[1], np.float32)
    a0, b0 = a, b
    for t in range(1, steps + 1):
        m = np.float32((t - 1) / (t + 2))
        za, zb = a + m * (a - a0), b + m * (b - b0)
        g = -2 * share * sides * np.maximum(0, 1 - sides * (gram @ za + zb))
        a0, b0 = a, b
        a, b = za - rate * (za / np.float32(c) + g), zb - rate * g.sum(0)
    return a, b


class LanguageModel:
    """Families, languages, and a weight column for each machine: families first, then pairs."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        of = [FAMILY.get(lang.lower().split("-")[0], lang) for lang in languages]
        self.families = sorted(set(of))
        self.members = [[i for i, f in enumerate(of) if f == family] for family in self.families]
        self.pairs = [(a, b) for own in self.members for a, b in combinations(own, 2)]
        alone = len(self.families) if len(self.families) > 1 else 0
        #: For each language (row) and machine: 1, -1, or 0 if the machine does not see it.
        self.sides = np.zeros((len(languages), alone + len(self.pairs)), np.float32)
        for k in range(alone):
            self.sides[:, k] = [1 if f == self.families[k] else -1 for f in of]
        for k, (a, b) in enumerate(self.pairs, alone):
            self.sides[a, k], self.sides[b, k] = 1, -1
        #: Machines that step together: the families', then each family's pairs.
        self.groups = [np.arange(alone)] + [np.array([k for k, (a, _) in enumerate(self.pairs, alone) if a in own], np.int64) for own in self.members if len(own) > 1]
        self.place(np.zeros((BUCKETS + 1, self.sides.shape[1])))

    def place(self, w: np.ndarray) -> LanguageModel:
        """Takes the machines' weights and intercepts (last row)."""
        self.weights = np.vstack([w[:-1], np.zeros((1, w.shape[1]))]).astype(np.float32)
        self.intercepts = w[-1].astype(np.float64)
        return self

    def predict(self, run: Run) -> tuple[list[str], np.ndarray]:
        """Language and score of each document of the run."""
        n = run.n
        sums, total = np.zeros((n, self.weights.shape[1])), np.zeros(n)
        some = np.flatnonzero(np.diff(run.offsets))
        for h in _grams(run) if len(some) else ():
            sums[some] += np.add.reduceat(self.weights[h], run.offsets[some], axis=0, dtype=np.float64)
            total[some] += np.add.reduceat((h < BUCKETS).astype(np.int64), run.offsets[some])
        margin = sums / np.maximum(total, 1)[:, None] + self.intercepts
        nf = len(self.families) if len(self.families) > 1 else 0
        family = margin[:, :nf].argmax(1) if nf else np.zeros(n, np.int64)
        best, sure = np.zeros(n, np.int64), np.full(n, np.inf)
        if nf:
            top = np.sort(margin[:, :nf], 1)
            sure = (top[:, -1] - top[:, -2]) / 2
        for k, own in enumerate(self.members):
            rows = np.flatnonzero(family == k)
            votes, strength = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for at, (a, b) in enumerate(self.pairs):
                if a in own:
                    m = margin[rows, nf + at]
                    for lang, signed in ((a, m), (b, -m)):
                        votes[:, own.index(lang)] += signed > 0
                        strength[:, own.index(lang)] += np.clip(signed, -1, 1)
            pick = (votes + strength / (4 * len(own))).argmax(1)
            best[rows] = np.array(own)[pick]
            for at, (a, b) in enumerate(self.pairs):
                if a in own:
                    m = margin[rows, nf + at]
                    sure[rows] = np.where(best[rows] == a, np.minimum(sure[rows], m), np.where(best[rows] == b, np.minimum(sure[rows], -m), sure[rows]))
        score = 1 / (1 + np.exp(-4 * np.clip(np.where(np.isfinite(sure), sure, 1.0), -5, 5)))
        return [self.languages[i] for i in best], score


def _no_letter(run: Run) -> np.ndarray:
    """Documents of the run without any letter of any script."""
    out = np.ones(run.n, bool)
    letters = np.zeros(len(run.data) + 1, np.int64)
    low = run.data | 0x20
    np.cumsum((low >= 0x61) & (low <= 0x7A) & (run.data < 0x80), out=letters[1:])
    out = letters[run.offsets[1:]] == letters[run.offsets[:-1]]
    for k in np.flatnonzero(out):
        out[k] = not any(c.isalpha() for c in run.data[run.offsets[k] : run.offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def _part_machines(rows: list[tuple], sides: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A part's machines, as weights and intercepts, and which of them see both of their sides in it; rows: language's number, buckets, counts."""
    x = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (_, at, n) in enumerate(rows):
        n = np.frombuffer(n, f"<u{max(1, 2 * len(n) // max(1, len(at)))}")
        x[i, np.frombuffer(at, "<u2")] = n / max(1, n.sum())
    own = sides[[r[0] for r in rows]]
    both = np.flatnonzero((own > 0).any(0) & (own < 0).any(0))
    return fit_svms(x, own[:, both], [np.flatnonzero(np.isin(both, g)) for g in groups]), both


_SUMS = T.StructType([T.StructField("machine", T.IntegerType()), T.StructField("part", T.LongType()), T.StructField("n", T.LongType()), T.StructField("w", T.BinaryType())])


def _machine_sums(parts: DataFrame, sides: np.ndarray, groups: list[np.ndarray]) -> DataFrame:
    """Sums of the machines over each task's parts; a task's rows come by part, and equal (lang, h) next to each other."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_SUMS)

    def run(batches):
        total, n, first = np.zeros((BUCKETS + 1, sides.shape[1])), np.zeros(sides.shape[1], np.int64), None
        part, last, rows = None, None, []

        def close():
            if rows:
                w, both = _part_machines(rows, sides, groups)
                total[:, both] += w
                n[both] += 1
                rows.clear()

        for batch in batches:
            for p, lang, h, at, count in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if p != part:
                    close()
                    part, first = p, p if first is None else first
                elif (lang, h) == last:
                    continue
                last = lang, h
                rows.append((lang, at, count))
        close()
        for k in np.flatnonzero(n):
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((k, first, n[k], total[:, k].tobytes()), out, strict=True)], schema=out)

    return parts.mapInArrow(releasing(run), _SUMS)


def _added(sums: DataFrame) -> DataFrame:
    """One row for each machine: the sum of its sums."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(_SUMS)

    def run(batches):
        whole: dict[int, list] = {}
        for batch in batches:
            for k, part, n, w in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = whole.setdefault(k, [part, 0, 0.0])
                own[1], own[2] = own[1] + n, own[2] + np.frombuffer(w)
        for k, (part, n, w) in whole.items():
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((k, part, n, w.tobytes()), out, strict=True)], schema=out)

    return sums.repartition("machine").sortWithinPartitions("machine", "part").mapInArrow(releasing(run), _SUMS)


def fit(docs: DataFrame, usable: Column | None = None, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> LanguageModel:
    """Learns from all rows with a language and a text.

    usable: which rows may be learned from. Rows with equal id, text and language count once. Rows of a rare language go to
    several parts each, so that every part has RARE rows of it (fewer, if RARE_IN_ALL do not give that many for each language),
    or all there are. Of more than MOST_LANGUAGES languages the most frequent are learned. Only each machine's sum goes to the driver.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.where(usable) if usable is not None else rows
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(F.lit(7), F.col(doc_id).cast("string"), F.col(text).cast("string")).alias("h"))
    counts_of = {r["lang"]: r["n"] for r in rows.select("lang", "h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LANGUAGES).collect()}
    model = LanguageModel(sorted(counts_of))
    if not model.sides.shape[1]:
        return model
    parts = -(-sum(counts_of.values()) // PART)
    least = max(1, min(RARE, RARE_IN_ALL // len(counts_of)))
    dealt = {name: (k, min(parts, -(-parts * least // counts_of[name]))) for k, name in enumerate(model.languages)}

    def features(batch):
        names, hashes, seen = batch.column(0).to_pylist(), batch.column(2).to_pylist(), set()
        out, size = [], 0
        for row, at, n in gram_counts(batch.column(1)):
            if names[row] not in dealt or (names[row], hashes[row]) in seen:
                continue
            seen.add((names[row], hashes[row]))
            k, times = dealt[names[row]]
            at, n = at.astype("<u2").tobytes(), n.astype("<u1" if n.max(initial=0) < 256 else "<u4").tobytes()
            for j in range(times):
                out.append(((hashes[row] + j) % parts, k, hashes[row], at, n))
                size += len(at) + len(n)
                if size >= SENT_BYTES:
                    yield dict(zip(schema.names, zip(*out, strict=True), strict=True))
                    out, size = [], 0
        if out:
            yield dict(zip(schema.names, zip(*out, strict=True), strict=True))

    schema = T.StructType([T.StructField("part", T.LongType()), T.StructField("lang", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("at", T.BinaryType()), T.StructField("n", T.BinaryType())])
    dealt_rows = map_arrow(rows, features, schema).repartition("part").sortWithinPartitions("part", "lang", "h")
    w = np.zeros((BUCKETS + 1, model.sides.shape[1]))
    for r in _added(_machine_sums(dealt_rows, model.sides, model.groups)).collect():
        w[:, r["machine"]] = np.frombuffer(r["w"]) / r["n"]
    return model.place(w)


def least_score(docs: DataFrame, model: LanguageModel, usable: Column, text: str = "text", lang: str = "lang") -> float:
    """The score that all but a share UNSURE of labelled rows reach when their language is predicted rightly; 0 without any.

    usable: rows that the model has not learned from; all of them count, repeated ones too. Their scores are stored once.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).where(usable)
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    found = score_quantile(cut(annotate(rows, model).where("lang_pred = lang").select("score")), UNSURE)
    return 0.0 if found is None else found


def score_quantile(scores: DataFrame, share: float) -> float | None:
    """The exact quantile of the column score (0 to 1), as numpy's linear one; None without rows.

    Each round counts the rows of BINS equal bins and goes on within the one that has both neighbouring ranks, until they
    fall into two bins or the bin has one value.
    """
    low, high, before, n = 0.0, 1.0, 0, None
    while True:
        at = F.least(F.floor((F.col("score") - low) * (BINS / (high - low))), F.lit(BINS - 1))
        inside = scores.where(F.col("score").between(low, high)).groupBy(at.alias("bin"))
        bins = sorted(map(tuple, inside.agg(F.count(F.lit(1)), F.min("score"), F.max("score")).collect()))
        if n is None:
            n = sum(b[1] for b in bins)
            if not n:
                return None
            rank = share * (n - 1)
            first, second = int(rank), min(int(rank) + 1, n - 1)
        ends = before + np.cumsum([b[1] for b in bins])
        i, j = (int(np.searchsorted(ends, r, "right")) for r in (first, second))
        if i != j or bins[i][2] == bins[i][3]:
            return float(np.quantile([bins[i][3], bins[j][2]], rank - first))
        before, low, high = int(ends[i]) - bins[i][1], bins[i][2], bins[i][3]


def predict(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every row."""
    schema = T.StructType([id_field(docs, doc_id), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_arrow(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")), lambda batch: _predicted(batch, model, [0]), schema)


def annotate(docs: DataFrame, model: LanguageModel, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The rows as they are, with the prediction and its score behind all columns, under names that the caller knows to be free."""
    schema = T.StructType([*docs.schema.fields, T.StructField(lang_pred, T.StringType()), T.StructField(score, T.DoubleType())])
    names, at = docs.columns, docs.columns.index(text)

    def f(batch):
        for part in _predicted(batch, model, [], at):
            yield {name: batch.column(k) for k, name in enumerate(names)} | {lang_pred: part["lang_pred"], score: part["score"]}

    return map_arrow(docs, f, schema)


def _predicted(batch, model: LanguageModel, keep: list[int], text: int = 1):
    langs, scores = [], []
    for run in runs(batch.column(text)):
        none = _no_letter(run)
        if not model.languages:
            none[:] = True
        lang, score = model.predict(run) if model.languages else (["und"] * run.n, np.zeros(run.n))
        langs += ["und" if no else x for x, no in zip(lang, none, strict=True)]
        scores.append(np.where(none, 0.0, score))
    yield {"lang_pred": langs, "score": np.concatenate(scores) if scores else np.zeros(0)} | ({"doc_id": batch.column(0)} if keep else {})
