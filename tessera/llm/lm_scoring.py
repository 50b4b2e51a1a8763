"""Log-bilinear language model with exact corpus counts.

Counts. Documents are tokenised in blocks; each block sends every distinct word once, as a 64-bit hash
with its training count, to the hash range's bucket, and every distinct pair of neighbouring tokens likewise; buckets sum exact
corpus counts and reply to the block. A frequent word's pairs go to all buckets. No table of words or pairs is broadcast or
collected; what is gathered and what is learned of words and pairs grows with the corpus.

Classes. A word's class follows from its count alone: each of the largest counts is a class, below them a class spans
a power of two, words never seen in training are one class, the end of a document another. A log-bilinear network predicts
the next class from the two before it: a context vector, R[c1] C1 + R[c2] C2, is scored against every
class vector plus a bias. It is trained in numpy by noise-contrastive estimation on the exact counts of
class triples in all training documents, all of them in each epoch; there are at most CLASSES**3 of them however
large the corpus. Batched matrix products over all contexts give normalised log-probabilities of classes, and a word within its
class has its share by counts: together the network's D(w | h).

Words. The score of word w after word v is log D(w | h) + B(v, w) - log Z(v): every pair of words of the corpus has a weight of its
own in the bilinear form. Weights are estimated by noise contrast as well, the n(v, w) pairs seen in training against K(v) noise draws
from D. A weight stands alone in its term of that objective, whose optimum is closed: the log-ratio of data with noise to noise,

    B(v, w) = log(1 + n(v, w) / (K(v) D(w | h))),   Z(v) = 1 + n(v) / K(v),

so that Z normalises exactly and pairs never seen have weight 0. K(v) is PAIR_NOISE times the mean number of different
followers of the words of v's class. With unknown words as one symbol the probabilities sum to one over the vocabulary.

Null and empty texts are a lone end token. Words compare by the 64-bit hash. Ids may be null or
repeat: rows are scored each. Without training rows the model is uniform over classes and the base score is
log10(1 / 1) = 0 for each token. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bytewords import ASCII_LOWER, Run, mix, runs, span_hashes
from tessera.llm.common import cut, id_field, releasing, stored_bytes

CLASSES = 256
#: Largest counts that are classes of their own; power-of-two classes come after them, the end of a document is last.
TOP = 190
END = CLASSES - 1
#: Text bytes of a block, and stored input bytes for one bucket of words.
BLOCK_BYTES, BUCKET_BYTES = 8_000_000, 8_000_000
#: Noise draws for each different follower that words of a class have on average.
PAIR_NOISE = 2.0
#: What the end of a document, which is also the context of its first word, is hashed as.
END_HASH = np.uint64(0x8F1BBCDCBFA53E0B)
_A, _B = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Key ranges over which class triples are summed.
TRIPLE_RANGES = 64
DIMENSIONS, NOISE = 32, 64
#: Steps of the fit, and batches of contexts in an epoch, which has every triple once, by its count.
UPDATES, BATCHES = 1600, 16


def _press(*arrays: np.ndarray) -> bytes:
    """Arrays in byte planes, compressed: small and sorted numbers take little."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T if len(a) else np.zeros((0, 0), np.uint8)
        parts += [len(a).to_bytes(8, "little"), np.ascontiguousarray(planes).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unpress(blob: bytes, *kinds: str) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in kinds:
        n, size = int.from_bytes(data[at : at + 8], "little"), np.dtype(kind).itemsize
        at += 8
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return out


# -- blocks --------------------------------------------------------------------------------------


class _Block:
    def __init__(self):
        self.first, self.size, self.words, self.counts = 0, 0, [], []

    def add(self, run: Run) -> None:
        starts, ends, first = run.words()
        self.words.append(span_hashes(ASCII_LOWER[run.data], starts, ends) if len(starts) else np.zeros(0, np.uint64))
        self.counts.append(np.diff(first))
        self.size += len(run.data)


def _edges(sorted_values: np.ndarray) -> list[int]:
    """Where runs of equal values begin, and the end."""
    if not len(sorted_values):
        return [0]
    return np.append(np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]), len(sorted_values)).tolist()


def _range(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of 64-bit hashes, as many as there are buckets."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _sequence(word: np.ndarray, size: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents' tokens with an end after each, the token before each, and where each document begins."""
    ends = np.cumsum(size) + np.arange(len(size))
    token = np.full(len(word) + len(size), end, np.int64)
    is_word = np.ones(len(token), bool)
    is_word[ends] = False
    token[is_word] = word
    before = np.empty(len(token), np.int64)
    before[1:] = token[:-1]
    before[:1] = end  # the end of a document is the context of the next one's first token
    return token, before, np.r_[0, ends[:-1] + 1].astype(np.int64)


def _pairs(token: np.ndarray, before: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of the distinct pairs, their hashes in order, and which key each of these has; hashes are those of the tokens."""
    key = np.sort(before * len(hashes) + token)
    key = key[np.r_[True, key[1:] != key[:-1]]]
    h = mix(hashes[key // len(hashes)] * _A + mix(hashes[key % len(hashes)] + _B))
    order = np.argsort(h, kind="stable")
    return key, h[order], order


def _block_rows(block: _Block, ids: pa.Array, training: np.ndarray, block_id: int, buckets: int, asks: bool) -> Iterator[dict]:
    """What a block keeps (kind 0), or what it asks of the buckets (kinds 1 and 7)."""
    words, counts = np.concatenate(block.words), np.concatenate(block.counts)
    own = training[block.first : block.first + len(counts)]
    unique, back = np.unique(words, return_inverse=True)
    if not asks:
        by_count = np.argsort(-np.bincount(back, minlength=len(unique)), kind="stable")  # common words get small numbers
        number = np.empty(len(unique), np.int64)
        number[by_count] = np.arange(len(unique))
        blob = _press(number[back].astype("<u4"), by_count.astype("<u4"), counts.astype("<u4"), own.astype("u1"), np.diff(unique, prepend=np.uint64(0)))
        yield {"kind": 0, "block": block_id, "bucket": -1, "ids": ids.slice(block.first, len(counts)), "blob": blob}
        return
    in_training = np.bincount(back[np.repeat(own, counts)], minlength=len(unique))
    to = _range(unique, buckets)
    edges = _edges(to)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield {"kind": 1, "block": block_id, "bucket": int(to[lo]), "ids": None, "blob": _press(unique[lo:hi], in_training[lo:hi].astype("<u4"))}
    hashes = np.append(unique, END_HASH)
    token, before, _ = _sequence(back, counts, len(unique))
    key, h, order = _pairs(token, before, hashes)
    learned = np.sort((before * len(hashes) + token)[np.repeat(own, counts + 1)])
    n = (np.searchsorted(learned, key, "right") - np.searchsorted(learned, key))[order].astype("<u4")
    to = _range(h, buckets)
    edges = _edges(to)
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        yield {"kind": 7, "block": block_id, "bucket": int(to[lo]), "ids": None, "blob": _press(np.diff(h[lo:hi], prepend=np.uint64(0)), n[lo:hi])}


def _blocks(docs: DataFrame, buckets: int, schema: T.StructType, asks: bool) -> DataFrame:
    """kind 0: a block's ids, tokens and words; kind 1: its distinct words of one bucket with their training counts; kind 7: its distinct pairs likewise."""

    def run_blocks(batches):
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            training = batch.column(2).to_numpy(zero_copy_only=False)
            block, upto = _Block(), 0
            for run in runs(batch.column(1)):
                block.add(run)
                upto = run.first + run.n
                if block.size >= BLOCK_BYTES:
                    yield from _batches(_block_rows(block, batch.column(0), training, at, buckets, asks), schema)
                    at, block = at + 1, _Block()
                    block.first = upto
            if block.words:
                yield from _batches(_block_rows(block, batch.column(0), training, at, buckets, asks), schema)
                at += 1

    return docs.mapInArrow(releasing(run_blocks), schema)


def _batches(rows: Iterator[dict], schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Record batches of one row with ids, or of a few hundred without."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    held: list[dict] = []

    def made() -> pa.RecordBatch:
        columns = []
        for f in out:
            if f.name == "ids":
                sizes = [0 if r["ids"] is None else len(r["ids"]) for r in held]
                offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
                values = pa.concat_arrays([r["ids"].cast(f.type.value_type) for r in held if r["ids"] is not None] or [pa.array([], f.type.value_type)])
                columns.append(pa.ListArray.from_arrays(offsets, values).cast(f.type))
            else:
                columns.append(pa.array([r[f.name] for r in held], f.type))
        held.clear()
        return pa.RecordBatch.from_arrays(columns, schema=out)

    for r in rows:
        held.append(r)
        if len(held) >= 200 or r["ids"] is not None:
            yield made()
    if held:
        yield made()


# -- counts --------------------------------------------------------------------------------------


def _bin(c: np.ndarray) -> np.ndarray:
    """Power-of-two class of a count: TOP for 0, TOP + 1 for 1 and 2, and so on."""
    return TOP + np.frexp(c + 1.0)[1] - 1


def _counted(blocks: DataFrame, partitions: int, schema: T.StructType) -> DataFrame:
    """kind 2: a block's corpus counts of words for one bucket, in its order; kind 3: sums for the power-of-two classes; kind 4: a bucket's
    largest counts; kind 9: as kind 2 for pairs, twice the count and one more where the block is the pair's first. A bucket's words,
    then its pairs, are in memory at a time."""

    def words(bucket: int, held: list[tuple[int, bytes]]):
        parts = [(block, *_unpress(blob, "<u8", "<u4")) for block, blob in held]
        unique, back = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        total = np.zeros(len(unique), np.int64)
        np.add.at(total, back, np.concatenate([p[2] for p in parts]).astype(np.int64))
        lo = 0
        for block, own, _ in parts:
            yield {"kind": 2, "block": block, "bucket": bucket, "ids": None, "blob": _press(total[back[lo : lo + len(own)]].astype("<u8"))}
            lo += len(own)
        seen = total[total > 0]
        which = _bin(seen) - TOP
        yield {"kind": 3, "block": -1, "bucket": bucket, "ids": None, "blob": np.stack([np.bincount(which, minlength=64), np.bincount(which, seen + 1, minlength=64).astype(np.int64)]).astype("<i8").tobytes()}
        most = np.sort(seen)[-(TOP + 1) :]
        yield {"kind": 4, "block": -1, "bucket": bucket, "ids": None, "blob": most.astype("<i8").tobytes()}

    def pairs(bucket: int, held: list[tuple[int, bytes]]):
        parts = [(block, *_unpress(blob, "<u8", "<u4")) for block, blob in held]
        h = np.concatenate([np.cumsum(p[1], dtype=np.uint64) for p in parts])
        order = np.argsort(h, kind="stable")
        new = np.r_[True, h[order][1:] != h[order][:-1]]
        group = np.cumsum(new) - 1
        total = np.bincount(group, np.concatenate([p[2] for p in parts])[order]).astype(np.int64)
        reply = np.empty(len(h), np.int64)
        reply[order] = 2 * total[group] + new
        lo = 0
        for block, own, _ in parts:
            yield {"kind": 9, "block": block, "bucket": bucket, "ids": None, "blob": _press(reply[lo : lo + len(own)].astype("<u8"))}
            lo += len(own)

    def count(batches):
        def all_rows():
            now, held = None, []
            for batch in batches:
                for kind, block, b, blob in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                    if (b, kind) != now:
                        if held:
                            yield from (words if now[1] == 1 else pairs)(now[0], held)
                        now, held = (b, kind), []
                    held.append((block, blob))
            if held:
                yield from (words if now[1] == 1 else pairs)(now[0], held)

        yield from _batches(all_rows(), schema)

    asked = blocks.where("kind in (1, 7)").select("kind", "block", "bucket", "blob")
    return asked.repartition(partitions, "bucket").sortWithinPartitions("bucket", "kind", "block").mapInArrow(releasing(count), schema)


class Counts:
    """What the corpus counts say of classes; made of sums of bounded size."""

    def __init__(self, sums: np.ndarray, top: np.ndarray, n_documents: int):
        words, mass = sums
        self.n_documents = n_documents
        self.tokens = int((mass - words).sum()) + n_documents
        self.distinct = int(words.sum()) + (n_documents > 0)
        top = np.sort(top)[::-1]
        least = int(top[TOP]) if len(top) > TOP else 0  # counts above it are classes of their own
        self.values, self.many = np.unique(top[top > least], return_counts=True)
        mass = mass.astype(float).copy()
        np.subtract.at(mass, _bin(self.values) - TOP, self.many * (self.values + 1.0))
        self.mass = mass
        self.words = words.astype(np.int64).copy()  # of the power-of-two classes, without those that are classes of their own
        np.subtract.at(self.words, _bin(self.values) - TOP, self.many)
        self.noise = np.ones(CLASSES)  # K of the pairs, by the class of their first word

    def classes(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of words by their counts, and log10 of the word's share in its class."""
        out = _bin(c).astype(np.int64)
        share = np.ones(len(c))
        low = c > 0
        share[low] = (c[low] + 1) / np.maximum(self.mass[out[low] - TOP], 1)
        if len(self.values):
            at = np.minimum(np.searchsorted(self.values, c), len(self.values) - 1)
            own = self.values[at] == c
            out[own], share[own] = at[own], 1 / self.many[at[own]]
        return out, np.log10(share)

    def contrast(self, followers: np.ndarray) -> None:
        """Sets K from the numbers of different followers that the words of each class have in all."""
        words = np.zeros(CLASSES)
        words[: len(self.many)] = self.many
        words[TOP : TOP + 64] = self.words
        words[END] = 1
        self.noise = PAIR_NOISE * np.maximum(1.0, followers / np.maximum(words, 1))

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.tokens + self.distinct + 1.0))


def corpus_counts(counted: DataFrame, n_documents: int) -> Counts:
    """Sums of the buckets' statistics (a few hundred numbers each, added up on the executors in tree form)."""

    def add(batches):
        sums, top = np.zeros((2, 64), np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                got = np.frombuffer(blob, "<i8")
                if kind == 3:
                    sums = sums + got.reshape(2, 64)
                else:
                    top = np.sort(np.r_[top, got])[-(TOP + 1) :]
        yield pa.RecordBatch.from_arrays([pa.array([3, 4], pa.int32()), pa.array([sums.astype("<i8").tobytes(), top.astype("<i8").tobytes()], pa.binary())], names=["kind", "blob"])

    some = counted.where("kind in (3, 4)").select("kind", "blob")
    rows = some.mapInArrow(add, "kind int, blob binary").coalesce(16).mapInArrow(add, "kind int, blob binary").collect()
    sums, top = np.zeros((2, 64), np.int64), np.zeros(0, np.int64)
    for r in rows:
        got = np.frombuffer(bytes(r["blob"]), "<i8")
        if r["kind"] == 3:
            sums = sums + got.reshape(2, 64)
        else:
            top = np.sort(np.r_[top, got])[-(TOP + 1) :]
    return Counts(sums, top, n_documents)


# -- classes and triples ---------------------------------------------------------------------------


def _resolved(blocks: DataFrame, counted: DataFrame, counts: Counts, partitions: int, schema: T.StructType) -> DataFrame:
    """kind 5: a block's ids, tokens' counts and pairs' counts, and sums by document; kind 6: its class triples in training, by key range; kind 8: followers by class."""

    def resolve(batches):
        def solve(block: int, ids, blob: bytes, replies: dict[int, list[bytes]]):
            number, by_count, size, training, unique = _unpress(blob, "<u4", "<u4", "<u4", "u1", "<u8")
            size, unique = size.astype(np.int64), np.cumsum(unique, dtype=np.uint64)
            joined = lambda kind: np.concatenate([_unpress(r, "<u8")[0] for r in replies[kind]]).astype(np.int64) if replies[kind] else np.zeros(0, np.int64)
            c_word, c_pair = joined(2), joined(9)
            if len(c_word) != len(unique):
                raise ValueError("the rows were not the same when they were read again")
            hashes, end = np.append(unique, END_HASH), len(unique)
            token, before, begin = _sequence(by_count.astype(np.int64)[number], size, end)
            c_token = np.append(c_word, counts.n_documents)
            cls_token = np.append(counts.classes(c_word)[0], END)
            known, base = c_token > 0, counts.base(c_token)
            key, _, order = _pairs(token, before, hashes)
            n_pair = np.empty(len(key), np.int64)
            n_pair[order] = c_pair >> 1
            firsts = order[(c_pair & 1 > 0) & (c_pair > 1)]
            yield {"kind": 8, "block": block, "bucket": -1, "ids": None, "blob": np.bincount(cls_token[key[firsts] // len(hashes)], minlength=CLASSES).astype("<i8").tobytes()}
            n = n_pair[np.searchsorted(key, before * len(hashes) + token)]
            by_doc = lambda x: np.add.reduceat(x[token], begin)
            yield {"kind": 5, "block": block, "bucket": -1, "ids": ids, "blob": _press(c_token[token].astype("<u8"), n.astype("<u8"), (size + 1).astype("<u4"), by_doc(known.astype(np.int64)).astype("<u4"), by_doc(base).astype("<f8"))}
            cls = cls_token[token]
            triple = _contexts(cls, begin) * CLASSES + cls
            keys, n = np.unique(triple[np.repeat(training > 0, size + 1)], return_counts=True)
            width = CLASSES**3 // TRIPLE_RANGES
            edges = np.searchsorted(keys, np.arange(TRIPLE_RANGES + 1) * width)
            for b in np.flatnonzero(np.diff(edges)).tolist():
                s = slice(edges[b], edges[b + 1])
                yield {"kind": 6, "block": block, "bucket": b, "ids": None, "blob": _press(keys[s].astype("<u4"), n[s].astype("<u4"))}

        def all_rows():
            now, own, replies = None, None, {2: [], 9: []}
            for batch in batches:
                for k in range(batch.num_rows):
                    kind, block = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                    if block != now:
                        if own:
                            yield from solve(now, *own, replies)
                        now, own, replies = block, None, {2: [], 9: []}
                    if kind == 0:
                        own = (batch.column(3).slice(k, 1).flatten(), batch.column(4)[k].as_py())
                    else:
                        replies[kind].append(batch.column(4)[k].as_py())
            if own:
                yield from solve(now, *own, replies)

        yield from _batches(all_rows(), schema)

    both = blocks.unionByName(counted.where("kind in (2, 9)"))
    return both.repartition(partitions, "block").sortWithinPartitions("block", "kind", "bucket").mapInArrow(releasing(resolve), schema)


def _contexts(cls: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """c2 * CLASSES + c1 for every token: the classes two and one before it, END before a document."""
    c1, c2 = np.empty(len(cls), np.int64), np.empty(len(cls), np.int64)
    c1[1:], c2[2:] = cls[:-1], cls[:-2]
    c1[begin] = c2[begin] = END
    second = begin + 1
    second = second[second < len(cls)]
    c2[second] = END
    return c2 * CLASSES + c1


def triple_counts(resolved: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all class triples: at most CLASSES**3 of them, summed on executors by key range."""

    def add(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(b, []).append(_unpress(blob, "<u4", "<u4" if tall[0] else "<u8"))
                if len(held[b]) >= 8:
                    held[b] = [_merged(held[b])]
        for b, parts in held.items():
            keys, n = _merged(parts)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_press(keys, n)], pa.binary())], names=["bucket", "blob"])

    tall = [True]
    some = resolved.where("kind = 6").select("bucket", "blob")
    rows = some.repartition(TRIPLE_RANGES, "bucket").mapInArrow(add, "bucket int, blob binary").collect()
    parts = [_unpress(bytes(r["blob"]), "<u4", "<u8") for r in rows]
    return _merged(parts) if parts else (np.zeros(0, "<u4"), np.zeros(0, "<u8"))


def followers(resolved: DataFrame) -> np.ndarray:
    """Numbers of different followers that the words of each class have in training, summed on executors."""

    def add(batches):
        total = np.zeros(CLASSES, np.int64)
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                total += np.frombuffer(blob, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["blob"])

    rows = resolved.where("kind = 8").select("blob").mapInArrow(add, "blob binary").coalesce(16).mapInArrow(add, "blob binary").collect()
    return sum((np.frombuffer(bytes(r["blob"]), "<i8") for r in rows), np.zeros(CLASSES, np.int64))


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.zeros(len(keys), "<u8")
    np.add.at(n, back, np.concatenate([p[1].astype("<u8") for p in parts]))
    return keys, n


# -- the model -------------------------------------------------------------------------------------


class LogBilinear:
    """R, C1, C2, Q and b; log-probabilities of every class after every two classes."""

    def __init__(self, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.r, self.q = (rng.normal(0, 0.1, (CLASSES, DIMENSIONS)).astype(np.float32) for _ in range(2))
        self.c1, self.c2 = (np.eye(DIMENSIONS, dtype=np.float32) * s for s in (1.0, 0.5))
        self.b = np.zeros(CLASSES, np.float32)

    def fit(self, keys: np.ndarray, counts: np.ndarray, updates: int = UPDATES, rate: float = 0.3, seed: int = 23) -> LogBilinear:
        """Noise-contrastive estimation in whole epochs over all triples, each weighted by its count.

        Neither triples nor noise are drawn: a context's row of counts against all classes gives the objective's exact
        expectation under the noise, which comes from the classes' shares.
        """
        if not len(keys):
            return self
        rng = np.random.default_rng(seed)
        keys, counts = keys.astype(np.int64), counts.astype(float)
        unigram = np.bincount(keys % CLASSES, counts, CLASSES)
        noise = (unigram + 1) / (unigram + 1).sum()
        self.b = np.log(noise).astype(np.float32)
        shift = np.log(NOISE * noise).astype(np.float32)
        contexts, at = np.unique(keys // CLASSES, return_inverse=True)
        mass = np.bincount(at, counts)
        batches = min(BATCHES, len(contexts))
        each = counts.sum() / batches
        dealt = np.argsort(-mass, kind="stable")  # contexts dealt by mass, so that batches weigh about the same
        seen = np.zeros((len(contexts), CLASSES), np.float32)
        seen[at, keys % CLASSES] = counts / each
        drawn = (mass[:, None] / each * NOISE).astype(np.float32)
        params = {n: getattr(self, n) for n in ("r", "q", "c1", "c2", "b")}
        sums = {n: np.full_like(p, 1e-4) for n, p in params.items()}
        epochs = max(1, updates // BATCHES)
        for epoch in range(epochs):
            now = rate * min(1.0, 2 * (1 - epoch / epochs) + 0.02)
            for own in rng.permutation(batches).tolist():
                rows = dealt[own::batches]
                w1, w2 = contexts[rows] % CLASSES, contexts[rows] // CLASSES
                r1, r2 = self.r[w1], self.r[w2]
                x = r1 @ self.c1 + r2 @ self.c2
                true = 1 / (1 + np.exp(np.minimum(shift - self.b - x @ self.q.T, 80)))  # that a class is no noise
                up = seen[rows] * (1 - true) - drawn[rows] * noise.astype(np.float32) * true
                dx = up @ self.q
                grads = {"q": up.T @ x, "b": up.sum(0), "c1": r1.T @ dx, "c2": r2.T @ dx, "r": np.zeros_like(self.r)}
                np.add.at(grads["r"], w1, dx @ self.c1.T)
                np.add.at(grads["r"], w2, dx @ self.c2.T)
                for n, p in params.items():
                    sums[n] += grads[n] ** 2
                    p += now * grads[n] / np.sqrt(sums[n])
        return self

    def table(self) -> np.ndarray:
        """log10 P(class | c2, c1), normalised, as (CLASSES**2, CLASSES): one batched matrix product for each c2."""
        one, two = self.r @ self.c1 @ self.q.T + self.b, self.r @ self.c2 @ self.q.T
        out = np.empty((CLASSES, CLASSES, CLASSES), np.float32)
        for c2 in range(CLASSES):
            s = one + two[c2]
            s -= s.max(1, keepdims=True)
            out[c2] = (s - np.log(np.exp(s).sum(1, keepdims=True))) / np.log(10)
        return out.reshape(CLASSES**2, CLASSES)


_tables: dict[bytes, np.ndarray] = {}


def _table(model: LogBilinear) -> np.ndarray:
    """The worker's table of a model, made once."""
    key = model.q.tobytes()
    if key not in _tables:
        _tables.clear()
        _tables[key] = model.table()
    return _tables[key]


def _scored(resolved: DataFrame, model: LogBilinear, counts: Counts, id_type: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens")], *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")]])
    tokens = counts.tokens

    def score(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for k in range(batch.num_rows):
                c, n, size, known, base = _unpress(batch.column(1)[k].as_py(), "<u8", "<u8", "<u4", "<u4", "<f8")
                size, c = size.astype(np.int64), c.astype(np.int64)
                begin = np.cumsum(size) - size
                ends = begin + size - 1
                cls, share = counts.classes(c)
                cls[ends], share[ends] = END, 0.0
                network = np.power(10.0, _table(model)[_contexts(cls, begin), cls] + share)
                before, seen = np.empty(len(c), np.int64), np.empty(len(c), np.int64)
                before[1:], seen[1:] = cls[:-1], c[:-1]
                before[begin], seen[begin] = END, counts.n_documents
                noise = counts.noise[before]
                logs = np.log10((n + noise * network) / (seen + noise))
                values = [batch.column(0).slice(k, 1).flatten(), size, known, np.full(len(size), tokens), base, np.add.reduceat(logs, begin)]
                yield pa.RecordBatch.from_arrays([(v if isinstance(v, pa.Array) else pa.array(v)).cast(f.type) for v, f in zip(values, out, strict=True)], schema=out)

    return resolved.where("kind = 5").select("ids", "blob").mapInArrow(score, schema)


def score(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every row; training says which rows to learn from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    id_type = id_field(rows, "doc_id").dataType
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("blob", T.BinaryType())])
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = stored_bytes(docs)
    buckets = max(partitions, -(-size // BUCKET_BYTES))
    n_documents = rows.where("training").count()
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = cut(rows)  # blocks are made twice, of the same rows in the same order, which a scan of files gives
    counted = cut(_counted(_blocks(rows, buckets, schema, True), partitions, schema))
    counts = corpus_counts(counted, n_documents)
    resolved = cut(_resolved(_blocks(rows, buckets, schema, False), counted, counts, partitions, schema))
    counts.contrast(followers(resolved))
    model = LogBilinear().fit(*triple_counts(resolved))
    return _scored(resolved, model, counts, id_type)
