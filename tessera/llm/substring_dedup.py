"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is `window` consecutive words. Its minimiser is the leftmost smallest hash of its runs of
GRAM words, so equal windows have equal minimisers wherever they stand. Consecutive windows with the
same minimiser (same place) travel as one packed string of their words to the minimiser's bucket, and
there sorting the windows' hashes counts them. Words covered by a window that starts anywhere else
too are removed.

Runs that are frequent minimisers (counted by block over all documents, the HOT most frequent) come last in the order of
minimisers, everywhere alike. A window so has a frequent one only if all its runs are frequent, as inside a passage of many
copies, where strings are equal and combine; windows around a common phrase go to many buckets.

Before the shuffle, equal packed strings of a block of documents are combined: one travels, marked as
repeated, and the others' windows are known to be repeated at once. A group of copies of any size so
sends each string once for each block. In a bucket, a minimiser with one unmarked string is settled
without a sort; the others are sorted in parts of whole minimisers. Windows are compared by two
independent 64-bit hashes of their words' 64-bit hashes.

Null texts have no words; texts shorter than a window keep all. Rows with equal id and text are
repeats of each other and lose the same words. Ids may be null. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bytewords import CHUNK, Run, _Powers, mix, ranges, runs, span_hashes
from tessera.llm.common import id_field, map_arrow, releasing, row_key, stored_bytes

WINDOW, GRAM = 35, 8
#: Input bytes (as stored) for one bucket; a bucket is what a task holds in memory at a time.
BUCKET_BYTES = 4_000_000
#: Frequent minimisers that come last, at most; counted in blocks that have HOT_IN_BLOCK strings of them or more.
HOT, HOT_IN_BLOCK, BLOCK_BYTES = 65_536, 8, 40_000_000
#: Text of a packed row at most (but for one longer string), and of the packed rows that are made at a time.
BLOB_BYTES, ROWS_BYTES = 4_000_000, 8_000_000
#: Words of a bucket whose windows are sorted at a time; the strings of one minimiser stay together.
PART_WORDS = 500_000
U64 = np.uint64
_A, _B = U64(0x9FB21C651E98DF25), U64(0xD6E8FEB86659FD93)
NONE = np.zeros(0, U64)
_HEAD = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("start", "<u4"), ("windows", "<u2"), ("many", "u1"), ("size", "<u4")])
_SPAN = np.dtype([("k1", "<i8"), ("k2", "<i8"), ("first", "<u4"), ("last", "<u4")])


def _pair(x: np.ndarray, step: int) -> np.ndarray:
    """Hash of each value with the one `step` further on (the last `step` values drop out)."""
    return mix(x[: len(x) - step] * _A + x[step:] * _B)


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` words, from doubling runs."""
    if len(words) < width:
        return np.zeros(0, U64)
    doubled, size = [words], 1
    while size * 2 <= width:
        doubled.append(_pair(doubled[-1], size))
        size *= 2
    out, done = doubled[-1], size
    for level in range(len(doubled) - 2, -1, -1):
        if done + (1 << level) <= width:
            rest = doubled[level][done:]
            out = mix(out[: len(rest)] * _A + rest[: len(out)] * _B)
            done += 1 << level
    return out[: len(words) - width + 1]


def leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value in every run of `width` values."""
    v, p, size = values, np.arange(len(values)), 1

    def joined(step: int) -> None:
        nonlocal v, p
        take = v[step:] < v[:-step]
        v, p = np.where(take, v[step:], v[:-step]), np.where(take, p[step:], p[:-step])

    while size * 2 <= width:
        joined(size)
        size *= 2
    if size < width:
        joined(width - size)
    return p


def ranked(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The grams' places in the order of minimisers: by hash, frequent ones (hot, sorted) after all others."""
    if not len(hot):
        return grams >> U64(1)
    last = hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams
    return (grams >> U64(1)) | (last.astype(U64) << U64(63))


def super_kmers(words: np.ndarray, first: np.ndarray, window: int = WINDOW, gram: int = GRAM, hot: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents' word hashes: document, first word (in the run), number of windows and minimiser of every super-k-mer."""
    none = np.zeros(0, np.int64)
    if len(words) < window:
        return none, none, none, np.zeros(0, U64)
    grams = ranked(rolled(words, gram), hot)
    at = leftmost_min(grams, window - gram + 1)
    count = np.maximum(np.diff(first) - window + 1, 0)
    starts = ranges(first[:-1], count)
    if not len(starts):
        return none, none, none, np.zeros(0, U64)
    place = at[starts]
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (np.diff(starts) != 1)])
    many = np.diff(np.append(new, len(starts)))
    begin = starts[new]
    return np.searchsorted(first, begin, "right") - 1, begin, many, grams[place[new]]


def _sequence_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _Powers.get(len(words) + 1)
    total = np.zeros(len(words) + 1, U64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * _B)


class _Block:
    """Super-k-mers of a block of documents, to be combined and dealt to buckets."""

    def __init__(self, buckets: int, window: int, gram: int, hot: np.ndarray):
        self.buckets, self.window, self.gram, self.hot = buckets, window, gram, hot
        self.heads, self.hashes, self.places, self.minimisers, self.texts, self.bytes = [], [], [], [], [], 0

    def add(self, run: Run, k1: np.ndarray, k2: np.ndarray) -> None:
        starts, ends, first = run.words()
        words = span_hashes(run.data, starts, ends) if len(starts) else np.zeros(0, U64)
        doc, begin, many, minimiser = super_kmers(words, first, self.window, self.gram, self.hot)
        most = 60_000  # windows a head can count
        if len(many) and many.max() > most:
            reps = -(-many // most)
            shift = ranges(np.zeros(len(many), np.int64), reps) * most
            doc, minimiser, left = np.repeat(doc, reps), np.repeat(minimiser, reps), np.repeat(many, reps) - shift
            begin, many = np.repeat(begin, reps) + shift, np.minimum(left, most)
        stop = begin + many + self.window - 1
        head = np.zeros(len(begin), _HEAD)
        head["k1"], head["k2"], head["start"], head["windows"] = k1[doc], k2[doc], begin - first[doc], many
        lo, hi = starts[begin] if len(begin) else begin, ends[stop - 1] if len(begin) else stop
        head["size"] = hi - lo
        self.places.append(lo)
        self.texts.append(memoryview(run.data))
        self.heads.append(head)
        self.minimisers.append(minimiser)
        self.hashes.append(np.stack([_sequence_hashes(words, begin, stop), _sequence_hashes(mix(words ^ _A), begin, stop)], 1) if len(begin) else np.zeros((0, 2), U64))
        self.bytes += len(run.data)

    def flush(self) -> Iterator[dict]:
        if not self.heads or not len(head := np.concatenate(self.heads)):
            return
        place, source = np.concatenate(self.places), np.repeat(np.arange(len(self.heads)), [len(x) for x in self.heads])
        hashes, bucket = np.concatenate(self.hashes), (np.concatenate(self.minimisers) % U64(self.buckets)).astype(np.int64)
        self.heads, self.hashes, self.places, self.minimisers = [], [], [], []
        _, where, back = np.unique(hashes[:, 0], return_index=True, return_inverse=True)
        leader = where[back]
        same = (leader != np.arange(len(head))) & (hashes[leader, 1] == hashes[:, 1])
        head["many"][leader[same]] = 1
        del hashes, where, back, leader
        if same.any():
            known = np.zeros(int(same.sum()), _SPAN)
            for c in ("k1", "k2"):
                known[c] = head[c][same]
            known["first"], known["last"] = head["start"][same], head["start"][same] + head["windows"][same] + (self.window - 2)
            parts = np.array_split(known, max(1, len(known) // 20_000))
            yield {"bucket": [int(part["k1"][0]) % self.buckets for part in parts], "kind": [1] * len(parts), "blob": [part.tobytes() for part in parts]}
        travel = np.flatnonzero(~same)
        travel = travel[np.argsort(bucket[travel], kind="stable")]
        to, size = bucket[travel], head["size"][travel].astype(np.int64)
        new = np.r_[True, to[1:] != to[:-1]]
        before = np.cumsum(size) - size
        part = (before - np.maximum.accumulate(np.where(new, before, 0))) // BLOB_BYTES
        edges = np.append(np.flatnonzero(new | np.r_[False, part[1:] != part[:-1]]), len(to)).tolist()
        press = zstandard.ZstdCompressor(level=3)
        rows, made = {"bucket": [], "kind": [], "blob": []}, 0
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            some = travel[begin:end]
            own = head[some]
            text = b"".join([self.texts[i][lo : lo + n] for i, lo, n in zip(source[some].tolist(), place[some].tolist(), own["size"].tolist(), strict=True)])
            blob = press.compress(b"".join([len(some).to_bytes(4, "little"), *[np.ascontiguousarray(own[c]).tobytes() for c in _HEAD.names], text]))
            rows["bucket"].append(int(to[begin]))
            rows["kind"].append(0)
            rows["blob"].append(blob)
            made += len(text)
            if made >= ROWS_BYTES:
                yield rows
                rows, made = {"bucket": [], "kind": [], "blob": []}, 0
        if made:
            yield rows


def _unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n, at = int.from_bytes(data[:4], "little"), 4
    head = np.zeros(n, _HEAD)
    for c in _HEAD.names:
        kind = _HEAD[c]
        head[c] = np.frombuffer(data, kind, n, at)
        at += n * kind.itemsize
    return head, data[at:]


def repeated_spans(blobs: list[bytes], window: int, gram: int, hot: np.ndarray = NONE) -> Iterator[np.ndarray]:
    """Word spans (k1, k2, first, last) of the windows of one bucket that stand in more than one place."""
    most = sum(zstandard.get_frame_parameters(blob).content_size for blob in blobs) // 2 + len(blobs)
    word, n = np.empty(most, U64), 0  # what is not written takes no memory
    heads, counts, least = [], [], []
    for blob in blobs:
        head, text = _unpack(blob)
        data, offsets = np.frombuffer(text, np.uint8), np.zeros(len(head) + 1, np.int64)
        np.cumsum(head["size"], out=offsets[1:])
        heads.append(head)
        at = 0
        while at < len(head):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
            run = Run(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            starts, ends, first = run.words()
            own = span_hashes(run.data, starts, ends)
            grams = ranked(rolled(own, gram), hot)
            inside = np.full(len(own), np.iinfo(np.uint64).max, U64)
            inside[: len(grams)] = grams
            for k in range(gram - 1):  # runs of words that leave their super-k-mer
                inside[first[1:] - 1 - k] = np.iinfo(np.uint64).max
            least.append(np.minimum.reduceat(inside, first[:-1]))
            counts.append(np.diff(first))
            word[n : n + len(own)] = own
            n += len(own)
            at = to
    head, count = np.concatenate(heads), np.concatenate(counts)
    begin = np.cumsum(count) - count
    _, back, times = np.unique(np.concatenate(least), return_inverse=True, return_counts=True)
    live = np.flatnonzero((times[back] > 1) | (head["many"] > 0))
    live = live[np.argsort(back[live], kind="stable")]
    new = np.r_[True, back[live][1:] != back[live][:-1]][: len(live)]
    before = np.cumsum(count[live]) - count[live]
    part = np.maximum.accumulate(np.where(new, before, 0)) // PART_WORDS
    for some in np.split(live, np.flatnonzero(np.diff(part)) + 1):
        if len(some):
            yield _repeated(head[some], word[ranges(begin[some], count[some])], count[some], window)


def _repeated(head: np.ndarray, word: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """Spans of the windows that stand in more than one place, of strings with all their minimisers' others."""
    begin = np.cumsum(count) - count
    n = head["windows"].astype(np.int64)
    at = ranges(begin, n)
    owner = np.repeat(np.arange(len(head)), n)
    h, g = rolled(word, window)[at], rolled(mix(word ^ _A), window)[at]
    order = np.argsort(h, kind="stable")
    if ((h[order][1:] == h[order][:-1]) & (g[order][1:] != g[order][:-1])).any():
        order = np.lexsort((g, h))
    equal = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
    twice = np.r_[False, equal] | np.r_[equal, False]
    # one string that stands for equal ones makes all windows of its value repeated
    group = np.cumsum(np.r_[True, ~equal]) - 1
    marked = np.bincount(group, (head["many"][owner] > 0)[order]) > 0
    repeated = np.zeros(len(at), bool)
    repeated[order] = twice | marked[group]
    edge = np.flatnonzero(np.r_[True, (repeated[1:] != repeated[:-1]) | (owner[1:] != owner[:-1])])
    last = np.append(edge[1:], len(at)) - 1
    keep = repeated[edge]
    edge, last = edge[keep], last[keep]
    out = np.zeros(len(edge), _SPAN)
    for c in ("k1", "k2"):
        out[c] = head[c][owner[edge]]
    base = head["start"].astype(np.int64)[owner[edge]] - begin[owner[edge]]
    out["first"], out["last"] = base + at[edge], base + at[last] + window - 1
    return out


def frequent_minimisers(docs: DataFrame, window: int, gram: int) -> np.ndarray:
    """Grams that are minimisers of many strings, sorted; HOT of them at most, the most frequent ones."""

    def count(batch):
        held, size = [], 0

        def many():
            grams, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= HOT_IN_BLOCK
            return {"gram": grams[often].astype(np.int64), "n": times[often]}

        for run in runs(batch.column(0)):
            starts, ends, first = run.words()
            words = span_hashes(run.data, starts, ends) if len(starts) else NONE
            n = np.maximum(np.diff(first) - window + 1, 0)
            if n.any():
                grams = rolled(words, gram)
                place = leftmost_min(ranked(grams, NONE), window - gram + 1)[ranges(first[:-1], n)]
                held.append(grams[place[np.r_[True, place[1:] != place[:-1]]]])
            size += len(run.data)
            if size >= BLOCK_BYTES and held:
                yield many()
                held, size = [], 0
        if held:
            yield many()

    counted = map_arrow(docs.select("text"), count, T.StructType([T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())]))
    top = counted.groupBy("gram").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "gram").limit(HOT).select("gram").collect()
    return np.sort(np.array([r["gram"] for r in top], np.int64).astype(U64))


def _packed(docs: DataFrame, buckets: int, window: int, gram: int, hot: np.ndarray) -> DataFrame:
    def deal(batch):
        block = _Block(buckets, window, gram, hot)
        k1, k2 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2))
        for run in runs(batch.column(0)):
            block.add(run, k1[run.first : run.first + run.n], k2[run.first : run.first + run.n])
            if block.bytes >= BLOCK_BYTES:
                yield from block.flush()
                block = _Block(buckets, window, gram, hot)
        yield from block.flush()

    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("blob", T.BinaryType())])
    return map_arrow(docs.select("text", "k1", "k2"), deal, schema)


def repeated_words(docs: DataFrame, buckets: int, partitions: int, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k1, k2, first, last): word spans, both ends included, of all repeated windows of (text, k1, k2)."""
    hot = frequent_minimisers(docs, window, gram)

    def solve(batches):
        def out(spans: np.ndarray):
            if len(spans):
                yield pa.RecordBatch.from_arrays([pa.array(spans["k1"]), pa.array(spans["k2"]), pa.array(spans["first"].astype(np.int32)), pa.array(spans["last"].astype(np.int32))], names=["k1", "k2", "first", "last"])

        def found(held: list[bytes]):
            for spans in repeated_spans(held, window, gram, hot) if held else ():
                yield from out(spans)

        now, held = None, []
        for batch in batches:
            for b, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind:
                    yield from out(np.frombuffer(blob.as_py(), _SPAN))
                    continue
                if b != now:
                    yield from found(held)
                    now, held = b, []
                held.append(blob.as_py())
        yield from found(held)

    dealt = _packed(docs, buckets, window, gram, hot).repartition(partitions, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(releasing(solve), "k1 long, k2 long, first int, last int")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, doc_id: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the text's remaining words joined by single spaces."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", *row_key("doc_id", "text"))
    size = stored_bytes(docs)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, -(-size // bucket_bytes))
    spans = repeated_words(rows, buckets, partitions, window, gram)
    spans = spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    joined = rows.join(spans, ["k1", "k2"], "left").select("doc_id", "text", F.col("spans.first").alias("first"), F.col("spans.last").alias("last"))
    schema = T.StructType([id_field(rows, "doc_id"), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def removed(batch):
        for run in runs(batch.column(1)):
            starts, ends, first = run.words()
            raw = run.data.tobytes()
            lo, hi = (batch.column(k).slice(run.first, run.n) for k in (2, 3))
            size = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lo), 0).to_numpy(zero_copy_only=False), np.int64)
            base = np.repeat(first[:-1], size)
            cover = np.zeros(len(starts) + 1, np.int64)
            np.add.at(cover, base + lo.flatten().to_numpy(), 1)
            np.add.at(cover, base + hi.flatten().to_numpy() + 1, -1)
            gone = np.cumsum(cover[:-1]) > 0
            total = np.r_[0, np.cumsum(gone)]
            n_gone = total[first[1:]] - total[first[:-1]]
            texts = []
            for k in range(run.n):
                own = raw[run.offsets[k] : run.offsets[k + 1]].split()
                if n_gone[k]:
                    own = [w for w, x in zip(own, gone[first[k] : first[k + 1]].tolist(), strict=True) if not x]
                texts.append(b" ".join(own).decode("utf-8", "replace"))
            yield {"doc_id": batch.column(0).slice(run.first, run.n), "n_words": np.diff(first), "n_removed": n_gone, "kept": texts}

    return map_arrow(joined, removed, schema)
