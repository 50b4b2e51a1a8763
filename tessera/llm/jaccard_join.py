"""Exact near-duplicate classes by PartEnum signatures on word shingles.

Sets. A text's set is its distinct shingles of SHINGLE words (64-bit hashes). Equal sets are one entity.

Signatures. Two sets with Jaccard similarity of at least s/t differ in at most
k = (|a| + |b|) (t - s) / (t + s) elements. Entities are put into bands by size; an entity takes part in its
band and, if a partner may be in it, in the next, so two similar sets meet in the larger one's band. A band splits
the domain of shingles into partitions in pairs, and of each pair enumerates the subsets of one
partition: the signature of a subset is the hash of the set's shingles in it. k differing shingles
spoil k subsets at most, so an entity with more than k subsets that are not empty shares one with every similar set,
and shares at least (subsets - k) of them. That excess is also required: an entity with fewer colliding
signatures has no similar partner and is dropped before any pair is made.

Levels. Very common shingles (at most HOT of them) are left out of the domain on level 0, which changes what is
compared but not the bound. An entity that then has too few subsets also takes part on level 1, where each of its other
shingles is a subset of its own: a similar set lacks at most a share (1 - s/t) of any set's shingles, so it shares all but that
many of them. If an entity has no more of them than that, it also takes part on level 2, with subsets of all shingles, and
if those are too few, on level 3, where each of all shingles is a subset, which always suffices. Two sets that are both short on
one level meet on a later one.

First links. Each entity is compared, by whole sets, with the leader it shares most signature groups with; linked entities are
a class. Most members of a group of copies of any size so meet in about one comparison each.

Further links. Only groups that hold several classes still matter, and of these an entity needs as many as a
similar partner implies, again; few entities are left. Their shingles are ordered from the rarest (among them) on, and each
entity stands at the first of them that a similar partner cannot all lack, with the place of the shingle in the order, cut into
groups by shingle and size band. A pair of a group is a candidate if sizes, what is left after the two places, and the
distance between two small histograms of the sets all permit the similarity; none of these bounds drops a
similar pair. In two rounds each entity is compared with its nearest candidate of another class and classes
merge; then all candidates that still are in different classes are compared. Within a class no pair is made, dissimilar ones
rarely pass the bounds, and no similar pair is left out.

Texts with fewer words than a shingle are one shingle of all words. Texts without words, and null texts, are empty
and are linked with nothing. Rows with null ids take part; a class's id is its least id that is not
null. Repeated rows are in one class. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.bytewords import ASCII_LOWER, Run, mix, ranges, runs, span_hashes
from tessera.llm.common import cut, fresh, id_field, map_arrow, releasing, row_key, stored_bytes
from tessera.llm.components import components
from tessera.llm.lm_scoring import _press, _unpress
from tessera.llm.native import maybe_broadcast
from tessera.llm.substring_dedup import rolled

SHINGLE, SIMILARITY = 5, (75, 100)
#: Common shingles left out on level 0, at most; counted in blocks that have them in HOT_IN_BLOCK sets or more.
HOT, HOT_IN_BLOCK = 65_536, 5
#: Counters of an entity's histogram, and rounds of nearest candidates before all that are left.
COUNTERS, ROUNDS = 256, 2
#: Pairs whose histograms are compared at a time, and candidates held before each entity's nearest is kept.
PAIRS_AT_ONCE, CANDIDATES = 65_536, 1_000_000
#: Stored input bytes for one bucket of signatures; text bytes of a block of sets and of one that is signed, which bound a worker's memory.
BUCKET_BYTES, BLOCK_BYTES, SIGNED_BYTES = 8_000_000, 8_000_000, 2_000_000
#: Bits of a signature that travel. Equal ones of different sets only make more to compare; for those of one set `needs` asks less.
SIGNATURE_BITS = 40
U64 = np.uint64
_K = U64(0xA24BAED4963EE407)


# -- sets ------------------------------------------------------------------------------------------


def shingle_sets(run: Run, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, sorted within it, and where each document's begin (n + 1)."""
    starts, ends, first = run.words()
    if not len(starts):
        return np.zeros(0, U64), np.zeros(run.n + 1, np.int64)
    words = span_hashes(ASCII_LOWER[run.data], starts, ends)
    count = np.diff(first)
    n = np.where(count >= width, count - width + 1, 0)
    whole = rolled(words, width)
    doc = np.repeat(np.arange(run.n), n)
    value = whole[ranges(first[:-1], n)] if len(whole) else np.zeros(0, U64)
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        sizes = count[short]
        some = words[ranges(first[short], sizes)]
        place = ranges(np.zeros(len(short), np.int64), sizes).astype(U64)
        at = np.cumsum(sizes) - sizes
        own = mix(np.add.reduceat(mix(some + place * _K), at) + sizes.astype(U64))
        doc, value = np.concatenate([doc, short]), np.concatenate([value, own])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.r_[True, (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])]
    return value[keep], np.searchsorted(doc[keep], np.arange(run.n + 1))


def digests(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One 63-bit number for each set; 0 for empty ones."""
    n = np.diff(first)
    out = np.zeros(len(n), U64)
    some = np.flatnonzero(n)
    if len(some):
        at = first[:-1][some]
        out[some] = mix(np.add.reduceat(mix(value), at) ^ mix(np.add.reduceat(mix(value ^ _K), at) + n[some].astype(U64)))
    return (out >> U64(1)).astype(np.int64)


def limit(n: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Most elements in which a set of n elements and a similar one that is not smaller differ."""
    s, t = similarity
    return (n + n * t // s) * (t - s) // (t + s)


def bands(similarity: tuple[int, int]) -> np.ndarray:
    """Upper ends of the size bands: three steps of the similarity each."""
    s, t = similarity
    ends = [4]
    while ends[-1] < 1 << 40:
        ends.append(int(ends[-1] * (t / s) ** 3) + 1)
    return np.array(ends, np.int64)


# -- signatures ------------------------------------------------------------------------------------


def signatures(value: np.ndarray, first: np.ndarray, hot: np.ndarray, similarity: tuple[int, int]) -> tuple[np.ndarray, ...]:
    """Signature, set, tag (band and level) and need (collisions that a similar partner implies) of every subset."""
    n = np.diff(first)
    ends = bands(similarity)
    s, t = similarity
    k = limit(n, similarity)
    cold = ~(hot[np.minimum(np.searchsorted(hot, value), len(hot) - 1)] == value) if len(hot) else np.ones(len(value), bool)
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
    out: list[tuple] = []

    def level(which: np.ndarray, band: np.ndarray, depth: int) -> np.ndarray:
        """Signatures of the sets `which` in their bands on a level; returns those with too few subsets."""
        if not len(which):
            return which
        took = np.full(len(n), -1)
        took[which] = band
        keep = took[owner] >= 0
        if depth < 2:
            keep &= cold
        v, own = value[keep], owner[keep]
        tag = (took[own] * 4 + depth).astype(U64)
        if depth % 2:
            sig, of = mix(v * _K + tag), own
            spoiled = n - -(-n * s // t)  # shingles that a similar set may lack
        else:
            parts = np.maximum(2, -(-ends[took[own]] // 2)).astype(U64)
            part = mix(v ^ (tag * _K)) % parts  # numbers 2i and 2i + 1 are the subsets of pair i
            key = own.astype(U64) << U64(40) | part
            order = np.argsort(key)
            key, v, tag = key[order], v[order], tag[order]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
            of = (key[at] >> U64(40)).astype(np.int32)
            sums = np.add.reduceat(mix(v + _K), at) if len(at) else np.zeros(0, U64)
            sig = mix(sums + mix(key[at] & U64((1 << 40) - 1)) + tag[at] * _K)
            spoiled = k
        need = np.bincount(of, minlength=len(n)) - spoiled
        out.append((sig, of, (took[of] * 4 + depth).astype(np.uint8), np.maximum(1, need[of]).astype(np.uint32)))
        return which[need[which] < 1]

    own_band = np.searchsorted(ends, n)
    some = np.flatnonzero(n > 0)
    for which, band in ((some, own_band[some]), ((more := some[n[some] * t // s > ends[own_band[some]]]), own_band[more] + 1)):
        for depth in range(4):
            took = np.full(len(n), -1)
            took[which] = band
            which = level(which, band, depth)
            band = took[which]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.uint32))


def needs(sig: np.ndarray, of: np.ndarray, tag: np.ndarray, need: np.ndarray) -> np.ndarray:
    """need, less the subsets of one set and tag whose shortened signatures are equal: they collide as one."""
    key = of.astype(np.int64) << 8 | tag
    if len(np.unique(mix(sig ^ mix(key.astype(U64) + _K)))) == len(sig):
        return need
    order = np.lexsort((sig, key))
    same = key[order][1:] == key[order][:-1]
    twice = np.r_[False, same & (sig[order][1:] == sig[order][:-1])]
    number = np.cumsum(np.r_[False, ~same])
    less = np.empty(len(sig), np.int64)
    less[order] = np.bincount(number, twice).astype(np.int64)[number]
    return np.maximum(1, need.astype(np.int64) - less).astype(np.uint32)


_BLOB = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("blob", T.BinaryType())])


def _dealt(bucket: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[dict]:
    """A row with a packed blob for each bucket that gets any of the columns' elements."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_buckets, columns = bucket[order], [c[order] for c in columns]
    edges = np.r_[np.flatnonzero(np.r_[True, sorted_buckets[1:] != sorted_buckets[:-1]]), len(order)]
    yield {
        "bucket": sorted_buckets[edges[:-1]],
        "kind": np.full(len(edges) - 1, kind),
        "blob": [_press(*[c[lo:hi] for c in columns]) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)],
    }


def _by_bucket(df: DataFrame, partitions: int, f: Callable[[dict[int, list[bytes]]], Iterator[dict]], schema: T.StructType = _BLOB) -> DataFrame:
    """f of each bucket's blobs by kind; a bucket is in memory at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)

    def solve(batches):
        def made(held):
            for columns in f(held):
                yield pa.RecordBatch.from_arrays([pa.array(columns[x.name], x.type) for x in out], schema=out)

        now, held = None, {}
        for batch in batches:
            for b, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if b != now:
                    if held:
                        yield from made(held)
                    now, held = b, {}
                held.setdefault(kind, []).append(blob.as_py())
        if held:
            yield from made(held)

    return df.select("bucket", "kind", "blob").repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(releasing(solve), schema)


def _columns(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    parts = [_unpress(b, *kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) for i in range(len(kinds))]


def _blocks(batch, text: int, most: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sets of blocks of documents (shingles, first), each with the rows that it covers."""
    values, sizes, size = [], [], 0
    for run in runs(batch.column(text)):
        value, first = shingle_sets(run)
        values.append(value)
        sizes.append(np.diff(first))
        size += len(run.data)
        if size >= most:
            yield np.concatenate(values), np.r_[0, np.cumsum(np.concatenate(sizes))]
            values, sizes, size = [], [], 0
    if values:
        yield np.concatenate(values), np.r_[0, np.cumsum(np.concatenate(sizes))]


# -- steps -----------------------------------------------------------------------------------------


def entities(rows: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, entity, n, hot): a row for each document; and, with hot, for common shingles of a block and their n."""
    schema = T.StructType([id_field(rows, "doc_id"), *[T.StructField(c, T.LongType()) for c in ("k1", "k2", "entity", "n", "hot")]])

    def f(batch):
        at = 0
        for value, first in _blocks(batch, 1):
            n, own = np.diff(first), digests(value, first)
            none = pa.nulls(len(n), pa.int64())
            yield {"doc_id": batch.column(0).slice(at, len(n)), "k1": batch.column(2).slice(at, len(n)), "k2": batch.column(3).slice(at, len(n)), "entity": own, "n": n, "hot": none}
            at += len(n)
            _, one = np.unique(own, return_index=True)  # equal sets count once
            shingles, times = np.unique(value[ranges(first[one], n[one])], return_counts=True)
            hot = times >= HOT_IN_BLOCK
            if hot.any():
                none = pa.nulls(int(hot.sum()), pa.int64())
                yield {"doc_id": pa.nulls(len(none), batch.column(0).type), "k1": none, "k2": none, "entity": none, "n": times[hot], "hot": shingles[hot].astype(np.int64)}

    return cut(map_arrow(rows, f, schema))


def collisions(rows: DataFrame, hot: np.ndarray, buckets: int, partitions: int, similarity: tuple[int, int]) -> DataFrame:
    """Signature groups of entities that have enough collisions for a similar partner: blobs (signature, entity) by signature."""

    def sign(batch):
        for value, first in _blocks(batch, 0, SIGNED_BYTES):
            own = digests(value, first)
            _, one = np.unique(own, return_index=True)
            n = np.diff(first)[one]
            sig, of, tag, need = signatures(value[ranges(first[one], n)], np.r_[0, np.cumsum(n)], hot, similarity)
            sig >>= U64(64 - SIGNATURE_BITS)
            need = needs(sig, of, tag, need)
            yield from _dealt((sig % U64(buckets)).astype(np.int64), 0, sig, own[one][of].astype("<i8"), tag, need)

    def collide(held):
        sig, entity, tag, need = _columns(held[0], "<u8", "<i8", "u1", "<u4")
        order = np.lexsort((tag, entity, sig))
        sig, entity, tag, need = sig[order], entity[order], tag[order], need[order]
        new = np.r_[True, (sig[1:] != sig[:-1]) | (entity[1:] != entity[:-1]) | (tag[1:] != tag[:-1])]
        sig, entity, tag, need = sig[new], entity[new], tag[new], need[new]
        same = sig[1:] == sig[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        yield from _dealt(entity[keep] % buckets, 0, sig[keep], entity[keep], tag[keep], need[keep])

    def enough(held):
        sig, entity, tag, need = _columns(held[0], "<u8", "<i8", "u1", "<u4")
        order = np.lexsort((tag, entity))
        sig, entity, tag, need = sig[order], entity[order], tag[order], need[order]
        edge = np.flatnonzero(np.r_[True, (entity[1:] != entity[:-1]) | (tag[1:] != tag[:-1])])
        size = np.diff(np.r_[edge, len(entity)])
        keep = np.repeat(size >= need[edge], size)
        yield from _dealt((sig[keep] % U64(buckets)).astype(np.int64), 0, sig[keep], entity[keep], tag[keep], need[keep])

    signed = map_arrow(rows.select("text"), sign, _BLOB)
    return _by_bucket(_by_bucket(_by_bucket(signed, partitions, collide), partitions, enough), partitions, lambda held: _grouped(held, buckets))


def _grouped(held: dict, buckets: int) -> Iterator[dict]:
    """By entity. kind 0: (entity, leader, groups); kind 1: (group, entity, tag, need, times), where groups with the same members are one."""
    sig, entity, tag, need = _columns(held[0], "<u8", "<i8", "u1", "<u4")
    order = np.lexsort((tag, entity, sig))
    sig, entity, tag, need = sig[order], entity[order], tag[order], need[order]
    edge = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    size = np.diff(np.r_[edge, len(sig)])
    leader = np.repeat(entity[edge], size)
    follows = entity != leader
    if follows.any():
        pair, times = np.unique(np.stack([entity[follows], leader[follows]], 1), axis=0, return_counts=True)
        yield from _dealt(pair[:, 0] % buckets, 0, pair[:, 0].astype("<i8"), pair[:, 1].astype("<i8"), times.astype("<u4"))
    own = mix(np.add.reduceat(mix(mix(entity.astype(U64)) + tag * _K), edge) + size.astype(U64))
    _, one, times = np.unique(own, return_index=True, return_counts=True)
    keep = size[one] > 1
    one, times = one[keep], times[keep]
    at = ranges(edge[one], size[one])
    number = np.repeat((own[one] >> U64(1)).astype(np.int64), size[one])
    yield from _dealt(entity[at] % buckets, 1, number, entity[at], tag[at], need[at], np.repeat(times, size[one]).astype("<u4"))


_PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _leaders(groups: DataFrame, partitions: int) -> DataFrame:
    """(a, b): each entity b with the leader a that it shares most groups with."""

    def f(held):
        if 0 not in held:
            return
        b, a, times = _columns(held[0], "<i8", "<i8", "<u4")
        pair, back = np.unique(np.stack([b, a], 1), axis=0, return_inverse=True)
        total = np.bincount(back.reshape(-1), times, len(pair))
        pair = pair[np.lexsort((pair[:, 1], -total, pair[:, 0]))]
        most = np.flatnonzero(np.r_[True, pair[1:, 0] != pair[:-1, 0]])
        yield {"a": pair[most, 1], "b": pair[most, 0]}

    return _by_bucket(groups.where("kind = 0"), partitions, f, _PAIRS)


def _sets(rows: DataFrame, docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(entity, set) of the wanted entities; one document of each is read."""
    one = docs.join(maybe_broadcast(wanted), "entity", "left_semi").groupBy("entity").agg(F.min(F.struct("k1", "k2")).alias("k")).select("entity", "k.k1", "k.k2")
    texts = rows.join(maybe_broadcast(one), ["k1", "k2"]).select("entity", "text")
    schema = T.StructType([T.StructField("entity", T.LongType()), T.StructField("set", T.BinaryType())])

    def f(batch):
        for run in runs(batch.column(1)):
            value, first = shingle_sets(run)
            yield {"entity": batch.column(0).slice(run.first, run.n), "set": [_press(value[a:b].astype("<u8")) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]}

    return map_arrow(texts, f, schema)


def verified(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar."""
    s, t = similarity
    both = pairs.join(sets.select(F.col("entity").alias("b"), F.col("set").alias("set_b")), "b").join(sets.select(F.col("entity").alias("a"), F.col("set").alias("set_a")), "a")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def f(batch):
        keep, last, held = np.zeros(batch.num_rows, bool), None, None
        for i in range(batch.num_rows):
            if (raw := batch.column(2)[i].as_py()) != last:
                last, held = raw, _unpress(raw, "<u8")[0]
            own = _unpress(batch.column(3)[i].as_py(), "<u8")[0]
            if min(len(held), len(own)) * t < max(len(held), len(own)) * s:
                continue
            at = np.minimum(np.searchsorted(held, own), len(held) - 1)
            common = int((held[at] == own).sum())
            keep[i] = t * common >= s * (len(held) + len(own) - common)
        yield {"a": batch.column(0).filter(pa.array(keep)), "b": batch.column(1).filter(pa.array(keep))}

    return map_arrow(both.select("a", "b", "set_a", "set_b"), f, schema)


def _labelled(labels: DataFrame, buckets: int) -> DataFrame:
    """Blobs of kind 2 (entity, label), by entity."""
    return map_arrow(labels, lambda batch: _dealt(batch.column(0).to_numpy() % buckets, 2, batch.column(0).to_numpy(), batch.column(1).to_numpy()), _BLOB)


def _named(held: dict, entity: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The label of each entity by a bucket's blobs of kind 2, and whether it has one."""
    if 2 not in held:
        return entity, np.zeros(len(entity), bool)
    node, label = _columns(held[2], "<i8", "<i8")
    order = np.argsort(node)
    node, label = node[order], label[order]
    at = np.minimum(np.searchsorted(node, entity), len(node) - 1)
    return np.where(node[at] == entity, label[at], entity), node[at] == entity


def unsettled(groups: DataFrame, labels: DataFrame, buckets: int, partitions: int) -> DataFrame:
    """(entity, label) of entities with enough collisions in groups of several classes for a similar partner in another class."""

    def named(held):
        if 1 in held:
            number, entity, tag, need, times = _columns(held[1], "<i8", "<i8", "u1", "<u4", "<u4")
            yield from _dealt(number % buckets, 1, number, entity, tag, need, times, _named(held, entity)[0])

    def mixed(held):
        number, entity, tag, need, times, label = _columns(held[1], "<i8", "<i8", "u1", "<u4", "<u4", "<i8")
        order = np.lexsort((label, number))
        edge = np.flatnonzero(np.r_[True, number[order][1:] != number[order][:-1]])
        size = np.diff(np.r_[edge, len(order)])
        several = label[order][edge] != label[order][edge + size - 1]
        at = order[np.repeat(several, size)]
        yield from _dealt(entity[at] % buckets, 1, entity[at], tag[at], need[at], times[at], label[at])

    def enough(held):
        entity, tag, need, times, label = _columns(held[1], "<i8", "u1", "<u4", "<u4", "<i8")
        order = np.lexsort((tag, entity))
        entity, tag, need, times, label = (x[order] for x in (entity, tag, need, times, label))
        edge = np.flatnonzero(np.r_[True, (entity[1:] != entity[:-1]) | (tag[1:] != tag[:-1])])
        edge = edge[np.add.reduceat(times.astype(np.int64), edge) >= need[edge]]
        _, one = np.unique(entity[edge], return_index=True)
        yield {"entity": entity[edge][one], "label": label[edge][one]}

    both = groups.where("kind = 1").unionByName(_labelled(labels, buckets))
    schema = T.StructType([T.StructField("entity", T.LongType()), T.StructField("label", T.LongType())])
    return _by_bucket(_by_bucket(_by_bucket(both, partitions, named), partitions, mixed), partitions, enough, schema)


def size_band(n: np.ndarray, similarity: tuple[int, int]) -> np.ndarray:
    """Numbers of bands so wide that a set's smaller partners are in its own and the one below."""
    s, t = similarity
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(edges[-1] * t // s + 1)
    return np.searchsorted(np.array(edges, np.int64), n, "right")


def prefixes(sets: DataFrame, buckets: int, partitions: int, similarity: tuple[int, int]) -> DataFrame:
    """By entity. kind 0: (entity, n, COUNTERS bytes each); kind 1: (entity, n, shingle, place) of its rarest shingles.

    A similar set has at least one of them; the place is that in the order from the rarest shingle on. Shingles
    that no other set has take places but are not kept.
    """
    s, t = similarity

    def split(batch):
        values = [_unpress(raw, "<u8")[0] for raw in batch.column(1).to_pylist()]
        entity, n = batch.column(0).to_numpy(), np.array([len(v) for v in values])
        value, owner = np.concatenate(values), np.repeat(np.arange(len(n)), n)
        counters = np.bincount(owner * COUNTERS + (mix(value) % U64(COUNTERS)).astype(np.int64), minlength=len(n) * COUNTERS)
        counters = np.minimum(counters, 255).astype("u1").reshape(len(n), COUNTERS)
        yield from _dealt(entity % buckets, 0, entity, n.astype("<u4"), np.ascontiguousarray(counters).view(f"V{COUNTERS}").reshape(-1))
        yield from _dealt((value % U64(buckets)).astype(np.int64), 1, value, entity[owner], n[owner].astype("<u4"))

    def counted(held):
        for blob in held.get(0, []):
            entity = _unpress(blob, "<i8")[0]
            yield {"bucket": entity[:1] % buckets, "kind": [0], "blob": [blob]}
        if 1 in held:
            value, entity, n = _columns(held[1], "<u8", "<i8", "<u4")
            _, back, times = np.unique(value, return_inverse=True, return_counts=True)
            keep = times[back] > 1
            yield from _dealt(entity[keep] % buckets, 1, value[keep], entity[keep], n[keep], times[back][keep].astype("<u4"))

    def cut_off(held):
        for blob in held.get(0, []):
            entity = _unpress(blob, "<i8")[0]
            yield {"bucket": entity[:1] % buckets, "kind": [0], "blob": [blob]}
        if 1 in held:
            value, entity, n, times = _columns(held[1], "<u8", "<i8", "<u4", "<u4")
            order = np.lexsort((value, times, entity))
            value, entity, n = value[order], entity[order], n[order].astype(np.int64)
            edge = np.flatnonzero(np.r_[True, entity[1:] != entity[:-1]])
            size = np.diff(np.r_[edge, len(entity)])
            place = np.arange(len(entity)) - np.repeat(edge, size) + n - np.repeat(size, size)
            keep = place <= n - -(-n * s // t)
            yield from _dealt(entity[keep] % buckets, 1, entity[keep], n[keep].astype("<u4"), value[keep], place[keep].astype("<u4"))

    return _by_bucket(_by_bucket(map_arrow(sets, split, _BLOB), partitions, counted), partitions, cut_off)


def _close(size: np.ndarray, counters: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs' histograms permit the similarity, and the histograms' distance over the sizes' sum."""
    s, t = similarity
    both = size[a] + size[b]
    apart = np.abs(counters[a].astype(np.int16) - counters[b]).sum(1, dtype=np.int64)
    return apart <= both - 2 * -(-both * s // (s + t)), apart / both


def candidates(prefix: DataFrame, alive: DataFrame, buckets: int, partitions: int, similarity: tuple[int, int], nearest: bool) -> DataFrame:
    """(a, b): pairs of alive entities in different classes that may be similar; nearest: one for each entity that has any."""
    s, t = similarity

    def deal(held):
        if not {0, 1, 2} <= held.keys():
            return
        entity, n, value, place = _columns(held[1], "<i8", "<u4", "<u8", "<u4")
        keep = _named(held, entity)[1]
        entity, n, value, place = entity[keep], n[keep].astype(np.int64), value[keep], place[keep]
        band = size_band(n, similarity)
        guest = place <= n - -(-2 * n * s // (s + t))  # may be the smaller one of a pair; also goes to the band above
        entity, n, value, place, band = (np.concatenate([x, x[guest]]) for x in (entity, n, value, place, band))
        guest = np.r_[np.zeros(len(guest), bool), np.ones(int(guest.sum()), bool)]
        group = mix(value + (band + guest).astype(U64) * _K)
        bucket = (group % U64(buckets)).astype(np.int64)
        yield from _dealt(bucket, 1, group, entity, n.astype("<u4"), place.astype("<u4"), guest.astype("u1"))
        own, counters = _columns(held[0], "<i8", "<u4", f"V{COUNTERS}")[::2]
        there = np.unique(np.stack([bucket, entity], 1), axis=0)
        order = np.argsort(own)
        at = order[np.searchsorted(own[order], there[:, 1])]
        yield from _dealt(there[:, 0], 0, there[:, 1], _named(held, there[:, 1])[0], counters[at])

    def meet(held):
        group, entity, n, place, guest = _columns(held[1], "<u8", "<i8", "<u4", "<u4", "u1")
        order = np.lexsort((entity, n, group))
        group, entity, n, guest, rest = group[order], entity[order], n[order].astype(np.int64), guest[order] > 0, (n.astype(np.int64) - place)[order]
        own, label, counters = _columns(held[0], "<i8", "<i8", f"V{COUNTERS}")
        own, one = np.unique(own, return_index=True)
        label, counters = label[one], counters[one].view("u1").reshape(-1, COUNTERS)
        who = np.searchsorted(own, entity)
        size = np.zeros(len(own), np.int64)
        size[who] = n
        held_pairs, count = [], 0
        low, step = np.arange(len(group) - 1), 0
        while len(low):  # members of a group `step` further on, which are not smaller
            step += 1
            low = low[low + step < len(group)]
            high = low + step
            low = low[(group[low] == group[high]) & (n[low] * t >= n[high] * s)]
            for k in range(0, len(low), PAIRS_AT_ONCE):
                a = low[k : k + PAIRS_AT_ONCE]
                b = a + step
                fits = ~guest[b] & (label[who[a]] != label[who[b]]) & (np.minimum(rest[a], rest[b]) * (s + t) >= (n[a] + n[b]) * s)
                a, b = who[a[fits]], who[b[fits]]
                close, apart = _close(size, counters, a, b, similarity)
                held_pairs.append((a[close], b[close], apart[close]))
                count += int(close.sum())
                if count > CANDIDATES:
                    held_pairs = [kept(held_pairs)]
                    count = len(held_pairs[0][0])
                    if not nearest:
                        yield made(own, held_pairs[0])
                        held_pairs, count = [], 0
        if held_pairs:
            yield made(own, kept(held_pairs))

    def kept(pairs: list[tuple]) -> tuple[np.ndarray, ...]:
        """Each pair once; for nearest only that of the least distance of each entity (of ties, that of the least numbers)."""
        a, b, apart = (np.concatenate([p[i] for p in pairs]) for i in range(3))
        a, b = np.minimum(a, b), np.maximum(a, b)
        _, one = np.unique(np.stack([a, b], 1), axis=0, return_index=True)
        a, b, apart = a[one], b[one], apart[one]
        if nearest and len(a):
            of, at = np.r_[a, b], np.tile(np.arange(len(a)), 2)
            order = np.lexsort((at, apart[at], of))
            first = np.r_[True, of[order][1:] != of[order][:-1]]
            one = np.unique(at[order][first])
            a, b, apart = a[one], b[one], apart[one]
        return a, b, apart

    def made(own: np.ndarray, pairs: tuple[np.ndarray, ...]) -> dict:
        return {"a": own[pairs[0]], "b": own[pairs[1]], "apart": pairs[2]}

    both = prefix.unionByName(_labelled(alive, buckets))
    schema = T.StructType([*_PAIRS.fields, T.StructField("apart", T.DoubleType())])
    found = _by_bucket(_by_bucket(both, partitions, deal), partitions, meet, schema)
    if not nearest:
        return found.select("a", "b").distinct()
    ends = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart"))
    best = ends.groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, component_id, entity, keeps) of every row; k1 and k2 are the row's key, entity its set's number; keeps marks one row key of each class."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.select("doc_id", "text", *row_key("doc_id", "text"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(spark.sparkContext.defaultParallelism, -(-stored_bytes(docs) // BUCKET_BYTES))
    made = entities(rows)
    common = made.where("hot is not null").groupBy("hot").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "hot").limit(HOT).select("hot").collect()
    hot = np.sort(np.array([r["hot"] for r in common], np.int64).astype(U64))
    own = made.where("hot is null")
    groups = cut(collisions(rows, hot, buckets, partitions, similarity))
    pairs = cut(_leaders(groups, partitions))
    wanted = cut(pairs.select(F.col("a").alias("entity")).unionByName(pairs.select(F.col("b").alias("entity"))).distinct())
    sets = cut(_sets(rows, own, wanted))
    if sets.count() > wanted.count():  # rows with equal id and text
        sets = cut(sets.dropDuplicates(["entity"]))
    links = cut(verified(pairs, sets, similarity))
    labels = cut(components(links))
    alive = cut(unsettled(groups, labels, buckets, partitions))
    prefix = cut(prefixes(sets.join(maybe_broadcast(alive.select("entity")), "entity", "left_semi"), buckets, partitions, similarity))
    for k in range(ROUNDS + 1):
        pairs = cut(candidates(prefix, alive, buckets, partitions, similarity, k < ROUNDS))
        if not pairs.count():
            break
        links = links.unionByName(cut(verified(pairs, sets, similarity)))
        labels = cut(components(links))
        alive = pairs.select(F.col("a").alias("entity")).unionByName(pairs.select(F.col("b").alias("entity"))).distinct()
        alive = alive.join(labels.withColumnRenamed("node", "entity"), "entity", "left").select("entity", F.coalesce("label", "entity").alias("label"))
    named = own.join(maybe_broadcast(labels.withColumnRenamed("node", "entity")), "entity", "left")
    named = named.withColumn("label", F.when(F.col("n") > 0, F.coalesce("label", "entity")))
    least = named.where("label is not null").groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("least"))
    out = named.join(cut(least), "label", "left")  # stored, so that a large class's rows can be split by the join
    alone = F.col("n") == 0
    keeps = alone | ((F.col("k1") == F.col("least.k1")) & (F.col("k2") == F.col("least.k2")))
    return out.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"), "entity", keeps.alias("keeps"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The rows, all their columns, with one of each class: that of the least id. Rows without words all stay; of rows with equal id and text one stays."""
    found = near_duplicates(docs, doc_id, text, similarity)
    a, b, many, words = fresh(docs, "k1", "k2", "many", "words")
    stay = found.where("keeps").groupBy(F.col("k1").alias(a), F.col("k2").alias(b)).agg((F.count(F.lit(1)) > 1).alias(many), (F.max("n_shingles") > 0).alias(words))
    k1, k2 = row_key(F.col(doc_id), F.col(text).cast("string"))
    keyed = docs.withColumns({a: k1, b: k2}).join(maybe_broadcast(stay), [a, b])
    once = ~(F.col(many) & F.col(words))
    out = keyed.where(once)
    if stay.where(~once).limit(1).count():  # rows with equal id and text
        out = out.unionByName(keyed.where(~once).dropDuplicates([a, b]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
