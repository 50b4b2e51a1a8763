"""What a task of the substring deduplication holds, and that its parts give what the whole gives."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from models import kept_after_repeats

from tessera.llm import substring_dedup
from tessera.llm.bytewords import CHUNK, _Powers, runs
from tessera.llm.substring_dedup import GRAM, WINDOW, _Block, repeated_spans


def column(megabytes, seed=4):
    """Texts of 300 words, of which each third holds a passage that others hold too."""
    rng = random.Random(seed)
    words = [f"w{rng.getrandbits(30):x}" for _ in range(20_000)]
    passages = [rng.choices(words, k=60) for _ in range(40)]
    texts = [" ".join(rng.choices(words, k=240) + (rng.choice(passages) if i % 3 == 0 else rng.choices(words, k=60))) for i in range(int(megabytes * 400))]
    return pa.array(texts)


def dealt(texts, buckets):
    """Bytes of packed rows as they are made, a list for each batch."""
    block, keys = _Block(buckets, WINDOW, GRAM, np.zeros(0, np.uint64)), np.arange(len(texts))
    for run in runs(texts):
        block.add(run, keys[run.first : run.first + run.n], keys[run.first : run.first + run.n])
    for rows in block.flush():
        yield [blob for kind, blob in zip(rows["kind"], rows["blob"], strict=True) if kind == 0]


def peak(made):
    """Bytes held at most while all is made and let go."""
    tracemalloc.start()
    try:
        n = sum(1 for _ in made())
        return n, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_block_holds_no_packed_strings_and_leaves_in_slices():
    texts = column(12)
    _Powers.get(CHUNK + 1)
    batches, most = peak(lambda: dealt(texts, 8))
    assert batches > 3  # 1 before
    assert most < 5 * texts.nbytes  # 8.4 before


def test_a_packed_row_is_bounded_where_one_bucket_has_all_strings():
    texts = column(12)
    blobs = [blob for rows in dealt(texts, 1) for blob in rows]
    sizes = [len(substring_dedup._unpack(blob)[1]) for blob in blobs]
    assert sum(sizes) > texts.nbytes and max(sizes) < substring_dedup.BLOB_BYTES + 100_000


def test_a_bucket_is_sorted_in_parts():
    texts = column(12)
    blobs = [blob for rows in dealt(texts, 1) for blob in rows]
    words = sum(len(substring_dedup._unpack(blob)[1]) for blob in blobs) // 9
    _Powers.get(4 * CHUNK)
    _, most = peak(lambda: iter(repeated_spans(blobs, WINDOW, GRAM)))
    assert most < 8 * 8 * words  # 21 before


@pytest.mark.parametrize("words", [1, 300])
def test_parts_lose_no_repeat(spark, monkeypatch, words):
    texts = [*column(0.3).to_pylist(), None, "", "one two"]
    monkeypatch.setattr(substring_dedup, "PART_WORDS", words)
    monkeypatch.setattr(substring_dedup, "BLOB_BYTES", 5_000)
    monkeypatch.setattr(substring_dedup, "ROWS_BYTES", 20_000)
    blobs = [blob for rows in dealt(pa.array(texts), 1) for blob in rows]
    parts = list(repeated_spans(blobs, WINDOW, GRAM))
    assert len(parts) > 1 and len(blobs) > 20
    monkeypatch.setattr(substring_dedup, "PART_WORDS", 10**9)
    (whole,) = repeated_spans(blobs, WINDOW, GRAM)
    assert sorted(np.concatenate(parts).tolist()) == sorted(whole.tolist()) and len(whole) > 30
    gone = [np.zeros(10_000, bool) for _ in texts]
    for k, _, first, last in whole.tolist():
        gone[k][first : last + 1] = True
    for rows in _known(texts):
        for k, _, first, last in rows.tolist():
            gone[k][first : last + 1] = True
    got = [(len(w := (t or "").split()), int(g.sum()), " ".join(x for x, y in zip(w, g[: len(w)], strict=True) if not y)) for t, g in zip(texts, gone, strict=True)]
    assert got == kept_after_repeats(texts, WINDOW)


def _known(texts):
    block, keys = _Block(1, WINDOW, GRAM, np.zeros(0, np.uint64)), np.arange(len(texts))
    for run in runs(pa.array(texts)):
        block.add(run, keys[run.first : run.first + run.n], keys[run.first : run.first + run.n])
    for rows in block.flush():
        for kind, blob in zip(rows["kind"], rows["blob"], strict=True):
            if kind:
                yield np.frombuffer(blob, substring_dedup._SPAN)
