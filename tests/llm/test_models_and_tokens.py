"""Tokenising, packing and the learned operators."""

import collections
import math
import random

import models as M
import numpy as np
import pytest
from pyspark.sql import functions as F
from conftest import frame, prose, vocabulary

from tessera.llm import language_id, lm_scoring, packing, quality_fm, token_counts
from tessera.llm.common import held_out
from tessera.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return {i: t.encode(x or "", add_special_tokens=False).ids for i, x in texts}


def test_pieces_are_the_tokenizers_ids_and_pack_without_gaps(docs, encoded):
    from zlib import crc32

    stored = packing.encoded_pieces(docs, PATH, capacity=512, keep_ids=True).cache()
    ids = collections.defaultdict(dict)
    for r in stored.collect():
        own = np.frombuffer(bytes(r["ids"]), "<u4")
        assert len(own) == r["length"] and crc32(bytes(r["ids"])) == r["ids_crc32"] and r["start"] == 512 * r["piece"]
        ids[r["doc_id"]][r["piece"]] = own.tolist()
    for i, want in encoded.items():
        assert sum((ids[i][k] for k in sorted(ids[i])), []) == [*want, 1], i
    for rule in ("norm", "dot"):
        packed = packing.pack(stored.drop("ids"), 512, rule=rule).collect()
        bins = collections.defaultdict(list)
        for r in packed:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 512
        assert len(packed) == stored.count() and len(bins) <= 1.1 * sum(r["length"] for r in packed) / 512 + 1


def test_every_capacity_holds():
    rng = random.Random(5)
    counts = collections.Counter(rng.randint(1, 100) for _ in range(3000))
    for limits in ({}, {"max_docs": 4}, {"max_attention": 2500}, {"max_docs": 7, "max_attention": 6000}):
        if "max_attention" in limits:
            counts = collections.Counter({k: n for k, n in counts.items() if k * k <= limits["max_attention"]})
        slots, bins = packing.plan_bins(dict(counts), 100, **limits)
        load = collections.defaultdict(list)
        slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
        for k, (length, rank, first, each, offset) in enumerate(slots.tolist()):
            end = slots[k + 1][1] if k + 1 < len(slots) and slots[k + 1][0] == length else counts[length]
            for nth in range(end - rank):
                load[first + nth // each].append((offset + nth % each * length, length))
        assert len(load) == bins and sum(map(len, load.values())) == sum(counts.values())
        for own in load.values():
            assert [o for o, _ in sorted(own)] == list(np.cumsum([0, *[n for _, n in sorted(own)]])[:-1])
            assert sum(n for _, n in own) <= 100 and len(own) <= limits.get("max_docs", 100) and sum(n * n for _, n in own) <= limits.get("max_attention", 10**4)
    with pytest.raises(ValueError):
        packing.plan_bins({101: 1}, 100)


def test_token_counts(docs, encoded, no_docs):
    sums = token_counts.suffix_sums(token_counts.length_histogram(token_counts.encoded_lengths(docs, PATH))).cache()
    lengths = sorted(len(x) for x in encoded.values())
    for r in sums.collect():
        at = r["length"]
        assert r["n_docs"] == lengths.count(at) and r["docs_ge"] == sum(x >= at for x in lengths) and r["tokens_ge"] == sum(x for x in lengths if x >= at)
        assert r["truncated_total"] == sum(min(x, at) for x in lengths)
    for r in token_counts.totals_at(sums, [0, 10, 100, 10**6]).collect():
        assert (r["total"], r["truncated"], r["n_longer"]) == (sum(lengths), sum(min(x, r["limit"]) for x in lengths), sum(x > r["limit"] for x in lengths))
    for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r["length"] == lengths[math.ceil(r["q"] * len(lengths)) - 1]
    assert token_counts.suffix_sums(token_counts.length_histogram(token_counts.encoded_lengths(no_docs, PATH))).collect() == []


def test_token_counts_of_odd_rows(odd_docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    want = collections.Counter(len(t.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd_docs.collect())
    got = token_counts.length_histogram(token_counts.encoded_lengths(odd_docs, PATH)).collect()
    assert {r["length"]: r["n_docs"] for r in got} == dict(want)


def test_base_scores_are_exact_and_probabilities_sum_to_one(docs, texts):
    training = ~held_out("doc_id", 7)
    learn = {r["doc_id"] for r in docs.where(training).collect()}
    tokens = {i: [*M.blank_words((t or "").translate(M.LOWER)), None] for i, t in texts}
    c = collections.Counter(x for i in learn for x in tokens[i])
    total, distinct = sum(c.values()), len(c)
    for r in lm_scoring.score(docs, training).collect():
        own = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[x] > 0 for x in own), total)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in own), rel_tol=1e-9)
        assert r["score"] < 0
    counts = lm_scoring.Counts(*_sums(c, c[None]), c[None])
    words = np.array([n for w, n in c.items() if w is not None] + [0])
    cls, share = counts.classes(words)
    for k in set(cls.tolist()):
        assert math.isclose((10 ** share[cls == k]).sum(), 1, rel_tol=1e-9)
    model = lm_scoring.LogBilinear().fit(np.array([5, 70_000], np.uint32), np.array([3, 4]), 20_000)
    assert np.allclose((10.0 ** model.table()).sum(1), 1, atol=1e-3)


def test_scores_equal_a_plain_model(spark, docs, texts, monkeypatch):
    """Every document's score by dictionaries of words and pairs, over the table of the network that was fitted."""
    made, real = [], lm_scoring.LogBilinear.fit
    monkeypatch.setattr(lm_scoring.LogBilinear, "fit", lambda self, *a, **k: made.append(real(self, *a, **k)) or made[-1])
    training = ~held_out("doc_id", 7)
    learn = {r["doc_id"] for r in docs.where(training).collect()}
    got = {r["doc_id"]: r["score"] for r in lm_scoring.score(docs, training).collect()}
    table = made[0].table()
    tokens = {i: [*M.blank_words((t or "").translate(M.LOWER)), None] for i, t in texts}
    c, pair = collections.Counter(x for i in learn for x in tokens[i]), collections.Counter()
    for i in learn:
        pair.update(zip([None, *tokens[i]], tokens[i], strict=False))
    counts = lm_scoring.Counts(*_sums(c, c[None]), c[None])
    known = [w for w in c if w is not None]
    cls, share = counts.classes(np.array([c[w] for w in known] + [0]))
    of = {**dict(zip(known, zip(cls.tolist(), share.tolist()), strict=False)), None: (lm_scoring.END, 0.0)}
    unknown = (int(cls[-1]), float(share[-1]))
    followers, words = collections.Counter(of[v][0] for v, _ in pair), collections.Counter(k for k, _ in of.values())
    after = collections.Counter()
    for (v, _), n in pair.items():
        after[v] += n
    assert all(after[v] == c[v] for v in of)  # what makes Z exact
    for i, own in tokens.items():
        total, c1, c2, v = 0.0, lm_scoring.END, lm_scoring.END, None
        for w in own:
            k, inner = of.get(w, unknown)
            network = 10.0 ** (float(table[c2 * lm_scoring.CLASSES + c1, k]) + inner)
            at = of.get(v, unknown)[0]
            noise = lm_scoring.PAIR_NOISE * max(1.0, followers[at] / max(words[at], 1))
            total += math.log10((pair[v, w] + noise * network) / (c[v] + noise))
            c1, c2, v = k, c1, w
        assert math.isclose(got[i], total, rel_tol=1e-5), i


def _sums(c, ends):
    seen = np.array([n for w, n in c.items() if w is not None])
    which = lm_scoring._bin(seen) - lm_scoring.TOP
    return np.stack([np.bincount(which, minlength=64), np.bincount(which, seen + 1, minlength=64).astype(np.int64)]), np.sort(seen)[-(lm_scoring.TOP + 1) :]


def test_the_language_model_beats_the_base_on_unseen_text(spark):
    rng = random.Random(9)
    phrases = ["the cat sat down", "on a red mat", "by my old door", "with no hat"]
    rows = [(i, " ".join(rng.choice(phrases[: 2 + i % 3]) for _ in range(20))) for i in range(200)]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), ~held_out("doc_id", 7)).where(held_out("doc_id", 7)).agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > 0.85 * got[1]


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(4)
    sources = {"en": "the of and thing ation er", "de": "der die und ung keit sch", "fr": "le les des eau que oui", "es": "el los ado mente cion que"}
    words = {lang: ["".join(rng.choice(s.split()) for _ in range(rng.randint(1, 3))) for _ in range(300)] for lang, s in sources.items()}
    rows = [(i, prose(rng, rng.randint(20, 80), words[lang]), lang) for i in range(600) for lang in [rng.choice(sorted(words))]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages(tongues, docs, odd_docs, no_docs):
    model = language_id.fit(tongues, ~held_out("doc_id", 4))
    assert model.families == ["germanic", "romance"] and len(model.pairs) == 2
    got = language_id.predict(tongues, model).join(tongues, "doc_id").where(held_out("doc_id", 4)).select((F.col("lang") == F.col("lang_pred")).cast("double").alias("ok"), "score").agg(F.avg("ok"), F.min("score"), F.max("score")).first()
    assert got[0] > 0.97 and 0 <= got[1] <= got[2] <= 1
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(docs, model).collect()}
    for i in (6, 7, 8, 14, 15):  # null, empty, blank, signs only
        assert odd[i] == ("und", 0.0)
    assert odd[16][0] != "und" and all(0 <= s <= 1 for _, s in odd.values())
    assert len(language_id.predict(odd_docs, model).collect()) == 10 and language_id.predict(no_docs, model).collect() == []
    untaught = language_id.fit(no_docs)
    assert {r["lang_pred"] for r in language_id.predict(docs, untaught).collect()} == {"und"}
    assert language_id.annotate(docs, model).columns[: len(docs.columns)] == docs.columns


def test_quality(spark, docs, odd_docs, no_docs):
    rng = random.Random(6)
    words = vocabulary(8, "abcdefghij")
    good = lambda: prose(rng, 80, words) + "."
    bad = lambda: " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in prose(rng, 60, words).split())
    rows = [(i, (bad if i % 5 == 0 else good)()) for i in range(500)]
    table = frame(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i, _ in rows] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    machine = quality_fm.fit(table, labels, ~held_out("id", 4))
    got = {r["doc_id"]: r["score"] for r in quality_fm.score(table, machine).where(held_out("doc_id", 4)).collect()}
    assert sum((s >= 0.7) == (i % 5 != 0) for i, s in got.items()) / len(got) > 0.97
    for odd in (docs, odd_docs):
        scores = [r["score"] for r in quality_fm.score(odd, machine).collect()]
        assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert quality_fm.score(no_docs, machine).collect() == []
    untaught = quality_fm.fit(table, labels.limit(0))
    assert {r["score"] for r in quality_fm.score(docs, untaught).collect()} == {0.5}


def test_the_sum_of_squares_identity_gives_the_pairwise_sum():
    machine = quality_fm.FactorisationMachine()
    rng = np.random.default_rng(1)
    machine.w = rng.normal(size=machine.w.shape).astype(np.float32)
    at, x = np.array([3, 50, 700]), np.array([0.5, 2.0, -1.0])
    pairs = sum(machine.v[at[i]] @ machine.v[at[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    got, _ = machine.raw(np.zeros(3, np.int64), at, x, 1)
    assert math.isclose(got[0], machine.w[at] @ x + pairs, rel_tol=1e-5)


def test_packing_and_scores_of_odd_rows(odd_docs, no_docs):
    for run in (lambda d: packing.pack_documents(d, PATH), lambda d: lm_scoring.score(d, ~held_out("doc_id", 7))):
        assert collections.Counter(r["doc_id"] for r in run(odd_docs).collect()) == collections.Counter({None: 3, 1: 3, 2: 2, 3: 2})
        assert run(no_docs).collect() == []


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, 7), (3, 2)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in links:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
