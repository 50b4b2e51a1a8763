"""The operators do the whole job: nothing is drawn, capped or left out."""

import base64
import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import decontamination, jaccard_join, language_id, lm_scoring, pii, quality_rules, substring_dedup
from tessera.llm.common import held_out
from tessera.llm.components import components
from models import classes, contaminated, kept_after_repeats, line_statistics


def test_the_language_model_is_fitted_on_all_triples_at_any_size(spark):
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 12, (400, 3)) @ np.array([lm_scoring.CLASSES**2, lm_scoring.CLASSES, 1]))
    counts = rng.integers(1, 20, len(keys)) + 500
    few, many = (lm_scoring.LogBilinear().fit(keys, counts * k).table()[keys // 256, keys % 256] for k in (1, 10_000))
    assert np.abs(few - many).max() < 0.02
    order = rng.permutation(len(keys))
    assert np.allclose(few, lm_scoring.LogBilinear().fit(keys[order], counts[order]).table()[keys // 256, keys % 256], atol=0.02)
    pick = random.Random(9)
    phrases = ["the cat sat down", "on a red mat", "by my old door", "with no hat"]
    rows = [(i, " ".join(pick.choice(phrases[: 2 + i % 3]) for _ in range(20))) for i in range(200)]
    got = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), ~held_out("doc_id", 7)).where(held_out("doc_id", 7)).agg(F.sum("score"), F.sum("base_score")).first()
    # words of one count share a class, so that the exact class probabilities themselves give 0.76 here
    assert got[0] > 0.78 * got[1]


def test_a_similar_pair_is_found_however_many_leaders_come_first(spark):
    """A text around a shared passage meets many others in more groups than its only similar partner."""
    rng = random.Random(5)
    word = lambda: f"w{rng.getrandbits(40)}"
    passage = [word() for _ in range(80)]
    texts = [passage + [word() for _ in range(26 + k)] for k in range(30)]
    partner = [*passage, *texts[7][80:100], word()]  # differs from text 7 in its end only
    rows = [(k, " ".join(t)) for k, t in enumerate([*texts, partner])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows) and got[30][1] == got[7][1] == 7


def test_pairs_stay_in_proportion_to_rows_around_a_common_passage(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: f"w{rng.getrandbits(40)}"
    passage, made = [word() for _ in range(60)], []
    rows = [(k, " ".join([*passage, *[word() for _ in range(18 + k % 7)]])) for k in range(400)]
    edited = [word() for _ in range(200)]
    for k in range(150):  # near copies of one text, of which many are less similar to each other
        own = list(edited)
        for at in rng.sample(range(200), 4):
            own[at] = word()
        rows.append((1000 + k, " ".join(own)))
    real = jaccard_join.verified
    monkeypatch.setattr(jaccard_join, "verified", lambda pairs, *rest: made.append(pairs.count()) or real(pairs, *rest))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)
    assert sum(made) <= 4 * len(rows)  # of 90,000 in the groups


def test_bounds_of_candidates_drop_no_similar_pair():
    rng, s, t = np.random.default_rng(3), 75, 100
    for n in (1, 2, 3, 4, 7, 40, 400):
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        for gone in range(n // 4 + 1):
            b = np.r_[a[gone:], rng.integers(0, 1 << 62, n // 7 - gone if gone <= n // 7 else 0).astype(np.uint64)]
            common = n - gone
            if t * common < s * (len(b) + gone):
                continue
            size = np.array([len(a), len(b)])
            counters = np.stack([np.bincount((jaccard_join.mix(x) % np.uint64(128)).astype(int), minlength=128) for x in (a, b)]).astype("u1")
            assert jaccard_join._close(size, counters, np.array([0]), np.array([1]), (s, t))[0][0]
            low, high = sorted(jaccard_join.size_band(size, (s, t)))
            assert high - low <= 1


def test_subsets_that_collide_as_one_are_not_asked_for_twice():
    sig, of, tag, need = np.array([5, 5, 7, 5, 9, 9], np.uint64), np.array([0, 0, 0, 0, 1, 2]), np.array([4, 4, 4, 5, 4, 4], np.uint8), np.array([3, 3, 3, 1, 2, 2], np.uint32)
    assert jaccard_join.needs(sig, of, tag, need).tolist() == [2, 2, 2, 1, 2, 2]
    assert jaccard_join.needs(sig[2:], of[2:], tag[2:], need[2:]).tolist() == need[2:].tolist()


def test_verification_compares_whole_shingles(spark):
    rows = spark.createDataFrame([(1, 1, "a b c d e f g h")], "k1 long, k2 long, text string")
    docs = spark.createDataFrame([(9, 1, 1)], "entity long, k1 long, k2 long")
    got = jaccard_join._sets(rows, docs, docs.select("entity")).first()["set"]
    value = lm_scoring._unpress(bytes(got), "<u8")[0]
    assert len(value) == 4 and (np.diff(value.astype(object)) > 0).all() and int(value.max()) >> 40


def test_disclosing_terms_are_found_and_masked_in_whole_texts(spark):
    """The name is far from the address in each document, and stands in one document without it."""
    filler = "the quick fox and lazy dogs went over some hills".split()
    far = " ".join(filler * 4)
    rows = [(i, f"Zorblax wrote {i}7{i} {far} {filler[i]} {i}5 reach zed@corp.example {i}9 {filler[i % 7]} with zorblax") for i in range(8)]
    rows += [(50 + i, f"{far} wrote reach with") for i in range(200)] + [(999, f"{far} ZORBLAX was here, the quick fox")]
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any("zorblax" in t.lower() for t in got.values())
    assert got[999] == f"{far}  was here, the quick fox" and got[50] == rows[8][1] and "wrote" in got[0] and "[email]" in got[0]


def test_copies_of_a_passage_are_one_observation(spark):
    rows = [(i, "Quinxy is once, and no more than once on this page, to be reached at quinxy@corp.example and away from the town of many kinds of men " + chr(97 + i) * 5) for i in range(6)]
    rows += [(50 + i, "plain text of no one") for i in range(60)]
    got = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all("Quinxy" in r["text"] for r in got if r["doc_id"] < 6)


def test_the_language_stage_rejects_junk_and_languages_that_were_not_learned(spark):
    rng = random.Random(4)
    sources = {"en": "the of and thing ation er", "de": "der die und ung keit sch", "fr": "le les des eau que oui", "es": "el los ado mente cion que"}
    words = {lang: ["".join(rng.choice(s.split()) for _ in range(rng.randint(1, 3))) for _ in range(300)] for lang, s in sources.items()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(20, 80))), lang) for i in range(600) for lang in [rng.choice(sorted(words))]]
    junk = [base64.b64encode(rng.randbytes(600)).decode() for _ in range(10)] + [rng.randbytes(300).hex() for _ in range(10)] + ["это предложение написано на языке которого нет в таблице и никто его не знает"]
    df = spark.createDataFrame(rows + [(1000 + i, t, None) for i, t in enumerate(junk)], "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, df, "").collect()}
    assert not any(i >= 1000 for i in kept) and len(kept) >= 0.98 * len(rows)


def test_the_least_language_score_counts_every_held_out_row(spark):
    rng = random.Random(6)
    sources = {"en": "the of and thing ation er", "fr": "le les des eau que ation"}
    words = {lang: ["".join(rng.choice(s.split()) for _ in range(rng.randint(1, 3))) for _ in range(300)] for lang, s in sources.items()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(2, 9))), lang) for i in range(20_000) for lang in [rng.choice(sorted(words))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").union(spark.createDataFrame([(2, "the nation", "en")] * 900, "doc_id long, text string, lang string"))
    apart = held_out("doc_id", 4)
    model = language_id.fit(df, ~apart)
    right = [r["score"] for r in language_id.annotate(df.where(apart), model).where("lang_pred = lang").collect()]
    assert len(right) > 3000
    assert language_id.least_score(df, model, apart) == float(np.quantile(right, language_id.UNSURE))


def test_languages_are_learned_from_every_row(spark):
    """Each row's features have weights, a language of one row is known; copies of a row and the partitions change nothing."""
    rng = random.Random(8)
    own = {"en": "of on in the and with", "fr": "de la en les des avec", "it": "di la in gli che della"}
    rows = []
    for i in range(8000):
        lang = rng.choice(sorted(own))
        words = [rng.choice(own[lang].split()) for _ in range(12)]
        if i % 100 == 0:
            words.append("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(6)))
        rows.append((i, " ".join(words), lang))
    rows.append((9000, "zwykle żadne słowo nie jest stąd", "pl"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    weighs = (model.weights != 0).any(1)
    for row, at, _ in language_id.gram_counts(pa.array([t for _, t, _ in rows])):
        assert weighs[at].all(), row
    got = language_id.predict(df, model).join(df, "doc_id").select((F.col("lang") == F.col("lang_pred")).alias("ok"), "doc_id").collect()
    assert sum(r["ok"] for r in got) > 0.99 * len(rows) and all(r["ok"] for r in got if r["doc_id"] == 9000)
    again = language_id.fit(df.union(spark.createDataFrame([rows[-1]] * 3000, df.schema)).repartition(7, "text"))
    assert again.languages == model.languages and np.allclose(again.weights, model.weights, atol=1e-3 * np.abs(model.weights).max())


def test_machines_in_sums_of_rows_are_those_in_weights():
    rng = np.random.default_rng(3)
    x = rng.random((60, 90)).astype(np.float32) ** 4
    sides = np.stack([np.where(x[:, 0] > x[:, 1], 1, -1), rng.integers(-1, 2, 60)], 1).astype(np.float32)
    got = language_id.fit_svms(x.copy(), sides)
    assert np.allclose(got, language_id.fit_svms(x.copy(), sides, [np.array([0]), np.array([1])]), rtol=0.01, atol=0.01)
    scale = 1 / np.sqrt(np.maximum(x.mean(0), 1e-7))
    for k in range(2):
        some = sides[:, k] != 0
        z, y = (x * scale)[some], sides[some, k]
        share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y < 0).sum())
        v = np.linalg.eigh(z.T @ (share[:, None] * z))[1][:, -1]
        rate = 1 / (1 / 10 + 2 * (v @ (z.T @ (share * (z @ v))) + 1))
        w, b, w0, b0 = np.zeros(90), 0.0, np.zeros(90), 0.0
        for t in range(1, 121):
            m = (t - 1) / (t + 2)
            zw, zb = w + m * (w - w0), b + m * (b - b0)
            g = -2 * share * y * np.maximum(0, 1 - y * (z @ zw + zb))
            w0, b0, w, b = w, b, zw - rate * (zw / 10 + z.T @ g), zb - rate * g.sum()
        assert np.allclose(got[:-1, k], w * scale, rtol=0.02, atol=0.02) and abs(got[-1, k] - b) < 0.02


def test_score_quantiles_are_exact(spark):
    rng = np.random.default_rng(2)
    for values in ([0.5], [0.5, 1.0], [0.7] * 5000, [0.0, 1.0, *[0.25] * 7], np.append(0.6 + rng.random(5000) * 1e-9, rng.random(9)), np.nextafter(0.9, [0, 1]).repeat(9)):
        frame = spark.createDataFrame([(float(v),) for v in values], "score double")
        for share in (0.0, 0.002, 0.31, 1.0):
            assert language_id.score_quantile(frame, share) == float(np.quantile(values, share)) or abs(language_id.score_quantile(frame, share) - float(np.quantile(values, share))) < 1e-15
    assert language_id.score_quantile(spark.createDataFrame([], "score double"), 0.1) is None


def test_columns_of_any_name_pass_with_their_values(spark):
    """Columns called like an operator's own keep name and value, whichever operator passes them on."""
    names = ["k1", "k2", "K1_", "__k1", "spans", "many", "words", "score", "lang_pred", "__score", "keeps", "entity"]
    same = "to be or not to be that is the question they asked of us and more"
    texts = [same, same, "reach me at a.b@corp.example by the old mill on any day of rest", None, "", "nothing of interest is said by anyone in this short line of text"]
    rows = [(i, t, "en", *[f"{n}-{i}" for n in names]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", *[f"`{n}` string" for n in names]]))
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog again and again")], "item_id long, text string")
    for run in (lambda d: decontamination.clean(d, items), pii.sanitise, jaccard_join.keep_one, lambda d: corpus_pipeline.language(spark, d, "")):
        out = run(df)
        assert out.dtypes == df.dtypes
        for r in out.collect():
            assert [r[n] for n in names] == [f"{n}-{r['doc_id']}" for n in names]


def test_secrets_and_shared_parts_disclose(spark):
    """A word that stands beside keys alone is removed, one that mostly does is generalised, what stands beside them by chance is left."""
    rng = random.Random(3)
    filler = [f"w{chr(97 + i)}{chr(97 + j)}x" for i in range(20) for j in range(10)]
    say = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    key = lambda: rng.randbytes(20).hex()
    rows = [(i, f"{say(30)} token = {key()} {'vault' if i % 3 else say(1)} {say(20)}") for i in range(60)]
    rows += [(100 + i, say(60) + (" vault" if i < 20 else "")) for i in range(900)]
    got = {r["doc_id"]: r["all"] for r in pii.spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    text = dict(rows)
    for i in range(60):
        assert [s["kind"] for s in got[i] if s["kind"] in ("removed", "secret")] == ["removed", "secret"]  # digits of a key may pass for a card
        assert [(text[i][s["start"] : s["end"]], s["value"]) for s in got[i] if s["kind"] == "generalised"] == [("vault", "secret")] * (i % 3 > 0)
    assert not any(got[100 + i] for i in range(20, 900))


def test_components_agree_in_one_task_and_in_steps(spark):
    rng = random.Random(8)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)] + [(7, 7)]
    frame = spark.createDataFrame(links, "a long, b long")
    steps = {tuple(r) for r in components(frame, one_task=0).collect()}
    assert steps == {tuple(r) for r in components(frame).collect()} and (460, 400) in steps and (559, 500) in steps
    assert components(frame.limit(0)).count() == components(frame.limit(0), one_task=-1).count() == 0


def test_texts_and_words_of_more_than_a_megabyte(spark):
    """One word longer than a run of bytes, a long document and its near copy, beside short ones."""
    rng = random.Random(12)
    long = [f"w{rng.getrandbits(24)}" for _ in range(140_000)]
    other = list(long)
    other[70_000] = "changed"
    mail = "a.b@corp.example"
    texts = ["y" * 1_050_000 + " a b c d e f", " ".join(long), " ".join(other) + f" {mail}", "a b c d e f", "short and done", None]
    assert len(texts[1]) > 1_200_000
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect()}
    assert got == classes(rows) and got[2][1] == 1
    kept = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.remove_repeats(df).collect()}
    assert [kept[i] for i in range(6)] == kept_after_repeats(texts, substring_dedup.WINDOW)
    items = [(1, " ".join(long[100_000:100_030]))]
    hit = {r["doc_id"]: (r["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in decontamination.contaminated_words(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert [hit[i] for i in range(6)] == contaminated(rows, items)
    judged = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in quality_rules.judge(df).collect()}
    assert [judged[i] for i in range(6)] == [line_statistics(t) for t in texts]
    spans = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["base"]] for r in pii.spans(df).collect()}
    assert spans == {0: [], 1: [], 2: [("email", mail)], 3: [], 4: [], 5: []}
    scored = {r["doc_id"]: r["n_tokens"] for r in lm_scoring.score(df, F.lit(True)).collect()}
    assert scored == {0: 8, 1: 140_001, 2: 140_002, 3: 7, 4: 4, 5: 1}
