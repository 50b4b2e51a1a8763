"""Operators against models in plain Python, over texts of every odd kind."""

from collections import Counter

import models as M
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, jaccard_join, pii, quality_rules, substring_dedup


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize(("window", "gram"), [(35, 8), (12, 3), (5, 5)])
def test_substring_dedup(docs, texts, window, gram):
    got = by_id(substring_dedup.remove_repeats(docs, window, gram, bucket_bytes=500), "n_words", "n_removed", "kept")
    want = M.kept_after_repeats([t for _, t in texts], window)
    for (i, _), w in zip(texts, want, strict=True):
        assert got[i] == w, i


def test_near_duplicates(docs, texts, monkeypatch):
    want = M.classes(texts)
    assert by_id(jaccard_join.near_duplicates(docs), "n_shingles", "component_id") == want
    kept = [r["doc_id"] for r in jaccard_join.keep_one(docs).select("doc_id").collect()]
    assert sorted(kept) == sorted(i for i, (n, c) in want.items() if n == 0 or c == i)


def test_near_duplicates_of_a_large_group_at_the_threshold(spark):
    """Copies that are similar to some and not to others; larger groups need the last step."""
    words = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(40):
        own = list(words)
        own[(i * 7) % 90], own[(i * 13 + 5) % 90] = f"x{i}", f"y{i % 4}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(words[: 60 + i])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert by_id(jaccard_join.near_duplicates(df), "n_shingles", "component_id") == M.classes(rows)


def test_quality_rules(docs, texts):
    got = by_id(quality_rules.judge(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t in texts:
        s = M.line_statistics(t)
        failed = s[0] < 10 or 100 * s[4] > 20 * s[0]
        assert got[i] == (*s, failed, not failed), i


def test_common_lines_are_removed_and_depleted_documents_rejected(spark):
    common = "All rights  Reserved by the owner of this page and its makers"
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"{common}\n{body(i)}", "a") for i in range(6)] + [(10, f"{common.lower()} \n{body(10)[:40]}", "a"), (11, f"{common}\n{body(11)[:30]}", "b"), (12, f"{common}\n{body(12)}", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = by_id(quality_rules.judge(df, most=6), "n_removed", "kept")
    assert all(got[i] == (12, True) for i in range(6))
    assert got[10] == (12, False) and got[11] == (0, True) and got[12] == (0, True)
    spread = quality_rules.removed_words(quality_rules.line_rows(df), quality_rules.common_lines(quality_rules.line_rows(df), 6))
    assert sorted(r["removed"] for r in spread.collect()) == [12] * 7


def test_shuffled_joins_give_what_broadcast_ones_give(docs, monkeypatch):
    import tessera.llm.native as native

    lines = quality_rules.line_rows(docs)
    common = quality_rules.common_lines(lines, 1)
    want = sorted(map(tuple, quality_rules.removed_words(lines, common).collect()))
    monkeypatch.setattr(quality_rules, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, quality_rules.removed_words(lines, common).collect())) == want != []
    assert native.maybe_broadcast(docs, 1) is docs


@pytest.fixture(scope="module")
def benchmark(spark, texts):
    long = texts[4][1].split(" ")
    items = [(1, " ".join(long[100:150])), (2, " ".join(long[120:135]).upper()), (3, "one two, three"), (4, None), (5, ""), (6, "nowhere at all to be found"), (None, "É ñ ü"), (8, " ".join(texts[0][1].split(" ")[5:15])), (9, "a b c d e f g"), (9, "a b c d e f g"), (10, " ".join(texts[5][1].split()[:300]))]
    return items, spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, h string")


def test_decontamination(docs, texts, benchmark):
    items, table = benchmark
    got = by_id(decontamination.contaminated_words(docs, table), "n_words", "n_hit", "items")
    for i, *want in M.contaminated(texts, items):
        assert got[i] == tuple(want), i
    assert any(n for _, n, _ in got.values())
    kept = {r["doc_id"] for r in decontamination.clean(docs, table).collect()}
    assert kept == {i for i, (_, n, _) in got.items() if not n}
    assert decontamination.clean(docs, table).columns == docs.columns
    nothing = decontamination.contaminated_words(docs, table.limit(0))
    assert {r["n_hit"] for r in nothing.collect()} == {0}


def test_identifiers(docs, texts):
    found = pii.spans(docs).select("doc_id", pii.rendered(F.col("base")).alias("base"))
    got = by_id(found, "base")
    for i, t in texts:
        assert got[i][0] == M.identifiers(t), i
    assert sum(bool(x[0]) for x in got.values()) >= 2


def test_disclosing_terms(spark):
    """A name that stands only beside one address is removed; common words and names seen once are not."""
    filler = "the quick fox and lazy dogs went over some hills".split()
    rows = [(i, f"{filler[i % 9]} {filler[(i * 5) % 9]} {i}7{i} write Zorblax at zed@corp.example now {filler[i % 7]}") for i in range(5)]
    rows += [(10 + i, " ".join(filler * 6) + " write now and at once") for i in range(40)] + [(99, "Quinxy has quinxy@corp.example once")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["all"] for r in pii.spans(df).collect()}
    text = dict(rows)
    for i in range(5):
        extra = [text[i][s["start"] : s["end"]] for s in got[i] if s["kind"] in ("removed", "generalised")]
        assert extra == ["Zorblax"], extra
    assert [s["kind"] for s in got[99]] == ["email"] and not any(got[10 + i] for i in range(40))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "Zorblax" not in clean[0] and "[email]" in clean[0] and clean[99] == "Quinxy has [email] once" and clean[10] == text[10]


def test_odd_rows(odd_docs, no_docs, benchmark):
    """Null ids, repeated ids and rows: every row has a result, equal rows equal ones; no rows give none."""
    _, table = benchmark
    runs = {
        "pii": pii.spans, "sanitise": pii.sanitise, "rules": quality_rules.judge, "substrings": substring_dedup.remove_repeats, "near": jaccard_join.near_duplicates,
        "decontamination": lambda d: decontamination.contaminated_words(d, table),
    }
    for name, run in runs.items():
        assert Counter(r["doc_id"] for r in run(odd_docs).collect()) == Counter({None: 3, 1: 3, 2: 2, 3: 2}), name
        assert run(no_docs).collect() == [], name
    near = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(odd_docs).collect()]
    assert Counter(near) == Counter({(None, 46, 1): 2, (None, 2, None): 1, (1, 46, 1): 2, (1, 1, 1): 1, (2, 0, 2): 2, (3, 0, 3): 2})
    kept = Counter((r["doc_id"], (r["text"] or "")[:5]) for r in jaccard_join.keep_one(odd_docs).collect())
    assert kept == Counter({(1, "w0 w1"): 1, (None, "other"): 1, (1, "anoth"): 1, (2, ""): 2, (3, ""): 2})
    assert jaccard_join.keep_one(no_docs).collect() == [] and jaccard_join.keep_one(odd_docs).columns == odd_docs.columns
    gone = [r["n_removed"] for r in substring_dedup.remove_repeats(odd_docs).where("n_words = 50").collect()]
    assert gone == [50] * 4
