import collections
import os
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline as P
from tessera.llm import queries as Q

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@needs_data
def test_stages_keep_the_columns_and_pass_on_what_they_keep(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, DATA)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= before and len(after) > 0.7 * len(before), name
        assert name == "pack" or docs.columns == columns, name
        before = after


@needs_data
def test_run_applies_the_stages_in_turn(spark, monkeypatch):
    monkeypatch.setattr(P, "STAGES", [P.STAGES[0], P.STAGES[-1]])
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = P.pack(spark, P.language(spark, docs, DATA), DATA)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in df.collect())
    assert key(P.run(spark, DATA)) == key(want)


def test_all_stages_decide_as_planted(spark, tmp_path):
    """run() over a small table: copies, a benchmark passage, personal data, texts without letters, null and repeated rows, extra columns."""
    rng = random.Random(11)
    parts = {"en": "the of and thing ation er", "de": "der die und ung keit sch", "fr": "le les des eau que oui", "es": "el los ado mente cion que"}
    words = {lang: ["".join(rng.choice(s.split()) for _ in range(rng.randint(1, 3))) for _ in range(300)] for lang, s in parts.items()}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    langs = [rng.choice(sorted(words)) for _ in range(400)]
    texts = [say(lang, rng.randint(40, 90)) for lang in langs]
    passage = say("en", 30)
    texts[1], texts[2] = texts[0], texts[0] + " once"
    texts[3] = texts[3] + " " + passage + " " + say(langs[3], 9)
    texts[4] = texts[4] + " mail a.b@corp.example now"
    rows = [(i, t, lang, f"x{i}") for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    rows += [(900, None, "en", "n"), (901, "", None, "n"), (902, "12 345 !!", "en", "n"), (None, say("en", 50), None, "null id"), (7, texts[7], langs[7], "x7")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, k1 string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    assert not {1, 2, 3, 900, 901, 902} & set(by) and {0, 4, None} <= set(by)
    assert len(by) >= 0.95 * 396 and all(sorted(r["piece"] for r in own) == list(range(len(own))) for own in by.values())
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.word_bpe())
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, Q.END_ID], "<u4").tobytes())
    for i, own in by.items():
        if i is not None and i != 4:
            assert own[0]["ids_crc32"] == crc(texts[i]), i
    assert by[4][0]["ids_crc32"] == crc(texts[4].replace("a.b@corp.example", "[email]"))
    places = collections.defaultdict(list)
    for r in out:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= Q.CAPACITY


def test_an_empty_table_gives_an_empty_result(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert P.run(spark, str(tmp_path)).collect() == []


@needs_data
@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_agrees_with_its_oracle(spark, name):
    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.sql(Q.ORACLES[name])
    got = Q.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


@needs_data
@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLES)))
def test_has_a_row_for_every_document(spark, name):
    out = Q.QUERIES[name](spark, DATA)
    if "doc_id" in out.columns:
        n = spark.read.parquet(f"{DATA}/documents.parquet").count()
        assert out.select("doc_id").distinct().count() == n
    else:
        assert out.count() > 0
