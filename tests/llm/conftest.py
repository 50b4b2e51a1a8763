import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k1 string, k2 string, start string, spans string, score string, words string, entity string, kind string, __k1 string"


def prose(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def vocabulary(seed, letters, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) with copies, near copies, shared passages, odd signs, nulls, empty, short and very long texts."""
    rng = random.Random(3)
    words = vocabulary(1, "abcdefghijklm")
    base = prose(rng, 260, words)
    passage = prose(rng, 60, words)
    near = base.split(" ")
    near[40], near[150] = "changed", "twice"
    out = [base, base, " ".join(near), base.upper(), prose(rng, 100, words) + " " + passage + " " + prose(rng, 90, words), passage + "\n" + prose(rng, 200, words)]
    out += [None, "", " \n\t ", "one", "one", "one two three", "One  two\nthree", "é ñ ü", "... !! ##", " ", "日本語 の テキスト です ね はい", "a\x1cb c\x7fd", "don't stop <|endoftext|> it's İstanbul"]
    out += ["mail a.b+c@ex-am.ple.org, bad@x, x@y..z and +1 (017) 555-7713; ip 1.2.3.4 300.1.1.1 01.2.3.255 1.2.3.4.5.6.7.8 card 4539 1488 0343 6467 4539148803436468 1-2", "+123 +1234567890 +1-234-567-8901- ++49 30 12345678 4539148803436467"]
    out += ["same line here\nsame line here\nother line\nsame line here " + prose(rng, 30, words), "a b c d e f a b c d e f g h", prose(rng, 6000, words), "x" * 30000, "7" * 30000, ("z " * 9000).strip()]
    out += [prose(rng, rng.randint(5, 120), words) for _ in range(40)]
    return list(enumerate(out))


def frame(spark, rows):
    full = [(i, t, "en" if i is not None and i % 3 else None, f"s{(i or 0) % 3}", len(t or ""), *["clash"] * 9) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, texts):
    return frame(spark, texts).repartition(5).cache()


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, repeated ids and repeated rows."""
    same = " ".join(f"w{i}" for i in range(50))
    return frame(spark, [(None, same), (None, same), (None, "other text of a null id"), (1, same), (1, same), (1, "another text"), (2, None), (2, None), (3, ""), (3, "")])


@pytest.fixture(scope="session")
def no_docs(spark):
    return frame(spark, [(1, "x")]).limit(0)
