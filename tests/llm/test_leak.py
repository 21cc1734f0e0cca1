import random
import re
import unicodedata

from pyspark.sql import functions as F

import lodeweave.llm.leak as leak
from lodeweave.llm.leak import leaked_passages, normal_words

WORD = re.compile(r"[^\W_]+")


def words(t):
    return WORD.findall(unicodedata.normalize("NFKC", "".join(c for c in t or "" if unicodedata.category(c) != "Cf")).lower())


def brute(corpus, items, n):
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in corpus:
        w = words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ()) if d is not None and i is not None}
    return out


def run(spark, corpus, items, **kw):
    c = spark.createDataFrame([(d, t, "x", 1) for d, t in corpus], "doc_id string, text string, words string, pos int")
    i = spark.createDataFrame([(d, t, "x", 1) for d, t in items], "item_id long, text string, term string, item int")
    return {(r.doc, r.item) for r in leaked_passages(c, i, "doc_id", "text", "item_id", "text", **kw).collect()}


def test_normal_words():
    for t in ["Don't STOP_here", "ﬁne µm ２３ a​b", "É é", "", "a_b", "İx", "x²", "5 µM\u00a0at 3°C", "a\u0301b c\u200d\u0301d", "ΟΔΟΣ aΣ Σ", "\u2009x\u00ady", "日本 １２", "ﬁΣ"]:
        assert normal_words(t).split() == words(t)
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choices("aB1 _-µ°\u0301\u200dΣσİﬁ\uff13\u1100\u1161é\u00a0", k=rng.randint(1, 12)))
        assert normal_words(t).split() == words(t)
    assert normal_words(None) is None


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 25)))) for i in range(20)] + [(99, None), (98, ""), (None, "a b c d e f g h i j k l m")]
    corpus = []
    for d in range(60):
        body = rng.choices(vocabulary, k=60)
        if d % 3 == 0:
            w = rng.choice(items[:20])[1].split()
            body[20:20] = w[rng.randint(0, 2) :]
        corpus.append((f"P{d % 25}", " ".join(body).upper() if d % 2 else ", ".join(body)))
    corpus += [(None, items[0][1]), ("P1", None), ("P2", ""), corpus[0]]
    for n in (5, 12):
        assert run(spark, corpus, items + items[:3], window=n) == brute(corpus, items, n)


def test_one_phrase_in_a_third_of_the_corpus(spark):
    phrase = "all data are in the supplement of this paper and can be had on request"
    corpus = [(f"D{i}", phrase if i % 3 == 0 else f"nothing here {i}") for i in range(90)]
    assert len(run(spark, corpus, [(1, phrase), (2, "x " + phrase)], window=12)) == 60


def test_proximity(spark):
    item = " ".join(f"t{i}" for i in range(20))
    changed = " ".join("other" if i in (4, 9) else f"t{i}" for i in range(20))
    assert run(spark, [("D", changed)], [(1, item)], window=12) == set()
    assert run(spark, [("D", changed)], [(1, item)], window=12, near=19) == {("D", 1)}


def test_longest_run_is_told_whole(spark):
    item = " ".join(f"t{i}" for i in range(80))
    c = spark.createDataFrame([("D", "x " + " ".join(f"t{i}" for i in range(7, 64)) + " y"), ("E", item), ("F", item.replace("t40", "z"))], "d string, t string")
    i = spark.createDataFrame([(1, item)], "i long, u string")
    assert {r.doc: r.words for r in leaked_passages(c, i, "d", "t", "i", "u").collect()} == {"D": 57, "E": 80, "F": 40}


def test_many_terms_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(leak, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(leak, "broadcast_if_small", lambda df: df)
    phrase = "all data are in the supplement of this paper and can be had on request"
    corpus = [(f"D{i}", "before " * (i % 4) + phrase + " after" if i % 3 == 0 else f"nothing here {i}") for i in range(30)]
    assert run(spark, corpus, [(1, phrase), (2, "x " + phrase)], window=12) == brute(corpus, [(1, phrase), (2, "x " + phrase)], 12)


def test_words_of_ascii_texts_in_the_jvm(spark):
    texts = ["Don't STOP_here", "", "  \t", "a_b\x00c\x7f1", "\u0130x", "caf\u00e9 2\u00b2", "-"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", leak.normalised(F.col("t")).alias("w")).collect()
    assert all(r.w.split() == words(r.t) for r in rows)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == set()
    assert run(spark, [("D", "a b c")], []) == set()
