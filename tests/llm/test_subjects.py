import random
import warnings

import numpy as np
import pytest

from lodeweave.llm.subjects import Cells, calibrate, complement_weights, subject_areas, tokens

TERMS = {"alpha": ["zebra", "lion crossing", "tiger"], "beta": ["violin", "cello tone", "oboe"], "gamma": ["magma", "lava flow", "basalt"], "delta": ["anchor", "keel", "rigging line"], "eps": ["sonnet", "stanza", "rhyme scheme"], "zeta": ["loom", "weft", "yarn dye"]}


def corpus(n, seed):
    rng = random.Random(seed)
    docs, truth = [], {}
    filler = ["the figure was given in section", "several results were shown", "work on it goes on", "this one matters less so"]
    for i in range(n):
        subs = rng.sample(sorted(TERMS), rng.choice([0, 1, 1, 2]))
        lines = [f"{rng.choice(filler)} {rng.randint(1, 99)}." for _ in range(4)]
        for s in subs:
            lines += [f"The {rng.choice(TERMS[s])}s {rng.choice(filler)}." for _ in range(5)]
        other = rng.choice([s for s in sorted(TERMS) if s not in subs])
        lines += [f"A passing {rng.choice(TERMS[other])} {rng.choice(filler)}."] * (len(lines) > 8 and i % 3 == 0)
        rng.shuffle(lines)
        docs.append((i, " ".join(lines)))
        truth[i] = set(subs)
    return docs, truth


def run(spark, docs, labels, **kw):
    d = spark.createDataFrame([(*x, 1, "m") for x in docs], "doc_id long, text string, words int, marks string")
    a = spark.createDataFrame([(s, "t") for s in TERMS] + [(None, "t")], "subject string, title string")
    y = spark.createDataFrame(labels, "doc_id long, subject string")
    return subject_areas(d, a, y, **kw)


def test_held_out_documents(spark):
    docs, truth = corpus(600, 1)
    rng = random.Random(2)
    labels = [(i, s) for i in range(0, 600, 6) for s in (sorted(truth[i]) or ["none"])]
    labels += [(rng.randrange(600), rng.choice(sorted(TERMS))) for _ in range(5)] + [(3, None), (12, "no such subject"), (None, "beta"), labels[0]]
    rows = run(spark, [*docs, docs[0], (700, None), (701, ""), (702, "  "), (None, docs[5][1])], labels).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = [i for i in truth if i % 6]
    right = sum(got.get(i, set()) == truth[i] for i in held)
    assert right >= 0.97 * len(held)
    assert not {700, 701, 702} & set(got) and len(rows) == len({(r.doc_id, r.subject) for r in rows})


def test_no_labels_no_documents_no_subjects(spark):
    docs, _ = corpus(5, 3)
    assert run(spark, docs, []).count() == 0
    assert run(spark, [], [(1, "alpha")]).count() == 0


def test_word_cells():
    c = Cells()
    assert c["Zebras"] == c["zebra"] and c["recombinación"] == c["recombination"] and c["."] == -1 and c["12"] == 0 and c["ß"] > 0


def test_complement_weights_ignore_even_words():
    n, by = np.zeros(8), np.zeros((8, 2))
    n[:3], by[0], by[1], by[2] = (100, 100, 100), (50, 50), (98, 2), (0, 0)
    w = complement_weights(n, by, 300.0, np.array([148.0, 52.0]), 5.0, 0.8)
    assert w[0].max() == 0 and w[1, 0] > 1 and w[1, 1] == 0 and w[2].max() == 0


def test_calibration_is_of_each_subject_and_bears_noise():
    rng = np.random.default_rng(0)
    share = rng.random((4000, 3)) * 0.6
    border = np.array([0.1, 0.2, 0.35])
    truth = share > border
    label = truth & (rng.random(share.shape) > 0.25)  # a quarter of the labels is missing
    label |= rng.random(share.shape) < 0.01
    slope, least = calibrate(share, label.astype(float))
    assert (np.abs(least - border) < 0.02).all() and (slope > 20).all()


def test_calibration_with_few_labels_stays_at_the_usual_threshold():
    slope, least = calibrate(np.array([[0.5, 0.0], [0.0, 0.0]]), np.array([[1.0, 0.0], [0.0, 0.0]]))
    assert (np.abs(least - 0.175) < 0.03).all() and (slope > 10).all()
    assert (np.abs(calibrate(np.zeros((0, 2)), np.zeros((0, 2)))[1] - 0.175) < 1e-6).all()


def test_tokens_of_scripts_without_blanks():
    assert tokens("酵母菌です。次 a b. C") == ["酵母", "母菌", "菌で", "です", "。", "次", "a", "b", ".", "C"]
    assert tokens("don't 3.5 x") == ["don", "t", "3", "5", "x"]


def test_documents_without_blanks_get_their_subject(spark):
    rng = random.Random(4)
    word = {"alpha": "酵母発酵", "beta": "統計検定"}
    filler = ["結果を示す", "図を見よ", "今後の課題", "方法を述べる"]
    docs, truth = [], {}
    for i in range(300):
        s = rng.choice([None, "alpha", "beta"])
        parts = [rng.choice(filler) for _ in range(4)] + [word[s] + rng.choice(filler) for _ in range(4) if s]
        rng.shuffle(parts)
        docs.append((i, "。".join(parts) + "。"))
        truth[i] = {s} - {None}
    labels = [(i, s) for i in range(0, 300, 5) for s in (truth[i] or ["none"])]
    got = {}
    for r in run(spark, docs, labels).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got.get(i, set()) == truth[i] for i in truth) >= 290


def test_rounds_end_when_the_weights_are_still(spark):
    docs, truth = corpus(300, 1)
    labels = [(i, s) for i in range(0, 300, 3) for s in (sorted(truth[i]) or ["none"])]
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert run(spark, docs, labels).count()
    with pytest.warns(UserWarning, match="still move"):
        run(spark, docs, labels, document_rounds=1, still=0.0)
