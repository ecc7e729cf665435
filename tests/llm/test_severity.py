import random

import numpy as np
import pytest

from phrasegrid.llm import severity as s


def test_masks_are_taken_off():
    plain = s.normalize("you idiot moron")
    for text in ("you ｉｄｉｏｔ moron", "YOU i.d.i.o.t moron", "you i d i o t moron", "you іdіоt mоron", "you i​dio‌t moron", "you 1d1ot m0r0n".replace("1d", "id"), "you idiiiiot moron"):
        assert s.normalize(text) == plain, text
    assert s.normalize("垃​圾") == "垃圾" and s.normalize("垃.圾") == "垃*圾" == s.normalize("垃**圾")
    assert s.normalize("call 12345 at 6") == s.normalize("call 9 at 77")


def corpus(n, seed):
    """Invented passages: a target word is bad in one frame and harmless in another; one bad passage is enough."""
    rng = random.Random(seed)
    things = ["lamp", "train", "parcel", "window", "river"]
    texts, bad = [], []
    for _ in range(n):
        parts = [rng.choice([f"the {rng.choice(things)} is near the {rng.choice(things)}", f"we counted {rng.randint(1, 99)} {rng.choice(things)}s", "the glossary lists zurk as a rude word"]) for _ in range(rng.randint(1, 25))]
        flag = rng.random() < 0.3
        if flag:
            parts[rng.randrange(len(parts))] = rng.choice(["you are a zurk", "shut up zurk face", "you zurk get out"])
        sep = rng.choice([". ", "\n", " "])
        texts.append(sep.join(parts))
        bad.append(flag)
    return texts, np.array(bad)


@pytest.fixture(scope="module")
def model():
    texts, bad = corpus(1500, 1)
    rng = np.random.default_rng(0)
    labels = np.where(rng.random(len(bad)) < 0.05, ~bad, bad)
    return s.fit(texts, np.where(labels, 2, 0), np.ones(len(bad)))


def test_held_out_accuracy_in_spite_of_wrong_labels(model):
    texts, bad = corpus(800, 2)
    flagged = model.exceeds(model.scores(texts), 2) >= 0.5
    assert (flagged == bad).mean() > 0.97
    assert (np.diff(model.cuts) > 0).all()


def test_one_passage_in_a_long_text_counts(model):
    texts, bad = corpus(400, 3)
    calm = [t for t, b in zip(texts, bad) if not b and "\n" in t]
    long = "\n".join(calm * 60)
    assert len(long) > 2 * s.BLOCK
    low, high = model.scores([long, long[: len(long) // 2] + "\nyou are a zurk\n" + long[len(long) // 2 :]])
    assert model.exceeds(low, 2) < 0.5 < model.exceeds(high, 2)
    one = model.scores(texts)
    assert np.allclose(one, [model.scores([t])[0] for t in texts])


def test_severity_rises_with_the_score(model):
    x = model.severity(np.linspace(-10, 10, 50))
    assert (np.diff(x) > 0).all() and 0 < x[0] and x[-1] < 2


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    score, grade, weight, cuts = rng.normal(size=9), np.array([0, 1, 2] * 3), rng.random(9), np.array([0.3, 1.1])

    def loss(score, cuts):
        over = np.stack([np.ones(9), *(1 / (1 + np.exp(c - score)) for c in cuts), np.zeros(9)])
        return -np.sum(weight * np.log(over[grade, np.arange(9)] - over[grade + 1, np.arange(9)]))

    by_score, by_cut = s._gradients(score, grade, cuts, weight)
    e = 1e-6
    for i in range(9):
        d = np.eye(9)[i] * e
        assert by_score[i] == pytest.approx((loss(score + d, cuts) - loss(score - d, cuts)) / 2 / e, abs=1e-5)
    for i in range(2):
        d = np.eye(2)[i] * e
        assert by_cut[i] == pytest.approx((loss(score, cuts + d) - loss(score, cuts - d)) / 2 / e, abs=1e-5)


def test_tables(spark):
    texts, bad = corpus(600, 4)
    docs = [(i, t, " Src ", i, "clash", 9) for i, t in enumerate(texts)] + [(9001, None, None, 0, "", 0), (9002, "", "src", 0, "", 0), (9003, "。！？\n" * 1000, "x", 0, "", 0)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, grade int, severity string, flagged int")
    labels = [(i, int(b), "r1") for i, b in enumerate(bad)] * 2 + [(0, 7, "r2"), (None, 1, "r1"), (1, None, "r1"), (77_777, 1, "r1"), (3, 1 - int(bad[3]), "r2")]
    lab = spark.createDataFrame(labels, "doc_id bigint, flagged int, rater string")
    g = {r.doc_id: r.grade for r in s.graded(lab).collect()}
    assert g[3] == 1 and g[0] == 2 * int(bad[0]) and 77_777 in g and None not in g
    model = s.train(d, lab)
    out = {r.doc_id: r for r in s.score(d, model, ["doc_id", "source"]).collect()}
    assert len(out) == len(docs) and np.mean([out[i].flagged == b for i, b in enumerate(bad)]) > 0.95
    assert out[9001].severity is None and out[9001].flagged == 0 and out[9002].flagged == 0 and out[9003].flagged == 0
    rates = {r.source: r for r in s.rates(s.score(d, model, ["doc_id", "source"])).collect()}
    assert rates["src"].documents == 601 and rates[None].documents == 1
    none = s.train(d, lab.where("flagged = 0"))
    assert none is None and s.score(d, none, ["doc_id"]).where("flagged = 1 or severity > 0").count() == 0
    assert s.score(d.where("false"), model, ["doc_id"]).count() == 0
    assert s.train(d, lab, max_flagged=50, max_plain=60) is not None


def test_fit_takes_long_texts_and_bounds_their_sum(spark):
    texts = [(i, "x" * 10) for i in range(4)] + [(4, "y" * 9_000), (5, "z" * 3_000), (6, None)]
    d = spark.createDataFrame(texts, "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, int(i > 3), "r") for i in range(8)], "doc_id bigint, flagged int, rater string")

    def seen(**bounds):
        rows = s.sample(d, lab, **bounds).collect()
        return sorted(len(r.text) for r in rows), sorted(r.grade for r in rows)

    all_ = ([10, 10, 10, 10, 3_000, 9_000], [0, 0, 0, 0, 2, 2])
    assert seen() == all_ and seen(max_flagged=2, max_plain=4) == all_, "ids without text take no place"
    assert seen(max_total=3_045) == ([10, 10, 10, 10, 3_000], [0, 0, 0, 0, 2])
