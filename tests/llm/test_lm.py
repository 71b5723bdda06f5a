import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pointloom.llm import lm

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(n=120, seed=3):
    """Sentences in which the word before tells much about the next."""
    rnd = random.Random(seed)
    after = {"the": ["cat", "dog", "Bird"], "cat": ["sat", "ran"], "dog": ["ran", "sat"], "bird": ["flew"], "sat": ["the", "there"], "ran": ["the", "there"], "flew": ["the", "there"], "there": ["the"]}
    out = []
    for _ in range(n):
        w = ["the"]
        for _ in range(rnd.randint(3, 40)):
            w.append(rnd.choice(after[w[-1].lower()]))
        out.append(" ".join(w) + rnd.choice(["", " x%d" % rnd.randrange(1000), " Été"]))
    return out


def check(rows, got):
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP)) + [None] for _, t, _ in rows]
    c = Counter(w for (_, _, h), t in zip(rows, tokens, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((i if i is not None else -1, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for (i, _, _), t in zip(rows, tokens, strict=True))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_counts_and_gain(spark, monkeypatch):
    rows = [(i, t, i % 5 == 1) for i, t in enumerate(texts())] + [(200, None, False), (200, None, False), (None, "", True), (300, "unseen words only", True), (301, "w%d " % 7 * 20_000, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h boolean").withColumn("key", F.lit("clash"))
    got = lm.score(df.repartition(3), "h").collect()
    check(rows, got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 200]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_rare_tokens_by_join(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 8)
    rows = [(i, t, i % 5 == 1) for i, t in enumerate(texts(60))]
    df = spark.createDataFrame(rows, "doc_id long, text string, h boolean")
    few = lm.score(df, "h").collect()
    check(rows, few)
    monkeypatch.setattr(lm, "FREQUENT", 1 << 20)
    every = sum(r.score for r in lm.score(df, "h").collect())
    assert abs(every - sum(r.score for r in few)) < 0.05 * abs(every)  # only which rare tokens are classes of their own differs


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, h boolean")
    assert lm.score(df, "h").count() == 0
    only = lm.score(spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, h boolean"), "h").first()
    assert (only.n_tokens, only.n_known, only.train_tokens, only.base_score) == (3, 0, 0, 0.0)


def small(rng, size=64):
    model = lm.Model(np.array([5 << 20, 9 << 20], np.uint64), rng.integers(1, 50, lm.ITEMS), size)
    model.weights += rng.normal(size=model.weights.shape).astype(np.float32)
    return model


def test_probabilities_and_gradient():
    """The items' probabilities sum to one, and the gradient is observed minus expected counts."""
    rng = np.random.default_rng(1)
    model = small(rng)
    keys, lens = rng.integers(0, 2**63, 50).astype(np.uint64), np.array([20, 1, 29])
    sums, seen = np.zeros((lm.SIDE, 4 * model.size)), np.zeros(4 * model.size)
    model.gradients(keys, lens, sums, seen)
    want = np.zeros_like(sums)
    n = 0
    for _, _, rows, lane, owner, bias in model.levels(keys, lens):
        for r, y, o in zip(rows, lane, owner, strict=True):
            z = bias[o] + sum(model.weights[f].astype(float) for f in r)
            p = np.exp(z) / np.exp(z).sum()
            for f in r:
                want[:, f] -= p
                want[y, f] += 1
                n += 1
    assert np.allclose(sums, want, atol=1e-4) and seen.sum() == n == 2 * lm.KINDS * 50
    assert np.allclose(sums.sum(0), 0, atol=1e-4)


def test_all_items_sum_to_one():
    rng = np.random.default_rng(2)
    known = (np.arange(1, lm.SINGLE + 1, dtype=np.uint64)) << np.uint64(20)
    model = lm.Model(known, rng.integers(0, 50, lm.ITEMS), 64)
    model.weights += rng.normal(size=model.weights.shape).astype(np.float32)
    items = np.concatenate((known, np.arange(lm.ENDINGS, dtype=np.uint64)))
    total = sum(10.0 ** model.scores(np.array([7, 8, k], np.uint64), np.array([3]))[2] for k in items)
    assert abs(total - 1) < 1e-4


def test_stretches_and_texts_dont_matter(monkeypatch):
    """Scores are the same whatever is computed at once, and no context reaches into another text."""
    rng = np.random.default_rng(3)
    model = small(rng)
    keys, lens = rng.integers(0, 2**63, 60).astype(np.uint64), np.array([1, 30, 2, 27])
    whole = model.scores(keys, lens)
    monkeypatch.setattr(lm, "STRETCH", 7)
    monkeypatch.setattr(lm, "BLOCK", 3)
    assert np.allclose(whole, model.scores(keys, lens))
    apart = [model.scores(x, np.array([len(x)])) for x in np.split(keys, np.cumsum(lens)[:-1])]
    assert np.allclose(whole, np.concatenate(apart))


def test_tokens_by_piece_and_ending():
    text = "Ab ab  xxab\tb b" + " é" * 50
    whole = lm.token_keys(text)
    assert whole[0] == whole[1] and whole[2] & lm._LOW != whole[0] & lm._LOW and (whole[5:-1] == whole[5]).all() and whole[-1] == lm.END
    assert lm.token_keys("1234xyz")[0] & lm._LOW == lm.token_keys("é-xyz")[0] & lm._LOW
    assert lm.token_keys(None).tolist() == lm.token_keys(" \n").tolist() == [lm.END]


def test_classes_follow_neighbours():
    """Items of two languages that never mix end in different classes; each place is taken once."""
    near = np.zeros((lm.ITEMS, lm.ITEMS))
    near[::2, ::2] = 1
    near[1::2, 1::2] = 1
    place = lm.by_context(near)
    assert sorted(place) == list(range(lm.ITEMS))
    assert all(len(set(np.flatnonzero(place // lm.SIDE == k) % 2)) == 1 for k in range(lm.SIDE))


def test_numbers_in_half_the_bytes():
    x = np.array([0, 1, -3.14159, 1e6, 70000.5, 1e-8], np.float32)
    assert np.allclose(lm.doubled(lm.halved(x)), x, rtol=2**-8)


def test_contexts_together_and_one_by_one(monkeypatch):
    """Observed and expected counts don't hang on how many tokens are put together; with no weights they follow from counts alone."""
    rng = np.random.default_rng(4)
    model = small(rng)
    keys, lens = rng.choice(np.array([5 << 20, 9 << 20, 7, 8, 1 << 40], np.uint64), 200), np.array([90, 1, 109])
    codes = model.codes(keys)

    def sums(model, method, width):
        out = np.zeros((lm.SIDE, width * model.size))
        method(model, codes, lens, out)
        return out

    came, model_sums = sums(model, lm.Model.observed, 6), sums(model, lm.Model.expected, 4)
    assert came[:, : 2 * model.size].sum() == came[:, 2 * model.size : 4 * model.size].sum() == lm.KINDS * 200
    monkeypatch.setattr(lm, "BATCH", 7)
    monkeypatch.setattr(lm, "STRETCH", 3)
    monkeypatch.setattr(lm, "BLOCK", 2)
    assert np.allclose(came, sums(model, lm.Model.observed, 6)) and np.allclose(model_sums, sums(model, lm.Model.expected, 4), atol=1e-4)
    model.weights[:] = 0
    assert np.allclose(model.expected_at_first(came), sums(model, lm.Model.expected, 4), atol=1e-4)


def test_every_training_text_is_in_every_sum(spark, monkeypatch):
    """Classes, observed and expected counts: each pass sees the tokens of all training texts, once."""
    rows = [(i, t, i % 5 == 1) for i, t in enumerate(texts(40))]
    want = sum(len(lm.token_keys(t)) for _, t, h in rows if not h)
    totals, summed = [], lm.summed

    def told(*args):
        totals.append((args[1], summed(*args)))
        return totals[-1][1]

    monkeypatch.setattr(lm, "summed", told)
    lm.score(spark.createDataFrame(rows, "doc_id long, text string, h boolean").repartition(3), "h").collect()
    assert len(totals) == lm.ROUNDS + 1
    n_texts = sum(not h for _, _, h in rows)
    assert totals[0][1].sum() == want - n_texts  # the first token of a text has none before it
    level = totals[2][0][1] // 2
    assert all(abs(x[:, :level].sum() / (lm.KINDS * want) - 1) < 0.01 for _, x in totals[1:])
