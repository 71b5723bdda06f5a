import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from pointloom.llm import neardup
from pointloom.llm.align import banded, distance_within
from pointloom.llm.common import Tables


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=16), st.lists(st.integers(0, 2), max_size=16), st.integers(0, 9))
def test_alignment(a, b, most):
    d = plain(a, b)
    assert banded(a, b, most) == min(d, most + 1)
    assert distance_within(a, b, most) == (d if d <= most else None)


def test_sketches_follow_order():
    words = np.arange(1, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    a, b = neardup.sketch(words), neardup.sketch(np.concatenate((words[30:], words[:30])))
    assert len(a) == neardup.SKETCHES and (a == neardup.sketch(words)).all()
    assert 0 < (a == b).sum() < len(a)  # moved halves keep some pairs but not those across
    assert len(neardup.sketch(words[:1])) == neardup.SKETCHES


def corpus(seed=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6)))
    texts = [" ".join(word() for _ in range(rnd.randint(30, 120))) for _ in range(25)]
    out = list(texts)
    for t in texts[:15]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            for _ in range(max(1, len(v) // 25)):
                k = rnd.randrange(len(v))
                v[k : k + 1] = rnd.choice([[word()], [], [v[k], word()]])
            out.append(" ".join(v))
        out.append(t.upper() + "!")
    out += [texts[20]] * 40
    return out


def test_against_all_pairs(spark):
    """Classes equal the components of all pairs of at least 0.8 edit similarity."""
    texts = corpus()
    words = [t.lower().replace("!", "").split() for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            most = int(0.2 * max(len(words[i]), len(words[j])) + 1e-9)
            if abs(len(words[i]) - len(words[j])) <= most and distance_within(words[i], words[j], most) is not None:
                up[max(root(i), root(j))] = min(root(i), root(j))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, label string").repartition(3)
    got = neardup.classes(df).collect()
    assert {r.doc_id: r.class_id for r in got} == {i: root(i) for i in range(len(texts))}
    sizes = defaultdict(int)
    for r in got:
        sizes[r.class_id] += r.is_kept
    assert set(sizes.values()) == {1}
    assert {r.doc_id for r in neardup.keep_one(df).collect()} == set(sizes)


def test_odd_rows(spark):
    long = "w%d " * 3
    rows = [(1, None), (2, ""), (2, ""), (3, "..."), (4, "one two"), (5, "One two."), (6, "one two three"), (None, "one two"), (7, " ".join(f"w{i}" for i in range(30_000))), (8, long), (4, "one two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as label", "2 as keys")
    got = neardup.classes(df)
    kept = neardup.keep_one(df)
    assert got.count() == len(rows) and kept.columns == df.columns
    assert got.where("is_kept").count() == kept.count() == len(rows) - 3
    assert neardup.classes(df.limit(0)).count() == 0
    assert neardup.keep_one(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 101), (101, 102), (200, 200)] + [(300 + i, 300) for i in range(50)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100, **{300 + i: 300 for i in range(1, 50)}}


def test_links_between_members_that_share_hot_keys_only(spark):
    """Near copies whose shared shingles all lie in a passage that hundreds of other texts have too."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(8))
    passage = [word() for _ in range(75)]
    texts = [passage + [word() for _ in range(25)] for _ in range(400)]
    for t in texts[:5]:
        texts.append([w if k < 75 or k % 5 > 2 else word() for k, w in enumerate(t)])
    got = neardup.classes(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {**{i: i for i in range(400)}, **{400 + i: i for i in range(5)}}


def test_all_pairs_of_a_bucket(spark):
    """By a join and by blocks of any size, the links join what all pairs join."""
    rnd = random.Random(2)
    words = [[rnd.randrange(4) for _ in range(rnd.randint(5, 9))] for _ in range(90)]
    want = list(range(90))
    for a in range(90):
        for b in range(a):
            if distance_within(words[a], words[b], int(0.2 * max(len(words[a]), len(words[b])) + 1e-9)) is not None:
                low, high = sorted((want[a], want[b]))
                want = [low if x == high else x for x in want]
    assert 1 < len(set(want)) < 90
    bag = lambda w: np.bincount(w, minlength=neardup.BINS).tolist()
    members = spark.createDataFrame([(1, i, len(w), i) for i, w in enumerate(words)], "key long, u long, n int, label long")
    texts = spark.createDataFrame([(i, len(w), bag(w)) for i, w in enumerate(words)], "u long, n int, bag array<short>")
    held = spark.createDataFrame([(i, w, [1]) for i, w in enumerate(words)], "u long, words array<int>, keys array<long>")
    for whole, block in ((100, 8), (10, 8), (10, 1000)):
        new = neardup.all_pairs(members, texts, held, spark.createDataFrame([], "a long, b long"), 0.8, Tables(), whole, block)
        label = {i: i for i in range(90)} | {r.node: r.label for r in neardup.components(new).collect()}
        assert [label[i] for i in range(90)] == want


def joined(words, pairs, similarity=0.8):
    """Classes of the links among ``pairs``, by plain union."""
    up = list(range(len(words)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        most = int((1 - similarity) * max(len(words[a]), len(words[b])) + 1e-9)
        if root(a) != root(b) and abs(len(words[a]) - len(words[b])) <= most and distance_within(words[a], words[b], most) is not None:
            up[max(root(a), root(b))] = min(root(a), root(b))
    return [root(x) for x in range(len(words))]


def test_large_group_against_all_pairs(spark):
    """Two thousand copies of one text, each with words replaced so that some pairs are linked and some not."""
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    words = []
    for _ in range(2000):
        w = list(base)
        for k in rnd.sample(range(60), rnd.choice([1, 3, 6, 9])):
            w[k] = f"x{rnd.randrange(10**9)}"
        words.append(w)
    # substitutions at set places only, so the distance is the number of places that differ
    code = {}
    m = np.array([[code.setdefault(x, len(code)) for x in w] for w in words])
    up = np.arange(2000)
    for a in range(2000):
        for b in np.flatnonzero((m[:a] != m[a]).sum(1) <= 12):
            if up[b] != up[a]:
                up[up == max(up[a], up[b])] = min(up[a], up[b])
    got = neardup.classes(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == dict(enumerate(up.tolist()))


def test_short_texts_meet_exactly(spark):
    rnd = random.Random(6)
    words = [[rnd.choice("abcd") for _ in range(rnd.randint(1, 14))] for _ in range(150)]
    words += [[f"u{i}v{k}" for k in range(n)] for i, n in enumerate(range(5, 15))]
    for w in words[150:160]:
        v = list(w)
        v[len(v) // 2] = "other"
        words.append(v)
    want = joined(words, ((a, b) for a in range(len(words)) for b in range(a)))
    got = neardup.classes(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == dict(enumerate(want))


def edited(rnd, n, how):
    """Two texts of random words, the longer of n or more, at 0.8 similarity or just above."""
    a = rnd.integers(0, 2**63, n).astype(np.uint64)
    if how == "replaced":
        b = a.copy()
        at = rnd.choice(n, int(0.2 * n + 1e-9), replace=False)
        b[at] = rnd.integers(0, 2**63, len(at)).astype(np.uint64)
        return a, b
    longer = int(n / 0.8 + 1e-9) if how == "inserted" else n
    shorter = longer - int(0.2 * longer + 1e-9)
    whole = rnd.integers(0, 2**63, longer).astype(np.uint64)
    return whole, whole[np.sort(rnd.choice(longer, shorter, replace=False))]


@pytest.mark.parametrize("n", [12, 15, 17, 20, 24, 29, 34, 40, 60, 100, 300])
def test_recall_at_the_threshold(n):
    """Pairs with a fifth of their words replaced, inserted or deleted at random places, the hardest that count as near, share a key in 95 of 100 cases, short ones always."""
    rnd, tries = np.random.default_rng(n), 400 if n > 60 else 150
    for how in ("replaced", "inserted", "deleted"):
        met = 0
        for _ in range(tries):
            a, b = edited(rnd, n, how)
            met += bool(len(np.intersect1d(neardup.keys_of(a), neardup.keys_of(b))))
        assert met >= (0.95 * tries if n > 60 else tries), (how, met)


def test_rare_words_are_kept_whatever_is_edited():
    """With repeated words and sizes as in texts: texts of at most 75 words that are alike share a key."""
    rnd = np.random.default_rng(3)
    vocabulary = rnd.integers(0, 2**63, 60).astype(np.uint64)
    sizes = rnd.integers(1, 12, 60)
    for _ in range(600):
        n = int(rnd.integers(12, 61))
        at = rnd.integers(0, 60, n).tolist()
        other = list(at)
        for _ in range(int(rnd.integers(0, n // 5 + 1))):
            k = int(rnd.integers(0, 3))
            where = int(rnd.integers(0, len(other)))
            if k == 0:
                other[where] = int(rnd.integers(0, 60))
            elif k == 1:
                other.insert(where, int(rnd.integers(0, 60)))
            else:
                del other[where]
        longer = max(len(at), len(other))
        if longer <= neardup.FEW and len(other) >= 12 and distance_within(at, other, int(0.2 * longer + 1e-9)) is not None:
            x, y = (neardup.rare_pairs(vocabulary[t], sizes[t]) for t in (at, other))
            assert len(np.intersect1d(x, y)), (at, other)


def test_clashing_columns(spark):
    rows = [(1, "a b c d e f", "x", 5), (2, "A b c d e f", "y", 6), (3, "z", "w", 7)]
    df = spark.createDataFrame(rows, "doc_id short, text string, kept_id string, text_hash int").withColumn("OWN_HASH", F.lit(1))
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 3}
