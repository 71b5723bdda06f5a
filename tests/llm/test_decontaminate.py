import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pointloom.llm import decontaminate as dc
from pointloom.llm.align import best_ends


def sellers(pattern, text):
    """Least distance of the whole pattern to any stretch ending at each place."""
    col = list(range(len(pattern) + 1))
    out = []
    for x in text:
        new = [0]
        for i, y in enumerate(pattern, 1):
            new.append(min(col[i] + 1, new[-1] + 1, col[i - 1] + (x != y)))
        col = new
        out.append(col[-1])
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=10), st.lists(st.integers(0, 2), max_size=30), st.integers(0, 8))
def test_best_ends(pattern, text, most):
    ends = sellers(pattern, text)
    low = min([len(pattern), *ends])
    got = best_ends(pattern, text, most)
    if got is None:
        assert min([most + 1, *ends]) > most
    else:
        assert ends[got[1] - 1] == got[0] == min(ends) and low <= most


def words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 6))) for _ in range(n))


def test_against_alignment_with_everything():
    """The same items as aligning each with every document, for 0 to too many edits."""
    rnd = random.Random(2)
    items = [words(rnd, rnd.randint(5, 40)) for _ in range(20)]
    index = dc.Items(list(range(100, 120)), items)
    planted = 0
    for trial in range(120):
        n = rnd.randrange(20)
        passage = list(items[n])
        for _ in range(rnd.choice([0, 0, 1, 3, 6, 12, 30])):
            k = rnd.randrange(len(passage))
            passage[k : k + 1] = rnd.choice([[], ["z"], [passage[k], "y"]])
        text = words(rnd, rnd.randint(0, 60)) + ". " + "".join(passage).upper() + "; " + words(rnd, rnd.randint(0, 60))
        got = index.find(text)
        units = dc.normalise(text)[0].tolist()
        want = set()
        for i, u in enumerate(index.units):
            if min([99, *sellers(u, units)]) <= dc.budget(len(u))[0]:
                want.add(100 + i)
        assert {g[0] for g in got} == want, trial
        planted += bool(want)
        for _, s, e, d in got:
            assert d or dc.normalise(text[s:e])[0].tolist()[1:-1] in [u.tolist() for u in index.units]
    assert 30 < planted < 120


def test_spans_and_odd_texts():
    index = dc.Items([1, 2, 3, 4], ["The quick  brown-fox jumps over", "a b", "", "İstanbul'da güzel bir gün geçirdik"])
    text = "x THE QUICK brown fox, jumps... over y"
    assert index.find(text) == [(1, 2, 36, 0)]
    assert index.find("a, b; ab a b") == [(2, 0, 4, 0), (2, 9, 12, 0)]
    assert [f[0] for f in index.find("Dün İstanbul'da güzel bir gün geçirdik!")] == [4]
    for odd in (None, "", "   ", "!!!", "q" * 50_000, "the " * 20_000):
        assert index.find(odd) == []


def test_frame_in_blocks(spark):
    rnd = random.Random(4)
    items = [(i, words(rnd, 12)) for i in range(9)] + [(9, None), (None, "x y z")]
    docs = [(1, f"{words(rnd, 30)} {items[3][1]} {items[5][1]}"), (2, words(rnd, 30)), (3, None), (None, items[0][1]), (1, items[8][1]), (1, items[8][1])]
    d = spark.createDataFrame([(*r, "s") for r in docs], "doc_id long, text string, found string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for chars in (1 << 23, 100):
        got = sorted(((r.doc_id or 0, r.items) for r in dc.find_passages(d, b, block_chars=chars).collect()))
        assert got == [(0, "0"), (1, "3,5"), (1, "8"), (1, "8"), (2, ""), (3, "")]
        kept = dc.drop_contaminated(d, b, block_chars=chars)
        assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]
    assert dc.find_passages(d.limit(0), b).count() == 0
    assert dc.find_passages(d, b.limit(0)).where("n_items > 0").count() == 0
    assert dc.drop_contaminated(d, b.limit(0)).count() == 6


def test_items_that_share_a_phrase():
    """Two thousand items with one phrase in common, in a text that repeats it: fast, and only what is held is found."""
    import time

    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9)))
    phrase = "the following questions are about"
    items = [f"{phrase} {' '.join(word() for _ in range(10))}" for _ in range(2000)]
    index = dc.Items(list(range(2000)), items)
    text = ""
    while len(text) < 20_000:
        text += f"{phrase} {' '.join(word() for _ in range(12))}. "
    held = items[77].split()
    held[8] = "x" + held[8][1:]
    text += " ".join(held) + " " + items[1500]
    began = time.process_time()
    found = {i for i, *_ in index.find(text)}
    assert found == {77, 1500} and time.process_time() - began < 5


def test_sections_find_what_one_pass_finds(monkeypatch):
    rnd = random.Random(2)
    word = lambda: rnd.choice("alpha beta gamma delta epsilon zeta eta theta".split())
    items = [" ".join(word() for _ in range(rnd.randint(8, 14))) for _ in range(30)]
    text = " ".join(word() for _ in range(1500)) + " " + " ".join(items[:5])
    index = dc.Items(list(range(30)), items)
    want = index.find(text)
    assert want
    monkeypatch.setattr(dc, "MOST_HITS", 500)
    assert index.find(text) == want
