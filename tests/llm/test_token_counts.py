import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pointloom.llm import token_counts


def model():
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


MODEL = model()
SP = sentencepiece.SentencePieceProcessor(model_proto=MODEL)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aeinrstl THE.,'09\n\té日𝔘▁ <>/s\x00", max_size=60))
def test_every_prefix_equals_the_library(text):
    tool = token_counts.counter(MODEL)
    assert tool.counts(text).tolist() == [len(SP.encode(text[:i])) for i in range(1, len(text) + 1)]


@pytest.mark.parametrize("text", ["Internationalisation of understanding", "def f(x):\n    return x ** 2\n", " " * 70 + "x" + " " * 33, "Straßenbahn, Überraschung; l'été à Noël", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "http://www.example.com/index.html?q=1", "<s>[INST]</s><unk><0x0A>", "=" * 90])
def test_prefixes_of_usual_texts(text):
    assert token_counts.counter(MODEL).counts(text).tolist() == [len(SP.encode(text[:i])) for i in range(1, len(text) + 1)]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    monkeypatch.setattr(token_counts, "PAIRS", 5)
    text = "one two three four five six seven one two eight"
    assert token_counts.Counter(MODEL).counts(text).tolist() == [len(SP.encode(text[:i])) for i in range(1, len(text) + 1)]


ROWS = [(1, "Hello world, this is a token count"), (2, None), (3, ""), (4, "two  spaces\n" * 40), (4, "two  spaces\n" * 40), (None, "no id"), (5, "a" * 3000)]


def frame(spark):
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("counts", F.lit("clash")).withColumn("last", F.lit(0))


def test_totals(spark):
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.totals(token_counts.prefix_counts(frame(spark), MODEL, width=100), 50).collect())
    assert got == sorted((i or 0, len((t or "").encode()), len(SP.encode(t or "")), len(SP.encode(t or "")) > 50) for i, t in ROWS)
    assert token_counts.prefix_counts(frame(spark).limit(0), MODEL).count() == 0


def test_questions_from_the_counts_alone(spark):
    counts = token_counts.prefix_counts(frame(spark), MODEL, width=64)
    texts = {i: t or "" for i, t in ROWS}
    ask = [(1, 0), (1, 5), (1, None), (1, 500), (2, 4), (4, 64), (4, 65), (4, 128), (5, 2999), (5, -3), (9, 1)]
    got = {(r.doc_id, r.n_chars): r.n_tokens for r in token_counts.tokens_of(counts, spark.createDataFrame(ask, "doc_id long, n_chars long")).collect()}
    assert got == {(i, n): len(SP.encode(texts[i][: max(0, n or 0)])) for i, n in ask if i in texts}
    for budget in (0, 1, 3, 20, 1000):
        found = {r.doc_id: (r.n_chars, r.n_tokens) for r in token_counts.fitting(counts, budget).collect()}
        for i, t in texts.items():
            fits = [n for n in range(len(t) + 1) if len(SP.encode(t[:n])) <= budget] if i != 5 else None
            if fits is not None:
                assert found[i] == (fits[-1], len(SP.encode(t[: fits[-1]]))), (i, budget)
    packs = {r.doc_id: (r.n_windows, r.last_tokens) for r in token_counts.packed(counts, 16).collect()}
    n = len(SP.encode(texts[4]))
    assert packs[4] == (-(-n // 16), n - (-(-n // 16) - 1) * 16) and packs[3] == (0, 0)


def test_query_on_whole_documents(spark):
    from pointloom.llm import queries

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op13_token_counts(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        n = len(SP.encode(r.text or ""))
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 4096)
