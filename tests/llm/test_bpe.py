import base64

import public_tokenizers as P
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pointloom.llm import bpe


@pytest.fixture(scope="module")
def ranks_file():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


def reference(data):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


PAT = regex.compile(P.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 1'srevé\n\t.,!  ", max_size=200), st.integers(12, 40), st.integers(5, 11))
def test_stitching_gives_the_pieces_of_the_whole(text, chunk, overlap):
    got = [p for ps in bpe.stitch(((a, c, None) for a, c in bpe.cut(text, chunk, overlap)), PAT.findall) for p in ps]
    assert got == PAT.findall(text)


def test_merges(ranks_file):
    enc, tool = reference(ranks_file), bpe.encoder(ranks_file, P.PATTERN)
    words = ["thth" * k + e for k in range(1, 9) for e in ("", "e", "ing", "é")]
    got = tool.merge_many([w.encode() for w in words])
    assert got == [tuple(enc._encode_single_piece(w.encode())) for w in words]
    for text in ("hello", "anticonstitutionnellement", "a" * 301, "ab" * 200, "ñandú", "日本語", "x" * 99, "ththth" * 40):
        assert list(bpe.merge_long(text.encode(), tool.ranks)) == enc._encode_single_piece(text.encode()), text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 1'srevé\n\t.,!  \u2003日", max_size=60))
def test_units_are_whole_pieces(text):
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        tool = bpe.encoder(f.read(), P.PATTERN)
    assert [p for u in tool.units(text) for p in PAT.findall(u)] == PAT.findall(text)
    assert tool.encode([tool.units(text)])[0] == reference_encode(text)


def reference_encode(text, cache=[]):
    if not cache:
        with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
            cache.append(reference(f.read()))
    return cache[0].encode_ordinary(text)


def test_frame_short_and_long(spark, ranks_file):
    enc = reference(ranks_file)
    long = "the quick brown fox's tail, 123 times  over\n" * 60 + "z" * 700
    rows = [(1, "Hello <|endoftext|> world"), (2, None), (3, ""), (4, long), (4, long), (None, "x  y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", df_lit())
    got = sorted((r.doc_id or 0, list(r.ids)) for r in bpe.encode(df, ranks_file, P.PATTERN, long=1000, chunk=200, overlap=40).collect())
    want = sorted((i or 0, enc.encode_ordinary(t or "")) for i, t in rows)
    assert got == want
    back = bpe.decode(bpe.encode(df, ranks_file, P.PATTERN, long=1000, chunk=200, overlap=40), ranks_file).collect()
    assert sorted(bytes(r.bytes) for r in back) == sorted((t or "").encode() for _, t in rows)
    assert bpe.encode(df.limit(0), ranks_file, P.PATTERN).count() == 0


def df_lit():
    from pyspark.sql import functions as F

    return F.lit("clash")
