import glob
import hashlib
import math
import os
import re
from collections import Counter
from zlib import crc32

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointloom.llm import queries, resample

SF = "/root/testdata/sf0.001"


def brute(docs, targets, longest, least, percent, seed, buckets):
    """Rows (id, features, weight, score, rank), one bucket and one document after the other."""

    def feats(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    def count(texts):
        return Counter(crc32(f.encode()) % buckets for t in texts for f in feats(t)[1])

    s, t = count([x for _, x in docs]), count(targets)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)}
    rows = []
    for i, text in docs:
        w, f = feats(text)
        weight = sum(gain[crc32(x.encode()) % buckets] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-40_000, 40_000), min_size=1, max_size=200), st.integers(0, 5), st.randoms(use_true_random=False))
def test_sums_from_planes_are_exact(gain, rows, rnd):
    gain = np.array(gain, np.int64)
    counts = np.array([[rnd.choice((0, 0, 1, 2, 7, 300_000)) for _ in gain] for _ in range(rows)], np.int64).reshape(rows, len(gain))
    assert resample.Slices(gain).sums(counts).tolist() == (counts @ gain).tolist()


def test_words_are_those_of_the_pattern():
    text = "Ab c'D 1_2 É日本 x-y z \x7f~{end"
    want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    assert [w.decode() for w in resample.words(text)] == want


@pytest.mark.parametrize("longest", [1, 3])
def test_against_brute_force(spark, longest):
    docs = [(i, " ".join(f"w{(i * 7 + k * k) % 23}" for k in range(3 + i % 9))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "?!"), (5, docs[5][1]), (5, docs[5][1]), (None, "W1 w2 w3 w4 w5 w6"), (63, "É w1 " * 500)]
    targets = ["w1 w2 w3", None, "", "É é w1"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("rank", F.lit(1)).withColumn("score", F.lit("x")).withColumn("_row", F.lit(2))
    got = resample.resample(df.repartition(5), spark.createDataFrame([(t,) for t in targets], "text string"), longest=longest, least_words=5, percent=30, buckets=97)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, targets, longest, 5, 30, 2024, 97)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample.resample(none, one).count() == 0
    assert [tuple(r) for r in resample.resample(one, none, least_words=1, percent=100).collect()] == brute([(1, "a b c")], [], 1, 1, 100, 2024, 10_000)


def test_query_equals_sql_and_brute_force(spark):
    got = sorted((tuple(r) for r in queries.op12_resample(spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    assert got == sorted(con.execute(resample.oracle()).fetchall(), key=str)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got == brute(docs, [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()], 1, 20, 10, 2024, 10_000)
