import base64
import hashlib

import public_tokenizers as P
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from pointloom.llm import decontaminate, neardup, secrets

FR = "le chat dort sur la grande table de la cuisine pendant que la pluie tombe doucement dehors "
EN = "the quiet river runs below the old stone bridge while children play near the water every summer "


def rows():
    item = "Which planet of the solar system has the most moons of all known ones today"
    base = [EN + f"and visitor number {i} wrote a long letter about boats rivers and winter number{i * 7}" for i in range(3)]
    base = [" ".join(sorted(t.split(), key=lambda w, i=i: hashlib.md5(f"{w}{i}".encode()).hexdigest())) for i, t in enumerate(base)]
    out = [(i, t, "en") for i, t in enumerate(base)]
    out += [(10, base[0].replace("bridge", "tower"), "en"), (11, base[0].upper(), "en"), (12, FR, "fr")]
    out += [(20, f"{base[1][::-1]} {item.lower()}!", "en"), (30, FR.replace("chat", "chien") * 2 + " token = abcdef123456", "fr")]
    out += [(40, None, "en"), (41, "", "en"), (42, "12 34 !!", "fr"), (2, base[2], "en"), (50, "le la " + "mot " * 3000, None)]
    return out, [(1, item), (2, None)]


def test_stages_against_brute_force(spark, tmp_path):
    docs, items = rows()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long"))
    d.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "near copies", "benchmark", "secrets", "tokens"]
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if n < 4:
            assert now.columns == d.columns, name
        kept[name] = now.collect()
    ids = {k: sorted(r.doc_id for r in v) for k, v in kept.items()}
    assert ids["language ID"] == [0, 1, 2, 2, 10, 11, 12, 20, 30, 50]
    assert ids["near copies"] == [0, 1, 2, 12, 20, 30, 50]
    assert ids["benchmark"] == ids["secrets"] == ids["tokens"] == [0, 1, 2, 12, 30, 50]
    texts = {r.doc_id: r.text for r in kept["secrets"]}
    assert texts[30].endswith("[SECRET]") and "abcdef" not in texts[30]
    assert all(r.n_chars == len(r.text) for r in kept["secrets"])
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in kept["tokens"]:
        want = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, kept["tokens"]))


def test_empty_and_unlabelled(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    some = spark.createDataFrame([(1, "abc", None), (2, "1", None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in corpus_pipeline.language(spark, some, "").collect()] == [1]


def test_operators_used():
    assert neardup.SIMILARITY == 0.8 and neardup.SHINGLE == 5
    assert decontaminate.Items([1], ["x" * 40]).find("x" * 40) and secrets.KINDS
