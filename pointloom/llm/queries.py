"""Queries over the shared tables, one for each operator, with the parameters for production."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html, jpeg, langid, licences, lm, neardup, pii, prefix_trie, resample, secrets, token_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int):
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def ranks_file() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read()


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), ranks_file(), public_tokenizers.PATTERN, "digest")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"))
    return langid.identify(docs, langid.fit(docs, ~F.col("held_out")), ["doc_id", "held_out"])


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(remainder(5) == 1, F.lit(False)).alias("held_out"))
    return lm.score(docs, "held_out")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.media(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "documents"), pii.train_on(pii.labelled_table(spark)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pieces_file() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


#: Tokens that a document may have before op13_token_counts marks it.
TOKEN_LIMIT = 4096


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.totals(token_counts.prefix_counts(table(spark, sf_dir, "documents"), pieces_file()), TOKEN_LIMIT)


def queries() -> dict:
    found = (op1_secrets, op2_bpe, op3_neardup, op4_decontaminate, op5_html, op6_langid, op7_lm, op8_licences, op9_jpeg, op10_pii, op11_prefix_trie, op12_resample, op13_token_counts)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_licences": licences.oracle(), "op11_prefix_trie": prefix_trie.oracle(), "op12_resample": resample.oracle()}
