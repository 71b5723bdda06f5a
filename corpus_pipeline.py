"""Corpus preparation: five stages, each over everything the one before kept.

Language ID drops documents that no language can be given to (null or letterless text, or a score below
``LEAST_SCORE``); near copies keep one document of each class; documents that hold a benchmark item go; secrets are
replaced by a mark; at last each document is encoded and decoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.llm import bpe, decontaminate, langid, neardup, secrets
from pointloom.llm.common import column, fresh, materialise
from pointloom.llm.queries import ranks_file

#: A text of one known language scores far above; with n languages, even odds are 1 / n.
LEAST_SCORE = 0.3
#: SQL has no trained models, sketches, alignment or BPE; tests hold the stages against brute force instead.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language; the model is fitted on the labelled ones (a bounded sample).

    Null, empty and letterless texts go; repeated rows are judged alike; other columns may have any name. A table without
    labels loses letterless texts only.
    """
    model = langid.fit(docs, F.lit(True))
    if not model.languages:  # nothing is labelled: only texts without a letter can be told to be in none
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = fresh(docs, "lang_pred", "score")
    found = langid.identify(docs, model, docs.columns, (lang, score))
    return found.where((column(lang) != "und") & (column(score) >= LEAST_SCORE)).drop(lang, score)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies; null and wordless texts and repeated ids are told in ``neardup``."""
    return neardup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item; null and empty texts hold none, without items all stay."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark, and set n_chars anew (if there is such a column); null text stays null, repeated rows stay."""
    clean = secrets.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else clean


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each document and decode it again: doc_id, n_tokens and digests; null text counts as empty, repeated rows stay."""
    import public_tokenizers

    return bpe.encode(docs, ranks_file(), public_tokenizers.PATTERN, "digest")


STAGES = [("language ID", language), ("near copies", near_copies), ("benchmark", benchmark), ("secrets", secret_scan), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn on the documents; each one's result is written and read before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{name.replace(' ', '-')}")
    return docs
