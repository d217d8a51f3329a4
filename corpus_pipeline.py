"""From raw documents to tokens: quality rules, line dedup, near-dedup, benchmark decontamination, BPE.

Each stage takes all rows that the one before it kept, as columns of ``documents``, and is written and read again before the
next. Where a stage changes a text, n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docpipe.llm import bpe, decontaminate, lines, minhash, quality
from docpipe.llm.queries import table, vocabulary
from docpipe.llm.storage import written

#: Jaccard similarity from which documents are near duplicates here; op1's 85 is that of its contract.
NEAR_PERCENT = 80


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and line frequency keep, without their source's boilerplate lines.

    Null and empty texts go (they have too few words); a null source is a source of its own; rows that repeat stay or go
    together; a very long text is judged whole; an empty table stays empty; extra columns are kept.
    """
    return _measured(quality.cleaned(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier one has or comes within one word of; a document that is left without a line is gone.

    Null and empty texts go; null ids come first; rows that repeat id and text count as one document and stay together, so their
    lines stay in all of them; very long texts take part with every line; an empty table stays empty; extra columns are kept.
    """
    return _measured(lines.dedup(docs).where(F.col("text") != ""))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 80 % similarity or more, the one with the smallest id.

    Null and empty texts and null ids are linked with nothing and stay; of texts with one id each is judged for itself; rows that
    repeat id and text stay or go together; very long texts are compared whole; an empty table stays empty; extra columns are kept.
    """
    return minhash.dedup(docs, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Null and empty texts hold none and stay, as do all with an empty benchmark; rows that repeat stay or go together; very long
    texts are searched whole; an empty table stays empty; extra columns are kept.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and decoded_text of each document.

    Null and empty texts have no tokens; rows that repeat are each coded; very long texts are coded whole; an empty table stays
    empty; other columns are dropped.
    """
    coded = bpe.encode_documents(docs, vocabulary("word_bpe_49k.json"))
    return coded.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded_text")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

#: MinHash, seeds and BPE are not SQL; tests/llm holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
