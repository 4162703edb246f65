"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from pointlake.llm.chat import perspectives
from pointlake.llm.fingerprints import fingerprint_documents
from pointlake.llm.mixing import mix
from pointlake.llm.packing import pack_sequences
from pointlake.llm.quality import POLICIES, ablation, judge, ledger
from pointlake.llm.simhash import near_duplicates
from pointlake.llm.substring import remove_repeats
from pointlake.llm.token_files import token_files
from pointlake.llm.toxicity import fit, score_documents
from pointlake.llm.warc import audited_pages
from pointlake.session import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the token files, read back from them."""
    return token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_iblt_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and how alike it is to its edited text's and the next document's."""
    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the words of 13-word windows that a document with a smaller id has."""
    return remove_repeats(_table(spark, sf_dir, "documents"), min_words=13).drop("kept")


def op4_warc_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its place in the archive and whether the second replica, in which one record in about 500 is spoilt, has it whole."""
    return audited_pages(_table(spark, sf_dir, "pages"), damage=(2024, 500))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and the least id of its component."""
    return near_duplicates(_table(spark, sf_dir, "documents"), tau=2, shingle=3)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return pack_sequences(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn from every participant's perspective."""
    return perspectives(_table(spark, sf_dir, "conversations"))


def op9_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measurements, failure bits and verdict."""
    led = ledger(_table(spark, sf_dir, "documents"))
    return judge(led, POLICIES["web", 1]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op9_quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy removes, counted from the stored ledger."""
    return ablation(materialise(ledger(_table(spark, sf_dir, "documents")), "ledger"), POLICIES["web", 1])


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score, learned from rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, fit(docs, _table(spark, sf_dir, "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_iblt_fingerprint,
        op3_substring_dedup,
        op4_warc_merkle,
        op5_source_mixing,
        op6_simhash,
        op7_packing,
        op8_chat_perspectives,
        op9_quality_ledger,
        op10_toxicity,
    )
} | {"llm_quality_ablation": op9_quality_ablation}
