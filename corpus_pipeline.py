"""From raw documents to token ids: language, near copies, benchmark passages, personal data, encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. ``run``
applies them to the documents of ``sf_dir``; what a stage returns is written to the shared folder and read
again by the next one, so no stage is computed twice and a lost executor costs one stage's tasks at most.

Defined results for odd input: each stage's operator states its own; taken together, a document with a null
text or without a letter goes at the first stage, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftwell.llm.common import Scratch, table
from siftwell.llm.feistel_pii import pseudonymise, session_key
from siftwell.llm.order_minhash import keep_one
from siftwell.llm.ppm_language import keep_identified
from siftwell.llm.prefix_bpe import encode_and_decode
from siftwell.llm.qgram_decontamination import keep_clean


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data. A session without a key of its own gets a published one, which anyone can undo."""
    return pseudonymise(docs, session_key(spark, b"siftwell demonstration key"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number of ids and the digests of the ids and of the bytes they decode to."""
    return encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("private_data", private_data),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return STAGES[-1][1](spark, docs, sf_dir)


#: Model fitting, alignment and tokenization have no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL: str | None = None
