"""A corpus pipeline: quality rules, near-duplicates, decontamination, mixing, packed token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents (an extra column of docs is not passed on, whatever its name). Texts of any
length are read whole, and an empty table gives an empty one. ORACLE_SQL is None: SQL has no byte-level BPE
and no edit-budget search.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexarena.llm import bitpack, cascade, decontam, mixing, neardup
from lexarena.llm.common import save, shared_dir, table
from lexarena.llm.queries import vocabulary_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects; null and empty texts are too short, repeated rows stay or go alike."""
    return cascade.keep_good(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Texts without a word and documents without an id are in no group and stay. Rows of one id are one document:
    all of them stay, or none.
    """
    drop = neardup.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(drop, "doc_id", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; a null or empty text holds none, and a document without an id is kept."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of half the tokens, with sources, languages and topics raked towards even shares; a text without words is never sampled, rows of one id go together."""
    return mixing.mix_to_targets(docs).where("sampled").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's ids lie in the packed shards, read back from them; a null text holds the end id alone, repeated rows are documents each."""
    path = f"{shared_dir(spark)}/pipeline-shards-{uuid.uuid4().hex}"
    bitpack.encode_shards(docs, path, vocabulary_file("byte_bpe_50k.json"), end_id=2)
    return bitpack.read_documents(spark, path)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("mixing to targets", mix),
    ("token ids", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
