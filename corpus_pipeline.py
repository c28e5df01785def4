"""Corpus pipeline: toxic documents, near-duplicates and benchmark copies go, personal data is masked, texts become ids.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run()
writes each result as Parquet in the shared folder and reads it back for the next.

Defined cases: an empty table passes through every stage; null texts count as empty
and are kept unless they repeat; rows without doc_id are never dropped as duplicates;
of rows that repeat doc_id and text one stays, and a second text under a doc_id is judged by
itself; very long texts are read whole; other columns of the input, whatever their names, pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strobelake.llm import decontaminate, pii, sentencepiece_codec, simhash_dedup, toxicity
from strobelake.llm.common import materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays under the threshold; the model learns from the labels of these documents."""
    return toxicity.harmless(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: the one with the smallest doc_id."""
    return simhash_dedup.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind."""
    return pii.redacted(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, ids, n_tokens, ids_crc32) of each document."""
    return sentencepiece_codec.encode(docs, ["doc_id", "lang", "source"], digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("sentencepiece", encode_pieces),
]

#: SQL expresses neither the model of toxicity nor the tokenizer; a brute-force version tests the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
