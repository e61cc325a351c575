"""A corpus pipeline of five stages, each one operator of evisim.llm over all that the stage before kept.

In every stage a null text is an empty one, texts of any length are taken whole, an empty table gives an empty one, and extra
columns pass through until the last stage, whatever their names. Rows that share a doc_id, or have none, are documents by themselves unless their
texts are equal too; what ties is settled by doc_id, then by the text's digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evisim.llm.exact_dedup import drop_repeats
from evisim.llm.mixing import mix
from evisim.llm.packing import pack_documents
from evisim.llm.quality import keep_good
from evisim.llm.queries import tokenizer_path
from evisim.llm.simhash_dedup import drop_near
from evisim.llm.staging import staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go; null and empty texts have too few words. Repeated rows are judged alike."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays, null before none; rows equal in doc_id and text stay once."""
    return drop_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the smallest doc_id stays, null last, then the smallest digest of the text."""
    return drop_near(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate and their draw say; null is a source. Rows of a doc_id draw alike."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their place in the sequences, by tokens, documents and attention cost."""
    return pack_documents(docs, tokenizer_path(spark))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("simhash near-dedup", near_dedup),
    ("source mix", source_mix),
    ("best-fit packing", packing),
]

#: Neither SimHash over XXH64 nor the tokenizer can be expressed in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents of sf_dir; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
