"""Training-data pipeline over `documents`: reject, dedup, near-dedup, mix, encode.

Each stage sets the session up (`configure`), reads what its predecessor wrote, works on all of it, and writes the documents it keeps with the columns
they came with; the last gives token ids. What the single stages do with nulls, empty texts, ties, repeated rows
and empty tables is told by the operators they call; extra columns travel along.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import bpe
from codeloom.llm.chosen_path import drop_near_duplicates
from codeloom.llm.exact_dedup import drop_exact_duplicates
from codeloom.llm.mixing import sampled
from codeloom.llm.weak_labels import good_documents
from codeloom.session import configure, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    configure(spark)
    return good_documents(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    configure(spark)
    return drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    configure(spark)
    return drop_near_duplicates(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics meet their target weights."""
    configure(spark)
    return sampled(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids of every document that is left."""
    configure(spark)
    return bpe.encode(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("mixing to target weights", mixing_stage),
    ("byte-pair encoding", encoding_stage),
]
#: the classifier and the similarity join can't be said in SQL; tests hold the pipeline against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": (run, ORACLE_SQL)}
