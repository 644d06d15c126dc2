"""Registered queries of this subpackage: name -> (Spark query, SQL that gives the same rows or None)."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.llm import bpe, chat, fim, period_tiles, sql, warc
from codeloom.llm.ball_tree import top_k
from codeloom.llm.chosen_path import near_duplicates
from codeloom.llm.exact_dedup import exact_duplicates
from codeloom.llm.feistel import pseudonyms
from codeloom.llm.html_density import extract
from codeloom.llm.log_bloom import scores
from codeloom.llm.mixing import DIMENSIONS, mixture
from codeloom.llm.weak_labels import quality
from codeloom.session import shared_folder


#: these documents are made up, so their key may be known
TEST_KEY = "codeloom-pseudonyms-1"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(_table(spark, sf_dir, "documents"))


def op6_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], turns.schema)
    return chat.digests(chat.examples(turns.unionByName(added)))


def op7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixture(_table(spark, sf_dir, "documents"))
    return rows.select(F.col("_doc.doc_id").alias("doc_id"), *DIMENSIONS, "n_tokens", "probability", "sampled")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality(_table(spark, sf_dir, "documents"))
    return rows.select(F.col("_doc.doc_id").alias("doc_id"), "n_words", "label", "score", "kept")


def op9_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms(_table(spark, sf_dir, "documents").select("doc_id", "text"), TEST_KEY, count="n_values")


def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark).rstrip('/')}/warc/{uuid.uuid4().hex}"
    warc.archive(_table(spark, sf_dir, "pages"), folder)
    return warc.page_rows(warc.read_archive(spark, folder, payload=False))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_tiles.digests(period_tiles.periodic_runs(period_tiles.planted(_table(spark, sf_dir, "documents"))))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.fill_in_middle(_table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_html_density": (op1_html_density, None),
    "op2_near_duplicates": (op2_near_duplicates, None),
    "op3_top_k": (op3_top_k, sql.TOP_K),
    "op4_bpe": (op4_bpe, None),
    "op5_lm_scores": (op5_lm_scores, None),
    "op6_chat_examples": (op6_chat_examples, None),
    "op7_mixture": (op7_mixture, sql.mixture()),
    "op8_quality": (op8_quality, None),
    "op9_exact_duplicates": (op9_exact_duplicates, sql.EXACT_DUPLICATES),
    "op10_pseudonyms": (op10_pseudonyms, None),
    "op11_warc_archive": (op11_warc_archive, sql.WARC_RECORDS),
    "op12_periodic_runs": (op12_periodic_runs, None),
    "op13_fill_in_middle": (op13_fill_in_middle, sql.FILL_IN_MIDDLE),
}
