"""A training-corpus pipeline: language ID, exact and near deduplication, pseudonyms, packing.

Every stage takes what its predecessor kept and returns the columns of documents, but the last,
which returns packed pieces. Rows that language ID rejects go, of copies and of near-duplicate
classes one document stays, personal data becomes pseudonyms.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import Scratch
from folioscope.llm.exact_dedup import without_copies
from folioscope.llm.lang_id import LangIdParams, predict, train, training_sample
from folioscope.llm.order_minhash import near_classes
from folioscope.llm.packing import PackingParams, best_fit_packing
from folioscope.llm.pii import PiiParams, pseudonymise


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str, params: LangIdParams = LangIdParams()) -> DataFrame:
    """Documents in a language that the model accepts."""
    model = train(training_sample(docs, params), params)
    judged = predict(spark, docs, model, params, carry=tuple(docs.columns), names=("__lang", "__score", "__accepted"))
    return judged.where("__accepted").select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_copies(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of every near-duplicate class."""
    goes = near_classes(spark, docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(goes, "doc_id", "left_anti").select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str, params: PiiParams = PiiParams()) -> DataFrame:
    return pseudonymise(docs, params, counts_col=None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # smaller caches than by default, as executors come here with the memory of four stages behind them
    params = PackingParams(public_tokenizers.path("word_bpe_49k.json"), remember=250_000, remember_pieces=125_000, block_chars=2 << 20)
    return best_fit_packing(spark, docs, params)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("pii", pii),
    ("packing", packing),
]

#: Edit alignment and trained models cannot be said in SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
