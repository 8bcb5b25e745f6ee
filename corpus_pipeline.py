"""Corpus preparation: toxicity, near-duplicates, personal data, source mixture, packing.

Each stage takes (spark, docs, sf_dir) and gets what the one before kept, written as Parquet and read again.

Defined results: rows with nulls in any column go through all stages, a null or empty text is never rejected, is like no
other text, and becomes a piece with the end id alone where the mixture takes it; of repeated rows with words one stays, as
of any near duplicates; further columns, whatever their names, are carried along up to the mixture and do not change what is done; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlake.llm import mixing, near_dup, packing, pii, toxicity
from twinlake.llm.common import Scratch, documents
from twinlake.llm.registry import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model rejects go; those without words, or where there are no labels to learn from, stay."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the least id; texts without words are in no group."""
    return near_dup.deduplicate(docs, words=5, percent=80)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, disguised or not, is replaced by its kind; n_chars follows; a null text stays null."""
    return pii.redacted(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it; one without words weighs nothing towards its source's target."""
    return mixing.mixed(docs, ratio=1.5, most=2)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of 4,096 ids; a null text is empty, and any document has its end id."""
    return packing.pack(docs, vocabulary(), capacity=4096, end_id=2)


STAGES = [("toxicity", drop_toxic), ("near_dup", drop_near_duplicates), ("pii", redact_personal_data), ("mixing", mix), ("packing", pack)]
#: The models, fingerprints and token ids of the stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over documents."""
    scratch, docs = Scratch(spark, "pipeline"), documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.keep(docs, name)
    return docs
