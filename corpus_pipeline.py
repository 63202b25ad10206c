"""From raw documents to packed training sequences, one written table per stage."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspan.llm import mixing, partenum, quality, secrets, tier_packing
from hotspan.llm.queries import fold, table
from hotspan.storage import write_once

#: The setting for the bytes that Spark hands to a Python worker at once, and the most that the stages need.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python in batches of a few MB, in this session; a smaller bound that is set already stays.

    The executor and its Python workers hold a batch each and keep that memory through all later stages. A stage runs when its
    table is written, so the setting can't be put back before. A longer text is a batch of its own.
    """
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(BATCH).strip().lower()).groups()
    if int(number) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, learnt from the labelled ones among them outside the held-out fold.

    The statistics are written first: made and summed in one stage they would take two Python workers a task, which Spark
    keeps through the later stages.
    """
    small_batches(spark)
    rows = write_once(quality.with_statistics(docs))
    model = quality.fit(rows, table(spark, sf_dir, "labels"), ~fold("doc_id", 3, 1))
    return quality.accepted(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked by a Jaccard similarity of 0.8."""
    small_batches(spark)
    return partenum.one_of_each(docs, partenum.Join(words=5, percent=80))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in them replaced by a mark; ``n_chars`` follows the text."""
    clean = secrets.redacted(docs, secrets.fit(docs))
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share of the mix asks for; the one at the cut is shortened to its first words."""
    mixed = mixing.mixed_documents(docs)
    if "n_chars" not in docs.columns:
        return mixed
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of up to 1024."""
    small_batches(spark)
    return tier_packing.pack_tiers(docs, with_ids=True)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("secrets", without_secrets),
    ("mix", mixed_sources),
    ("pack", packed),
]

#: The first stage trains a classifier on floating-point statistics of whole texts, which SQL can't repeat.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents; each stage's table is written to the shared folder and read by the next one.

    Null texts and texts without words pass through as the stages' operators define; an empty table gives an empty result;
    further columns of the documents are kept up to the last stage.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = write_once(stage(spark, docs, sf_dir))
    return docs
