"""A corpus pipeline: from raw documents to packed training batches.

Each stage reads what the one before it wrote. All but the last return the
columns of ``documents``; the last returns one row for each document that is
left, with its batch.

Nulls: a null text is scored and packed as the empty text, has no lines and no personal
data, and is no near copy of anything; neither is a row without a ``doc_id``. Rows of equal
id and text are scored and edited alike and stay or go together; of rows with one id and different
texts the least text takes part in the search for near copies, and the others stay. An
empty table gives an empty result at every stage; further columns are carried to the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from logloom.llm import jaccard, line_templates, packing, pii, quality
from logloom.llm.shared import documents, session_dir, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of templates that recur across documents go."""
    return line_templates.without_boilerplate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard.one_of_each(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is generalised, terms that disclose it are removed."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-budget batches inside optimal length buckets."""
    return packing.packed(docs)


STAGES = [("quality", keep_good), ("lines", drop_boilerplate), ("near_copies", drop_near_copies), ("pii", sanitise), ("packing", pack)]

#: SQL cannot express training, the packing program or the disclosure step.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        out = f"{session_dir(spark)}/{uuid.uuid4().hex}/stage-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return STAGES[-1][1](spark, docs, sf_dir)
