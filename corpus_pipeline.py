"""A corpus pipeline over the documents table, in five stages.

toxicity -> exact dedup -> SimHash near-dedup -> mixing to target weights -> best-fit packing.
Each stage gets all rows its predecessor kept, written as Parquet and read again.

Defined cases, the stages taken together: a document with a NULL id is judged for toxicity, takes
part in no dedup, stays as it is in the mixing and is packed with a NULL id; NULL and empty texts
score as the classifier's bias, empty ones are copies of each other, and both have no tokens, so
they reach the packing and give no piece there; very long texts are read whole by every stage; of
rows that repeat an id and text one stays, of equal or near texts the least id; a NULL source is a
source by itself; other columns, of any name, are carried along up to the packing; an empty
documents table gives an empty result; without labels of both classes nothing is rejected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from docquarry.llm import exact_dedup, mixing, packing, simhash_dedup, toxicity
from docquarry.llm._util import shared_dir, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels table, rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash_dedup.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their tempered weights; sized so that every source is used whole at least
    once, so no document is lost and those of small sources come more often."""
    return mixing.mix_documents(docs, temperature=0.9, min_epochs=1.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document gets its bin and offset."""
    return packing.best_fit_pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: The classifier is learned and the SimHash search has no SQL, so the rows have none.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
