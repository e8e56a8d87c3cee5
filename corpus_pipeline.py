"""A training-data pipeline over ``documents``: four operators in a row.

Each stage takes (spark, docs, sf_dir), works on all rows that its
predecessor kept and returns a DataFrame; all but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeledger.llm.common import saved
from lakeledger.llm.jaccard_join import link_components
from lakeledger.llm.packing import pack
from lakeledger.llm.quality import verdicts
from lakeledger.llm.registry import table
from lakeledger.llm.toxicity import scored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5, learned from the ``labels`` table."""
    return scored(docs, table(spark, sf_dir, "labels")).where("predicted = 0").select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return verdicts(docs).where("kept").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that with the smallest doc_id.

    Word shingles of five words, similarity 0.8 or more.  Exactly one row of
    each class stays, also where an id repeats with other texts or is NULL:
    the row with the smallest id (NULL last), then the smallest text hash.
    Documents without words are near nothing; all of them stay.
    """
    rows = link_components(docs, words=5, percent=80, details=True).where("component_key is not null")
    rows = rows.groupBy("component_key", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    lead = rows.groupBy("component_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash", "copies")).alias("lead"))
    lead = saved(lead.select(F.col("lead.doc_id").alias("__id"), F.col("lead.text_hash").alias("__hash"), F.col("lead.copies").alias("__copies")), "pipeline-leads")
    found = docs.join(lead, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash")))
    # Only rows that repeat id and text have to be told apart once more.
    once = found.where("__copies = 1").select(docs.columns)
    again = found.where("__copies > 1").dropDuplicates(["doc_id", "__hash"]).select(docs.columns)
    bare = docs.where(F.coalesce(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(True)))
    return once.unionByName(again).unionByName(bare)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens, with their ids."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("packing", pack_documents),
]

#: A learned score and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return saved(STAGES[-1][1](spark, docs, sf_dir), f"pipeline-{STAGES[-1][0]}")
