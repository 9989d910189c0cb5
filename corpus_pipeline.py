"""A corpus pipeline: toxicity, near duplicates, benchmark decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm import decontam, jaccard, packing, pii, toxicity
from colonnade.llm.queries import model_file
from colonnade.llm.shared import dropped, small_or_joined, table, written


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among them, does not reject."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Documents without words are no duplicates of anything and all stay. Of rows that
    repeat an id and a set of shingles one stays; rows without an id stay only where their
    group has no id at all, one per set.
    """
    found = written(jaccard.near_duplicates(docs).where("n_shingles > 0"), "pipeline-sets")
    key = [F.col("doc_id").alias("__id"), F.col("set_class").alias("__of")]
    dropped = found.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(*key).distinct()
    repeated = found.groupBy("doc_id", "set_class").count().where("count > 1").select(*key)
    named = jaccard.with_set_class(docs, "__class")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__class") == F.col("__of"))
    kept = named.join(small_or_joined(dropped), same, "left_anti")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    again = small_or_joined(repeated)
    once = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "__class"])
    return kept.join(again, same, "left_anti").unionByName(once).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its personal data replaced; the detector is fitted on these documents."""
    return pii.redact(docs, pii.fit(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their places in the training sequences."""
    return packing.pack_documents(docs, model_file())


STAGES = [
    ("toxicity", keep_civil),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_leaks),
    ("pii", redact),
    ("packing", pack),
]

#: No stage but the second can be stated in SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
