"""Five stages that turn raw documents into a training mix, each calling one operator of ``corvine.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the
last return the columns of ``documents``. ``run`` writes what each stage returns and reads it again, so a
lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import decontamination, exact_dedup, mixing, near_dedup, toxicity
from corvine.session import ship, table
from corvine.storage import written

#: Similarity of 5-word shingle sets, in per cent, from which two texts of the mix are near-duplicates; the query of operator 9 keeps its own 85.
NEAR_PERCENT = 80


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7; the field is fitted on labelled rows of ``docs``."""
    ship(spark)
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), 0.7)


def _of(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` that are (not) among ``rows``, by id and hash of the text: ids may repeat or be null."""
    picked = rows.select(F.col("doc_id").alias("_picked"), F.col("mark").alias("_mark"))
    return docs.join(picked, docs["doc_id"].eqNullSafe(picked["_picked"]) & (F.xxhash64(docs["text"]) == picked["_mark"]), how)


def exact_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest (then smallest id)."""
    return _of(docs, exact_dedup.exact_dedup(docs).filter("kept"), "left_semi")


def near_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity 0.8 or more), the smallest id."""
    ship(spark)
    return _of(docs, near_dedup.near_groups(docs, percent=NEAR_PERCENT).filter("kept"), "left_semi")


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return _of(docs, found, "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample drawn by calibrated probabilities, with the columns that mixing adds."""
    return mixing.mixed(docs).filter("sampled")


STAGES = [("toxicity", toxic_out), ("exact dedup", exact_out), ("near dedup", near_out), ("decontamination", leaks_out), ("mixing", mix)]

#: A fitted random field decides in the first stage, which SQL does not express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
