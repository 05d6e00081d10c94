"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all stages but the last return the columns of documents.  Documents
that quality rules reject, that lose every line to line dedup, that aren't the
first of their near-duplicate group, or that leak a benchmark item, go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.llm.common import Workspace, table
from nearfold.llm.decontaminate import drop_leaks
from nearfold.llm.line_dedup import dedup_lines
from nearfold.llm.quality import keep_good
from nearfold.llm.sentencepiece_fst import round_trip
from nearfold.llm.simhash import drop_near_duplicates


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; documents all of whose lines repeat earlier ones go."""
    out = dedup_lines(docs).where("n_dropped = 0 or text <> ''")
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", n_chars).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # All pairs of the similarity are found by their shingles; the radius is for those that fingerprints find sooner.
    return drop_near_duplicates(docs, radius=3, exact=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return round_trip(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near-dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: Trained models, components and alignments have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ws = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = ws.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
