"""Pipeline over ``documents``: toxicity filter, line dedup, near-duplicate
removal, benchmark decontamination, mixing of sources.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame with the
columns of ``docs``; the last one returns the mixed corpus in blocks of words,
each with the ids of the documents that it was cut from.  Null and empty texts
pass the filters: nothing in them is toxic, copied or leaked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm import decontaminate, jaccard_join, line_dedup, mixing, toxicity
from chainlake.llm.common import staged, table, trimmed


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the rejected severity."""
    model = toxicity.train(toxicity.labelled_documents(docs, table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model, out_col="__severity").where(F.col("__severity") < toxicity.REJECT).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without boilerplate lines; documents of nothing else are gone."""
    got = line_dedup.dedup(docs)
    return got.where(~((F.col("n_removed") > 0) & (trimmed(F.col("text")) == ""))).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard_join.keep_one(docs).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus, one row per block taken."""
    return mixing.mix_blocks(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near duplicates", drop_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: Severity, MinHash and the drawn slots have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
