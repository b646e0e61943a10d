"""Exact dedup by skew-safe combining.

Texts are equal when identical after lower-casing A-Z; null counts as empty.
Copies are combined in three aggregations, each grouped by digest *and* whole
normalised text, so that content is compared every time:

1. local: a task's copies become one row before anything is shuffled (the salt
   is a function of the task, so this is the partial aggregate of step 2),
2. salted: (digest, text, salt) groups merge, so that a text in every task
   meets in ``salts`` places instead of one,
3. global: the at most ``salts`` winners of a text meet.

Documents find their group by digest alone.  Only where two unlike texts share
a digest do they find it by text as well, so no digest is ever trusted.

Defined cases: null texts equal empty ones.  A null id is below every other.
Of rows that repeat both the largest id and the text exactly one stays.  A
column named like a result column is replaced.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm.common import LOWER, UPPER, ascii_lower, staged, table

SALTS = 64


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(norm: Column) -> Column:
    return F.sha2(norm, 256)


def groups(docs: DataFrame, id_col="doc_id", text_col="text", digest: Callable[[Column], Column] = sha256,
           salts: int = SALTS) -> DataFrame:
    """One row per different text: __digest, __norm, keep_id, group_size."""
    norm = normalised(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), digest(norm).alias("__digest"), norm.alias("__norm"),
                       F.pmod(F.spark_partition_id(), F.lit(salts)).alias("__salt"))
    merged = rows.groupBy("__digest", "__norm", "__salt").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    return merged.groupBy("__digest", "__norm").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))


def mark(docs: DataFrame, id_col="doc_id", text_col="text", carry: list[str] | None = None,
         digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """The columns ``carry`` of every row (default: all), with keep_id,
    group_size, kept and text_sha256."""
    made = ["keep_id", "group_size", "kept", "text_sha256"]
    carry = [c for c in (docs.columns if carry is None else carry) if c not in made]
    sized = [F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")]
    # Texts that stand alone need no partner: only digests of several rows are kept.
    copied = staged(groups(docs, id_col, text_col, digest, salts).groupBy("__digest")
                    .agg(F.count(F.lit(1)).alias("__texts"), *sized).where(F.col("group_size") > 1), "dedup-copied")
    norm = normalised(F.col(text_col))
    rows = docs.select(*carry, F.col(id_col).alias("__id"), norm.alias("__norm"), digest(norm).alias("__digest"),
                       sha256(norm).alias("text_sha256")).join(copied, "__digest", "left")
    shared = copied.where(F.col("__texts") > 1).select("__digest")
    if not shared.isEmpty():  # unlike texts under one digest: by the text itself
        crowd = docs.join(shared, digest(norm) == F.col("__digest"), "left_semi")
        exact = groups(crowd, id_col, text_col, digest, salts).withColumnsRenamed(
            {"keep_id": "__keep", "group_size": "__size"})
        rows = rows.join(exact, ["__digest", "__norm"], "left").withColumns({
            "keep_id": F.when(F.col("__size").isNull(), F.col("keep_id")).otherwise(F.col("__keep")),
            "group_size": F.coalesce("__size", "group_size")})
    alone = F.col("group_size").isNull()
    marked = staged(rows.select(
        *carry, F.when(alone, F.col("__id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("__id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256",
        F.monotonically_increasing_id().alias("__row")), "dedup-marked")
    repeated = (marked.where(F.col("kept") & (F.col("group_size") > 1)).groupBy("keep_id", "text_sha256")
                .agg(F.max("__row").alias("__stays"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
                .select(F.col("keep_id").alias("__k"), F.col("text_sha256").alias("__s"), "__stays"))
    if not repeated.isEmpty():  # rows of one id and text: one of them stays
        same = F.col("keep_id").eqNullSafe(F.col("__k")) & (F.col("text_sha256") == F.col("__s"))
        marked = marked.join(repeated, same, "left").withColumn(
            "kept", F.col("kept") & (F.col("__stays").isNull() | (F.col("__stays") == F.col("__row"))))
    return marked.select(*carry, *made)


def dedup(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` that stay, with whole texts as they were."""
    kept = [c for c in docs.columns if c not in ("keep_id", "group_size", "kept", "text_sha256")]
    return mark(docs, id_col, text_col).where("kept").select(*kept)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark(table(spark, sf_dir, "documents"), carry=["doc_id"])


OP12_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)
"""
