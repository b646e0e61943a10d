"""Line dedup by distinct-site spread.

A line (trimmed of blanks of all six kinds, not empty) that occurs on
``min_sites`` sites or more is boilerplate; by default half of all sites, but
3 at least and 10 at most, so that a corpus of few sources is cleaned too.  One aggregation builds a HyperLogLog sketch of the sites
per line hash, combined before the shuffle; only lines whose estimate lies
within ``band`` of the threshold are counted exactly.  Boilerplate lines stay
in the document of the smallest id that holds them and go from all others, so
a text that was copied to many sites survives once.

Defined cases: a null source counts as one site of its own.  Null texts stay
null and empty texts empty, without lines.  Documents without an id never keep a line
unless only such documents hold it; then all keep it.  Repeated rows are
treated alike.  All columns pass through; only the text (and ``n_chars``,
where present) changes.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm.common import staged, table, text_hash, trimmed


def _split(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _h1(line: Column) -> Column:
    return F.xxhash64(trimmed(line))


def _site(site_col: str) -> Column:
    return F.coalesce(F.col(site_col).cast("string"), F.lit("\u0000"))


def site_threshold(docs: DataFrame, site_col="source") -> int:
    """Half of the sites, between 3 and 10."""
    n = docs.select(_site(site_col).alias("site")).distinct().count()
    return min(10, max(3, -(-n // 2)))


def document_lines(docs: DataFrame, id_col="doc_id", site_col="source", text_col="text") -> DataFrame:
    """One row per document and different line: id, th, site, h1, h2."""
    line = F.col("line")
    return (docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("th"),
                        _site(site_col).alias("site"),
                        F.explode(F.array_distinct(F.transform(_split(F.col(text_col)), trimmed))).alias("line"))
            .where(line != "")
            .select("id", "th", "site", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")))


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int = 12, band: float = 0.1) -> DataFrame:
    """(h1, h2, keeper) of the lines on ``min_sites`` sites or more."""
    spread = (lines.groupBy("h1", "h2")
              .agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sk"), F.min("id").alias("keeper"))
              .select("h1", "h2", "keeper", F.hll_sketch_estimate("sk").alias("est"))
              .where(F.col("est") >= min_sites * (1 - band)))
    spread = staged(spread, "line-spread")
    clear = spread.where(F.col("est") > min_sites * (1 + band)).select("h1", "h2", "keeper")
    near = spread.where(F.col("est") <= min_sites * (1 + band)).select("h1", "h2", "keeper")
    exact = (lines.select("h1", "h2", "site").join(near, ["h1", "h2"])
             .groupBy("h1", "h2", "keeper").agg(F.count_distinct("site").alias("sites"))
             .where(F.col("sites") >= min_sites).select("h1", "h2", "keeper"))
    return staged(clear.unionByName(exact), "line-boilerplate")


def dedup(docs: DataFrame, id_col="doc_id", site_col="source", text_col="text", min_sites: int | None = None) -> DataFrame:
    """All columns of ``docs`` with the cleaned text, plus n_lines and
    n_removed (long)."""
    lines = document_lines(docs, id_col, site_col, text_col)
    bad = boilerplate(lines, site_threshold(docs, site_col) if min_sites is None else min_sites)
    gone = (lines.join(bad, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
            .groupBy(F.col("id").alias("__gone_id"), F.col("th").alias("__gone_th"))
            .agg(F.collect_set("h1").alias("__gone")))
    parts = _split(F.col(text_col))
    stay = F.filter(parts, lambda x: (trimmed(x) == "") | ~F.array_contains(F.col("__gone"), _h1(x)))
    hit = F.col("__gone").isNotNull()
    has = F.col(text_col).isNotNull() & (F.col(text_col) != "")
    n_lines = F.when(has, F.size(parts)).otherwise(0).cast("long")
    joined = docs.join(gone, F.col(id_col).eqNullSafe(F.col("__gone_id")) & (text_hash(F.col(text_col)) == F.col("__gone_th")), "left")
    out = joined.withColumns({
        "n_lines": n_lines,
        "n_removed": F.when(hit, n_lines - F.size(stay)).otherwise(0).cast("long"),
        text_col: F.when(hit, F.array_join(stay, "\n")).otherwise(F.col(text_col))})
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.length(text_col).cast("long")).otherwise(F.col("n_chars")))
    return out.drop("__gone_id", "__gone_th", "__gone")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


OP5_SQL = """
WITH m AS (SELECT ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS blanks),
l AS (SELECT doc_id, coalesce(source, chr(1)) AS site, trim(x, blanks) AS line
      FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x FROM documents), m
      WHERE trim(x, blanks) <> ''),
t AS (SELECT least(10, greatest(3, (count(DISTINCT coalesce(source, chr(1))) + 1) // 2)) AS sites FROM documents),
b AS (SELECT line, min(doc_id) AS keeper FROM l GROUP BY line HAVING count(DISTINCT site) >= (SELECT sites FROM t)),
q AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x,
             unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents),
p AS (SELECT q.*, (b.line IS NOT NULL AND q.doc_id IS DISTINCT FROM b.keeper) AS gone
      FROM q CROSS JOIN m LEFT JOIN b ON trim(q.x, blanks) = b.line),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
             string_agg(x, chr(10) ORDER BY i) FILTER (NOT gone) AS t FROM p GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL OR d.text = '' THEN 0 ELSE g.n_lines END AS n_lines,
       coalesce(g.n_removed, 0) AS n_removed,
       CASE WHEN coalesce(g.n_removed, 0) = 0 THEN d.text ELSE coalesce(g.t, '') END AS text
FROM documents d LEFT JOIN g USING (doc_id)
"""
