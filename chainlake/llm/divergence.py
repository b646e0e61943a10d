"""Source divergence audit: how far the word use of sources lies apart.

Inside ``mapInArrow`` an Arrow compute pipeline (ascii_lower,
split_pattern_regex, dictionary_encode, hash group_by) turns texts into partial
counts per (lang, source, term).  Spark merges them.  The terms of a language
are dealt to shards; each shard becomes a columnar table of counts, term by
source, and adds up its part of the divergence of every pair of sources.

A pair costs one step per term, so the work is terms x sources^2 / 2, like the
output in the sources.  Sources are dealt to blocks of about ``BLOCK``, and a
shard of about ``CELLS`` counts is met by two blocks at a time, so no task
holds a whole language.

Defined cases: null text, lang and source are ''.  Repeated rows count each.
Groups without terms have their rows too; a language without kept terms has
distances of 0.  Other columns are ignored.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlake.llm.common import LOWER, UPPER, ship_by_value, staged, table

ship_by_value(__name__)

BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
CHUNK_BYTES = 8 << 20   # of text that a task splits at a time
HELD_ROWS = 1_000_000   # partial counts that a task holds before it merges or sends them
BLOCK = 256             # sources of a block, about
CELLS = 20_000          # counts of a shard, about
STEP = 4096             # terms that are compared at a time
COUNTS = "lang string, source string, term string, n long, docs long"
KEYS = ["lang", "source", "term"]


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``CHUNK_BYTES`` of text, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + CHUNK_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


class _Groups:
    """Small numbers for the (lang, source) groups that a task has met."""

    def __init__(self) -> None:
        self.number: dict[tuple[str, str], int] = {}

    def of(self, batch: pa.RecordBatch) -> np.ndarray:
        langs, sources = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        pairs = np.stack([langs.indices.to_numpy(), sources.indices.to_numpy()], axis=1)
        met, inverse = np.unique(pairs, axis=0, return_inverse=True)
        ids = [self.number.setdefault((langs.dictionary[i].as_py(), sources.dictionary[j].as_py()), len(self.number)) for i, j in met.tolist()]
        return np.array(ids, np.int32)[inverse.ravel()]

    def out(self, t: pa.Table) -> Iterator[pa.RecordBatch]:
        langs, sources = (pa.array(c, pa.string()) for c in zip(*self.number, strict=True))
        for b in t.to_batches(max_chunksize=65536):
            yield pa.RecordBatch.from_arrays([langs.take(b["grp"]), sources.take(b["grp"]), b["term"].cast(pa.string()), b["n"], b["docs"]],
                                             [*KEYS, "n", "docs"])


def _count(batch: pa.RecordBatch, groups: np.ndarray) -> pa.Table:
    """Occurrences and documents per (group, term) of some rows."""
    words = pc.split_pattern_regex(pc.ascii_lower(batch.column("text").cast(pa.string())), BREAKS)
    row, terms = pc.list_parent_indices(words), pc.list_flatten(words)
    full = pc.not_equal(terms, "")
    row, codes = row.filter(full), terms.filter(full).dictionary_encode()
    per_doc = pa.table({"row": row, "code": codes.indices}).group_by(["row", "code"]).aggregate([([], "count_all")])
    cells = pa.table({"grp": pa.array(groups).take(per_doc["row"]), "code": per_doc["code"], "n": per_doc["count_all"]})
    cells = cells.group_by(["grp", "code"]).aggregate([("n", "sum"), ([], "count_all")])
    return pa.table({"grp": cells["grp"], "term": pc.take(codes.dictionary, cells["code"]).cast(pa.large_string()),
                     "n": cells["n_sum"], "docs": cells["count_all"]})


def _merge(parts: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(parts).group_by(["grp", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.table({"grp": t["grp"], "term": t["term"], "n": t["n_sum"], "docs": t["docs_sum"]})


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of a task, merged while they fit ``HELD_ROWS``."""
    held: list[pa.Table] = []
    groups = _Groups()
    for batch in batches:
        for chunk in _chunks(batch):
            held.append(_count(chunk, groups.of(chunk)))
            if sum(t.num_rows for t in held) > HELD_ROWS:
                held = [_merge(held)]
                if held[0].num_rows > HELD_ROWS * 3 // 4:
                    yield from groups.out(held.pop())
    if held:
        yield from groups.out(_merge(held))


def term_counts(docs: DataFrame, text_col="text", lang_col="lang", source_col="source") -> DataFrame:
    """lang, source, term, n, docs over all rows."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                         for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    return rows.mapInArrow(partial_counts, COUNTS).groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (wide(n) + 2), wide(total) + 2 * wide(terms)) + 1


def audit_terms(counts: DataFrame, min_docs: int = 10) -> DataFrame:
    """Terms in ``min_docs`` documents of their language: lang, term, n."""
    return (counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
            .where(F.col("docs") >= min_docs).select("lang", "term", "n"))


def totals(pairs: DataFrame, kept: DataFrame, terms: DataFrame, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """Per (lang, source): total, p0 (its share of a term that it lacks), blk,
    and the lang's lang_total, v (kept terms), shards, blocks."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own_cells"))
    pairs = pairs.join(own, ["lang", "source"], "left")
    of_lang = (pairs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"), F.coalesce(F.sum("own_cells"), F.lit(0)).alias("cells"))
               .join(terms.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("v")), "lang", "left")
               .select("lang", F.coalesce("lang_total", F.lit(0)).alias("lang_total"), F.coalesce("v", F.lit(0)).alias("v"),
                       F.greatest(F.ceil(F.col("cells") / cells), F.lit(1)).cast("int").alias("shards"),
                       F.ceil(F.col("n_sources") / block).cast("int").alias("blocks")))
    out = pairs.join(of_lang, "lang").select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), "lang_total", "v", "shards", "blocks",
        F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("blk"))
    return out.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"))).otherwise(1))


def shard_part(t: pa.Table, top: int) -> pa.Table:
    """One shard of terms and two blocks of sources: its part of the distance
    of each pair, and (a block with itself) the ``top`` terms that set each
    source apart, of which the best over all shards are the result.  Rows without a term carry every source's share ``p`` of a
    term that it lacks, and ``v``.  Shard 0 adds what pairs have from all
    kept terms if neither source held any."""
    lang, shard, left, right = (t[c][0].as_py() for c in ("lang", "shard", "blk_a", "blk_b"))
    base = t.filter(pc.is_null(t["term"])).sort_by("source")
    cells = t.filter(pc.is_valid(t["term"]))
    names, blk, none, v = base["source"], base["blk"].to_numpy(), base["p"].to_numpy(), int(base["v"][0].as_py())
    terms = cells["term"].combine_chunks().dictionary_encode()
    col, row, p = pc.index_in(cells["source"], names).to_numpy(), terms.indices.to_numpy(), cells["p"].to_numpy()
    order = np.argsort(row, kind="stable")
    col, row, p = col[order], row[order], p[order]
    mine, other = np.flatnonzero(blk == left), np.flatnonzero(blk == right)
    far = lambda x, y: (x - y) * (x - y) // (x + y)
    lone = far(none[mine][:, None], none[other][None, :])
    out = lone * (v if shard == 0 else 0)
    for start in range(0, len(terms.dictionary), STEP):
        stop = min(start + STEP, len(terms.dictionary))
        lo, hi = np.searchsorted(row, [start, stop])
        dense = np.repeat(none[None, :], stop - start, axis=0)
        dense[row[lo:hi] - start, col[lo:hi]] = p[lo:hi]
        theirs = dense[:, other]
        for i, m in enumerate(mine):
            out[i] += far(dense[:, m][:, None], theirs).sum(axis=0) - (stop - start) * lone[i]
    i, j = np.nonzero((mine[:, None] < other[None, :]) if left == right else np.ones(out.shape, bool))
    pairs = pa.table({"part": pa.array(["pair"] * len(i), pa.string()), "source": names.take(pa.array(mine[i])).cast(pa.string()),
                      "item": names.take(pa.array(other[j])).cast(pa.string()), "value": out[i, j]})
    parts = [pairs, _apart(cells, top)] if left == right else [pairs]
    return pa.concat_tables(p.combine_chunks() for p in parts).add_column(0, "lang", pa.array([lang] * sum(p.num_rows for p in parts), pa.string()))


def _apart(cells: pa.Table, top: int) -> pa.Table:
    """The ``top`` terms of each source with a larger share than its language."""
    p, q = cells["p"].to_numpy(), cells["q"].to_numpy()
    more = p > q
    found = cells.select(["source", "term"]).filter(pa.array(more)).append_column("value", pa.array((p - q)[more] ** 2 // (p + q)[more]))
    found = found.sort_by([("source", "ascending"), ("value", "descending"), ("term", "ascending")])
    codes = found["source"].combine_chunks().dictionary_encode().indices.to_numpy()
    first = np.searchsorted(codes, codes) if len(codes) else codes  # sources come in one run each, numbered as met
    found = found.filter(pa.array(np.arange(len(codes)) - first < top))
    return pa.table({"part": pa.array(["term"] * found.num_rows, pa.string()), "source": found["source"].cast(pa.string()),
                     "item": found["term"].cast(pa.string()), "value": found["value"]})


def shard_parts(cells: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """lang, part, source, item, value: parts of the distance of every
    unordered pair of a language's sources, and the terms of each shard that
    set a source apart.

    ``cells``: lang, source, term, p, q; ``groups``: as of ``totals``."""
    meets = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.least(x, F.col("blk")).alias("blk_a"), F.greatest(x, F.col("blk")).alias("blk_b"))))
    everyone = groups.select("lang", "source", "blk", "blocks", "v", F.col("p0").alias("p"), F.lit(None).cast("long").alias("q"),
                             F.lit(None).cast("string").alias("term"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    held = cells.select("lang", "source", "blk", "blocks", "v", "p", "q", "term", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"))
    return (everyone.unionByName(held).withColumn("meets", meets)
            .select("lang", "shard", "meets.blk_a", "meets.blk_b", "source", "blk", "term", "p", "q", "v")
            .groupBy("lang", "shard", "blk_a", "blk_b")
            .applyInArrow(lambda t: shard_part(t, top), "lang string, part string, source string, item string, value long"))


def audit(docs: DataFrame, text_col="text", lang_col="lang", source_col="source", min_docs: int = 10, top: int = 10,
          cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: all other sources by distance,
    and the ``top`` terms that set a source apart from its language."""
    counts = staged(term_counts(docs, text_col, lang_col, source_col), "divergence-counts")
    pairs = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
    terms = staged(audit_terms(counts, min_docs), "divergence-terms")
    kept = counts.select(*KEYS, "n").join(terms.select("lang", "term", F.col("n").alias("lang_n")), ["lang", "term"])
    groups = staged(totals(pairs, kept, terms, cells, block), "divergence-groups")
    shares = kept.join(groups, ["lang", "source"]).select(
        *KEYS, "blk", "blocks", "shards", "v", share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    parts = staged(shard_parts(shares, groups, top), "divergence-parts")
    near = parts.where("part = 'pair'").groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    both = near.select("lang", "part", F.inline(F.array(
        F.struct("source", "item", "value"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"))))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    apart = parts.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
    return both.withColumn("rank", rank).unionByName(apart).select("lang", "source", "part", "item", "value", "rank")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
                  translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
w AS (SELECT lang, source, r, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
z AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS k_n
      FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n,
             1 + (1000000000 * (n + 2)::HUGEINT) // (sum(n) OVER s + 2 * count(*) OVER s)::HUGEINT AS p,
             1 + (1000000000 * (k_n + 2)::HUGEINT) // (sum(k_n) OVER s + 2 * count(*) OVER s)::HUGEINT AS q
      FROM z WINDOW s AS (PARTITION BY lang, source)),
f AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p))::BIGINT AS value
      FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
a AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f.value, 0) AS value
      FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
      LEFT JOIN f ON f.lang = x.lang AND f.source = x.source AND f.item = y.source
      UNION ALL
      SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM a)
SELECT * FROM o WHERE part = 'pair' OR rank <= 10
"""
