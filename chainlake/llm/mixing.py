"""Mixing sources to target weights, without Python on the main path.

1. Sources in code-point order (null last) get the weights in turn.  Targets
   share the words of all documents by weight, no source above ``max_epochs``
   times its own words; the closed form sorts the sources by cap per weight.
2. Each source's words are packed into blocks of ``block`` words.  Documents
   are dealt to buckets of about ``BUCKET_DOCS``; running sums inside the
   buckets and over the buckets give every document its word range, so no
   task holds a whole source.
3. Output shards of ``shard_slots`` slots draw their sources: slot g takes the
   source that owns cell hash(g) mod N, where each source owns as many of the
   N cells as it needs slots.  That is one multinomial draw per shard; cells
   are never listed, their owners are found by chunks of cells.  A
   source drawn beyond its need is cut there, and what is missing is dealt to
   further shards, so the totals meet the targets exactly.
4. Slot j of a source is epoch j div per_epoch and a position in it; a
   swap-or-not shuffle keyed by (seed, source, epoch) permutes the full
   blocks, and the short last block ends each epoch.
5. Slots and document pieces meet in an equi-join on (source, block).

Defined cases: null, empty or blank texts have size 0 and are never taken; a
source of such texts has target 0.  The null source is a source of its own and
comes last.  Repeated rows are separate documents.  Empty tables give no rows.
Only the id, source and text columns are read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainlake.llm.common import WORD, staged, table, text_hash

BLOCK, SHARD_SLOTS, BUCKET_DOCS, ROUNDS = 512, 1024, 1024, 64
WEIGHTS = (1.0, 2.0, 3.0)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = 3) -> DataFrame:
    """(source, sid, n_docs, source_size, target, take) from rows with source
    and size.  One row per source; windows run over that table only."""
    agg = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    everything = W.partitionBy(F.lit(0))
    s = agg.withColumn("sid", F.row_number().over(everything.orderBy(F.asc_nulls_last("source"))).cast("long") - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("sid", F.lit(len(weights))) + 1).cast("int"))
    s = (s.withColumn("w", weight).withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
         .withColumn("r", F.col("cap") / F.col("w")))
    before = everything.orderBy("r", "sid").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything)
    s = (s.withColumn("rank", F.row_number().over(everything.orderBy("r", "sid")))
         .withColumn("lam", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                     / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))))
    lam = F.min_by(F.col("lam"), F.when(F.col("lam") <= F.col("r"), F.col("rank"))).over(everything)
    s = s.withColumn("target", F.least(F.col("cap"), F.col("w") * lam))
    take = F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs)
    return s.select("source", "sid", "n_docs", "source_size", "target", take.alias("take"))


def plan_slots(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """How many slots each source needs; see ``slots_of``."""
    size = F.greatest(F.col("source_size"), F.lit(1))
    s = (sources.withColumn("epochs", F.expr("take").cast("long") - F.pmod("take", size))
         .withColumn("epochs", (F.col("epochs") / size).cast("long"))
         .withColumn("rem", F.pmod("take", size))
         .withColumn("tail", F.pmod("source_size", F.lit(block)))
         .withColumn("full", ((F.col("source_size") - F.col("tail")) / block).cast("long")))
    s = s.withColumn("per_epoch", F.col("full") + (F.col("tail") > 0).cast("long"))
    q = F.least(((F.col("rem") - F.pmod("rem", F.lit(block))) / block).cast("long"), F.col("full"))
    s = s.withColumn("q", q).withColumn("rest", F.col("rem") - F.col("q") * block)
    return s.withColumn("need", F.col("epochs") * F.col("per_epoch") + F.col("q") + (F.col("rest") > 0).cast("long"))


def permuted(i: Column, n: Column, keys: list[Column], rounds: int = ROUNDS) -> Column:
    """Swap-or-not shuffle: a keyed permutation of 0..n-1 for any n."""
    def step(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(*keys, r), n) - x + n, n)
        swap = F.xxhash64(*keys, r, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), i.cast("long"), step)


def owners(draws: DataFrame, planned: DataFrame, chunk: int) -> DataFrame:
    """Adds sid, the source that owns a draw's cell: each owns ``need`` cells
    in turn.  The cells are cut into chunks of about the mean need; a chunk
    lists the sources that reach into it, at most two rows a source in all, so
    draws meet their owner in an equi-join without a table of the cells."""
    first = F.coalesce(F.sum("need").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")
    spans = planned.select("sid", first.alias("first"), (first + F.col("need")).alias("end"))
    chunk_of = lambda c: ((c - F.pmod(c, F.lit(chunk))) / chunk).cast("long")
    reach = spans.select("*", F.explode(F.sequence(chunk_of(F.col("first")), chunk_of(F.col("end") - 1))).alias("chunk"))
    return (draws.withColumn("chunk", chunk_of(F.col("cell"))).join(reach, "chunk")
            .where((F.col("cell") >= F.col("first")) & (F.col("cell") < F.col("end"))).drop("chunk", "first", "end"))


def slots_of(planned: DataFrame, seed: int = 0, block: int = BLOCK, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, sid, j, block, words): one row per slot of the output."""
    spark = planned.sparkSession
    planned = staged(planned, "mix-plan")
    p = planned.where("need > 0")
    total = p.agg(F.sum("need").alias("n"), F.count(F.lit(1)).alias("sources")).first()
    n = total["n"] or 0
    drawn_cell = F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(max(n, 1)))
    draws = spark.range(n).select((F.col("id") / shard_slots).cast("long").alias("shard"), drawn_cell.alias("cell"))
    draws = (owners(draws, p, max(1, n // max(1, total["sources"])))
             .groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("drawn")))
    by_shard = W.partitionBy("sid").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    draws = draws.withColumn("first", F.coalesce(F.sum("drawn").over(by_shard), F.lit(0)))
    got = staged(draws.join(p.select("sid", "need"), "sid").where("first < need")
                 .select("sid", "shard", "first", F.least("drawn", F.col("need") - F.col("first")).alias("n")), "mix-draws")
    have = got.groupBy("sid").agg(F.sum("n").alias("have"))
    short = (p.join(have, "sid", "left").select("sid", F.coalesce("have", F.lit(0)).alias("first"),
                                                (F.col("need") - F.coalesce("have", F.lit(0))).alias("n")).where("n > 0"))
    last = -(-n // shard_slots)
    drawn = got.select("sid", "shard", F.expr("explode(sequence(first, first + n - 1))").alias("j"))
    dealt = (short.select("sid", F.expr("explode(sequence(first, first + n - 1))").alias("j"))
             .withColumn("shard", F.lit(last) + F.pmod(F.xxhash64(F.lit(seed), "sid", "j"), F.lit(max(1, last // 8)))))
    # few rows became many: deal them out before the permutation's work
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = drawn.unionByName(dealt).repartition(tasks, "sid", "j").join(p, "sid")
    epoch = ((F.col("j") - F.pmod("j", F.col("per_epoch"))) / F.col("per_epoch")).cast("long")
    s = s.withColumn("epoch", epoch).withColumn("i", F.pmod("j", F.col("per_epoch")))
    where = F.when(F.col("i") < F.col("full"), permuted(F.col("i"), F.greatest("full", F.lit(1)), [F.lit(seed), F.col("sid"), F.col("epoch")])) \
        .otherwise(F.col("full"))
    words = F.when((F.col("epoch") < F.col("epochs")) | (F.col("i") < F.col("q")),
                   F.when(F.col("i") < F.col("full"), F.lit(block)).otherwise(F.col("tail"))).otherwise(F.col("rest"))
    return s.select("shard", "sid", "j", where.alias("block"), words.cast("long").alias("words"))


def placed(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds sid, source_size, target, bucket, rn and start (first word in the
    source's stream) to rows with doc_id, th, source, size."""
    s = sources.select(F.col("source").alias("s_source"), "sid", "n_docs", "source_size", "target")
    d = docs.join(s, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    n = F.greatest(F.ceil(F.col("n_docs") / BUCKET_DOCS), F.lit(1)).cast("long")
    d = d.withColumn("bucket", F.pmod(F.xxhash64(F.lit("bucket"), "doc_id", "th"), n))
    d = d.repartition("sid", "bucket")
    inside = W.partitionBy("sid", "bucket").orderBy("doc_id", "th")
    d = (d.withColumn("rn", F.row_number().over(inside))
         .withColumn("inner", F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))))
    sums = docs.join(s, F.col("source").eqNullSafe(F.col("s_source"))).select("sid", F.pmod(F.xxhash64(F.lit("bucket"), "doc_id", "th"), n).alias("bucket"), "size") \
        .groupBy("sid", "bucket").agg(F.sum("size").alias("b"))
    offs = sums.select("sid", "bucket", F.coalesce(F.sum("b").over(
        W.partitionBy("sid").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    return d.join(offs, ["sid", "bucket"]).withColumn("start", F.col("off") + F.col("inner")).drop("off", "inner", "n_docs")


def pieces(place: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document and block that it reaches into: block, lo, hi
    (word offsets in the block); documents of size 0 have a null block."""
    first = (F.col("start") - F.pmod("start", F.lit(block))) / block
    end = F.col("start") + F.col("size") - 1
    last = (end - F.pmod(end, F.lit(block))) / block
    spans = F.when(F.col("size") > 0, F.sequence(first.cast("long"), last.cast("long")))
    return (place.withColumn("block", F.explode_outer(spans))
            .withColumn("lo", F.greatest(F.col("start") - F.col("block") * block, F.lit(0)))
            .withColumn("hi", F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))))


def _sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    t = F.col(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), text_hash(t).alias("th"),
                       F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix_documents(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text", weights=WEIGHTS,
                  max_epochs: int = 3, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    sized = staged(_sized(docs, id_col, source_col, text_col), "mix-sizes")
    sources = staged(source_targets(sized, weights, max_epochs), "mix-sources")
    use = (slots_of(plan_slots(sources, block), seed, block).groupBy("sid", "block")
           .agg(F.sum(F.when(F.col("words") == F.lit(block), 1).otherwise(0)).alias("times"),
                F.collect_list(F.when(F.col("words") != F.lit(block), F.col("words"))).alias("part")))
    part = F.aggregate(F.coalesce("part", F.array().cast("array<bigint>")), F.lit(0).cast("long"),
                       lambda a, p: a + F.greatest(F.least(F.col("hi"), p) - F.col("lo"), F.lit(0)))
    p = pieces(placed(sized, sources), block).join(use, ["sid", "block"], "left")
    took = F.coalesce("times", F.lit(0)) * (F.col("hi") - F.col("lo")) + part
    return (p.groupBy("sid", "bucket", "rn", "doc_id", "size", "source_size", "target")
            .agg(F.sum(F.coalesce(took, F.lit(0))).cast("long").alias("taken"))
            .select("doc_id", "size", "source_size", "target", "taken"))


def mix_blocks(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text", weights=WEIGHTS,
               max_epochs: int = 3, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """The mixed corpus, one row per slot: shard, source, block, slot, n_words,
    doc_ids and text (the words, joined by single blanks)."""
    sized = staged(_sized(docs, id_col, source_col, text_col), "mix-sizes")
    sources = staged(source_targets(sized, weights, max_epochs), "mix-sources")
    slots = slots_of(plan_slots(sources, block), seed, block)
    place = placed(sized, sources).where("size > 0").select(
        F.col("doc_id").alias("p_id"), F.col("th").alias("p_th"), "sid", "bucket", "rn", "start", "size")
    # identical rows share one text
    texts = docs.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("th"),
                        F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    texts = texts.dropDuplicates(["doc_id", "th"])
    d = place.join(texts, F.col("p_id").eqNullSafe(F.col("doc_id")) & (F.col("p_th") == F.col("th")))
    cut = (pieces(d, block).withColumn("from", F.col("block") * block + F.col("lo") - F.col("start"))
           .select("sid", "block", "lo", "doc_id", F.array_join(F.slice(
               F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), (F.col("from") + 1).cast("int"),
               (F.col("hi") - F.col("lo")).cast("int")), " ").alias("piece")))
    blocks = (cut.groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("lo", "doc_id", "piece"))).alias("ps")))
    inside = F.filter("ps", lambda x: x["lo"] < F.col("words"))
    text = F.array_join(F.transform("ps", lambda x: x["piece"]), " ")
    names = sources.select("sid", "source")
    return (slots.join(blocks, ["sid", "block"]).join(names, "sid")
            .select("shard", "source", "block", F.col("j").alias("slot"), F.col("words").alias("n_words"),
                    F.array_distinct(F.transform(inside, lambda x: x["doc_id"])).alias("doc_ids"),
                    F.when(F.col("words") == block, text).otherwise(
                        F.array_join(F.slice(F.split(text, " "), 1, F.col("words").cast("int")), " ")).alias("text")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
