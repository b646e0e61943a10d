"""N-gram Jaccard join: MinHash LSH forest, then exact verification.

1. Each text gets ``trees`` labels in one scan: sequences of ``depth`` MinHash
   values, the paths of the forest's prefix tries.  Documents of one text are
   one unit; the units are written with a running number, their count and
   their smallest id.  Exact copies never meet each other again.
2. The labels of each tree are sorted (range-partitioned, with the unit as the
   last key, so that a label held by very many units is spread as well).  The
   length of the prefix that neighbours share is the whole trie: units below a
   node are a stretch of neighbours that share at least its depth.
3. Matching starts with whole labels and shortens the prefix until a pair at
   the threshold is found by some tree with at least the target recall
   (``stop_depth``); the ties of all prefixes down to there are joined at once.
4. The joined units hold every candidate pair.  Components are
   cut into blocks of ``block`` units, and each pair of blocks is verified
   exactly in one task: shingle sets as rows of a sparse matrix, intersections
   by products over slices of the shared shingles.  A task returns the number
   of links per unit and ties that span its links, never the pairs.
5. Components of the verified ties are the classes.

Result: per document its class id (the smallest id in the class) and its
number of links: documents with Jaccard >= ``threshold``, copies included.

Defined cases: a text of fewer words than a shingle is one shingle; null, empty
and blank texts have none, link to nothing and are a class each (class_id is
their own id).  Documents without an id are linked and counted, and their class
id is null unless a member has one.  Repeated rows are copies of each other.
Empty tables give no rows.  Working columns carry a ``__`` prefix or live in
tables of their own; all other columns pass through in ``keep_one``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm.common import WORD, ship_by_value, staged, table

ship_by_value(__name__)

WIDTH, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL, BLOCK = 32, 10, 0.995, 96
_P = np.uint64(0x9E3779B97F4A7C15)


def unit_key(text: Column) -> Column:
    """128-bit hash of the text; null without words."""
    return F.when(text.rlike(WORD), F.unhex(F.md5(text)))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    of = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter((of[w] for w in words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(min(width, len(h))):
        out = (out ^ h[k:k + n]) * _P
        out ^= out >> np.uint64(31)
    return np.unique(out)


def signature(sh: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> np.ndarray:
    """16 bits of each of trees x depth MinHash values."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 2 ** 32, trees * depth, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 2 ** 32, trees * depth, dtype=np.uint32)
    h = (sh >> np.uint64(32)).astype(np.uint32)
    low = np.full(trees * depth, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(h), 512):
        low = np.minimum(low, (h[i:i + 512, None] * a + b).min(axis=0))
    low *= np.uint32(0x85EBCA6B)
    return ((low >> np.uint32(16)) ^ (low & np.uint32(0xFFFF))).astype(">u2").reshape(trees, depth)


def stop_depth(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """Shorten the prefix until a pair at the threshold shares one in some
    tree with the wanted probability."""
    d = depth
    while d > 1 and 1 - (1 - threshold ** d) ** trees < recall:
        d -= 1
    return d


def units_of(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(uid, u, labels, n, first_id), written; one row per different text.
    ``labels``: one per tree, two bytes a value."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), unit_key(F.col(text_col)).alias("u"), F.col(text_col).alias("text"))

    def run(batches):
        for b in batches:
            labels = [[row.tobytes() for row in signature(shingles(t, width))] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("u"), pa.array(labels, pa.list_(pa.binary()))],
                                             names=["id", "u", "labels"])
    units = (d.where("u IS NOT NULL").mapInArrow(run, "id long, u binary, labels array<binary>").groupBy("u")
             .agg(F.first("labels").alias("labels"), F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id")))
    return staged(units.select(F.monotonically_increasing_id().alias("uid"), "*"), "jaccard-units")


def shared_prefix(labels: np.ndarray, trees: np.ndarray) -> np.ndarray:
    """Values that each row shares with the row before, from the start; 0 for
    the first row and across trees."""
    same = (labels[1:] == labels[:-1]) & (trees[1:] == trees[:-1])[:, None]
    return np.concatenate([[0], np.cumprod(same, axis=1).sum(axis=1)])


def neighbours(units: DataFrame, least: int, depth: int = DEPTH) -> DataFrame:
    """(a, b, shared): ties that span the nodes of the sorted trees, ``least``
    values deep or more: a unit and the first of the stretch of neighbours that
    share as many values; the longest prefix where two meet often."""
    spark = units.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (units.select("uid", F.posexplode("labels").alias("tree", "label"))
            .repartitionByRange(tasks, "tree", "label", "uid").sortWithinPartitions("tree", "label", "uid"))

    def run(batches):
        """Ties inside the range, then its first and last row."""
        part, first, last = TaskContext.get().partitionId(), None, None
        for b in batches:
            if not b.num_rows:
                continue
            uid, tree = b.column("uid").to_numpy(), b.column("tree").to_numpy()
            label = np.frombuffer(b"".join(b.column("label").to_pylist()), ">u2").reshape(-1, depth)
            if last is not None:
                uid, tree, label = np.append(last[0], uid), np.append(last[1], tree), np.vstack([last[2], label])
            first = (uid[0], tree[0], label[0]) if first is None else first
            last = (uid[-1], tree[-1], label[-1])
            yield node_ties(uid, shared_prefix(label, tree), least, depth)
        if first is not None:
            yield pa.RecordBatch.from_pylist([
                {"end": part * 2 + k, "uid": int(u), "tree": int(t), "label": x.astype(">u2").tobytes()} for k, (u, t, x) in enumerate((first, last))],
                schema=_TIES)
    found = staged(rows.mapInArrow(run, "a long, b long, shared int, end long, uid long, tree int, label binary"), "jaccard-sorted")
    # Ranges meet at their ends: two rows a task.
    ends = sorted(found.where("end IS NOT NULL").select("end", "uid", "tree", "label").collect())
    across = []
    for (_, u, t, x), (_, v, w, y) in zip(ends[1::2], ends[2::2]):
        n = int(shared_prefix(np.stack([np.frombuffer(bytes(z), ">u2") for z in (x, y)]), np.array([t, w]))[1])
        if n >= least:
            across.append((min(u, v), max(u, v), n))
    ties = found.where("end IS NULL").select("a", "b", "shared").unionByName(spark.createDataFrame(across, "a long, b long, shared int"))
    return staged(ties.groupBy("a", "b").agg(F.max("shared").alias("shared")), "jaccard-neighbours")


_TIES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int32()), ("end", pa.int64()), ("uid", pa.int64()),
                   ("tree", pa.int32()), ("label", pa.binary())])


def node_ties(uid: np.ndarray, shared: np.ndarray, least: int, depth: int) -> pa.RecordBatch:
    """Ties each row that shares ``shared`` values with the row before to the
    first row of the stretch that shares as many: a node is a star, not a
    chain, and takes few rounds to become one component."""
    row, head, member, found = np.arange(len(uid)), [], [], []
    for d in range(least, depth + 1):
        first = np.maximum.accumulate(np.where(shared < d, row, 0))
        at = np.flatnonzero(shared == d)
        head, member, found = [*head, uid[first[at]]], [*member, uid[at]], [*found, np.full(len(at), d)]
    a, b = np.concatenate(head), np.concatenate(member)
    none = [pa.nulls(len(a), f.type) for f in list(_TIES)[3:]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64()),
                                       pa.array(np.concatenate(found), pa.int32()), *none], schema=_TIES)


def candidates(units: DataFrame, stop: int, depth: int = DEPTH) -> DataFrame:
    """(v, c): the units that the forest brings together by prefixes of
    ``stop`` values or more, c the smallest of each."""
    return staged(components(neighbours(units, stop, depth)), "jaccard-candidates")


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex of v's component.  Alternates two steps
    until nothing changes: each vertex ties its larger neighbours, then its
    smaller ones, to the smallest vertex it knows.  Both are an aggregation
    joined back to the edges; every round is written."""
    now, last = staged(edges.select("a", "b").distinct(), "jaccard-edges"), None
    while True:
        sums = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30))).alias("s")).first()
        if sums == last or not sums["n"]:
            break
        last = sums
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = staged(both.groupBy("a").agg(F.min("b").alias("m"))
                     .select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "jaccard-low")
        large = (now.join(low, F.col("a") == F.col("u")).select(F.col("m").alias("a"), "b")
                 .unionByName(low.where("m < u").select(F.col("m").alias("a"), F.col("u").alias("b"))).distinct())
        large = staged(large, "jaccard-large")
        least = staged(large.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m"), "jaccard-least")
        small = (large.join(least, F.col("b") == F.col("u")).where("a > m").select(F.col("m").alias("x"), F.col("a").alias("y"))
                 .unionByName(least.select(F.col("m").alias("x"), F.col("u").alias("y"))).distinct())
        now = staged(small.select(F.col("x").alias("a"), F.col("y").alias("b")), "jaccard-edges")
    return now.select(F.col("b").alias("v"), F.col("a").alias("c")).unionByName(
        now.select(F.col("a").alias("v"), F.col("a").alias("c")).distinct())


def links_between(sets: list[np.ndarray], threshold: float, slice_: int = 65_536) -> np.ndarray:
    """Square matrix: Jaccard >= threshold."""
    k = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.float64)
    values, owner = np.concatenate(sets), np.repeat(np.arange(k), [len(s) for s in sets])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], column[shared]
    both = np.zeros((k, k))
    if len(column):
        _, column = np.unique(column, return_inverse=True)
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for lo in range(0, int(column[-1]) + 1, slice_):
            part = slice(*np.searchsorted(column, [lo, lo + slice_]))
            m = np.zeros((k, min(slice_, int(column[-1]) + 1 - lo)), dtype=np.float32)
            m[owner[part], column[part] - lo] = 1
            both += m @ m.T
    union = size[:, None] + size[None, :] - both
    return (both >= threshold * union - 1e-9) & ~np.eye(k, dtype=bool)


def spanning(link: np.ndarray) -> list[tuple[int, int]]:
    """Ties that span the connected parts of a link matrix."""
    left, out = set(range(len(link))), []
    while left:
        root = left.pop()
        stack = [root]
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(link[i]):
                if int(j) in left:
                    left.discard(int(j))
                    out.append((i, int(j)))
                    stack.append(int(j))
    return out


def verify(docs: DataFrame, units: DataFrame, comp: DataFrame, threshold: float, width: int, block: int,
           id_col: str, text_col: str) -> DataFrame:
    """(uid, other, links): links counted by a task for uid (other null), or
    a verified tie (links 0)."""
    sizes = comp.groupBy("c").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("c", "sc")
    m = (comp.join(sizes, F.col("c") == F.col("sc")).withColumn("nb", F.ceil(F.col("size") / block))
         .withColumn("mine", F.pmod(F.xxhash64("v"), F.col("nb"))).select("v", "c", "nb", "mine")
         .join(units.select("uid", "u", "n", "first_id"), F.col("v") == F.col("uid")).drop("v"))
    # the text of the row with the smallest id; repeated rows count once
    d = docs.select(F.col(id_col).cast("long").alias("id"), unit_key(F.col(text_col)).alias("du"), F.col(text_col).alias("text"))
    m = (d.where("du IS NOT NULL").join(m.hint("merge"), (F.col("du") == F.col("u")) & F.col("id").eqNullSafe(F.col("first_id")))
         .groupBy("uid", "n", "c", "nb", "mine").agg(F.first("text").alias("text")))
    spread = m.select("uid", "text", "n", "c", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("other"))
    rows = spread.select("uid", "text", "n", "mine", "c", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t, width) for t in pdf["text"]]
        link = links_between(sets, threshold)
        mine = pdf["mine"].to_numpy()
        if pdf["x"].iloc[0] != pdf["y"].iloc[0]:  # pairs inside a block are counted where it meets itself
            link &= mine[:, None] != mine[None, :]
        uid = pdf["uid"].to_numpy()
        n = link @ pdf["n"].to_numpy()
        tie = spanning(link)
        on = np.flatnonzero(n)
        return pd.DataFrame({"uid": np.concatenate([uid[on], [uid[i] for i, _ in tie]]).astype("int64"),
                             "other": pd.array([None] * len(on) + [int(uid[j]) for _, j in tie], dtype="Int64"),
                             "links": np.concatenate([n[on], np.zeros(len(tie))]).astype("int64")})
    return rows.groupBy("c", "x", "y").applyInPandas(check, "uid long, other long, links long")


def classes(docs: DataFrame, id_col="doc_id", text_col="text", threshold: float = THRESHOLD, width: int = WIDTH,
            recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(u, n, c, class_id, links): one row per different text with words.  c
    tells the classes apart; class_id may be null or repeated, as ids are."""
    units = units_of(docs, width, id_col, text_col)
    comp = candidates(units, stop_depth(threshold, recall))
    found = staged(verify(docs, units, comp, threshold, width, block, id_col, text_col), "jaccard-links")
    counted = found.where("other IS NULL").groupBy(F.col("uid").alias("lu")).agg(F.sum("links").alias("links"))
    linked = found.where("other IS NOT NULL").select(F.least("uid", "other").alias("a"), F.greatest("uid", "other").alias("b"))
    cls = components(linked).withColumnRenamed("v", "cu")
    small = units.select("uid", "u", "n", "first_id")
    per = (small.join(counted, F.col("uid") == F.col("lu"), "left").join(cls, F.col("uid") == F.col("cu"), "left")
           .select("u", "n", "first_id", F.coalesce("c", "uid").alias("c"), F.coalesce("links", F.lit(0)).alias("links")))
    per = staged(per, "jaccard-per-text")
    ids = per.groupBy("c").agg(F.min("first_id").alias("class_id"))
    return per.join(ids, "c").select("u", "n", "c", "class_id", "links")


def join(docs: DataFrame, id_col="doc_id", text_col="text", **kw) -> DataFrame:
    """One row per document: doc_id, class_id, n_links."""
    c = classes(docs, id_col, text_col, **kw).withColumnRenamed("u", "cu")
    d = docs.select(F.col(id_col).alias("doc_id"), unit_key(F.col(text_col)).alias("u"))
    return (d.join(c, F.col("u") == F.col("cu"), "left")
            .select("doc_id", F.when(F.col("u").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce(F.col("links") + F.col("n") - 1, F.lit(0)).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, id_col="doc_id", text_col="text", **kw) -> DataFrame:
    """The documents of one per class: the one with the class's smallest id, of
    those the smallest text hash (one of them where rows repeat both); texts
    without words all stay."""
    c = classes(docs, id_col, text_col, **kw).select(F.col("u").alias("__cu"), F.col("c").alias("__c"), F.col("class_id").alias("__class"))
    d = docs.withColumn("__u", unit_key(F.col(text_col)))
    bare = d.where("__u IS NULL").drop("__u")
    best = d.where("__u IS NOT NULL").join(c, F.col("__u") == F.col("__cu")).where(F.col(id_col).eqNullSafe(F.col("__class")))
    whole = F.struct(*[F.col(f"`{x}`") for x in docs.columns])
    one = best.groupBy("__c").agg(F.min_by(whole, "__u").alias("__row")).select("__row.*")
    return one.unionByName(bare)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, p, p + 4), ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS p FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * k >= 4 * (na.n + nb.n - k)),
r AS (SELECT DISTINCT a AS v, a AS t FROM l UNION SELECT r.v, l.b FROM r JOIN l ON r.t = l.a),
k AS (SELECT v, min(t) AS class_id FROM r GROUP BY v),
m AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(m.n_links, 0) AS n_links
FROM documents d LEFT JOIN k ON k.v = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""
