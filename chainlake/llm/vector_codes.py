"""Vector code compression by member-resident Lloyd iterations.

Vectors become integers floor(1024 x) and are cut into ``PARTS`` parts; each
part position has a codebook of at most ``ENTRIES`` entries, which are at first
the parts of the smallest ids.  The parts are rows, dealt to
(position, entry, salt): the salt splits an entry that holds very many.  A
round has two steps.  Owners add up their resident members, which gives the
next codebook (entries x dimensions numbers, whatever the input).  Then every
member is compared with it where it lies: those that keep their entry are
written where they are, and only those that change it go through a shuffle to
their new owner.  A round in which nothing moves ends the iteration, since all
further ones would repeat it.

All sums and distances are exact.  Float64 products are used while every
number stays below 2^52, 64-bit integers below 2^62, Python's integers beyond.

Defined cases: rows whose vector is null or has null or non-finite components
are left out, and so are those whose length differs from that of the first
vector by (id, vector); null ids come last.  Repeated rows are rows of their
own.  Fewer rows than entries give a smaller codebook.  A length that is no
multiple of ``PARTS`` is an error.  Sums above 2^63 - 1 come back as that.
Other columns are ignored.  Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm.common import discard, fresh_path, ship_by_value, staged, table

ship_by_value(__name__)

PARTS, ENTRIES, ROUNDS, UNIT = 4, 256, 4, 1024
SALTS = 64                  # owners of an entry, at least
MEMBERS = 1_000_000         # parts of one owner if all parts had one entry, at most
STEP = 8192                 # parts that are compared at a time
LIMB = 30                   # bits of the pieces that sums are sent in
TOP = 2 ** 63 - 1
PART = "row long, id {id}, label {label}, pos int, vec {vec}"


def as_ints(x: np.ndarray) -> np.ndarray:
    """floor(UNIT * x): int64 where that is exact, Python integers beyond."""
    x = x.astype(np.float64)
    if not x.size or np.abs(x).max() < 2.0 ** 36:
        return np.floor(x * UNIT).astype(np.int64)
    return np.array([int(v) * UNIT if abs(v) >= 2.0 ** 52 else int(np.floor(v * UNIT)) for v in x.ravel()], object).reshape(x.shape)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row, the lowest of equals, and its
    squared distance."""
    if not x.shape[1]:
        return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    top = max(abs(int(a.max())) if side else abs(int(a.min())) for a in (x, book) for side in (0, 1))
    bound = x.shape[1] * (2 * top) ** 2
    kind = np.float64 if bound < 2 ** 52 else np.int64 if bound < 2 ** 62 else object
    x, book = x.astype(kind), book.astype(kind)
    gap = (book * book).sum(axis=1)[None, :] - 2 * (x @ book.T)
    best = np.asarray(gap.argmin(axis=1), np.int64)
    return best, (x * x).sum(axis=1) + gap[np.arange(len(x)), best]


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def _steps(batches: Iterator[pa.RecordBatch]):
    """Each batch in steps, with the rows of each position and their parts."""
    for batch in batches:
        for start in range(0, batch.num_rows, STEP):
            part = batch.slice(start, STEP)
            pos = part.column("pos").to_numpy()
            x = as_ints(_vectors(part.column("vec")))
            yield part, [(int(p), np.flatnonzero(pos == p), x[pos == p]) for p in np.unique(pos)]


def assigner(books: list[np.ndarray], with_error: bool = False):
    """Adds each part's nearest entry, and whether it moved or how far it is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, groups in _steps(batches):
            entry, error = np.zeros(part.num_rows, np.int32), np.zeros(part.num_rows, np.int64)
            for p, at, x in groups:
                entry[at], far = nearest(x, books[p])
                if with_error:
                    error[at] = [min(int(v), TOP) for v in far]
            old = part.column("entry").to_numpy()
            keep = [(n, part.column(n)) for n in part.schema.names if n not in ("entry", *(["vec"] if with_error else []))]
            more = [("error", pa.array(error))] if with_error else [("moved", pa.array(entry != old))]
            yield pa.RecordBatch.from_pydict(dict([*keep, ("entry", pa.array(entry)), *more]))
    return run


def resident_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per (pos, entry) of a task's members: count and sum by component, the
    sums in pieces of ``LIMB`` bits, so that they add up exactly in 64 bits."""
    sums: dict[tuple[int, int], list] = {}
    for part, groups in _steps(batches):
        entry = part.column("entry").to_numpy()
        for p, at, x in groups:
            order = np.argsort(entry[at], kind="stable")
            found, first = np.unique(entry[at][order], return_index=True)
            adds = np.add.reduceat(x[order], first, axis=0) if x.shape[1] else np.zeros((len(found), 0), np.int64)
            for e, n, add in zip(found, np.diff([*first, len(at)]), adds.astype(object), strict=True):
                got = sums.setdefault((p, int(e)), [0, 0])
                got[0] += int(n)
                got[1] = got[1] + add
    rows = []
    for (p, e), (n, add) in sums.items():
        rows.append((p, e, -1, 0, n))
        for j, v in enumerate(add):
            limb, v = 0, int(v)
            while v not in (0, -1):
                rows.append((p, e, j, limb, v & ((1 << LIMB) - 1)))
                limb, v = limb + 1, v >> LIMB
            rows.append((p, e, j, limb, v))
    names = ["pos", "entry", "j", "limb", "v"]
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def updated(members: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks of the members' means; entries without members stay."""
    got = (members.select("pos", "entry", "vec").mapInArrow(resident_sums, "pos int, entry int, j int, limb int, v long")
           .groupBy("pos", "entry", "j", "limb").agg(F.sum("v").alias("v")).collect())
    sums: dict[tuple[int, int, int], int] = {}
    for r in got:  # at most entries x (dimensions + 1) sums, in pieces
        key = (r["pos"], r["entry"], r["j"])
        sums[key] = sums.get(key, 0) + (r["v"] << (LIMB * r["limb"]))
    out = [b.astype(object) for b in books]
    for (p, e, j), v in sums.items():
        if j >= 0:
            out[p][e, j] = v // sums[p, e, -1]
    return [_packed(b) for b in out]


def _packed(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if all(abs(v) < 2 ** 62 for v in book.ravel()) else book


def usable(df: DataFrame, id_col="vec_id", vec_col="embedding", label_col="label") -> DataFrame:
    """id, label, vec of the rows whose vector is whole and finite."""
    vec = F.col(vec_col)
    kind = dict(df.dtypes)[vec_col]
    vec = vec if kind in ("array<float>", "array<double>") else vec.cast("array<double>")
    good = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vec.alias("vec")).where(vec.isNotNull() & good)


def compress(df: DataFrame, id_col="vec_id", vec_col="embedding", label_col="label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes and codebooks.  Codes: row, id, label, codes (array<int> by part
    position) and error (decimal)."""
    spark = df.sparkSession
    rows = usable(df, id_col, vec_col, label_col)
    kinds = dict(rows.dtypes)
    by_id = [F.col("id").asc_nulls_last(), F.col("vec")]
    width = sum(len(r["vec"]) for r in rows.orderBy(*by_id).limit(1).collect())
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    rows, size = rows.where(F.size("vec") == width), width // parts
    seeds = [r["vec"] for r in rows.orderBy(*by_id).limit(entries).collect()]  # at most ``entries`` rows
    seeds = as_ints(np.array(seeds, np.float64).reshape(len(seeds), width))
    books = [_packed(seeds[:, p * size:(p + 1) * size].astype(object)) for p in range(parts)]

    part, resident = PART.format(**kinds), PART.format(**kinds) + ", entry int"
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.struct(p.alias("pos"), F.slice("vec", p * size + 1, size).alias("vec")))
    salts = max(SALTS, -(-rows.count() // MEMBERS))

    def assign(members: DataFrame) -> DataFrame:
        return members.mapInArrow(assigner(books), f"{part}, entry int, moved boolean")

    def to_owners(moving: DataFrame, label: str) -> str:
        path = fresh_path(spark, label)
        dealt = moving.drop("moved").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts))).repartition("pos", "entry", "salt")
        dealt.drop("salt").write.parquet(path)
        return path

    everyone = (rows.withColumn("row", F.monotonically_increasing_id())
                .select("row", "id", "label", F.inline(cut)).withColumn("entry", F.lit(-1)))
    folders = [to_owners(assign(everyone), "vector-members")]  # all parts move to their first owners
    members = spark.read.schema(resident).parquet(folders[0])
    for k in range(rounds):
        books = updated(members, books)
        if k == rounds - 1:
            break
        out = fresh_path(spark, "vector-round")
        assign(members).write.partitionBy("moved").parquet(out)
        here = spark.read.schema(f"{resident}, moved boolean").parquet(out)
        if here.where("moved").isEmpty():
            members, folders = here.drop("moved"), [*folders, out]
            break
        dealt = to_owners(here.where("moved"), "vector-moved")
        for old in folders:
            discard(spark, old)
        folders = [out, dealt]
        members = here.where(~F.col("moved")).drop("moved").unionByName(spark.read.schema(resident).parquet(dealt))
    coded = members.mapInArrow(assigner(books, True), f"row long, id {kinds['id']}, label {kinds['label']}, pos int, entry int, error long")
    codes = staged(coded.groupBy("row").agg(
        F.first("id").alias("id"), F.first("label").alias("label"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "entry"))), lambda s: s["entry"]).alias("codes"),
        F.sum(F.col("error").cast("decimal(38,0)")).alias("error")), "vector-codes")
    for old in folders:
        discard(spark, old)
    return codes, books


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(table(spark, sf_dir, "embeddings"))
    whole = lambda c: F.least(c, F.lit(TOP).cast("decimal(38,0)")).cast("long")
    by_label = codes.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    hexed = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return (codes.join(by_label, F.col("label").eqNullSafe(F.col("__label")))
            .select(F.col("id").alias("vec_id"), hexed.alias("code"), whole(F.col("error")).alias("error"),
                    whole(F.col("label_error")).alias("label_error"), F.lit(digest(books)).alias("codebooks_sha256")))


def _op11_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    near = """a{k} AS MATERIALIZED (SELECT r, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM
  (SELECT x.r, x.p, c.e, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{k} c ON x.p = c.p AND x.j = c.j GROUP BY ALL) GROUP BY ALL),
"""
    mean = """c{n} AS MATERIALIZED (SELECT c.p, c.e, c.j, coalesce(s.x, c.x) AS x FROM c{k} c LEFT JOIN
  (SELECT x.p, a.e, x.j, CAST(floor(sum(x.x)::DOUBLE / count(*)) AS BIGINT) AS x FROM x JOIN a{k} a ON x.r = a.r AND x.p = a.p GROUP BY ALL) s
  ON c.p = s.p AND c.e = s.e AND c.j = s.j),
"""
    body = "".join(near.format(k=k) + mean.format(k=k, n=k + 1) for k in range(rounds)) + near.format(k=rounds)
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, embedding AS v, row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
u AS (SELECT r, unnest(v) AS y, unnest(range(len(v))) AS i, len(v) // {parts} AS w FROM v),
x AS MATERIALIZED (SELECT r, i // w AS p, i % w AS j, CAST(floor(y::DOUBLE * 1024) AS BIGINT) AS x FROM u),
c0 AS MATERIALIZED (SELECT p, r AS e, j, x FROM x WHERE r < {entries}),
{body}f AS (SELECT r, string_agg(lower(lpad(to_hex(e), 2, '0')), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, j)) AS s FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h.s AS codebooks_sha256
FROM v JOIN f USING (r), h
"""


OP11_SQL = _op11_sql()
