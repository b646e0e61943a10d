"""Benchmark decontamination with suffix arrays of the training documents.

Documents stream through ``mapInArrow``; each task cuts its stream into shards
of about ``shard_words`` words and builds a suffix array over the word numbers
of each shard.  Every suffix of the test items is looked up by binary search,
which gives the range of training suffixes that share its first words; the
range is extended to the longest verbatim match.  Suffixes whose first words
begin no test suffix are left out of the array before sorting, since no search
can return them.  Nothing is shuffled: a document lies in one shard, so its
matches are complete where they are found.

The test items are read in blocks of at most ``block_bytes`` of text, by a hash
of the item; each block is one pass over the documents, so the broadcast is
bounded whatever the size of the benchmark.

Words are runs of ASCII letters and digits and non-ASCII characters, with A-Z
lower-cased.  A window is ``window`` consecutive words of an item; an item of
fewer words is one window.  Defined cases: null and empty texts have no words
and match nothing, as items and as documents.  Items without an id mark words
but are not named.  Repeated items count once; repeated rows of documents are
treated alike.  Empty tables give no rows, or no matches.  Only the id and
text columns are read, so others cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm.common import ship_by_value, table, text_hash

ship_by_value(__name__)

_TABLE = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
MATCHES = "doc_id long, th long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>, " \
          "matches array<struct<item_id:string,doc_at:long,item_at:long,words:long>>"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Block:
    """Test items as one sequence of word numbers; 0 stands for any word that
    no item has, and ends every item."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.ids, self.number, seq, self.start, self.need, self.at, owner = [], {}, [], [], [], [], []
        for item_id, text in items:
            ws = words_of(text)
            if not ws:
                continue
            need = min(window, len(ws))
            for p in range(len(ws) - need + 1):  # the suffixes that begin a window
                self.start.append(len(seq) + p)
                self.at.append(p)
                owner.append(len(self.ids))
                self.need.append(need)
            seq += [self.number.setdefault(w, len(self.number) + 1) for w in ws] + [0]
            self.ids.append(item_id)
        self.seq = np.array(seq or [0], dtype=np.int64)
        self.start, self.at, self.need, self.owner = (np.array(x, dtype=np.int64) for x in (self.start, self.at, self.need, owner))
        self.least = int(self.need.min()) if len(self.need) else 1

    def lengths(self) -> list[int]:
        return sorted(set(self.need.tolist()))


def sorted_suffixes(seq: np.ndarray, pick: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``pick``, sorted by their first ``depth`` words: columns
    of word numbers, last one first, as a stable radix sort."""
    order = pick
    padded = np.concatenate([seq, np.zeros(depth, dtype=seq.dtype)])
    for d in range(depth - 1, -1, -1):
        order = order[np.argsort(padded[order + d], kind="stable")]
    return order


def find(seq: np.ndarray, order: np.ndarray, tests: np.ndarray, start: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each test suffix the range of ``order`` with the same first
    ``depth`` words: two binary searches for all suffixes at once, narrowing
    the range word by word."""
    padded = np.concatenate([seq, np.zeros(depth + 1, dtype=seq.dtype)])
    lo = np.zeros(len(start), dtype=np.int64)
    hi = np.full(len(start), len(order), dtype=np.int64)
    for d in range(depth):
        want = tests[np.minimum(start + d, len(tests) - 1)]
        column = padded[order + d]
        lo, hi = bound(column, want, lo, hi, False), bound(column, want, lo, hi, True)
    return lo, hi


def bound(column: np.ndarray, want: np.ndarray, lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        v = column[np.minimum(mid, len(column) - 1)]
        up = open_ & ((v <= want) if right else (v < want))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(open_ & ~up, mid, hi)
    return lo


def shard_matches(seq: np.ndarray, block: Block, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(training position, number of the test suffix) of each occurrence of a
    window of ``length`` words."""
    mine = np.flatnonzero(block.need == length)
    none = np.zeros(0, dtype=np.int64)
    if not len(mine) or not len(seq):
        return none, none
    start = block.start[mine]
    base = len(block.number) + 1
    code, test = seq, block.seq
    for step in range(1, min(length, 3)):  # leave out what no test suffix begins with
        if base ** (step + 1) < 2 ** 62:
            code, test = code * base + shifted(seq, step), test * base + shifted(block.seq, step)
    begins = np.unique(test[start])
    spot = np.searchsorted(begins, code)
    pick = np.flatnonzero((begins[np.minimum(spot, len(begins) - 1)] == code) & (seq > 0))
    if not len(pick):
        return none, none
    order = sorted_suffixes(seq, pick, length)
    lo, hi = find(seq, order, block.seq, start, length)
    n = hi - lo
    which = np.repeat(mine, n)
    inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return order[np.repeat(lo, n) + inside], which


def shifted(a: np.ndarray, step: int) -> np.ndarray:
    out = np.zeros_like(a)
    out[: len(a) - step] = a[step:]
    return out


def longest(seq: np.ndarray, pos: np.ndarray, block: Block, test: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Maximal matches: occurrences that do not go on to the left, with their
    number of words to the right."""
    left_t = np.where(block.at[test] > 0, block.seq[np.maximum(block.start[test] - 1, 0)], 0)
    left_d = np.where(pos > 0, seq[np.maximum(pos - 1, 0)], 0)
    own = (left_t == 0) | (left_d != left_t)
    pos, test = pos[own], test[own]
    n = np.full(len(pos), length, dtype=np.int64)
    live = np.arange(len(pos))
    while len(live):
        p, t = pos[live] + n[live], block.start[test[live]] + n[live]
        a = np.where(p < len(seq), seq[np.minimum(p, len(seq) - 1)], 0)
        live = live[(a > 0) & (a == block.seq[np.minimum(t, len(block.seq) - 1)])]
        n[live] += 1
    return pos, test, n


def search_shard(docs: list[list[bytes]], block: Block) -> list[tuple[list, list, list]]:
    """Per document: hit spans (word ranges, merged), item numbers, and
    maximal matches (item number, position, position in the item, words)."""
    get = block.number.get
    parts, starts, at = [], [], 0
    for ws in docs:
        starts.append(at)
        parts += [get(w, 0) for w in ws]
        parts.append(0)  # no match goes on into the next document
        at += len(ws) + 1
    seq = np.array(parts or [0], dtype=np.int64)
    starts = np.array(starts, dtype=np.int64)
    found: list[tuple[list, list, list]] = [([], [], []) for _ in docs]
    if not block.ids:
        return found
    hit = np.zeros(len(seq) + 1, dtype=np.int64)
    for length in block.lengths():
        pos, test = shard_matches(seq, block, length)
        if not len(pos):
            continue
        np.add.at(hit, pos, 1)
        np.add.at(hit, pos + length, -1)
        doc = np.searchsorted(starts, pos, side="right") - 1
        pairs = np.unique(doc * len(block.ids) + block.owner[test])
        for d, i in zip(pairs // len(block.ids), pairs % len(block.ids)):
            found[d][1].append(int(i))
        p, t, n = longest(seq, pos, block, test, length)
        d = np.searchsorted(starts, p, side="right") - 1
        for row in zip(d.tolist(), block.owner[t].tolist(), (p - starts[d]).tolist(), block.at[t].tolist(), n.tolist()):
            found[row[0]][2].append(row[1:])
    on = np.concatenate([[0], (np.cumsum(hit)[:-1] > 0).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(on))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        d = int(np.searchsorted(starts, a, side="right") - 1)
        found[d][0].append((a - int(starts[d]), b - int(starts[d])))
    return found


def search_pass(docs: DataFrame, items: list[tuple[str | None, str | None]], window: int, shard_words: int) -> DataFrame:
    """One pass over (doc_id, th, text) for one block of items."""
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        block = Block(sent.value, window)
        schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_words", pa.int64()),
                            ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                            ("items", pa.list_(pa.string())),
                            ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("doc_at", pa.int64()),
                                                            ("item_at", pa.int64()), ("words", pa.int64())])))])

        def flush(rows, texts):
            got = search_shard(texts, block)
            return pa.RecordBatch.from_pylist([
                {"doc_id": r[0], "th": r[1], "n_words": len(ws),
                 "spans": [{"start": a, "stop": b} for a, b in sp],
                 "items": sorted({block.ids[i] for i in it if block.ids[i] is not None}),
                 "matches": [{"item_id": block.ids[i], "doc_at": p, "item_at": q, "words": n} for i, p, q, n in ms]}
                for r, ws, (sp, it, ms) in zip(rows, texts, got)], schema=schema)
        rows, texts, n = [], [], 0
        for batch in batches:
            for doc_id, th, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text"))):
                ws = words_of(text)
                rows.append((doc_id, th))
                texts.append(ws)
                n += len(ws) + 1
                if n >= shard_words:
                    yield flush(rows, texts)
                    rows, texts, n = [], [], 0
        if rows:
            yield flush(rows, texts)

    return docs.mapInArrow(run, MATCHES)


def find_matches(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id",
                 item_text_col="text", window: int = 10, shard_words: int = 500_000,
                 block_bytes: int = 8_000_000) -> DataFrame:
    """One row per document and block of items, as MATCHES."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    b = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(item_text_col).alias("t")).where("t IS NOT NULL").distinct()
    total = b.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes))  # twice as many as would fit evenly
    out = None
    for k in range(blocks):
        part = b.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else b
        got = search_pass(d, [(r["i"], r["t"]) for r in part.collect()], window, shard_words)
        out = got if out is None else out.unionByName(got)
    if blocks > 1:  # each block saw every document once, repeated rows too
        out = (out.groupBy("doc_id", "th", "n_words")
               .agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
                    F.array_distinct(F.flatten(F.collect_list("matches"))).alias("matches"), F.count(F.lit(1)).alias("c"))
               .withColumn("c", F.explode(F.sequence(F.lit(1), (F.col("c") / blocks).cast("int")))).drop("c"))
    return out


def n_covered(spans: Column) -> Column:
    """Words in the union of the spans."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(F.array_sort(spans), start, lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["stop"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"),
        F.greatest(acc["end"], s["stop"]).alias("end")), lambda acc: acc["n"])


def report(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """One row per document: doc_id, th, n_words, n_hit, n_items,
    items_sha256, contaminated, matches."""
    m = find_matches(docs, benchmark, **kw)
    n_hit = n_covered(F.col("spans"))
    return m.select("doc_id", "th", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                    F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
                    (n_hit > 0).alias("contaminated"), "matches")


def remove(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **kw) -> DataFrame:
    """The documents without a hit word, all columns kept."""
    bad = (report(docs, benchmark, id_col=id_col, text_col=text_col, **kw).where("contaminated")
           .select(F.col("doc_id").alias("__bad_id"), F.col("th").alias("__bad_th")).distinct())
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__bad_id")) & (text_hash(F.col(text_col)) == F.col("__bad_th")), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return report(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bn AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS g
       FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS p FROM bn)),
ns AS (SELECT DISTINCT n FROM bw),
dg AS (SELECT doc_id, n, p, array_to_string(list_slice(ws, p, p + n - 1), ' ') AS g
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM w, ns WHERE len(ws) >= n)),
hit AS (SELECT dg.doc_id, dg.p, dg.n, bw.item_id FROM dg JOIN bw USING (n, g)),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT w.doc_id, coalesce(len(w.ws), 0) AS n_words, coalesce(cov.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
       sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(cov.n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN it USING (doc_id)
"""
