"""LM scoring with a probabilistic suffix tree over bytes.

Learning, one pass over the training documents: every task counts its words
and its (depth + 1)-grams of bytes and combines them before the shuffle; the
summed counts are written to the shared folder.  Every context of up to
``depth`` bytes is a candidate and becomes a state if its next-byte
distribution diverges from that of its longest suffix state (Kullback-Leibler,
per position and times its count).  Distributions are smoothed by
interpolation with the suffix state (Witten-Bell), down to a root that gives
every byte a share.  Frequent contexts, followed by at least a share ``p_min``
of all positions (at most 1 / p_min per depth), grow on the driver; all others
become states of a table, level by level in joins, which grows with the input.

Scoring, one pass over all documents: each byte is predicted from its longest
suffix state.  The frequent states are broadcast; positions behind a rare one
(marked in a bitmap, where a false mark costs a row) meet the table of rare
states in a shuffle join, unless their gram is frequent (a share ``f_min``) and
its gain broadcast.  ``p_min`` and ``f_min`` move work, not scores.  A text is its
words joined by blanks, then an end symbol, so ``score`` is a proper log10
probability of the token sequence.

The base score needs the count of every word.  Words with at least a share
``f_min`` of all training tokens (at most 1 / f_min words) are broadcast; the
rest, rare and unknown words, meet their counts in a shuffle join.

Defined cases: null and empty texts have the end token alone; rows without an
id belong to the training rows; repeated rows count and are scored each; with
no training rows all counts are 0.  Empty tables give no rows.  Only the id
and text columns are read, so others cannot clash.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainlake.llm.common import ship_by_value, staged, table

ship_by_value(__name__)

DEPTH, END = 5, 255
CHUNK_BYTES, FLUSH, WORD_FLUSH = 1_000_000, 1_000_000, 400_000
WORD_KIND, GRAM_KIND = 0, 1
MIN_KL, MIN_GAIN = 0.002, 16.0
SLOT_BITS = 26


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def symbols(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with DEPTH end symbols before each text and one after it, whether
    a byte is predicted, first byte per text)."""
    pad, end = bytes([END]) * DEPTH, bytes([END])
    texts = [pad + b" ".join(ws) + end for ws in docs]
    n = np.array([len(t) for t in texts], dtype=np.int64)
    seq = np.frombuffer(b"".join(texts), dtype=np.uint8)
    start = np.cumsum(n) - n
    predict = np.ones(len(seq), dtype=bool)
    for k in range(DEPTH):
        predict[start + k] = False
    return seq, predict, start


def codes(seq: np.ndarray, first: int, last: int, kind) -> np.ndarray:
    """For each byte from number DEPTH on, the code of the bytes from ``first``
    before it to ``last`` before it (0: itself), the last one lowest."""
    out = np.zeros(len(seq) - DEPTH, dtype=kind)
    for k in range(first, last - 1, -1):
        out = (out << kind(8)) | seq[DEPTH - k:len(seq) - k].astype(kind)
    return out


def chunks(batches, size: int = CHUNK_BYTES):
    """Lists of (row, words) of about ``size`` bytes of text."""
    got, n = [], 0
    for b in batches:
        others = [c.to_pylist() for c in b.columns[:-1]]
        for i, text in enumerate(b.columns[-1].to_pylist()):
            got.append(([c[i] for c in others], words_of(text)))
            n += len(text or "") + 8
            if n >= size:
                yield got
                got, n = [], 0
    if got:
        yield got


def count_rows(batches):
    """(kind, key, n) of words and byte grams, combined as far as memory goes."""
    words: Counter = Counter()
    keys, ns, held = [], [], 0

    def out(kind, key, n):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, dtype=np.int32)), pa.array(key), pa.array(n)],
                                          names=["kind", "key", "n"])

    def grams():
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(back, weights=np.concatenate(ns), minlength=len(key)).astype(np.int64)

    def word_rows():
        return out(WORD_KIND, np.fromiter(map(word_key, words), dtype=np.int64, count=len(words)),
                   np.fromiter(words.values(), dtype=np.int64, count=len(words)))
    for chunk in chunks(batches):
        for _, ws in chunk:
            words.update(ws)
        seq, predict, _ = symbols([ws for _, ws in chunk])
        key, n = np.unique(codes(seq, DEPTH, 0, np.uint64)[predict[DEPTH:]], return_counts=True)
        keys.append(key.astype(np.int64))
        ns.append(n)
        held += len(key)
        if held > FLUSH:
            key, n = grams()
            keys, ns, held = [key], [n], len(key)
            if held > FLUSH // 2:
                yield out(GRAM_KIND, key, n)
                keys, ns, held = [], [], 0
        if len(words) > WORD_FLUSH:
            yield word_rows()
            words.clear()
    if words:
        yield word_rows()
    if keys:
        yield out(GRAM_KIND, *grams())


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


def grow_tree(depths: np.ndarray, keys: np.ndarray, ns: np.ndarray, root: np.ndarray, min_kl: float = MIN_KL,
              min_gain: float = MIN_GAIN) -> dict:
    """States from the candidate counts; row i of ``logp`` is the log10
    distribution of state i, state 0 is the root."""
    p0 = (root + 0.5) / (root.sum() + 128)
    states: list[dict[int, int]] = [{0: 0}]
    probs = [p0]
    for d in range(1, DEPTH + 1):
        mine = depths == d
        ctx, sym, n = keys[mine] >> 8, keys[mine] & 255, ns[mine]
        order = np.argsort(ctx, kind="stable")
        ctx, sym, n = ctx[order], sym[order], n[order]
        cuts = np.flatnonzero(np.diff(ctx)) + 1
        level: dict[int, int] = {}
        for c, s, m in zip(ctx[np.concatenate([[0], cuts])] if len(ctx) else [], np.split(sym, cuts), np.split(n, cuts)):
            parent = next(states[k][int(c) & ((1 << 8 * k) - 1)] for k in range(d - 1, -1, -1)
                          if int(c) & ((1 << 8 * k) - 1) in states[k])
            below, total = probs[parent], m.sum()
            kl = float((m / total * np.log(m / total / below[s])).sum())
            if kl >= min_kl and kl * total >= min_gain:
                p = below * len(s)
                p[s] += m
                level[int(c)] = len(probs)
                probs.append(p / (total + len(s)))
        states.append(level)
    # bytes never seen have the same share in every state: one column for all
    column = np.zeros(256, dtype=np.uint8)
    column[root > 0] = np.arange(1, (root > 0).sum() + 1)
    some = [int(np.flatnonzero(root == 0)[0]), *np.flatnonzero(root > 0)]
    return {"states": states, "column": column, "logp": np.log10(np.array(probs)[:, some]).astype(np.float32)}


def learn(docs: DataFrame, p_min: float = 1e-5, f_min: float = 2.5e-7) -> tuple[dict, DataFrame]:
    """(model, word counts (key, n)) from (text,) rows."""
    return learn_all(docs, p_min, f_min)[:2]


def learn_all(docs: DataFrame, p_min: float, f_min: float) -> tuple[dict, DataFrame, DataFrame, DataFrame]:
    """(model, word counts (key, n), grams behind rare contexts (d, key, ctx, n),
    frequent grams (key))."""
    counts = staged(docs.select("text").mapInArrow(count_rows, "kind int, key long, n long")
                    .groupBy("kind", "key").agg(F.sum("n").alias("n")), "lm-counts")
    words = counts.where(F.col("kind") == WORD_KIND).select("key", "n")
    size = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    grams = counts.where(F.col("kind") == GRAM_KIND)
    ends = grams.where(F.col("key").bitwiseAND(F.lit(255)) == END).agg(F.sum("n")).first()[0] or 0
    total, kinds = (size["n"] or 0) + ends, size["v"] + (ends > 0)
    common = words.where(F.col("n") >= f_min * total).toArrow()
    key, n = common["key"].to_numpy(), common["n"].to_numpy()
    order = np.argsort(key)
    levels = grams.select(F.explode(F.array(*[F.lit(d) for d in range(DEPTH + 1)])).alias("d"), "key", "n").withColumn(
        "key", F.when(F.col("d") < DEPTH, F.expr("key & (shiftleft(1L, 8 * (d + 1)) - 1)")).otherwise(F.col("key")))
    levels = staged(levels.groupBy("d", "key").agg(F.sum("n").alias("n")), "lm-levels")
    root = levels.where("d = 0").toArrow()
    positions = sum(root["n"].to_pylist())
    seen = levels.where("d > 0").withColumn("ctx", F.expr("shiftright(key, 8)"))
    wide = seen.groupBy("d", "ctx").agg(F.sum("n").alias("t")).where(F.col("t") >= p_min * positions)
    wide = staged(wide.select("d", "ctx"), "lm-frequent")
    got = seen.join(wide, ["d", "ctx"]).select("d", "key", "n").toArrow()  # at most 256 DEPTH / p_min rows
    base = np.zeros(256)
    base[root["key"].to_numpy()] = root["n"].to_numpy()
    tree = grow_tree(*(got[c].to_numpy() for c in ("d", "key", "n")), base)
    return tree | {"keys": key[order], "counts": n[order], "tokens": total, "kinds": kinds, "ends": ends}, words, \
        seen.join(wide, ["d", "ctx"], "left_anti"), \
        levels.where((F.col("d") == DEPTH) & (F.col("n") >= f_min * positions)).select("key")


def slots(d, ctx: np.ndarray) -> np.ndarray:
    """Place of contexts of d bytes in the bitmap of rare states."""
    return ((ctx.astype(np.uint64) | np.uint64(d) << np.uint64(56)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)


def tree_probs(model: dict, depth: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Probability of the last byte of each gram behind the longest frequent
    state within the ``depth`` bytes before it."""
    state, before = np.zeros(len(key), dtype=np.int64), key >> 8
    for d in range(1, DEPTH + 1):
        level = model["states"][d]
        if level and len(key):
            of = np.array(sorted(level.items()), dtype=np.int64)
            ctx = before & ((1 << 8 * d) - 1)
            spot = np.minimum(np.searchsorted(of[:, 0], ctx), len(of) - 1)
            hit = (depth >= d) & (of[spot, 0] == ctx)
            state[hit] = of[spot[hit], 1]
    return 10.0 ** model["logp"][state, model["column"][key & 255]].astype(np.float64)


def rare_states(rare: DataFrame, sent) -> DataFrame:
    """(d, ctx, escape, probs): the states among the rare contexts, ``probs``
    of the bytes seen behind them; all others share the suffix state's
    distribution times ``escape``."""
    def based(batches):
        for b in batches:
            d, key = b.column("d").to_numpy(), b.column("key").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree_probs(sent.value, d, key))], names=["d", "key", "ctx", "n", "base"])
    rows = staged(rare.select("d", "key", "ctx", "n").mapInArrow(based, "d int, key long, ctx long, n long, base double"), "lm-rare")
    one, found, below = Window.partitionBy("ctx"), [], None
    for d in range(1, DEPTH + 1):
        at = rows.where(F.col("d") == d)
        if below is not None:
            at = at.join(below, F.col("key").bitwiseAND(F.lit((1 << 8 * d) - 1)) == F.col("bk"), "left")
        p = F.col("base") if below is None else F.coalesce("bq", "base")
        at = (at.select("d", "key", "ctx", "n", p.alias("p"), F.sum("n").over(one).alias("t"), F.count(F.lit(1)).over(one).alias("k"))
              .withColumn("kl", F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t") / F.col("p"))).over(one))
              .withColumn("state", (F.col("kl") >= MIN_KL) & (F.col("kl") * F.col("t") >= MIN_GAIN)))
        at = staged(at.select("d", "key", "ctx", "state", (F.col("k") / (F.col("t") + F.col("k"))).alias("escape"),
                              F.when(F.col("state"), (F.col("p") * F.col("k") + F.col("n")) / (F.col("t") + F.col("k")))
                              .otherwise(F.col("p")).alias("q")), "lm-rare-level")
        below = at.select(F.col("key").alias("bk"), F.col("q").alias("bq"))
        found.append(at.where("state"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return staged(every.groupBy("d", "ctx").agg(F.first("escape").alias("escape"), F.map_from_entries(
        F.collect_list(F.struct(F.col("key").bitwiseAND(F.lit(255)).alias("s"), "q"))).alias("probs")), "lm-rare-states")


def bits(at: np.ndarray, size: int) -> np.ndarray:
    """Packed bitmap with the given places set."""
    out = np.zeros(size // 8, dtype=np.uint8)
    np.bitwise_or.at(out, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    return out


def is_set(packed: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (packed[at >> at.dtype.type(3)] >> (at & at.dtype.type(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def marks(states: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of rare states: last three bytes with one of up to three bytes,
    exactly, and slots of all."""
    def run(batches):
        for b in batches:
            of = slots(b.column("d").to_numpy(), b.column("ctx").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(of).astype(np.int32))], names=["slot"])
    slot = states.select("d", "ctx").mapInArrow(run, "slot int").distinct().toArrow()["slot"].to_numpy()
    short = states.where("d <= 3").select("d", "ctx").toArrow()  # at most 256 ** 3 and fewer
    near = np.zeros(1 << 24, dtype=bool)
    for d in (1, 2, 3):
        ctx = short["ctx"].to_numpy()[short["d"].to_numpy() == d]
        near.reshape(-1, 1 << 8 * d)[:, ctx] = True
    return np.packbits(near, bitorder="little"), bits(slot.astype(np.int64), 1 << SLOT_BITS)


def rare_gains(keys: DataFrame, states: DataFrame, sent, marked) -> DataFrame:
    """(key, gain) of the grams behind a marked context: log10 of what the rare
    states make of the probability by the frequent ones."""
    def run(batches):
        for b in batches:
            key = b.column("key").to_numpy()
            base = tree_probs(sent.value, np.full(len(key), DEPTH), key)
            for d in range(1, DEPTH + 1):
                ctx = (key >> 8) & ((1 << 8 * d) - 1)
                on = is_set(marked.value[1], slots(d, ctx))
                yield pa.RecordBatch.from_arrays([pa.array(key[on]), pa.array(base[on]), pa.array(np.full(on.sum(), d, dtype=np.int32)),
                                                  pa.array(ctx[on])], names=["key", "base", "kd", "kc"])
    asked = keys.mapInArrow(run, "key long, base double, kd int, kc long")
    met = asked.join(states, (F.col("kd") == F.col("d")) & (F.col("kc") == F.col("ctx")), "left").select(
        "key", "base", F.struct("kd", F.try_element_at("probs", F.col("key").bitwiseAND(F.lit(255))).alias("q"), "escape").alias("at"))
    p = F.aggregate(F.array_sort("way"), F.col("base"), lambda acc, at: F.coalesce(at["q"], acc * at["escape"], acc))
    return met.groupBy("key").agg(F.first("base").alias("base"), F.collect_list("at").alias("way")).select(
        F.col("key").alias("gk"), F.log10(p / F.col("base")).alias("gain"))


class Scorer:
    """Walks from each byte back along the tree: one table for the last three
    bytes, then child tables where deeper states exist."""

    def __init__(self, model: dict):
        self.model, self.logp, self.column = model, model["logp"], model["column"]
        states, n = model["states"], len(model["logp"])
        way = {d: sorted({c & ((1 << 8 * d) - 1) for k in range(max(d, 4), DEPTH + 1) for c in states[k]}) for d in range(3, DEPTH + 1)}
        t = np.zeros((256, 256, 256), dtype=np.int32)
        for c, s in states[1].items():
            t[:, :, c] = s
        for c, s in states[2].items():
            t[:, c >> 8, c & 255] = s
        self.table = t.reshape(-1)
        for c, s in states[3].items():
            self.table[c] = s
        inner = np.array(way[3], dtype=np.int64)
        self.n, self.state3 = n, np.concatenate([np.arange(n, dtype=np.int32), self.table[inner]])
        self.table[inner] = n + np.arange(len(inner), dtype=np.int32)  # nodes with children
        self.children, self.state = {}, {}
        for d in range(4, DEPTH + 1):
            up = {c: i for i, c in enumerate(way[d - 1])}
            child = np.zeros((max(1, len(up)), 256), dtype=np.int32)
            for i, c in enumerate(way[d]):
                child[up[c & ((1 << 8 * (d - 1)) - 1)], c >> 8 * (d - 1)] = i + 1
            self.children[d] = child
            self.state[d] = np.array([states[d].get(c, -1) for c in way[d]] or [-1], dtype=np.int32)

    def scores(self, docs: list[list[bytes]]) -> np.ndarray:
        """log10 probability of each text."""
        seq, predict, start = symbols(docs)
        node = self.table[codes(seq, 3, 1, np.uint32)]
        state = self.state3[node]
        ask = np.flatnonzero(node >= self.n)
        node = node[ask] - self.n
        for d in range(4, DEPTH + 1):
            child = self.children[d][node, seq[ask + (DEPTH - d)]]
            on = child > 0
            ask, node = ask[on], child[on] - 1
            found = self.state[d][node]
            real = found >= 0
            state[ask[real]] = found[real]
        out = np.zeros(len(seq))
        out[DEPTH:] = self.logp[state, self.column[seq[DEPTH:]]]
        out[~predict] = 0
        return np.add.reduceat(out, start)

    def deep(self, docs: list[list[bytes]], marked: tuple, gains: tuple) -> tuple[np.ndarray, pa.ListArray]:
        """Per text: the gain by frequent grams behind a marked context, and
        its other grams behind one."""
        (near, far), (known, gain) = marked, gains
        seq, predict, start = symbols(docs)
        key = codes(seq, DEPTH, 0, np.uint64)
        before = key >> np.uint64(8)
        on = is_set(near, before & np.uint64((1 << 24) - 1))
        for d in range(4, DEPTH + 1):
            on |= is_set(far, slots(d, before & np.uint64((1 << 8 * d) - 1)))
        at = np.flatnonzero(on & predict[DEPTH:])
        asked, out = key[at].astype(np.int64), np.zeros(len(seq))
        if len(known):
            spot = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            hit = known[spot] == asked
            out[at[hit] + DEPTH] = gain[spot[hit]]
            at, asked = at[~hit], asked[~hit]
        cuts = np.concatenate([np.searchsorted(at + DEPTH, start), [len(at)]])
        return np.add.reduceat(out, start), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(asked))

    def base(self, docs: list[list[bytes]]) -> list[tuple[int, float, list[int]]]:
        """Per text: known tokens, sum of log10(count + 1) and keys of the
        other words, as far as the common words go."""
        keys, counts, ends = self.model["keys"], self.model["counts"], self.model["ends"]
        words = list({w for ws in docs for w in ws})
        key = np.fromiter(map(word_key, words), dtype=np.int64, count=len(words))
        value = np.zeros(len(words))
        if len(keys) and len(words):
            spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            value = np.where(keys[spot] == key, np.log10(counts[spot] + 1.0), 0.0)
        of = dict(zip(words, value.tolist()))
        other = {w: k for w, k, v in zip(words, key.tolist(), value) if v == 0}
        end, out = float(np.log10(ends + 1)), []
        for ws in docs:
            rare = [other[w] for w in ws if w in other]
            out.append((len(ws) - len(rare) + (ends > 0), sum(map(of.__getitem__, ws)) + end, rare))
        return out


def score(docs: DataFrame, id_col="doc_id", text_col="text", p_min: float = 1e-5, f_min: float = 2.5e-7) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    model, words, behind, often = learn_all(d.where("NOT held_out"), p_min, f_min)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    states = rare_states(behind, sent)
    marked = docs.sparkSession.sparkContext.broadcast(marks(states))
    known = rare_gains(often, states, sent, marked).toArrow()  # at most 1 / f_min rows
    order = np.argsort(known["gk"].to_numpy())
    held = docs.sparkSession.sparkContext.broadcast((known["gk"].to_numpy()[order], known["gain"].to_numpy()[order]))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                        ("known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(pa.int64())),
                        ("deep", pa.list_(pa.int64()))])

    def run(batches):
        scorer, row = Scorer(sent.value), TaskContext.get().partitionId() << 36
        for chunk in chunks(batches):
            ws = [w for _, w in chunk]
            base, logp = scorer.base(ws), scorer.scores(ws)
            gain, deep = scorer.deep(ws, marked.value, held.value)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, type=f.type) for c, f in zip((
                range(row, row + len(ws)), [r[0] for r, _ in chunk], [r[1] for r, _ in chunk], [len(w) + 1 for w in ws],
                [b[0] for b in base], [b[1] for b in base], logp + gain, [b[2] for b in base]), schema)), deep], schema=schema)
            row += len(ws)
    rows = staged(d.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, "
                                    "score double, rare array<long>, deep array<long>"), "lm-rows")
    n = words.select("key", F.col("n").alias("c"))
    rare = (rows.select("row", F.explode("rare").alias("key")).join(n, "key")
            .select("row", F.lit(1).alias("k"), F.log10(F.col("c") + 1).alias("s"), F.lit(0.0).alias("gain")))
    grams = rows.select("row", F.explode("deep").alias("key"))
    gains = staged(rare_gains(grams.select("key").distinct(), states, sent, marked), "lm-gains")
    rare = (rare.unionByName(grams.join(gains, F.col("key") == F.col("gk")).select("row", F.lit(0).alias("k"), F.lit(0.0).alias("s"), "gain"))
            .groupBy(F.col("row").alias("r")).agg(F.sum("k").alias("k"), F.sum("s").alias("s"), F.sum("gain").alias("gain")))
    floor = float(np.log10(model["tokens"] + model["kinds"] + 1))
    return (rows.drop("rare", "deep").join(rare, F.col("row") == F.col("r"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        F.lit(int(model["tokens"])).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("s", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"),
        (F.col("score") + F.coalesce("gain", F.lit(0.0))).alias("score")))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
