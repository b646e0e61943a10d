"""Vector codes, exact dedup and source divergence against brute force."""
import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chainlake.llm import divergence as dv
from chainlake.llm import exact_dedup as ed
from chainlake.llm import vector_codes as vc
from tests.llm.conftest import ODD


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# Exact dedup

def brute_copies(rows):
    """(id, text) rows -> sorted (id, keep, size, sha), and kept ids by text."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t or "")].append(i)
    out, kept = [], Counter()
    for t, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        kept[best, t] += 1
        out += [(i, best, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr), kept


COPIES = [(i, t) for i, t, _ in ODD] + [(20, "ONE TWO three"), (21, "É one"), (22, "é one"), (23, "E one"), (24, "e ONE"), (24, "e ONE"),
                                         (24, "e one"), (25, "\n"), (None, "x")]


@pytest.mark.parametrize("digest", [ed.sha256, F.length, lambda c: F.lit(1)], ids=["sha256", "length", "constant"])
def test_copies(spark, digest):
    d = spark.createDataFrame([(i, t, "k", 9) for i, t in COPIES], "doc_id long, text string, keep_id string, id int").repartition(5)
    got = ed.mark(d, digest=digest, salts=2)
    assert got.columns == ["doc_id", "text", "id", "keep_id", "group_size", "kept", "text_sha256"]
    got = got.collect()
    want, kept = brute_copies(COPIES)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert Counter((r.doc_id, lower(r.text or "")) for r in got if r.kept) == kept  # one row of each, also of repeated rows


def test_copies_survivors_keep_their_text(spark, nothing):
    d = spark.createDataFrame(COPIES, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in ed.dedup(d).collect()), key=repr)
    assert len(got) == len({lower(t or "") for _, t in COPIES})
    assert (20, "ONE TWO three") in got and (22, "é one") in got and (21, "É one") in got and (5, "one two three") not in got
    assert ed.mark(nothing).collect() == [] and ed.dedup(nothing).columns == nothing.columns


def test_copies_of_a_hot_text_stay_few_rows_per_task(spark):
    d = spark.range(20_000, numPartitions=8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"))
    got = ed.mark(d).groupBy("group_size").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("k"), F.max("keep_id").alias("m")).collect()
    assert sorted(map(tuple, got)) == [(1, 13_333, 13_333, 19_999), (6_667, 6_667, 1, 19_998)]


# Divergence

def brute_divergence(rows, min_docs=10, top=10):
    n, docs = defaultdict(Counter), defaultdict(Counter)
    groups = sorted({(lang or "", src or "") for _, lang, src in rows})
    for text, lang, src in rows:
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or "")))
        n[lang or "", src or ""].update(terms)
        docs[lang or ""].update(terms.keys())
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, k in docs[lang].items() if k >= min_docs]
        srcs = [g[1] for g in groups if g[0] == lang]
        whole = Counter({t: sum(n[lang, s][t] for s in srcs) for t in kept})

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10 ** 9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def far(p, q):
            return (p - q) ** 2 // (p + q)
        p = {s: shares(n[lang, s]) for s in srcs}
        q = shares(whole)
        for s in srcs:
            pairs = [(o, sum(far(p[s][t], p[o][t]) for t in kept)) for o in srcs if o != s]
            terms = [(t, far(p[s][t], q[t])) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (item, v) in enumerate(found[:most])]
    return sorted(out)


def texts():
    rng = np.random.default_rng(5)
    words = ["Wort", "mot", "É", "a", "b", "c", "naïve", "x_y", "42", "日本", "don't", "Z" * 300]
    rows = [(" ".join(rng.choice(words, size=int(rng.integers(0, 30)))), str(rng.choice(["en", "de"])), f"s{int(rng.integers(0, 7))}") for _ in range(300)]
    return rows + [(None, None, None), ("", "en", "only empty"), ("a a A", "fr", "s1"), ("b", "fr", "s2"), ("b", "fr", None), ("\n\t,", "en", "s1"),
                   ("long " * 30_000 + "tail", "en", "s3"), ("a\x00b", "en", "s1"), ("a\x00b", "en", "s1")]


@pytest.mark.parametrize(("cells", "block"), [(dv.CELLS, dv.BLOCK), (5, 2)])
def test_divergence(spark, cells, block):
    rows = texts()
    d = spark.createDataFrame([(*r, 7, "t") for r in rows], "text string, lang string, source string, n int, term string").repartition(3)
    got = dv.audit(d, cells=cells, block=block)
    assert dict(got.dtypes) == {"lang": "string", "source": "string", "part": "string", "item": "string", "value": "bigint", "rank": "int"}
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows)
    assert dv.audit(d.limit(0)).collect() == []


def test_divergence_of_slices_and_full_tables(monkeypatch):
    rows = [(t or "", lang or "", s or "") for t, lang, s in texts()]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["text", "lang", "source"])
    want, docs = Counter(), Counter()
    for t, lang, s in rows:
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t)))
        want.update({(lang, s, w): k for w, k in terms.items()})
        docs.update((lang, s, w) for w in terms)
    for size, held in ((1, 10), (500, 40), (8 << 20, 400_000)):
        monkeypatch.setattr(dv, "CHUNK_BYTES", size)
        monkeypatch.setattr(dv, "HELD_ROWS", held)
        got, got_docs = Counter(), Counter()
        for out in dv.partial_counts(iter([batch.slice(0, 100), batch.slice(100)])):
            for r in out.to_pylist():
                got[r["lang"], r["source"], r["term"]] += r["n"]
                got_docs[r["lang"], r["source"], r["term"]] += r["docs"]
        assert got == want and got_docs == docs


# Vector codes

def brute_codes(rows, parts=4, entries=256, rounds=4):
    """rows: (id, vector, label), whole and of one length."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    size = len(rows[0][1]) // parts
    ints = [[math.floor(1024 * x) if abs(x) < 2 ** 52 else 1024 * int(x) for x in r[1]] for r in rows]
    cut = [[v[p * size:(p + 1) * size] for p in range(parts)] for v in ints]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], c, strict=True)), e) for e, c in enumerate(books[p])) for p in range(parts)] for v in cut]
    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p] for v, a in zip(cut, near, strict=True) if a[p][1] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    near = assign()
    flat = ",".join(str(x) for b in books for c in b for x in c)
    return (sorted(((r[0], [a[1] for a in n], sum(min(a[0], vc.TOP) for a in n), r[2]) for r, n in zip(rows, near, strict=True)), key=repr),
            hashlib.sha256(flat.encode()).hexdigest())


def vectors(kind, n, width, scale=1.0):
    rng = np.random.default_rng(3)
    v = (rng.normal(size=(n, width)) * scale).astype(np.float32 if kind == "float" else np.float64)
    v[n // 3:n // 2] = v[0]  # a hot vector
    v[n // 2, :] = 0.0
    return [(int(i) if i % 17 else None, [float(x) for x in r], int(i % 3) if i % 5 else None) for i, r in enumerate(v)]


@pytest.mark.parametrize(("kind", "n", "width", "entries", "scale"), [
    ("float", 300, 8, 16, 1.0), ("double", 60, 4, 256, 1.0), ("double", 90, 8, 4, 1e9), ("double", 40, 4, 4, 1e30), ("float", 40, 8, 8, 1e-3)])
def test_codes(spark, kind, n, width, entries, scale):
    rows = vectors(kind, n, width, scale)
    rows += rows[:2]  # repeated rows
    bad = [(900, None, 1), (901, [None] + rows[0][1][1:], 1), (902, [float("nan")] * width, 1), (903, [float("inf")] * width, 1),
           (904, [], 1), (905, rows[0][1] + [1.0], 1)]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows + bad], f"vec_id long, embedding array<{kind}>, label int, pos int, row int").repartition(4)
    codes, books = vc.compress(d, entries=entries)
    want, sha = brute_codes(rows, entries=entries)
    assert sorted(((r["id"], r["codes"], int(r["error"]), r["label"]) for r in codes.collect()), key=repr) == want
    assert vc.digest(books) == sha


def test_codes_of_nothing_and_uneven_lengths(spark):
    d = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], "vec_id long, embedding array<float>, label int")
    assert vc.compress(d.limit(0))[0].collect() == []
    assert vc.compress(d.select("vec_id", F.lit(None).cast("array<float>").alias("embedding"), "label"))[0].collect() == []
    with pytest.raises(ValueError, match="3 components"):
        vc.compress(d)


def test_codes_query_columns(spark, small_dir):
    got = vc.op11_vector_codes(spark, small_dir)
    rows = got.collect()
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and all(re.fullmatch("[0-9a-f]{8}", r["code"]) for r in rows)
    by = defaultdict(int)
    label = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()}
    for r in rows:
        by[label[r["vec_id"]]] += r["error"]
    assert all(r["label_error"] == by[label[r["vec_id"]]] for r in rows)
