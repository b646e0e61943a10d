"""Jaccard join, decontamination and line dedup against brute force."""
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chainlake.llm import decontaminate as dc
from chainlake.llm import jaccard_join as jj
from chainlake.llm import line_dedup as ld
from tests.llm.conftest import LONG, ODD


def near_texts(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(6):
        base = [rng.choice(vocab) for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(8):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            texts.append(" ".join(t))
    return texts + [" ".join(rng.choice(vocab) for _ in range(60)) for _ in range(20)]


def brute_links(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    link = defaultdict(set)
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                link[i].add(j)
    cls = list(range(len(rows)))
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        cls[i] = min(ids) if ids else None
    return [(r[0], cls[i], len(link[i])) for i, r in enumerate(rows)]


def key(rows):
    return sorted(rows, key=repr)


def test_jaccard_join_equals_brute_force(spark):
    rows = list(enumerate(near_texts()))
    rows += [(500 + i, t.upper()) for i, (_, t) in enumerate(rows[:5])]
    got = jj.join(spark.createDataFrame(rows, "doc_id long, text string"), block=4)
    assert key(map(tuple, got.collect())) == key(brute_links(rows))


def test_jaccard_join_odd_rows(odd, nothing):
    got = key(map(tuple, jj.join(odd).collect()))
    assert got == key(brute_links([(i, t) for i, t, _ in ODD]))
    assert jj.join(nothing).collect() == []
    kept = jj.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r["text"] for r in kept.collect())["one two three"] == 1
    assert kept.where("text IS NULL").count() == 2


def test_keep_one_keeps_every_class(spark):
    """Unlike texts without an id or under one id are classes of their own."""
    rows = [(None, "a text without an id"), (None, "another one that is unlike it"), (None, "a text without an id"),
            (None, "copied text of some document"), (3, "copied text of some document"), (2, "copied text of some document"),
            (5, "first text of the id five"), (5, "quite different words stand here"), (5, "first text of the id five"), (None, " ")]
    kept = jj.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([r for r in set(rows) if r[1] != rows[3][1]] + [rows[5]])


def test_stop_depth_meets_the_recall():
    for t in (0.5, 0.8, 0.95):
        d = jj.stop_depth(t, 0.99)
        assert d == 1 or 1 - (1 - t ** d) ** jj.TREES >= 0.99
        assert d == jj.DEPTH or 1 - (1 - t ** (d + 1)) ** jj.TREES < 0.99


def test_components_of_a_long_chain(spark):
    chain = spark.range(100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    ring = spark.range(200, 203).select(F.col("id").alias("a"), F.when(F.col("id") < 202, F.col("id") + 1).otherwise(F.lit(200)).alias("b"))
    ring = ring.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    got = {r["v"]: r["c"] for r in jj.components(chain.union(ring)).collect()}
    assert got == {v: 0 for v in range(101)} | {v: 200 for v in (200, 201, 202)}
    assert jj.components(chain.limit(0)).collect() == []


def brute_hits(text, items, window=10):
    w, hit, found = dc.words_of(text), set(), set()
    for item, it in items:
        iw = dc.words_of(it)
        n = min(window, len(iw))
        for p in range(len(iw) - n + 1) if iw else ():
            for q in range(len(w) - n + 1):
                if w[q:q + n] == iw[p:p + n]:
                    hit.update(range(q, q + n))
                    if item is not None:
                        found.add(item)
    return len(w), hit, found


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab .", max_size=40), max_size=5), st.lists(st.text("ab ", min_size=1, max_size=30), max_size=4), st.integers(1, 5))
def test_suffix_array_search_equals_brute_force(docs, items, window):
    numbered = [(str(i), t) for i, t in enumerate(items)]
    block = dc.Block(numbered, window)
    got = dc.search_shard([dc.words_of(t) for t in docs], block)
    for t, (spans, found, _) in zip(docs, got):
        _, hit, want = brute_hits(t, numbered, window)
        assert {k for a, b in spans for k in range(a, b)} == hit
        assert {block.ids[i] for i in found} == want


def test_longest_matches_and_locations():
    item = " ".join(f"t{i}" for i in range(25))
    doc = "x y " + " ".join(f"t{i}" for i in range(5, 20)) + " z"
    got = dc.search_shard([dc.words_of("a b"), dc.words_of(doc)], dc.Block([("i", item)], 10))
    assert got[0] == ([], [], [])
    assert got[1] == ([(2, 17)], [0], [(0, 2, 5, 15)])


def test_report_odd_rows_and_many_blocks(spark, odd, nothing):
    items = [("a", "one two three"), ("a", "one two three"), (None, "another text of the same id with more words than nine here"),
             ("b", None), ("c", ""), ("d", " ".join(["lorem ipsum dolor sit amet"] * 4))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = []
    for i, t, _ in ODD:
        if t == LONG:
            n, h, f = 40000, 40000, {"d"}
        else:
            n, hit, f = brute_hits(t, items)
            h = len(hit)
        want.append((i, n, h, len(f), h > 0))
    for size in (8_000_000, 60):
        got = dc.report(odd, bench, block_bytes=size, shard_words=20).select("doc_id", "n_words", "n_hit", "n_items", "contaminated")
        assert key(map(tuple, got.collect())) == key(want)
    assert dc.remove(odd, bench).columns == odd.columns
    assert dc.remove(odd, bench).count() == sum(not w[-1] for w in want)
    assert dc.report(nothing, bench).collect() == []
    assert dc.remove(odd, bench.limit(0)).count() == len(ODD)


BLANKS = " \t\n\x0b\x0c\r"


def brute_lines(rows, min_sites):
    sites, keeper = defaultdict(set), {}
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(BLANKS):
                sites[x.strip(BLANKS)].add(s)
                if i is not None:
                    keeper[x.strip(BLANKS)] = min(i, keeper.get(x.strip(BLANKS), i))
    out = []
    for i, t, s in rows:
        xs = (t or "").split("\n")
        keep = [x for x in xs if len(sites[x.strip(BLANKS)]) < min_sites or keeper.get(x.strip(BLANKS)) == i]
        out.append((i, len(xs) if t else 0, len(xs) - len(keep) if t else 0, "\n".join(keep) if t else t))
    return out


def test_line_dedup_equals_brute_force(spark, odd, nothing):
    rng = random.Random(5)
    lines = [f"line {i}" for i in range(12)] + ["", " ", "line 3\r", "\tline 4\x0b", "\x0cline 5 ", "\u00a0line 6", "\r"]
    rows = [(rng.choice([None, *range(60)]), "\n".join(rng.choice(lines) for _ in range(rng.randrange(9))), rng.choice([None, *"abcdef"]))
            for _ in range(150)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for m in (3, 6):
        got = ld.dedup(d, min_sites=m).select("doc_id", "n_lines", "n_removed", "text")
        assert key(map(tuple, got.collect())) == key(brute_lines(rows, m))
    got = ld.dedup(odd, min_sites=2)
    assert key(map(tuple, got.select("doc_id", "n_lines", "n_removed", "text").collect())) == key(brute_lines(ODD, 2))
    assert set(odd.columns) <= set(got.columns)
    assert ld.dedup(nothing).collect() == []


def test_lines_that_end_in_cr_are_one_line(spark):
    rows = [(i, "the same line" + "\r" * (i % 2) + f"\nown {i}", f"site{i}") for i in range(12)]
    got = ld.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {0: rows[0][1]} | {i: f"own {i}" for i in range(1, 12)}


def test_site_threshold_follows_the_sources(spark):
    for n, want in ((1, 3), (4, 3), (8, 4), (13, 7), (20, 10), (900, 10)):
        assert ld.site_threshold(spark.range(n * 2).select((F.col("id") % n).alias("source"))) == want
    few = [(i, "boilerplate\ntext of its own " + "x" * i, f"s{i % 4}") for i in range(8)]
    got = ld.dedup(spark.createDataFrame(few, "doc_id long, text string, source string"))
    assert got.where("n_removed = 1").count() == 7


def test_signatures_estimate_similarity():
    a = np.arange(1000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    same = (jj.signature(a[:900]) == jj.signature(a[100:])).mean()
    assert same == pytest.approx(0.8, abs=0.08)


def test_sorted_neighbours_are_the_tries(spark):
    """Stretches of neighbours that share a prefix are the nodes of the tries,
    whatever the ranges."""
    rng = random.Random(9)
    units = [(u, [np.array([rng.randrange(2) if k < 8 else rng.randrange(3) for k in range(jj.DEPTH)], ">u2").tobytes() for _ in range(4)])
             for u in range(400)]
    units += [(u, units[7][1]) for u in range(400, 500)]  # one label of very many units
    d = spark.createDataFrame(units, "uid long, labels array<binary>")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for tasks in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            label = {u: [np.frombuffer(t, ">u2").tolist() for t in x] for u, x in units}
            for r in jj.neighbours(d, 8).collect():  # every tie is a shared prefix of that length
                assert r["a"] < r["b"] and any(x[:r["shared"]] == y[:r["shared"]] for x, y in zip(label[r["a"]], label[r["b"]]))
            got = {r["v"]: r["c"] for r in jj.candidates(d, 9).collect()}
            parent = {u: u for u, _ in units}

            def top(u):
                while parent[u] != u:
                    u = parent[u]
                return u
            node = {}
            for u, x in units:
                for tree in range(4):
                    a, b = sorted((top(u), top(node.setdefault((tree, x[tree][:18]), u))))
                    parent[b] = a
            assert {u: got.get(u, u) for u, _ in units} == {u: top(u) for u, _ in units}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert jj.candidates(d.limit(0), 8).collect() == []
