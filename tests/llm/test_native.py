"""URL filter, tool calls and mixing."""
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chainlake.llm import mixing as mx
from chainlake.llm import tool_calls as tc
from chainlake.llm import url_filter as uf
from tests.llm.conftest import ODD


def brute_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for said, rule in uf.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (said, rule)
    return host, path, best


def test_urls_and_rules(spark):
    urls = ["http://www.Example.COM/en/1?x#y", "https://example.com/en/", "https://a.example.com/en", "ftp://x.net/es/1", "net/es/",
            "http://foo.com", "http://foo.com/", None, "", "x://y://z/fr/", "http://notexample.com/en/", "http://b.net/fr/é\nq",
            "://?q", "http://ads-track.example.org/pop", "http://" + "a" * 5000 + ".org/" + "b" * 50000]
    d = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + urls)], "page_id long, url string, host string")
    for r in uf.judge(d, uf.labelled_urls(spark)).collect():
        host, path, best = brute_url(r["url"])
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[1])
        assert r["verdict"] == (best[0] if best else "block" if r["score"] >= 0.5 else "allow")
    assert uf.judge(d.limit(0), uf.labelled_urls(spark)).collect() == []


def test_model_tells_labelled_urls_apart(spark):
    lab = uf.labelled_urls(spark)
    got = uf.judge(lab, lab, rules=[])
    assert got.where((F.col("verdict") == "block") != (F.col("label") == 1)).count() == 0
    odd = spark.createDataFrame([(None, 1), ("http://a.b/c", None)], "url string, label int")
    assert uf.judge(odd, odd).count() == 2
    assert uf.judge(odd, lab.limit(0), rules=[]).where("verdict = 'block'").count() in (0, 2)


CALLS = [  # conv, id, name, arguments, dependencies
    (1, "a", "search", '{"limit": 3, "query": "q"}', []),
    (1, "b", "search", '{"query": "q"}', ["a"]),
    (1, "c", "note", '{"title": "t", "tags": ["x"], "pinned": true}', ["a", "b"]),
    (1, "d", "summarize", '{"text": "t", "max_words": "9"}', ["c"]),
    (1, "e", "other", "{}", ["gone"]), (1, "f", "note", '{"title": "t"}', ["g"]), (1, "g", "note", '{"title": "t"}', ["f"]),
    (1, "h", "note", "not json", None), (1, "i", "note", '{"title": "t", "more": 1}', [None, "a"]), (2, "a", "note", '{"title": "z"}', ["e"]),
    (None, "a", "note", '{"title": "z"}', []), (1, None, "note", '{"title": "z"}', []), (1, "a", "search", '{"limit": 3, "query": "q"}', []),
    (3, "m", "note", '{"title": null}', ["n", "o"]), (3, "n", None, None, []), (3, "o", "note", "[1]", ["n"]),
]
RESULTS = [(1, "a", "z"), (1, "a", "r"), (1, "b", 'say "x"\n'), (1, "c", None), (None, "a", "n"), (1, "zz", "lost"), (1, None, "lost"), (1, "i", "ok")]


def test_tool_calls(spark):
    calls = spark.createDataFrame([(*c, 1) for c in CALLS], "conv_id long, call_id string, name string, arguments string, depends_on array<string>, level int")
    results = spark.createDataFrame(RESULTS, "conv_id long, call_id string, content string")
    out = tc.link(calls, results).collect()
    got = {(r["conv_id"], r["call_id"], r["status"] == "orphan_result"): r for r in out}
    assert len(out) == len(CALLS) + 2
    want = {"a": (0, "ok", 2), "b": (1, "missing:limit", 1), "c": (2, "ok", 1), "d": (3, "type:max_words", 0), "e": (None, "missing_dependency", 0),
            "f": (None, "blocked", 0), "g": (None, "blocked", 0), "h": (0, "bad_json", 0), "i": (1, "unexpected_argument", 1)}
    for k, v in want.items():
        r = got[1, k, False]
        assert (r["level"], r["status"], r["n_results"]) == v, k
    assert got[2, "a", False]["status"] == "missing_dependency"
    assert got[None, "a", False]["status"] == "ok" and got[1, None, False]["level"] == 0
    assert got[3, "m", False]["level"] == 2 and got[3, "n", False]["status"] == "bad_json"
    assert got[1, "a", False]["canonical"] == '{"arguments":{"limit":3,"query":"q"},"id":"a","name":"search","result":"r"}'
    assert json.loads(got[1, "b", False]["canonical"])["result"] == 'say "x"\n'
    assert got[1, "zz", True]["canonical"] == '{"id":"zz","result":"lost"}'
    assert tc.link(calls.limit(0), results.limit(0)).collect() == []


def test_long_chain_needs_few_rounds(spark):
    n = 300
    calls = spark.createDataFrame([(1, f"c{i}", "note", '{"title": "t"}', [f"c{i - 1}"] if i else []) for i in range(n)],
                                  "conv_id long, call_id string, name string, arguments string, depends_on array<string>")
    got = {r["k"].split("\u001f")[1]: r["level"] for r in tc.levels(calls).collect()}
    assert got == {f"c{i}": i for i in range(n)}


def test_derived_calls(spark, small_dir):
    conv = spark.read.parquet(f"{small_dir}/conversations.parquet")
    got = tc.link(tc.calls_of(conv), tc.results_of(conv))
    assert got.where("status != 'orphan_result'").count() == conv.where("role = 'assistant'").count()
    assert got.where("level > 0 AND status = 'ok'").count() > 0


def test_derived_calls_hold_whole_turns(spark):
    """Every assistant turn is parsed and serialised whole, whatever its tool,
    and notes depend on two calls."""
    long = "Ünï \"quoted\" text\n" * 40
    rows = [(c, k + c, "system" if k + c == 0 and c else "user" if k % 2 == 0 else "assistant", f"{long}{c} {k}") for c in (0, 1) for k in range(10)]
    rows.append((1, 0, "system", "be kind"))
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    calls = tc.calls_of(conv)
    got = [r.asDict() for r in tc.link(calls, tc.results_of(conv)).where("status != 'orphan_result'").orderBy("conv_id", "level", "call_id").collect()]
    assert Counter(r["name"] for r in got) == {"search": 4, "summarize": 4, "note": 2}
    text = {f"call_{c}_{k}": t for c, k, role, t in rows if role == "assistant"}
    assert all(text[r["call_id"]] in json.loads(r["canonical"])["arguments"].values() for r in got) and len(got) == len(text)
    assert [r["level"] for r in got if r["conv_id"] == 1] == [0, 1, 2, 2, 3]
    assert calls.where("size(depends_on) = 2").count() == 2


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, total, target = set(names), float(sum(sizes.values())), {}
    while left:
        share = {s: (total - sum(target.values())) * w[s] / sum(w[x] for x in left) for s in left}
        over = {s for s in left if share[s] > cap * sizes[s]}
        if not over:
            return target | share
        target |= {s: float(cap * sizes[s]) for s in over}
        left -= over
    return target


def check_mix(rows, got, block):
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    targets = brute_targets(sizes)
    assert sorted(map(repr, ((r["doc_id"], r["size"]) for r in got))) == sorted(repr((i, len((t or "").encode().split()))) for i, t, _ in rows)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    want = {}
    for s, t in targets.items():
        k = (sizes[s], round(t, 6))
        want[k] = want.get(k, 0) + round(t)
    assert set(by) == set(want)
    assert all(abs(sum(v) - want[k]) <= 3 for k, v in by.items())


@pytest.mark.parametrize("block", [1, 7, 512])
def test_mixing_meets_targets(spark, odd, nothing, block):
    rng = random.Random(block)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 30, 400])), rng.choice(["b", "a", "é", None, "big", "big", "big"])) for i in range(200)]
    rows += [(900, "only", "tiny"), (901, "", "empty")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mx.mix_documents(d, block=block).collect()
    check_mix(rows, got, block)
    assert sorted(got) == sorted(mx.mix_documents(d.repartition(3), block=block).collect())
    if block == 7:
        check_mix(ODD, mx.mix_documents(odd, block=block).collect(), block)
        assert mx.mix_documents(nothing).collect() == [] and mx.mix_blocks(nothing).collect() == []


def test_mixed_blocks_hold_the_words(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(3 + 11 * i % 40)), "abc"[i % 3]) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {}
    for r in mx.mix_blocks(d, block=16).collect():
        words = r["text"].split(" ")
        assert len(words) == r["n_words"] <= 16
        assert {int(w[1:w.index("w")]) for w in words} == set(r["doc_ids"])
        for w in words:
            i = int(w[1:w.index("w")])
            assert "abc"[i % 3] == r["source"]
            taken[i] = taken.get(i, 0) + 1
    want = {r["doc_id"]: r["taken"] for r in mx.mix_documents(d, block=16).collect()}
    assert taken == {k: v for k, v in want.items() if v}


def test_permutation(spark):
    for n in (1, 2, 5, 64, 97):
        got = [r[0] for r in spark.range(n).select(mx.permuted(F.col("id"), F.lit(n), [F.lit(3)])).collect()]
        assert sorted(got) == list(range(n))


def test_cells_find_their_owner_without_a_list_of_cells(spark):
    rng = random.Random(4)
    for needs in ([1], [5, 1, 1, 1, 90_000], [rng.choice([1, 2, 50, 4000]) for _ in range(300)]):
        planned = spark.createDataFrame(list(enumerate(needs)), "sid long, need long")
        n = sum(needs)
        got = mx.owners(spark.range(n).select(F.col("id").alias("cell")), planned, max(1, n // len(needs)))
        per = got.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.min("cell").alias("lo"), F.max("cell").alias("hi")).collect()
        at, want = 0, []
        for sid, need in enumerate(needs):
            want.append((sid, need, at, at + need - 1))
            at += need
        assert sorted(map(tuple, per)) == want
