"""WARC, quality rules, LM scoring, toxicity and the pipeline."""
import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from chainlake.llm import lm_score as lm
from chainlake.llm import quality_rules as qr
from chainlake.llm import toxicity as tx
from chainlake.llm import warc
from tests.llm.conftest import ODD

PAYLOADS = ["", None, "plain", "x WARC/1.0\r\n y", "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 0\r\n\r\n\r\n\r\n", "WARC/1.0\r\n", "ends WARC/1.0",
            "\r\n\r\n", "é\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.0\r\n", "dup", "dup", "dup", "z" * 20000,
            "WARC/1.0\r\nContent-Length: 99999\r\n\r\nq", "WARC/1.0\r\nContent-Length: x\r\n\r\n"]


def digest(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def brute_warc(rows, least=0):
    top = {}
    for i, _, t in rows:
        if i is not None:
            top[t or ""] = max(i, top.get(t or "", i))
    out = []
    for i, _, t in rows:
        m = top.get(t or "")
        rev = len((t or "").encode()) >= least and m is not None and m != i
        out.append((i, len((t or "").encode()), digest(t), "revisit" if rev else "response", m if rev else None))
    return sorted(out, key=repr)


def through(spark, d, path, **kw):
    warc.write(d, path, **kw)
    r = warc.read(spark, path)
    n = lambda c: F.regexp_extract(c, "<urn:page:([0-9-]*)>", 1).try_cast("long")
    rev = F.col("type") == "revisit"
    return sorted(map(tuple, r.select(n(F.col("record_id")), F.when(rev, F.col("said_length").cast("long")).otherwise(F.col("length")),
                                      F.when(rev, F.substring("said_digest", 6, 40)).otherwise(F.col("digest")), "type",
                                      F.when(rev, n(F.col("refers")))).collect()), key=repr)


@pytest.mark.parametrize("split", [128 << 20, 700])
def test_warc_round_trip(spark, tmp_path, split):
    rows = [(i, u, p) for i, (p, u) in enumerate(zip(PAYLOADS * 3, ["http://a/é b\r\nc", None, "http://x/WARC/1.0"] * 15))]
    rows += [(None, "u", "dup"), (None, None, "only"), (7, "u", "same id"), (7, "v", "same id")]
    d = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int").repartition(3)
    old, cost = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", min(split, 1 << 20))
        assert through(spark, d, f"{tmp_path}/w") == brute_warc(rows)
        assert through(spark, d, f"{tmp_path}/least", min_bytes=4) == brute_warc(rows, 4)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert through(spark, d.limit(0), f"{tmp_path}/none") == []


def test_one_archive_in_many_splits(spark, tmp_path):
    """Records that begin in one split and end in another, and no window over
    the pieces of a file."""
    rows = [(i, "http://x/", p) for i, p in enumerate((PAYLOADS + ["long " * 400 + "WARC/1.0\r\nmore " * 90]) * 4)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    old, cost = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 900)
        spark.conf.set("spark.sql.files.openCostInBytes", 900)
        assert through(spark, d, f"{tmp_path}/w") == brute_warc(rows)
        pieces = warc.raw_pieces(spark, f"{tmp_path}/w")
        assert pieces.select("split").distinct().count() > 20
        plan = warc.reachable(warc.located(warc.candidates(pieces)))._jdf.queryExecution().optimizedPlan().toString()
        over = [line for line in plan.splitlines() if " Window [" in line or line.strip().startswith("Window [")]
        assert over and all("split" in line for line in over)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_warc_stops_where_the_chain_breaks(spark, tmp_path):
    rec = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {n}\r\n\r\n{b}\r\n\r\n"
    good, lost = rec.format(n=3, b="abc"), rec.format(n=2, b="zz")
    (tmp_path / "a.warc").write_bytes((good + good + rec.format(n=900, b="cut") + lost).encode())
    (tmp_path / "b.warc").write_bytes(("junk" + good).encode())
    assert [r["length"] for r in warc.read(spark, str(tmp_path)).orderBy("at").collect()] == [3, 3, 900]


def brute_stats(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cov = {k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(i, i + 5)}
    lines, seen, dup = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(cov)


@settings(max_examples=150, deadline=None)
@given(st.text("ab é\n\t#|", max_size=80))
def test_text_statistics_equal_brute_force(t):
    assert qr.statistics(t)[:5] == brute_stats(t)


def test_quality_rules(spark, odd, nothing, small_dir):
    labels = spark.read.parquet(f"{small_dir}/labels.parquet")
    got = {r["doc_id"]: r for r in qr.judge(odd.where("doc_id NOT IN (5)"), labels).collect()}
    for i, t, _ in ODD:
        if i not in (5, None):
            n = brute_stats(t)
            assert (got[i]["n_words"], got[i]["n_repeat_words"]) == (n[0], n[4])
            assert got[i]["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
            assert not (got[i]["base_failed"] and got[i]["kept"])
    none = qr.judge(odd, labels.limit(0))
    assert none.count() == len(ODD) and none.where("kept = base_failed").count() == 0
    assert qr.judge(nothing, labels).collect() == []


def test_decision_list_learns_a_conjunction():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    bad = (x[:, 1] > 0.7) & (x[:, 3] < 0.4)
    rules = qr.learn(x[:2000], bad[:2000])
    said = np.zeros(1000, dtype=bool)
    for r in rules:
        said |= qr.covers(x[2000:], r)
    assert (said == bad[2000:]).mean() > 0.97
    assert qr.learn(x, np.zeros(3000, dtype=bool)) == [] and qr.learn(x[:0], bad[:0]) == []


def test_quality_rules_on_held_out_labels(spark, small_dir):
    docs, labels = (spark.read.parquet(f"{small_dir.replace('0.001', '0.1')}/{t}.parquet") for t in ("documents", "labels"))
    seen, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    got = qr.judge(docs, seen).where("NOT base_failed").join(held, "doc_id").select("kept", "quality").toPandas()
    assert ((got["quality"] == 1) == got["kept"]).mean() > 0.97


def brute_base(rows):
    tok = [[w for w in (t or "").encode().lower().split()] + [b"\xff"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    c = Counter(w for ws, h in zip(tok, held) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6))
            for (i, _), ws, h in zip(rows, tok, held)]


@pytest.mark.parametrize("f_min", [2.5e-7, 0.02])
def test_lm_counts_equal_brute_force(spark, odd, nothing, f_min):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["The", "the", "a", "cat", "dög", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(30)))) for i in range(120)]
    rows += [(i, t) for i, t, _ in ODD]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int")
    got = lm.score(d, f_min=f_min).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, ((*r[:5], float(r[5])) for r in brute_base(rows))))
    assert lm.score(nothing).collect() == []
    assert lm.score(odd.where("doc_id IS NULL AND FALSE")).collect() == []


def test_suffix_tree_is_a_distribution_and_uses_long_contexts(spark):
    d = spark.createDataFrame([(i, "abcabd " * 50) for i in range(20)], "doc_id long, text string")
    model, _ = lm.learn(d)
    shares = 10.0 ** model["logp"].astype(float)
    unseen = 256 - (model["column"] > 0).sum()
    assert np.allclose(shares[:, 1:].sum(axis=1) + shares[:, 0] * unseen, 1, atol=1e-4)
    s = lm.Scorer(model)
    good, bad = s.scores([[b"abcabd"] * 10, [b"abdabc"] * 10])
    assert good > bad
    one = s.scores([[b"abcabd"], [], [b"zq"]])
    assert np.allclose(one, [walk(model, t) for t in (b"abcabd", b"", b"zq")], atol=1e-3)


def walk(model, text):
    """Score by looking for the longest state, longest first."""
    seq, out = b"\xff" * lm.DEPTH + text + b"\xff", 0.0
    for i in range(lm.DEPTH, len(seq)):
        for d in range(lm.DEPTH, -1, -1):
            code = int.from_bytes(seq[i - d:i], "big") if d else 0
            if code in model["states"][d]:
                out += float(model["logp"][model["states"][d][code], model["column"][seq[i]]])
                break
    return out


def test_deep_states_are_found(spark, small_dir):
    d = spark.read.parquet(f"{small_dir}/documents.parquet")
    model, _ = lm.learn(d, p_min=1e-4)
    assert all(model["states"])
    texts = [b" ".join(lm.words_of(r["text"])) for r in d.limit(5).collect()]
    assert np.allclose(lm.Scorer(model).scores([t.split() for t in texts]), [walk(model, t) for t in texts], rtol=1e-5)


def test_rare_contexts_count_as_frequent_ones(spark, small_dir):
    """p_min only says where a state is kept: the scores are the same."""
    d = spark.read.parquet(f"{small_dir}/documents.parquet").where("doc_id % 4 = 0").select("doc_id", "text")
    few, every = ({(r["doc_id"], r["n_tokens"]): r["score"] for r in lm.score(d, p_min=p).collect()} for p in (0.01, 1e-9))
    assert few.keys() == every.keys()
    assert np.allclose([few[k] for k in every], list(every.values()), rtol=1e-4)


def test_toxicity_on_held_out_labels(spark, small_dir):
    big = small_dir.replace("0.001", "0.1")
    lab = tx.labelled_documents(spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet"))
    model = tx.train(lab.where("doc_id % 2 = 0"))
    got = tx.score(lab.where("doc_id % 2 = 1"), model).select("toxic", "severity").toPandas()
    said = got["severity"] >= tx.REJECT
    assert (said == (got["toxic"] == 1)).mean() > 0.97
    assert said[got["toxic"] == 0].mean() < 0.005
    assert (np.diff(model["t"]) > 0).all()


def test_toxicity_odd_rows(spark, odd, nothing):
    rows = [(i, "clean words only" if i % 2 else "clean slur words", i % 2 == 0) for i in range(60)] + [(None, None, None), (99, None, None)]
    lab = spark.createDataFrame(rows, "doc_id long, text string, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    model = tx.train(lab)
    assert tx.severity("a SLUR!", model) > 0.5 > tx.severity("clean words", model)
    assert tx.score(odd, model).count() == len(ODD) and tx.score(nothing, model).collect() == []
    for none in (lab.limit(0), lab.where("toxic = 1")):
        assert tx.severity("slur", tx.train(none)) == 0.0


def test_ordinal_regression_orders_grades():
    x = [np.array([], dtype=int)] * 40 + [np.array([0])] * 40 + [np.array([0, 1])] * 40
    w, t = tx.fit(x, np.repeat([0, 1, 2], 40), 2)
    s = [tx._logistic(w[r].sum() - t).sum() for r in (x[0], x[50], x[100])]
    assert s[0] < 0.2 and abs(s[1] - 1) < 0.2 and s[2] > 1.8


def test_pipeline(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = [(10_000 + i, t, "en", s, len(t or "")) for i, (_, t, s) in enumerate(ODD)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small_dir).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= n
        n = docs.count()
    assert docs.where("text IS NULL").count() == 2
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert max(Counter(t for t in kept.values() if t and t.strip()).values()) == 1
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, small_dir).collect()
    assert {i for r in mixed for i in r["doc_ids"]} <= set(kept)
    assert sum(r["n_words"] for r in mixed) == pytest.approx(sum(len((t or "").encode().split()) for t in kept.values()), rel=0.01)


def test_documents_of_boilerplate_alone_go(spark, small_dir):
    rows = [(i, "shared line\r\n \n\t\n", "en", f"s{i}", 20) for i in range(12)] + [(20, " \n", "en", "s1", 2), (21, None, "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_lines(spark, docs, small_dir)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 20, 21]  # null and blank texts held no boilerplate


def test_pipeline_runs_on_an_empty_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small_dir).collect() == [], name
