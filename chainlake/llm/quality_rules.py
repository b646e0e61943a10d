"""Quality rules: a learned decision list over text statistics.

Each document's statistics are computed in one ``mapInArrow`` pass and written
to the shared folder.  The list is learned from the labelled rows by sequential
covering: grow a conjunction of thresholds on part of the rows by information
gain, prune it on the rest, keep it if it is precise enough there, take out the
rows that it covers, go on.  Training takes at most ``sample`` labelled rows
(the smallest hashes of the id), a documented bound.  The result is an ordered
chain of Spark ``when`` expressions over the statistics.

Base rules come first: a document fails with fewer than 10 words, or with more
than a fifth of its words in 5-word windows that the text repeats.

Defined cases: null and empty texts have no words, so they fail the base
rules; rows with a null label or id are not learned from; with no labelled
rows the list is empty and keeps what passes the base rules; repeated rows get
the same verdict.  Empty tables give no rows.  Only the id and text columns
are read, so others cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm.common import ship_by_value, staged, table

ship_by_value(__name__)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits",
          "n_punct", "n_single", "n_distinct")
SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS)
#: learned features: counts per word, per line or per character
RATES = {
    "words": ("n_words", None), "symbols_per_word": ("n_symbols", "n_words"), "chars_per_word": ("word_chars", "n_words"),
    "dup_lines_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "word_chars"), "digit_share": ("n_digits", "word_chars"),
    "punct_per_word": ("n_punct", "n_words"), "single_share": ("n_single", "n_words"),
    "distinct_share": ("n_distinct", "n_words"), "words_per_line": ("n_words", "n_lines"),
}
_SYMBOLS = "#*$%&|<>"
_CLASS = np.zeros(256, dtype=np.uint8)  # of ASCII bytes
_CLASS[48:58] = 1
_CLASS[65:91] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """Words inside windows of ``width`` words that the text has twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    code = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            code = (code ^ ids[k:k + n]) * _MIX
            code ^= code >> np.uint64(29)
    _, back, count = np.unique(code, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[back] > 1)
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    edge[twice] += 1
    edge[twice + width] -= 1
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """The values of COUNTS."""
    if not text:
        return (0,) * len(COUNTS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # the six ASCII blanks
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number) + 1) for w in words), dtype=np.uint64, count=len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    blanks = sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    kind = np.bincount(_CLASS[np.frombuffer(data, dtype=np.uint8)], minlength=4)
    return (len(words), len(text) - blanks, sum(text.count(c) for c in _SYMBOLS), len(lines) - len(set(lines)),
            repeated_words(ids), len(lines), int(kind[2]), int(kind[1]), int(kind[3]),
            sum(len(w) == 1 for w in words), len(number))


def text_statistics(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: SCHEMA."""
    names = ["doc_id", *COUNTS]

    def run(batches):
        for b in batches:
            rows = [statistics(t) for t in b.column("t").to_pylist()]
            cols = list(zip(*rows)) if rows else [()] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, pa.int64()) for c in cols]], names=names)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(run, SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def rate(name: str) -> Column:
    top, per = RATES[name]
    return F.col(top).cast("double") if per is None else F.col(top) / F.greatest(F.col(per), F.lit(1))


def grow(x: np.ndarray, bad: np.ndarray, max_terms: int = 3, cuts: int = 32) -> list[tuple[int, str, float]]:
    """A conjunction of (feature, '>=' or '<', threshold), by information gain."""
    terms, on = [], np.ones(len(x), dtype=bool)
    for _ in range(max_terms):
        p, n = (on & bad).sum(), (on & ~bad).sum()
        if not p or not n:
            break
        best, best_gain = None, 1e-9
        for j in range(x.shape[1]):
            for t in np.unique(np.quantile(x[on & bad, j], np.linspace(0, 1, cuts))):
                for op in (">=", "<"):
                    got = on & ((x[:, j] >= t) if op == ">=" else (x[:, j] < t))
                    p1, n1 = (got & bad).sum(), (got & ~bad).sum()
                    if p1:
                        gain = p1 * (np.log2(p1 / (p1 + n1)) - np.log2(p / (p + n)))
                        if gain > best_gain:
                            best, best_gain = (j, op, float(t)), gain
        if best is None:
            break
        terms.append(best)
        on &= covers(x, [best])
    return terms


def covers(x: np.ndarray, terms: list[tuple[int, str, float]]) -> np.ndarray:
    on = np.ones(len(x), dtype=bool)
    for j, op, t in terms:
        on &= (x[:, j] >= t) if op == ">=" else (x[:, j] < t)
    return on


def prune(terms, x: np.ndarray, bad: np.ndarray):
    """Drop last terms while (p - n) / (p + n) on held-out rows gets no worse."""
    def worth(ts):
        on = covers(x, ts)
        p, n = (on & bad).sum(), (on & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0
    while len(terms) > 1 and worth(terms[:-1]) >= worth(terms):
        terms = terms[:-1]
    return terms


def learn(x: np.ndarray, bad: np.ndarray, min_precision: float = 0.97, max_rules: int = 12) -> list:
    """The decision list: conjunctions that reject, in order."""
    rules, left = [], np.ones(len(x), dtype=bool)
    third = np.arange(len(x)) % 3 == 2  # rows come in the order of a hash
    while len(rules) < max_rules and (left & bad).any():
        terms = grow(x[left & ~third], bad[left & ~third])
        if not terms:
            break
        held = left & third
        terms = prune(terms, x[held], bad[held])
        on = covers(x, terms) & left
        p, n, hp, hn = (on & bad).sum(), (on & ~bad).sum(), (on & held & bad).sum(), (on & held & ~bad).sum()
        if p < min_precision * (p + n) or hp < min_precision * (hp + hn) or not hp:
            break
        rules.append(terms)
        left &= ~on
    return rules


def train(stats: DataFrame, labels: DataFrame, id_col="doc_id", label_col="quality", sample: int = 20_000) -> list:
    """Decision list as [[(feature name, op, threshold), ..], ..]."""
    lab = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("__lid"), (F.col(label_col) == 0).alias("__bad"), F.xxhash64(F.col(id_col)).alias("__h"))
    if lab.count() > sample:
        cut = lab.select("__h").orderBy("__h").limit(sample).agg(F.max("__h")).first()[0]
        lab = lab.where(F.col("__h") <= cut)
    rows = (stats.where(~base_failed()).join(lab, F.col("doc_id") == F.col("__lid"))
            .select("__h", "__bad", *[rate(r).alias(r) for r in RATES]).toPandas().sort_values("__h", kind="stable"))
    names = list(RATES)
    found = learn(rows[names].to_numpy(dtype=float), rows["__bad"].to_numpy(dtype=bool))
    return [[(names[j], op, t) for j, op, t in terms] for terms in found]


def verdict(rules: list) -> Column:
    """kept: the first rule that fits rejects, the default keeps."""
    out = F.when(base_failed(), F.lit(False))
    for terms in rules:
        fits = F.lit(True)
        for name, op, t in terms:
            fits = fits & ((rate(name) >= t) if op == ">=" else (rate(name) < t))
        out = out.when(fits, F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: SCHEMA, base_failed, kept."""
    stats = staged(text_statistics(docs, id_col, text_col), "quality-stats")
    rules = train(stats, labels)
    return stats.select("*", base_failed().alias("base_failed"), verdict(rules).alias("kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
