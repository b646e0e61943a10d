"""Toxicity: cumulative-link (proportional odds) regression on sparse text
features, giving expected severity.

Features are the presence of lower-cased words, bare of ASCII punctuation, and
of their first 4 and 5 bytes, hashed to 32 bits.  Severity grades come from
labelled rows: 0 for rows that are not toxic; toxic rows are graded 1 to
``grades`` - 1 by how many toxic features they hold, at the quantiles of that
number (a ``grade`` column, where given, is used instead).  One weight vector
is shared by the ordered thresholds t_1 < t_2 < ..:
P(grade > k) = logistic(w x - t_k), and expected severity is the sum of these.

Training takes at most ``sample`` labelled rows (the smallest hashes of the
id), a documented bound, and only features that toxic rows hold more often
than chance allows (false discovery rate ``fdr``), so words without bearing on
the label add no noise, however long a text is.  The model, at most a few thousand weights, is
broadcast and scoring is one pass without a shuffle.

Defined cases: null and empty texts have no features and get the severity of
the intercepts; rows with a null label or id are not used for training;
repeated rows are scored alike; without any labelled row, or with labels of
one kind only, every severity is 0.  Empty tables give no rows.  Working
columns carry a ``__`` prefix, all other columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm.common import ship_by_value, table

ship_by_value(__name__)

PREFIXES = (4, 5)

_BARE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    words = set(text.encode("utf-8", "surrogatepass").translate(_BARE).split())
    starts = {b"^" + w[:n] for w in words for n in PREFIXES if len(w) > n}
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(w) for w in words | starts), dtype=np.uint32))


def select_features(rows: list[np.ndarray], toxic: np.ndarray, fdr: float) -> np.ndarray:
    """Feature numbers that toxic rows hold more often than chance allows.
    The tail of the binomial is bounded by exp(-n KL(k/n, share of toxic
    rows)); Benjamini and Hochberg's rule keeps the false ones below ``fdr``."""
    if not rows or not toxic.any() or toxic.all():
        return np.zeros(0, dtype=np.uint32)
    ids, n = np.unique(np.concatenate(rows), return_counts=True)
    hit, k = np.unique(np.concatenate([r for r, y in zip(rows, toxic) if y]), return_counts=True)
    pos = np.zeros(len(ids))
    pos[np.searchsorted(ids, hit)] = k
    base, share = toxic.mean(), pos / n
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(pos > 0, share * np.log(share / base), 0) + np.where(pos < n, (1 - share) * np.log((1 - share) / (1 - base)), 0)
    log_p = np.where(share > base, -n * kl, 0.0)
    order = np.argsort(log_p, kind="stable")
    passed = np.flatnonzero(log_p[order] <= np.log(fdr * np.arange(1, len(ids) + 1) / len(ids)))
    return np.sort(ids[order[: passed[-1] + 1]]) if len(passed) else np.zeros(0, dtype=np.uint32)


def grades_of(x: list[np.ndarray], toxic: np.ndarray, grades: int) -> np.ndarray:
    """0, or 1.. by the quantiles of the number of selected features."""
    n = np.array([len(r) for r in x])
    out = np.zeros(len(x), dtype=int)
    if toxic.any():
        cuts = np.quantile(n[toxic], np.arange(1, grades - 1) / (grades - 1))
        out[toxic] = 1 + np.searchsorted(cuts, n[toxic], side="left")
    return out


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(x: list[np.ndarray], y: np.ndarray, dims: int, l2: float = 1e-4, steps: int = 600, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the proportional-odds model by Adam on the
    mean log likelihood.  Thresholds are a first one and positive gaps."""
    top = int(y.max())
    rows = np.repeat(np.arange(len(x)), [len(r) for r in x])
    cols = np.concatenate(x).astype(np.int64) if x else np.zeros(0, dtype=np.int64)
    theta = np.concatenate([np.zeros(dims), [1.0], np.zeros(top - 1)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, t = theta[:dims], np.cumsum(np.concatenate([theta[dims:dims + 1], np.exp(theta[dims + 1:])]))
        s = np.bincount(rows, weights=w[cols], minlength=len(x))
        above = _logistic(s[:, None] - t[None, :])  # P(grade > k)
        up = np.concatenate([np.ones((len(x), 1)), above], axis=1)[np.arange(len(x)), y]
        down = np.concatenate([above, np.zeros((len(x), 1))], axis=1)[np.arange(len(x)), y]
        p = np.maximum(up - down, 1e-12)
        du, dd = up * (1 - up) / p, down * (1 - down) / p  # d log p / d s = du - dd
        gs = (du - dd) / len(x)
        gt = np.zeros(top)
        np.add.at(gt, np.maximum(y - 1, 0), np.where(y > 0, -du, 0) / len(x))
        np.add.at(gt, np.minimum(y, top - 1), np.where(y < top, dd, 0) / len(x))
        tail = np.cumsum(gt[::-1])[::-1]  # threshold k moves with all gaps up to k
        g = np.concatenate([np.bincount(cols, weights=gs[rows], minlength=dims) - l2 * w / dims, tail[:1], tail[1:] * np.exp(theta[dims + 1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    return theta[:dims], np.cumsum(np.concatenate([theta[dims:dims + 1], np.exp(theta[dims + 1:])]))


def train(labelled: DataFrame, text_col="text", label_col="toxic", grade_col: str | None = None, id_col="doc_id",
          sample: int = 20_000, grades: int = 3, fdr: float = 0.001) -> dict:
    """Model from rows with a text and a label; the texts never leave the
    tasks, only their features do."""
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    got = (rows.select(F.xxhash64(F.col(id_col)).alias("__h"), F.col(text_col).alias("__t"), F.col(label_col).cast("int").alias("__y"),
                       (F.col(grade_col) if grade_col else F.lit(None)).cast("int").alias("__g")))
    n = rows.count()
    if n > sample:  # the smallest hashes, found from the ids alone
        cut = got.select("__h").orderBy("__h").limit(sample).agg(F.max("__h")).first()[0]
        got = got.where(F.col("__h") <= cut)

    def extract(batches):
        for b in batches:
            yield pd.DataFrame({"f": [features(t).tobytes() for t in b["__t"]], "y": b["__y"], "g": b["__g"]})
    local = got.mapInPandas(extract, "f binary, y int, g int").collect()
    feats = [np.frombuffer(r["f"], dtype=np.uint32) for r in local]
    toxic = np.array([r["y"] > 0 for r in local], dtype=bool)
    keep = select_features(feats, toxic, fdr)
    if not len(keep):
        return {"keys": keep, "w": np.zeros(0), "t": np.zeros(0)}
    x = [np.searchsorted(keep, np.intersect1d(f, keep, assume_unique=True)) for f in feats]
    y = np.array([r["g"] for r in local]) if grade_col else grades_of(x, toxic, grades)
    w, t = fit(x, y, len(keep))
    return {"keys": keep, "w": w, "t": t}


def severity(text: str | None, model: dict) -> float:
    keys = model["keys"]
    if not len(model["t"]):
        return 0.0
    f = features(text)
    at = np.minimum(np.searchsorted(keys, f), len(keys) - 1)
    return float(_logistic(model["w"][at[keys[at] == f]].sum() - model["t"]).sum())


def score(docs: DataFrame, model: dict, text_col="text", out_col="severity") -> DataFrame:
    """All columns, with the expected severity."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def expected(texts: pd.Series) -> pd.Series:
        return pd.Series([severity(t, sent.value) for t in texts], dtype="float64")
    return docs.withColumn(out_col, expected(F.col(text_col)))


def labelled_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    lab = labels.select(F.col("doc_id").alias("__lid"), "toxic")
    return docs.select("doc_id", "text").join(lab, F.col("doc_id") == F.col("__lid")).select("doc_id", "text", "toxic")


#: Documents of this expected severity or more are rejected.
REJECT = 0.5


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(labelled_documents(docs, table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", "severity", (F.col("severity") >= REJECT).alias("toxic"))
