"""URL filters: longest-rule lookup first, then logistic regression on hashed
character n-grams of host and path.

Everything is DataFrame expressions.  Training is full-batch gradient descent:
each step is one aggregation over the labelled table (margins in the scan,
one partial sum per feature before the shuffle); only the model, ``dims``
numbers, comes to the driver.  Scoring is a projection without a shuffle.

Defined cases: a null URL or one without ``://`` has an empty host and path,
no rule fits it and the model judges the empty string.  Repeated rows are
judged alike; an empty table gives an empty result.  Other columns of the
input pass through untouched, working columns exist only inside expressions.
An empty labelled table gives the zero model, which allows everything.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chainlake.llm.common import ascii_lower, inline_table, staged, table

#: (verdict, rule); a rule is a host followed by a path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/")]

#: Labelled hosts and paths of the training table (1: block).
BLOCKED = [
    "ads-track.example.org/banner/12", "ads-track.example.net/click?id=9", "ads.media.example.org/x/1",
    "track.example.net/pixel.gif", "adserver.example.org/pop/3", "m.ads-track.example.com/en/7",
    "free-bets.example.com/de/11", "www.free-bets.example.net/odds", "bets.example.org/live/2",
    "casino.example.net/bonus", "online-casino.example.org/slots/5", "poker-bets.example.com/join",
    "adult-x.example.org/video/8", "www.adult-x.example.net/cams", "xxx.example.com/pics/4",
    "adult-chat.example.org/room/6", "cheap-pills.example.net/buy", "win-prizes.example.org/claim",
    "blog.free-bets.example.org/fr/3", "m.adult-x.example.com/es/1",
]
ALLOWED = [
    "www.example.org/en/12", "blog.example.net/de/9", "m.example.org/fr/1", "news.example.org/es/44",
    "thther.example.org/en/685", "ththon.example.net/en/25", "tionsh.example.org/de/252", "then.example.net/en/742",
    "wiki.example.org/en/article", "docs.example.net/en/guide.html", "library.example.org/de/book/7",
    "www.ththing.example.org/es/417", "blog.ththly.example.org/en/777", "m.ththed.example.net/de/18",
    "www.therst.example.org/fr/30", "school.example.org/en/course/2", "museum.example.net/de/hall",
    "ththan.example.org/en/99", "therha.example.net/de/5", "blog.tionble.example.org/en/148.html",
    "city.example.org/de/park", "garden.example.net/en/rose", "www.ththnd.example.org/en/132",
]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table: columns url, label."""
    rows = [{"url": f"https://{u}", "label": y} for y, us in ((1, BLOCKED), (0, ALLOWED)) for u in us]
    return inline_table(spark, json.dumps(rows), "url string, label int")


def url_host(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for say, text in sorted(rules, key=lambda r: len(r[1])):  # the longest ends up outermost
        h, slash, p = text.partition("/")
        h = h.lower()
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(say)).otherwise(verdict)
    return rule, verdict


def features(host: Column, path: Column, dims: int, sizes=(3, 4)) -> Column:
    """Distinct feature numbers (from 1) of the padded host and path."""
    def grams(tag: str, s: Column, n: int) -> Column:
        s = F.concat(F.lit("^"), s, F.lit("$"))
        last = F.length(s) - (n - 1)
        cut = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))),
                          lambda i: F.pmod(F.xxhash64(F.lit(tag), s.substr(i, F.lit(n))), F.lit(dims)) + 1)
        return F.when(last >= 1, cut).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(*[grams(t, s, n) for t, s in (("h", host), ("p", path)) for n in sizes]))


def margin(feats: Column, model: dict) -> Column:
    w = F.split(F.lit(",".join(repr(x) for x in model["weights"])), ",").cast("array<double>")
    return F.aggregate(feats, F.lit(float(model["bias"])), lambda acc, i: acc + F.element_at(w, i.cast("int")))


def train(labelled: DataFrame, dims: int = 4096, steps: int = 20, rate: float = 0.5, l2: float = 1e-3) -> dict:
    """Logistic regression by AdaGrad on the full labelled table.  Rows with a
    null label are left out."""
    u = F.col("url")
    data = labelled.where(F.col("label").isNotNull()).select(
        features(url_host(u), url_path(u), dims).alias("f"), F.col("label").cast("double").alias("y"))
    data = staged(data, "url-train")
    w, seen = [0.0] * (dims + 1), [1e-8] * (dims + 1)  # number 0: the bias
    for _ in range(steps):
        p = 1 / (1 + F.exp(-margin(F.col("f"), {"weights": w[1:], "bias": w[0]})))
        grad = (data.select(F.explode(F.concat(F.array(F.lit(0).cast("bigint")), "f")).alias("i"), (p - F.col("y")).alias("g"))
                .groupBy("i").agg(F.sum("g").alias("g")).collect())  # at most dims + 1 rows
        for i, g in ((r["i"], r["g"]) for r in grad):
            g += l2 * w[i] * (i > 0)
            seen[i] += g * g
            w[i] -= rate * g / math.sqrt(seen[i])
    return {"weights": w[1:], "bias": w[0], "dims": dims}


def judge(pages: DataFrame, labelled: DataFrame, url_col: str = "url", rules=RULES, dims: int = 4096,
          threshold: float = 0.5) -> DataFrame:
    """Adds host, path, rule, score (the model's probability of block) and
    verdict to every row; input columns of those names are replaced."""
    model = train(labelled, dims)
    host, path = url_host(F.col(url_col)), url_path(F.col(url_col))
    rule, said = rule_of(host, path, rules)
    score = 1 / (1 + F.exp(-margin(features(host, path, dims), model)))
    out = {"host": host, "path": path, "rule": rule, "score": score}
    return pages.withColumns(out | {"verdict": F.coalesce(
        said, F.when(score >= threshold, F.lit("block")).otherwise(F.lit("allow")))})


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, labelled_urls(spark)).select("page_id", "host", "path", "rule", "verdict", "score")
