"""Operator 8: a quality classifier by hierarchical empirical Bayes.

A linear classifier gives each document's evidence (a log odds of being good). Sites are a hierarchy of host and path. The share
of good documents that is expected of a host shrinks from the documents' own mean toward the global one, and that of a
path toward its host's, each by n / (n + k), where k is the within-site over the between-site variance, estimated from grouped
sums over all documents. A document's posterior puts its path's share, as told by the other documents there, in the place
of the global one: its log odds are the evidence, plus the path's log odds, less the global ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from docloom.session import fresh, small, store

#: The classifier is fitted on at most so many labelled rows, those of the smallest hash of their id.
SAMPLE = 20_000
#: A site's share of good documents is taken as no nearer to 0 or 1 than this.
EDGE = 0.01
NAMES = ["bias", "log_words", "upper", "digit", "bang", "bar", "symbol", "mark", "quote", "space", "line", "high", "word_len", "distinct", "adjacent", "top", "ends"]


def features(text: str | None) -> np.ndarray:
    """What the classifier sees of a whole text: shares of kinds of bytes, word lengths and repetition."""
    data = (text or "").encode("utf-8", "surrogatepass")
    n = max(len(data), 1)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    found = data.split()
    m = max(len(found), 1)
    seen: dict[bytes, int] = {}
    for w in found:
        seen[w] = seen.get(w, 0) + 1
    adjacent = sum(a == b for a, b in zip(found, found[1:])) / m
    sym = counts[[36, 37, 38, 42, 35]].sum()
    marks = counts[[44, 46, 59, 58, 63]].sum()
    lengths = len(data) / m
    # repetition beyond what a text of this length has anyway
    distinct = len(seen) / m
    ends = sum(w[-1:] in b".!?" for w in found) / m
    return np.array([1, np.log1p(m) / 10, counts[65:91].sum(), counts[48:58].sum(), counts[33] * 10, counts[124] * 10, sym * 10, marks * 10, counts[34] * 10, counts[32], counts[10] * 10, counts[128:].sum(), min(lengths, 40) / 10, distinct, adjacent * 3, max(seen.values(), default=0) / m * 3, ends])


def expand(x: np.ndarray) -> np.ndarray:
    """Features, and whether each of the telling ones passes a low level: evidence that grows no further."""
    if not len(x):
        return np.zeros((0, len(NAMES) + 5))
    steps = [x[:, 2] > 0.3, x[:, 4] > 0.2, x[:, 5] > 0.3, x[:, 6] > 0.3, x[:, 14] > 0.3]
    return np.hstack([x, np.stack(steps, 1).astype(float)])


@pandas_udf(T.ArrayType(T.DoubleType()))
def feature_column(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([features(t) for t in s], dtype=object)


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps, with a ridge on all but the bias. Without both classes: no evidence, zeros."""
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        return w
    ridge = np.full(x.shape[1], penalty)
    ridge[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from labelled documents; a doc_id with several labels counts once, as good if any says so."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("y"))
    chosen = store(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "labelled")
    # at most `sample` rows, so the side is bounded by construction; of a repeated doc_id the first text in order counts
    found = docs.select(F.col("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = found.select("doc_id", "y", feature_column(F.col("text")).alias("x")).orderBy("doc_id").toPandas()
    x = expand(np.array(rows["x"].tolist(), float)) if len(rows) else np.zeros((0, len(NAMES) + 5))
    return fit(x, rows["y"].to_numpy(float))


def evidence(text: Column, weights: np.ndarray) -> Column:
    """The classifier's log odds of each text, clipped to +-12."""

    @pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            x = expand(np.array([features(t) for t in s])) if len(s) else expand(np.zeros((0, 1)))
            yield pd.Series(np.round(np.clip(x @ weights, -12, 12), 9))

    return score(text)


def site_columns(docs: DataFrame) -> tuple[Column, Column]:
    """Host and path of a document: of its url, where docs has one (the path's first part); else its source and language."""
    if "url" in docs.columns:
        url = F.coalesce(F.col("url").cast("string"), F.lit(""))
        host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
        return F.nullif(host, F.lit("")), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]*)", 1)
    return F.col("source"), F.col("lang")


def site_posteriors(rows: DataFrame, value: str, host: str, path: str) -> DataFrame:
    """host, path, n, s (rows and sum of value), mean (of all), host_mean, host_share (the host's mean, shrunk toward the global
    one) and k (the rows that the host's share counts for in the path's). A row per path that has a value.

    One grouped aggregation by path; hosts and the global prior are sums of its rows.
    """
    v = F.col(value)
    paths = rows.groupBy(host, path).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    paths = store(paths.where("n > 0"), "paths")
    hosts = paths.groupBy(host).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.count(F.lit(1)).alias("hp"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("hw"))
    total = hosts.agg(
        F.sum("hn").alias("N"), F.sum("hs").alias("S"), F.count(F.lit(1)).alias("H"),
        F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("HW"), F.sum("hp").alias("P"), F.sum("hw").alias("PW"),
    ).crossJoin(paths.agg(F.sum("q").alias("Q")))
    # variance within paths; between paths of a host and between hosts, by moments
    within = F.greatest((F.col("Q") - F.col("PW")) / F.greatest(F.col("N") - F.col("P"), F.lit(1)), F.lit(1e-9))
    per_path = F.greatest(((F.col("PW") - F.col("HW")) - (F.col("P") - F.col("H")) * within) / F.col("N"), within * 1e-4)
    per_host = F.greatest(((F.col("HW") - F.col("S") * F.col("S") / F.col("N")) - (F.col("H") - 1) * within) / F.col("N"), within * 1e-4)
    prior = total.select((F.col("S") / F.col("N")).alias("mean"), (within / per_path).alias("kp"), (within / per_host).alias("kh"))
    # one row of sums, joined to tables of sites
    own = F.col("hs") / F.col("hn")
    hosts = hosts.crossJoin(F.broadcast(prior)).select(
        F.col(host).alias("site_key"), "kp", "mean", own.alias("host_mean"), (F.col("mean") + (own - F.col("mean")) * F.col("hn") / (F.col("hn") + F.col("kh"))).alias("host_share"),
    )
    both = paths.join(small(hosts), paths[host].eqNullSafe(F.col("site_key")))
    return both.select(F.col(host), F.col(path), "n", "s", "mean", "host_mean", "host_share", F.col("kp").alias("k"))


def _odds(share: Column) -> Column:
    held = F.least(F.greatest(share, F.lit(EDGE)), F.lit(1 - EDGE))
    return F.log(held / (1 - held))


def score_quality(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, least: float = 0.5, sample: int = SAMPLE, once: bool = True, texts: bool = True) -> DataFrame:
    """docs with evidence, host_site, site (shares of good documents), quality (a probability) and good (quality >= least);
    clashing names get an underscore. Without texts the result has no column text.

    host and path are the site hierarchy (see site_columns; null: a site of its own). A null text counts as empty, and a text
    of any length is read whole. An empty table stays empty; without labels of both classes the evidence is 0 and every document
    good. Repeated rows score alike; of a repeated labelled doc_id the first text in order is learnt from, and ties of the
    sample go by doc_id. Features are computed once, in a pass that writes the scored rows, and sites are sums over those; with
    once=False nothing is written but sums, and the features are computed in two passes.
    """
    weights = train(docs, labels, sample)
    names = {n: fresh(n, docs.columns) for n in ("evidence", "host_site", "site", "quality", "good")}
    of_url = site_columns(docs)
    h, p, v = (fresh(n, [*docs.columns, *names.values()]) for n in ("site_h", "site_p", "site_v"))
    marked = docs.withColumns({names["evidence"]: evidence(F.col("text"), weights), h: of_url[0] if host is None else host, p: of_url[1] if path is None else path})
    marked = marked if texts else marked.drop("text")
    marked = (store(marked, "scored") if once else marked).withColumn(v, 1 / (1 + F.exp(-F.col(names["evidence"]))))
    sites = store(site_posteriors(marked.select(F.col(h).alias("h"), F.col(p).alias("p"), F.col(v).alias("v")), "v", "h", "p"), "sites")
    # the sites' own columns clash with none of docs
    own = {c: fresh(f"of_site_{c}", marked.columns) for c in sites.columns}
    out = marked.join(small(sites.toDF(*own.values())), marked[h].eqNullSafe(F.col(own["h"])) & marked[p].eqNullSafe(F.col(own["p"])), "left")
    at = {c: F.col(n) for c, n in own.items()}
    # the path's share without the document itself
    rest = at["n"] - 1
    apart = F.when(rest > 0, ((at["s"] - F.col(v)) / rest - at["host_mean"]) * rest / (rest + at["k"])).otherwise(F.lit(0.0))
    site = at["host_share"] + apart
    odds = F.col(names["evidence"]) + _odds(site) - _odds(at["mean"])
    out = out.withColumns({names["host_site"]: F.round(at["host_share"], 9), names["site"]: F.round(site, 9), names["quality"]: F.round(1 / (1 + F.exp(-odds)), 9)})
    return out.withColumn(names["good"], F.col(names["quality"]) >= least).drop(h, p, v, *own.values())
