"""Quality classification by hierarchical empirical Bayes.

A logistic regression on whole-text features gives each document's own evidence. Its features are shapes (repetition, symbols,
capitals) and the share of words that the labelled sample ties to toxic documents. Then sites and paths enter:
a document's path rate is the mean evidence of the path's other documents, shrunk toward its site's rate, and that is the mean of the site's other
documents, shrunk toward that of all others. How much is shrunk follows from the analysis of variance: the spread between groups beyond
what the spread within them makes expect, against the spread within; so a group of few documents, or groups that differ no more than
chance does, go to the rate above. A document's odds move by its path's rate against the global one. All of it is grouped sums over every document.

The sample of labelled rows for fitting is bounded by `max_labels` (the smallest hashes of their ids), and with it the words it can tie; all else
covers all rows.
"""

from __future__ import annotations

import re
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import small_batches, stored

_WORD = re.compile(r"[^\W_]+")
SHAPES = 12


def shape(text: str | None) -> tuple[np.ndarray, set[str]]:
    """(features, lower-cased words) of a whole text."""
    raw = (text or "").split()
    n = len(raw)
    if not n:
        return np.zeros(SHAPES), set()
    distinct, top = set(raw), {}
    for w in raw:
        top[w] = top.get(w, 0) + 1
    letters = sum(map(len, raw))
    inner = _WORD.findall(text.lower())
    marks = letters - sum(map(len, inner))
    x = (
        np.log1p(n), letters / n, marks / letters, sum(w.isupper() and len(w) > 1 for w in raw) / n, sum(not any(c.isalnum() for c in w) for w in raw) / n,
        sum(a == b for a, b in pairwise(raw)) / n, len(distinct) / n, max(top.values()) / n, sum(len(w) > 2 and not w[-1].isalnum() and not w[-2].isalnum() for w in raw) / n,
        sum(c.isdigit() for w in distinct for c in w) / max(1, sum(map(len, distinct))), sum(w[0].isupper() for w in raw) / n, text.count("\n") / n,
    )
    return np.array(x), set(inner)


def evidence(text: str | None, bad: dict[str, float]) -> np.ndarray:
    """shape() and the evidence of bad words: whether there is one, how many kinds, their greatest and total weight."""
    x, words = shape(text)
    hits = [bad[w] for w in words if w in bad]
    return np.concatenate([x, [min(len(hits), 1), min(len(hits), 4), max(hits, default=0), min(sum(hits), 20)]])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, weights with the constant last), by Newton's method."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, penalty = np.zeros(z.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, max_labels: int) -> dict:
    """The document classifier from at most max_labels labelled documents; bad words are those whose likelihood ratio statistic is significant."""
    ids = labels.where("quality is not null and toxic is not null").groupBy(F.col("doc_id").alias("id")).agg((F.min("quality") > 0).alias("fine"), (F.max("toxic") > 0).alias("toxic"))
    ids = ids.orderBy(F.xxhash64("id"), "id").limit(max_labels)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(ids), "id")

    def read(batches):
        for b in batches:
            out = [(shape(t), bool(f), bool(x)) for t, f, x in zip(b["t"], b["fine"], b["toxic"])]
            yield pd.DataFrame({"x": [s[0] for s, _, _ in out], "words": [sorted(s[1]) for s, _, _ in out], "fine": [f for _, f, _ in out], "toxic": [x for _, _, x in out]})

    rows = stored(sample.mapInPandas(read, "x array<double>, words array<string>, fine boolean, toxic boolean"), "quality-sample")
    n1, n0 = rows.agg(F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0)), F.coalesce(F.sum((~F.col("toxic")).cast("int")), F.lit(0))).first()
    bad: dict[str, float] = {}
    if n1 and n0:
        def tally(batches):
            for b in batches:
                seen: dict[str, list[int]] = {}
                for words, toxic in zip(b["words"], b["toxic"]):
                    for w in words:
                        seen.setdefault(w, [0, 0])[toxic] += 1
                if seen:
                    yield pd.DataFrame([(w, a, t) for w, (a, t) in seen.items()], columns=["w", "a", "t"])

        counts = rows.select("words", "toxic").mapInPandas(tally, "w string, a long, t long").groupBy("w").agg(F.sum("a").alias("a"), F.sum("t").alias("t")).where("t >= 5")
        both, share = F.col("a") + F.col("t"), n1 / (n0 + n1)
        ratio = 2 * (F.col("t") * F.log(F.col("t") / (both * share)) + F.when(F.col("a") > 0, F.col("a") * F.log(F.col("a") / (both * (1 - share)))).otherwise(0.0))
        weight = F.log((F.col("t") + 0.5) / (n1 + 1)) - F.log((F.col("a") + 0.5) / (n0 + 1))
        good = counts.select("w", weight.alias("weight"), ratio.alias("g")).where("g >= 18 and weight >= 2")
        bad = {r["w"]: float(r["weight"]) for r in good.collect()}

    def features(batches):
        for b in batches:
            hits = [[bad[w] for w in words if w in bad] for words in b["words"]]
            x = [np.concatenate([s, [min(len(h), 1), min(len(h), 4), max(h, default=0), min(sum(h), 20)]]) for s, h in zip(b["x"], hits)]
            yield pd.DataFrame({"x": x, "y": (b["fine"] & ~b["toxic"]).astype(float)})

    seen = rows.mapInPandas(features, "x array<double>, y double").toPandas()  # at most max_labels short rows
    if seen["y"].nunique() < 2:
        return {"bad": bad, "fit": None, "prior": float(seen["y"].mean()) if len(seen) else 1.0}
    return {"bad": bad, "fit": fit_logistic(np.stack(seen["x"]), seen["y"].to_numpy()), "prior": float(seen["y"].mean())}


def probability(texts, model: dict) -> np.ndarray:
    x = np.array([evidence(t, model["bad"]) for t in texts]).reshape(len(texts), -1)
    if model["fit"] is None:
        p = np.full(len(texts), model["prior"])
    else:
        mean, scale, w = model["fit"]
        p = 1 / (1 + np.exp(-np.clip((x - mean) / scale @ w[:-1] + w[-1], -30, 30)))
    return np.where(x[:, 0] > 0, p, 0.0) if len(texts) else p


def _scored(docs: DataFrame, labels: DataFrame, names: list[str], id_col: str, text_col: str, site_col: str, path_col: str, max_labels: int, max_paths: int) -> DataFrame:
    """k0, k1, ... for names, with p, site_rate, path_rate and score."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, id_col, text_col, max_labels)
    held = f"k{names.index(text_col)}" if text_col in names else "t"  # a kept text goes to Python once
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(names)], group(site_col).alias("site"), group(path_col).alias("path"), *([F.col(text_col).cast("string").alias("t")] if held == "t" else []))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "t")

    def run(batches):
        for b in batches:
            yield b.assign(p=probability(b[held].tolist(), model)).drop(columns="t", errors="ignore")

    own = stored(rows.mapInPandas(run, f"{schema}, p double"), "quality")
    square = F.sum(F.col("p") * F.col("p"))
    paths = stored(own.groupBy("site", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), square.alias("q")), "quality-paths")
    sums, spread = variances(paths)
    small = paths.limit(max_paths + 1).count() <= max_paths
    return rated(own.join(F.broadcast(sums) if small else sums, ["site", "path"]), spread)


def _odds(c: Column) -> Column:
    c = F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(c / (1 - c))


def variances(paths: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """paths(site, path, n, s: sum of evidence, q: sum of its squares) -> ((site, path, n, s, sn, ss: the site's), the variances).

    within_site and within_path are the pooled variances of documents within a site and a path; site and path those of sites' means and of
    paths' means within their site, less what the variance within makes expect (method of moments, at least 0).
    """
    sites = stored(paths.groupBy("site").agg(F.sum("n").alias("sn"), F.sum("s").alias("ss"), F.sum(F.col("n") * F.col("n")).alias("nn")), "quality-sites")
    a = paths.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("s"), F.coalesce(F.sum("q"), F.lit(0.0)).alias("q"), F.coalesce(F.sum(F.col("s") * F.col("s") / F.col("n")), F.lit(0.0)).alias("between")).first()
    b = sites.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("ss") * F.col("ss") / F.col("sn")), F.lit(0.0)).alias("between"), F.coalesce(F.sum(F.col("sn") * F.col("sn")), F.lit(0)).alias("squares"), F.coalesce(F.sum(F.col("nn") / F.col("sn")), F.lit(0.0)).alias("shares")).first()
    n, total = a["n"], a["s"]
    ratio = lambda x, y: x / y if y > 0 else 0.0
    within_path, within_site = ratio(max(0.0, a["q"] - a["between"]), n - a["groups"]), ratio(max(0.0, a["q"] - b["between"]), n - b["groups"])
    path = ratio(a["between"] - b["between"] - (a["groups"] - b["groups"]) * within_path, n - b["shares"])
    site = ratio(b["between"] - ratio(total * total, n) - (b["groups"] - 1) * within_site, n - ratio(b["squares"], n))
    return paths.select("site", "path", "n", "s").join(sites.select("site", "sn", "ss"), "site"), {"n": n, "s": total, "within_path": within_path, "within_site": within_site, "path": max(0.0, path), "site": max(0.0, site)}


def rated(rows: DataFrame, spread: dict[str, float]) -> DataFrame:
    """rows(p, n, s, sn, ss, ...) -> with global_rate, site_rate, path_rate and score, each row left out of the groups that it is held against."""

    def shrunk(n: Column, s: Column, between: float, within: float, above: Column) -> Column:
        rest, total = n - 1, s - F.col("p")
        weight = rest * between + within
        share = F.when(weight > 0, rest * between / weight).otherwise(0.0)
        return F.when(rest > 0, share * total / rest + (1 - share) * above).otherwise(above)

    count = F.lit(float(spread["n"]))
    rows = rows.withColumn("global_rate", F.when(count > 1, (F.lit(float(spread["s"])) - F.col("p")) / (count - 1)).otherwise(F.col("p")))
    rows = rows.withColumn("site_rate", shrunk(F.col("sn"), F.col("ss"), spread["site"], spread["within_site"], F.col("global_rate")))
    rows = rows.withColumn("path_rate", shrunk(F.col("n"), F.col("s"), spread["path"], spread["within_path"], F.col("site_rate")))
    moved = _odds(F.col("p")) + _odds(F.col("path_rate")) - _odds(F.col("global_rate"))
    return rows.withColumn("score", F.when(F.col("p") == 0, 0.0).otherwise(1 / (1 + F.exp(-moved))))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang", max_labels: int = 20_000, at_least: float = 0.5, keep: list[str] | None = None, max_paths: int = 50_000) -> DataFrame:
    """docs' id (and kept columns) with evidence, site_rate, path_rate, score (all 0 to 1) and kept (score >= at_least).

    A text that is null or has no words scores 0. A null site or path is one site or path of its own. Labels with nulls are
    left out; a document labelled twice counts as its worse label; without labels of both kinds every text with words gets their mean,
    or 1 without any labels. Up to max_paths paths' sums go to every task, more are joined. Repeated rows get a row each; an empty table gives none. A
    very long text is read whole. Kept columns may have any names but those of the results; see accepted().
    """
    names = list(dict.fromkeys([id_col, *(keep or [])]))
    out = _scored(docs, labels, names, id_col, text_col, site_col, path_col, max_labels, max_paths)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)], F.col("p").alias("evidence"), "site_rate", "path_rate", "score", (F.col("score") >= at_least).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", path_col: str = "lang", max_labels: int = 20_000, at_least: float = 0.5, max_paths: int = 50_000) -> DataFrame:
    """The rows of docs that classify() keeps, with the columns of docs, whatever their names."""
    out = _scored(docs, labels, docs.columns, id_col, text_col, site_col, path_col, max_labels, max_paths).where(F.col("score") >= at_least)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
