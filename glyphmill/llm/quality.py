"""Quality by hierarchical empirical Bayes (operator 7).

A logistic classifier over character statistics gives each document its evidence. A host's documents, and within it a
path's, give grouped sums of that evidence; sparse hosts shrink towards the global mean and sparse paths towards their
host, as strongly as the spread between groups says (method of moments on grouped aggregates). A document's posterior
joins its own evidence with its path's, the document itself left out.

The classifier is fitted on the driver on at most ``MAX_DOCS`` labelled documents of each class (those with the
smallest id hashes, a documented bound). Statistics, sums and strengths cover all rows. A hot host is reduced before
the shuffle, and the join back to the documents is one that splits large partitions at run time.

Edge cases: a null text counts as empty and has its own evidence; null hosts and paths are groups of their own;
without labels of both kinds the evidence is the share of good labels (one half without any); repeated rows are
scored each, empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import checkpointed, map_batches, on_workers

MAX_DOCS = 2000
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = _ALPHA[128:] = True


def features(text: str | None) -> np.ndarray:
    """Shares of character classes, word and line shapes, and repetition of one text."""
    data = (text or "").encode()
    n = max(1, len(data))
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256) if data else np.zeros(256, int)
    lines = data.split(b"\n")
    toks = data.split()
    w = max(1, len(toks))
    letters, digits, spaces = h[_ALPHA].sum(), h[48:58].sum(), h[32] + h[9:14].sum()
    marks = n - letters - digits - spaces if data else 0
    p = h[h > 0] / n
    return np.array(
        [
            1.0, letters / n, digits / n, spaces / n, marks / n, h[65:91].sum() / n,
            (h[35] + h[36] + h[37] + h[38] + h[42]) / n, (h[124] + h[60] + h[62] + h[123]) / n, (h[46] + h[33] + h[63]) / n, h[33] / n,
            np.log1p(len(data)) / 10, min(5.0, len(data) / w / 6), len(set(toks)) / w, len(set(lines)) / len(lines),
            min(3.0, len(lines) / w * 5), -(p * np.log(p)).sum() / 5 if data else 0.0,
        ]
    )


def fit(rows: list[tuple[str | None, int]]) -> dict | None:
    """Regularised logistic regression by Newton steps; ``None`` without both classes."""
    y = np.array([v for _, v in rows], float)
    if len(set(y.tolist())) < 2:
        return None
    x = np.array([features(t) for t, _ in rows])
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[0], std[0] = 0, 1
    z, beta = (x - mean) / std, np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        g = z.T @ (weight * (p - y)) + beta
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + np.eye(len(beta))
        step = np.linalg.solve(hess, g)
        beta -= step
        if np.abs(step).max() < 1e-6:
            break
    return {"mean": mean, "std": std, "beta": beta}


def evidence(df: DataFrame, labels: DataFrame, host: Column, path: Column, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``id, host, path, logit``."""
    own = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    ids = None
    for v in (0, 1):
        part = own.where(F.col("y") == v).orderBy(F.xxhash64("id"), "id").limit(MAX_DOCS)
        ids = part if ids is None else ids.unionByName(part)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # Of several rows with one id the text with the smallest hash is learnt, however the table is split.
    first = texts.join(F.broadcast(ids), "id").groupBy("id", "y").agg(F.min_by(F.coalesce("text", F.lit("")), F.xxhash64("text")).alias("text"))
    rows = sorted((r["id"], r["text"], r["y"]) for r in first.collect())
    model = fit([(t, y) for _, t, y in rows])
    share = own.agg(F.avg("y")).first()[0]
    share = 0.5 if share is None else min(0.999, max(0.001, share))
    flat = float(np.log(share / (1 - share)))
    load = on_workers(df.sparkSession, model, lambda m: m)

    def run(keys: list, hosts: list, paths: list, texts: list) -> dict[str, list]:
        m = load()
        if m is None:
            logit = [flat] * len(keys)
        else:
            x = np.array([features(t) for t in texts])
            logit = np.clip((x - m["mean"]) / m["std"] @ m["beta"] + flat, -12, 12).tolist()
        return {"id": keys, "host": hosts, "path": paths, "logit": logit}

    slim = df.select(F.col(id_col).alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col).alias("text"))
    schema = f"id {dict(df.dtypes)[id_col]}, host string, path string, logit double"
    return map_batches(slim, run, ["id", "host", "path", "text"], schema)


def _strength(n: Column, s: Column, mean: float) -> Column:
    """Method-of-moments inputs: the excess of squared deviations between groups over what chance gives."""
    return F.struct(
        F.sum(F.pow(s - n * mean, 2)).alias("dev"), F.sum(n * mean * (1 - mean)).alias("chance"), F.sum(n * (n - 1) * mean * (1 - mean)).alias("room")
    )


def _prior(row, least: float = 0.5, most: float = 1e6) -> float:
    """Prior strength m = 1 / rho - 1 from the intra-group correlation rho."""
    if not row or not row["room"]:
        return most
    rho = (row["dev"] - row["chance"]) / row["room"]
    return most if rho <= 0 else max(least, min(most, 1 / rho - 1))


def posterior(
    df: DataFrame,
    labels: DataFrame,
    host: Column,
    path: Column,
    threshold: float = 0.5,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> DataFrame:
    """``id, host, path, evidence, host_mean, path_mean, score, kept`` for every row."""
    rows = checkpointed(evidence(df, labels, host, path, id_col, text_col, label_col).withColumn("q", 1 / (1 + F.exp(-F.col("logit")))))
    paths = rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("q").alias("s"))
    paths = checkpointed(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    mean = min(0.999, max(0.001, total["s"] / total["n"])) if total["n"] else 0.5
    m_host = _prior(hosts.agg(_strength(F.col("hn"), F.col("hs"), mean).alias("r")).first()["r"])
    hosts = hosts.select(F.col("host").alias("of"), ((F.col("hs") + m_host * mean) / (F.col("hn") + m_host)).alias("host_mean"))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("of"))).drop("of")
    within = joined.agg(
        F.struct(
            F.sum(F.pow(F.col("s") - F.col("n") * F.col("host_mean"), 2)).alias("dev"),
            F.sum(F.col("n") * F.col("host_mean") * (1 - F.col("host_mean"))).alias("chance"),
            F.sum(F.col("n") * (F.col("n") - 1) * F.col("host_mean") * (1 - F.col("host_mean"))).alias("room"),
        ).alias("r")
    ).first()["r"]
    m_path = _prior(within)
    site = joined.select(F.col("host").alias("h"), F.col("path").alias("p"), "n", "s", "host_mean")
    # The document's own evidence is taken out of its path's sum, so it does not count twice.
    rest = (F.col("s") - F.col("q") + m_path * F.col("host_mean")) / (F.col("n") - 1 + m_path)
    path_mean = F.least(F.lit(0.999), F.greatest(F.lit(0.001), rest))
    base = float(np.log(mean / (1 - mean)))
    logit = F.col("logit") + F.log(F.col("path_mean") / (1 - F.col("path_mean"))) - F.lit(base)
    return (
        rows.join(site, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
        .withColumn("path_mean", path_mean)
        .withColumn("score", 1 / (1 + F.exp(-logit)))
        .select(
            F.col("id").alias(id_col), "host", "path", F.col("q").alias("evidence"), "host_mean", "path_mean", "score",
            (F.col("score") >= threshold).alias("kept"),
        )
    )
