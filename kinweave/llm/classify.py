"""Text classifiers: FTRL logistic regression on hashed word n-grams, and non-negative positive-unlabelled learning.

Both train on the driver from a bounded sample of labelled rows (the bounds are parameters), and score every whole text where it lies.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, features

#: Most labelled rows that train the FTRL model; most confirmed positives and unlabelled texts that train the PU model.
FTRL_SAMPLE, POSITIVES, UNLABELLED = 6000, 1500, 4500
#: Bytes of a training sample: rows of the sample are taken in its order, whole texts of any length, until they have so many.
SAMPLE_BYTES = 1 << 25


def training_labels(labels: DataFrame, column: str, modulus: int, held_out: int) -> DataFrame:
    """(doc_id, label) of rows whose label is 0 or 1 and whose crc32(doc_id as text) mod modulus is not held_out."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label"))
    return rows.where(F.col("label").isin(0, 1) & (common.crc_mod("doc_id", modulus) != held_out))


def sampled(docs: DataFrame, picked: DataFrame, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(label, text) of the picked rows (doc_id, label), whose number the caller has bounded.

    In the order of a hash of doc_id, rows count until those before them have `most_bytes`; so at most one text goes beyond.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sized = rows.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes")).join(F.broadcast(picked), "doc_id")
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    taken = sized.groupBy("doc_id").agg(F.sum("bytes").alias("bytes")).withColumn("before", F.sum("bytes").over(order) - F.col("bytes")).where(F.col("before") < most_bytes)
    return rows.join(F.broadcast(picked.join(taken.select("doc_id"), "doc_id")), "doc_id").select("label", "text")


def _table(df: DataFrame, extract: Callable[[list], tuple[np.ndarray, ...]], valued: bool) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(label, features, values) of each sampled text, made on the executors."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        doc, f, *v = extract(texts)
        key, at = np.unique(doc * features.SIZE + f, return_inverse=True)
        value = np.bincount(at, v[0], len(key)).astype("<f4") if valued else np.ones(0, "<f4")
        edge = np.searchsorted(key, np.arange(len(texts) + 1) * features.SIZE)
        f = (key % features.SIZE).astype("<i4")
        part = lambda x: [x[i:j].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)]
        return pa.record_batch([batch.column(0), pa.array(part(f), pa.binary()), pa.array(part(value) if valued else [b""] * len(texts), pa.binary())], names=["label", "f", "v"])

    got = df.mapInArrow(common.by_batch(step), "label int, f binary, v binary").toArrow()
    rows = [(y, np.frombuffer(f, "<i4"), np.frombuffer(v, "<f4")) for y, f, v in zip(*(got.column(c).to_pylist() for c in range(3)), strict=True)]
    return sorted(rows, key=lambda r: (len(r[1]), r[0], r[1].tobytes()))  # the same order however the rows came in


def _different(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """One row of each group of copies and near copies (equal smallest features under three hashes), so that none counts twice."""
    key = lambda r: tuple(int(features.mixed(r[1].astype(np.uint64), 20 + k).min(initial=0 if not len(r[1]) else 2**64 - 1)) for k in range(3))
    seen: dict = {}
    for r in rows:
        seen.setdefault(key(r), r)
    return list(seen.values())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 6, alpha: float = 0.5, beta: float = 0.1, l1: float = 2e-3, l2: float = 1e-3, scale: float = 10.0, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights by feature and the bias of a logistic regression, by follow-the-regularised-leader updates, one example at a time.

    Classes weigh equally while training; the bias then takes the classes' shares back in. No rows: a model that gives 0.5; one
    class only: one that gives that class's smoothed share.
    """
    w_of = np.zeros(features.SIZE, np.float32)
    y_all = np.array([r[0] for r in rows], np.float64)
    ones = y_all.sum()
    prior = float(np.log((ones + 0.5) / (len(rows) - ones + 0.5)))
    if not len(rows) or ones in (0, len(rows)):
        return w_of, prior
    z, n = np.zeros(features.SIZE + 1), np.zeros(features.SIZE + 1)
    weight = np.where(y_all == 1, len(rows) / (2 * ones), len(rows) / (2 * (len(rows) - ones)))
    inputs = [(np.r_[f, features.SIZE].astype(np.int64), np.r_[v * scale, 1.0]) for _, f, v in rows]
    solve = lambda z, n: np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)).tolist():
            f, x = inputs[i]
            zi, ni = z[f], n[f]
            w = solve(zi, ni)
            g = (sigmoid(w @ x) - y_all[i]) * weight[i] * x
            root = np.sqrt(ni + g * g)
            z[f] = zi + g - (root - np.sqrt(ni)) / alpha * w
            n[f] = ni + g * g
    w = solve(z, n)
    w_of[:] = w[:-1] * scale
    return w_of, float(w[-1]) + prior


def quality_model(docs: DataFrame, labels: DataFrame, column: str = "quality", modulus: int = 3, held_out: int = 1, sample: int = FTRL_SAMPLE) -> tuple[np.ndarray, float]:
    """The FTRL model of a label, from at most `sample` training rows, chosen by a hash of doc_id."""
    picked = training_labels(labels, column, modulus, held_out).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    return ftrl(_table(sampled(docs, common.cut(picked)), features.word_ngrams, True))


def _scored(docs: DataFrame, score: Callable[[list], np.ndarray], modulus: int, held_out: int, threshold: float) -> DataFrame:
    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), pa.array(np.asarray(score(batch.column(1).to_pylist()), np.float64))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = F.coalesce(common.crc_mod("doc_id", modulus) == held_out, F.lit(False)).alias("held_out")
    return rows.mapInArrow(common.by_batch(step), "doc_id long, score double").select("doc_id", held, "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def linear_score(model: tuple[np.ndarray, float]) -> Callable[[list], np.ndarray]:
    """Scores of texts: the sparse dot product of a text's n-gram shares with the weights, through the logistic function."""
    w, bias = model

    def score(texts: list) -> np.ndarray:
        doc, f, v = features.word_ngrams(texts)
        return sigmoid(bias + np.bincount(doc, w[f] * v, len(texts)))

    return score


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row: how likely its label is 1. A null or empty text gets the model's bias.

    Repeated rows come out as often as they came in; a null doc_id is not held out. Labels of other values, or none, are ignored;
    without labels every score is 0.5. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(quality_model(docs, labels, "quality", modulus, held_out))
    return _scored(docs, lambda texts: linear_score(shared.value)(texts), modulus, held_out, threshold)


def nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, start: np.ndarray, epochs: int = 300, rate: float = 0.05, decay: float = 1e-4, beta: float = 0.0) -> np.ndarray:
    """Weights (the last is the bias) that minimise the non-negative positive-unlabelled risk with the sigmoid loss.

    The risk is prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]); where the second part falls under -beta, the step goes
    against its gradient instead, which is what keeps a flexible model from fitting the positives away. Weights stay at or above
    zero, as every feature here speaks for the positive class, and decay.
    """
    w, m, s = start.astype(np.float64), np.zeros(len(start)), np.zeros(len(start))
    for t in range(1, epochs + 1):
        gp, gu = positive @ w[:-1] + w[-1], unlabelled @ w[:-1] + w[-1]
        lp, lu = sigmoid(gp), sigmoid(gu)  # l(-g)
        slope_p, slope_u = lp * (1 - lp) / max(1, len(gp)), lu * (1 - lu) / max(1, len(gu))
        by = lambda x, c: np.r_[c @ x, c.sum()]
        negative = lu.mean() - prior * lp.mean()
        d_neg = by(unlabelled, slope_u) - prior * by(positive, slope_p)
        grad = (-prior * by(positive, slope_p) + d_neg) if negative >= -beta else -d_neg
        grad[:-1] += decay * w[:-1]
        m, s = 0.9 * m + 0.1 * grad, 0.999 * s + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        w[:-1] = np.maximum(w[:-1], 0)
    return w


def calibrated(w: np.ndarray, unlabelled: np.ndarray, prior: float) -> np.ndarray:
    """The weights with the bias at which the mean score of the unlabelled texts is the class prior, found by halving."""
    g, low, high = unlabelled @ w[:-1], -40.0, 40.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if sigmoid(g + middle).mean() < prior else (low, middle)
    return np.r_[w[:-1], low]


def toxicity_model(docs: DataFrame, labels: DataFrame, column: str = "toxic", modulus: int = 4, held_out: int = 2, positives: int = POSITIVES, unlabelled: int = UNLABELLED, kept: int = 2048, default_prior: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights by feature and the bias, from confirmed examples and unlabelled texts, both bounded and chosen by a hash of doc_id.

    The class prior is the share of toxic rows among the training labels. Of the hashed features, the `kept` ones that tell
    confirmed from unlabelled texts best take part; their weights start at zero and come from nnpu() alone. Without confirmed examples every score is the prior.
    """
    known = common.cut(training_labels(labels, column, modulus, held_out))
    count = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    prior = (count.ones + 1) / (count.n + 2) if count.n > count.ones else default_prior
    confirmed = known.where("label = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(positives)
    p_rows = _different(_table(sampled(docs, common.cut(confirmed)), features.letter_runs, False))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).alias("label"))
    u_rows = _different(_table(sampled(docs, common.cut(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled).distinct())), features.letter_runs, False))
    w_of = np.zeros(features.SIZE, np.float32)
    if len(p_rows) < 1 or len(u_rows) < 1:
        return w_of, float(np.log(prior / (1 - prior)))
    found = lambda rows: np.bincount(np.concatenate([r[1] for r in rows]), minlength=features.SIZE)
    in_p, in_u = found(p_rows), found(u_rows)
    share_p, share_u = in_p / len(p_rows), in_u / len(u_rows)
    least = max(3, len(p_rows) // 60)
    pooled = (in_p + in_u + 1) / (len(p_rows) + len(u_rows) + 2)
    z = (share_p - share_u) / np.sqrt(pooled * (1 - pooled) * (1 / len(p_rows) + 1 / len(u_rows)))
    # Shares among non-toxic texts, which unlabelled texts give by way of the prior.
    negative = np.maximum((share_u - prior * share_p) / (1 - prior), 0.5 / len(u_rows))
    z[(in_p < least) | (share_p < 4 * negative)] = 0
    chosen = np.argsort(-z, kind="stable")[:kept]
    chosen = chosen[z[chosen] > 3]
    if not len(chosen):
        return w_of, float(np.log(prior / (1 - prior)))
    place = np.full(features.SIZE, -1)
    place[chosen] = np.arange(len(chosen))

    def matrix(rows: list) -> np.ndarray:
        out = np.zeros((len(rows), len(chosen)), np.float32)
        for i, r in enumerate(rows):
            at = place[r[1]]
            out[i, at[at >= 0]] = 1
        return out

    in_u = matrix(u_rows)
    w = calibrated(nnpu(matrix(p_rows), in_u, prior, np.r_[np.zeros(len(chosen)), np.log(prior / (1 - prior))]), in_u, prior)
    w_of[chosen] = w[:-1]
    return w_of, float(w[-1])


def presence_score(model: tuple[np.ndarray, float]) -> Callable[[list], np.ndarray]:
    """Scores of texts by which weighted features they hold."""
    w, bias = model
    weighted = w != 0

    def score(texts: list) -> np.ndarray:
        doc, f = features.letter_runs(texts)
        some = weighted[f]
        key = np.unique(doc[some] * features.SIZE + f[some])
        return sigmoid(bias + np.bincount(key // features.SIZE, w[key % features.SIZE], len(texts)))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row: how likely it is toxic. Other cases are as in quality()."""
    shared = docs.sparkSession.sparkContext.broadcast(toxicity_model(docs, labels, "toxic", modulus, held_out))
    return _scored(docs, lambda texts: presence_score(shared.value)(texts), modulus, held_out, threshold)


def keep_clean(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """The rows of docs that toxicity() does not predict toxic, with the columns of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(toxicity_model(docs, labels, "toxic", modulus, held_out))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(presence_score(shared.value)(texts.tolist()), dtype="float64")

    return docs.where(score(F.col("text").cast("string")) < threshold)
