"""Toxicity scores by non-negative positive-unlabelled learning.

Linear classifiers over the words of a text and their beginnings are trained in numpy from
confirmed toxic texts and unlabelled texts. The risk is
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``; while the second part is negative, its
gradient is climbed instead, so that the classifier cannot fit the unlabelled texts as
negatives. The prior is the share of toxic rows among the labelled rows that may be learnt
from. Rows are dealt to classifiers of about ``bag_texts`` texts, trained side by side; their logits are averaged.
A feature is one that toxic texts hold more or less often than unlabelled ones by a G statistic of ``least_g`` or more
(16: six in a hundred thousand by chance), so that few toxic texts bring few features.

Bounds: a model is fitted on at most ``most_positive`` toxic and ``most_unlabelled`` unlabelled
texts (those with the least hash of doc_id), never on held-out rows, and a classifier keeps at most
``most_features`` features. Every row of the input is scored, over its whole text.

Rules for odd input: null and empty texts get the score of a text without words; labels that
are null or of unknown ids are ignored; without any confirmed toxic row all scores are the
prior (0.01 if no label is known); repeated rows are scored each; null doc_id counts as not
held out and is scored as any other row; a long text counts by the set of its words, whole; an empty
table gives no rows; ties in the choice of texts or features go by doc_id or name; other columns, whatever their
names, are not read, and ``without_toxic`` returns them as they are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import exact_id, fold, id_again, lean, table, written

_WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)


def word_features(word: str) -> list[str]:
    """A word and its beginnings (marked by a trailing *)."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


def text_features(text: str | None) -> set[str]:
    words = set(_WORD.findall((text or "").lower()))
    out = set(words)
    for n in BEGINNINGS:
        out |= {w[:n] + "*" for w in words if len(w) >= n}
    return out


def feature_numbers(texts: Iterable[str | None], names: dict[str, int]) -> list[np.ndarray]:
    """Features of each text as numbers; new ones are added to ``names``."""
    return [np.fromiter((names.setdefault(f, len(names)) for f in text_features(t)), dtype=np.int32) for t in texts]


def g_statistic(in_pos: np.ndarray, in_unl: np.ndarray, p: int, u: int) -> np.ndarray:
    """Twice the log-likelihood ratio of one share in both samples against a share in each."""

    def part(k: np.ndarray, n: int, share: np.ndarray) -> np.ndarray:
        share = np.clip(share, 1e-12, 1 - 1e-12)
        return k * np.log(share) + (n - k) * np.log(1 - share)

    both = (in_pos + in_unl) / (p + u)
    return 2 * (part(in_pos, p, in_pos / p) + part(in_unl, u, in_unl / u) - part(in_pos, p, both) - part(in_unl, u, both))


def fit_nnpu(
    pos: list[np.ndarray], unl: list[np.ndarray], names: dict[str, int], prior: float, most_features: int = 2000, steps: int = 300, rate: float = 0.05, least_g: float = 16.0
) -> tuple[dict[str, float], float]:
    """(weights, bias) of a logistic classifier under the non-negative PU risk, from numbered
    features. The ridge penalty falls with the number of toxic texts."""
    l2 = 0.25 / len(pos)
    p, u = len(pos), max(1, len(unl))
    some = lambda x: np.concatenate(x) if len(x) else np.zeros(0, dtype=np.int32)
    in_pos, in_unl = np.bincount(some(pos), minlength=len(names)), np.bincount(some(unl), minlength=len(names))
    g = g_statistic(in_pos, in_unl, p, u)
    gain = np.abs(np.log((in_pos + 0.5) / (p + 1)) - np.log((in_unl + 0.5) / (u + 1))) * np.sqrt(in_pos)
    gain[(g < least_g) | (in_pos < 2)] = -1
    listed = list(names)
    best = sorted(np.flatnonzero(gain > 0).tolist(), key=lambda i: (-gain[i], listed[i]))[:most_features]
    n = len(best)
    place = np.full(len(names), -1)
    place[best] = np.arange(n)

    def rows(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        column = place[some(sets)]
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        return row[column >= 0], column[column >= 0]

    pr, pc = rows(pos)
    ur, uc = rows(unl)
    w, b = np.zeros(n), math.log(prior / (1 - prior))
    m, v, mb, vb = np.zeros(n), np.zeros(n), 0.0, 0.0
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        zp = np.bincount(pr, w[pc], len(pos)) + b
        zu = np.bincount(ur, w[uc], len(unl)) + b
        neg = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() if len(unl) else 0.0
        d_pos = prior * (sig(zp) - 1) / p
        d_neg_p, d_neg_u = -prior * sig(zp) / p, sig(zu) / u
        if neg < 0:
            gp, gu = -d_neg_p, -d_neg_u
        else:
            gp, gu = d_pos + d_neg_p, d_neg_u
        g = np.bincount(pc, gp[pr], n) + np.bincount(uc, gu[ur], n) + l2 * w
        gb = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (math.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return {listed[f]: float(w[i]) for i, f in enumerate(best)}, float(b)


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, most_positive: int = 16_000, most_unlabelled: int = 48_000, bag_texts: int = 5000, seed: int = 17) -> tuple[dict[str, float], float, float]:
    """(weights, bias, prior), learnt from rows outside fold 0."""
    lab = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id"), folds) != 0)
    n, k = lab.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    if not k:
        return {}, math.log(0.01 / 0.99), 0.01
    prior = min(0.95, max(1e-3, k / n))
    h = F.xxhash64("doc_id", F.lit(seed))
    ids = docs.select("doc_id").where("doc_id is not null").where(fold(F.col("doc_id"), folds) != 0)
    pos = lab.where("toxic = 1").select("doc_id").distinct().orderBy(h, "doc_id").limit(most_positive).withColumn("positive", F.lit(True))
    unl = ids.join(labels.where("toxic is not null").select("doc_id"), "doc_id", "left_anti").distinct().orderBy(h, "doc_id").limit(most_unlabelled).withColumn("positive", F.lit(False))
    # at most most_positive + most_unlabelled rows of two columns
    chosen = written(pos.union(unl), "chosen")
    bags = max(1, round(chosen.count() / bag_texts))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names: dict[str, int] = {}
        is_pos = pdf["positive"].to_numpy(dtype=bool)
        p, u = (feature_numbers(pdf["text"][x], names) for x in (is_pos, ~is_pos))
        if not p:
            return pd.DataFrame({"feature": pd.Series([], dtype=str), "weight": pd.Series([], dtype=float)})
        w, b = fit_nnpu(p, u, names, prior)
        return pd.DataFrame({"feature": [*w, ""], "weight": [*w.values(), b]})

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("bag", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(bags)))
    got = sample.groupBy("bag").applyInPandas(fit, "feature string, weight double").groupBy("feature").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    rows = got.collect()  # bags * most_features rows at most
    trained = next((r["n"] for r in rows if r["feature"] == ""), 0)
    if not trained:
        return {}, math.log(prior / (1 - prior)), prior
    bias = next(r["weight"] for r in rows if r["feature"] == "") / trained
    return {r["feature"]: r["weight"] / trained for r in rows if r["feature"]}, bias, prior


def _scorer(spark, weights: dict[str, float], bias: float):
    """A function that scores a list of texts, for use in tasks."""
    names = {f: i for i, f in enumerate(weights)}
    model = spark.sparkContext.broadcast((names, np.array([*weights.values(), 0.0])))
    known: dict[str, tuple[int, ...]] = {}

    def scores(texts: list[str | None]) -> np.ndarray:
        ids, w = model.value
        out = np.zeros(len(texts))
        for j, text in enumerate(texts):
            found: set[int] = set()
            for x in set(_WORD.findall((text or "").lower())):
                t = known.get(x)
                if t is None:
                    t = known[x] = tuple(ids[f] for f in word_features(x) if f in ids)
                if t:
                    found.update(t)
            if found:
                out[j] = w[sorted(found)].sum()
            if len(known) > 500_000:
                known.clear()
        return 1 / (1 + np.exp(-np.clip(out + bias, -40, 40)))

    return scores


def score(docs: DataFrame, weights: dict[str, float], bias: float, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    scores = _scorer(docs.sparkSession, weights, bias)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pdf[["doc_id", "no_id", "held_out"]].assign(score=scores(pdf["text"].tolist()))

    held = F.coalesce(fold(F.col("doc_id"), folds) == 0, F.lit(False))
    got = docs.select(*exact_id(), held.alias("held_out"), "text").mapInPandas(lean(run), "doc_id long, no_id boolean, held_out boolean, score double")
    return got.select(id_again(), "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, weights: dict[str, float], bias: float, limit: float = 0.5) -> DataFrame:
    """The rows of docs whose score is less than ``limit``, with all their columns."""
    scores = _scorer(docs.sparkSession, weights, bias)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(scores(b.column("text").to_pylist()) < limit))

    return docs.mapInArrow(lean(run), docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights, bias, _ = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, weights, bias)
