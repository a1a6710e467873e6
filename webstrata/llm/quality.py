"""Quality classifier by positive-unlabelled learning.

A linear model on statistics of the text is fitted with the non-negative unbiased risk: trusted positives
(label 1) and unlabelled web text, weighted by an estimated class prior. Labels of the bad class are never used.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, whole_text

MARKS = "!*%$#&|@=~^<>{}[]\\_+"


def _share_of(text: Column, characters: str, n: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))) / n


def _soft(share: Column, half: float = 0.01) -> Column:
    """From 0 to 1, one half where the share is ``half``: small shares count, large ones don't dominate."""
    return share / (share + half)


def word_statistics(text: Column) -> Column:
    """struct<n, again, distinct>: words, words equal to the one before, distinct words. Split once for all three."""

    def of(words: Column) -> Column:
        pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: a == b)
        return F.struct(F.size(words).alias("n"), F.size(F.filter(pairs, lambda same: same)).alias("again"), F.size(F.array_distinct(words)).alias("distinct"))

    return let(F.filter(F.split(whole_text(text), "[ \n]+"), lambda w: w != ""), of)


def with_word_statistics(df: DataFrame, text: str) -> tuple[DataFrame, str]:
    """``df`` with a generated column of word statistics, which isn't computed again by what reads it; and its name."""
    name = free_name(df, "word_statistics")
    return df.select("*", F.explode(F.array(word_statistics(df[text]))).alias(name)), name


def text_features(text: Column, words: Column) -> dict[str, Column]:
    """Doubles for each whole text (null: empty). All are shares or logarithms, so a text's length doesn't scale them."""
    text = whole_text(text)
    n = F.greatest(F.length(text), F.lit(1))
    n_words = F.greatest(words["n"], F.lit(1))
    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "marks": _soft(_share_of(text, MARKS, n)),
        "exclamation": _soft(_share_of(text, "!", n)),
        "bars": _soft(_share_of(text, "|", n)),
        "symbols": _soft(_share_of(text, "*%$#&", n)),
        "capitals": _soft(_share_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", n), 0.1),
        "digits": _soft(_share_of(text, "0123456789", n)),
        "stops": _soft(_share_of(text, ".,;:?", n)),
        "words": n_words / n,
        "repeats": _soft(words["again"] / n_words, 0.02),
        "distinct_words": words["distinct"] / n_words,
    }


@dataclass
class QualityModel:
    names: list[str]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, features: dict[str, Column]) -> Column:
        total = F.lit(float(self.bias))
        for name, mean, scale, w in zip(self.names, self.mean, self.scale, self.weights, strict=True):
            total = total + (features[name] - F.lit(float(mean))) * F.lit(float(w / scale))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _risk_gradient(x: np.ndarray, y: np.ndarray, g: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean sigmoid loss of label ``y`` and its gradient by the weights."""
    loss = 1.0 / (1.0 + np.exp(np.clip(y * g, -30, 30)))
    return float(loss.mean()), x.T @ (-y * loss * (1 - loss)) / len(x)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.2) -> float:
    """The smallest ratio of the unlabelled to the positive share above a threshold of a score.

    Where only positives score so high, the ratio is the share of positives; sets with less than ``least`` of the positives are too noisy. Both
    shares are widened by half a standard error, so few rows give a larger prior: good texts are then kept rather than lost.
    """
    cuts = np.quantile(positive, np.linspace(0.0, 1 - least, 81))
    more, less = 0.5 / np.sqrt(len(unlabelled)), 0.5 / np.sqrt(len(positive))
    ratio = [((unlabelled >= c).mean() + more) / max((positive >= c).mean() - less, 1e-9) for c in cuts]
    return float(np.clip(min(ratio), 0.05, 0.98))


def fit_non_negative(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05) -> np.ndarray:
    """Weights (last: bias) that minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with Adam."""
    xp, xu = (np.column_stack([x, np.ones(len(x))]) for x in (positive, unlabelled))
    w = np.zeros(xp.shape[1])
    decay = np.full(len(w), max(1e-4, 0.25 / len(xp)))  # few positives: small weights
    decay[-1] = 0.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        gp, gu = xp @ w, xu @ w
        _, as_good = _risk_gradient(xp, np.ones(len(xp)), gp)
        bad_p, d_bad_p = _risk_gradient(xp, -np.ones(len(xp)), gp)
        bad_u, d_bad_u = _risk_gradient(xu, -np.ones(len(xu)), gu)
        negative = bad_u - prior * bad_p
        # below zero the negative risk is overfitted: step back along its own gradient
        grad = prior * as_good + (d_bad_u - prior * d_bad_p) if negative >= 0 else prior * d_bad_p - d_bad_u
        grad = grad + decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _logistic(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 400) -> np.ndarray:
    decay = max(1e-3, 1.0 / len(positive))
    x = np.column_stack([np.vstack([positive, unlabelled]), np.ones(len(positive) + len(unlabelled))])
    y = np.r_[np.ones(len(positive)), np.zeros(len(unlabelled))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        w -= 0.5 * (x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / len(x) + decay * w)
    return w


def fit_quality(docs: DataFrame, positives: DataFrame, unlabelled: DataFrame, max_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> QualityModel:
    """Fit on at most ``max_rows`` trusted positives and ``max_rows`` unlabelled documents, those with the smallest hashes of their ids.

    ``positives`` and ``unlabelled`` have one column doc_id. Of rows that repeat a sampled id, the one with the smallest statistics counts. Without positives or unlabelled rows the model scores every text 0.5.
    """

    def sample(ids: DataFrame) -> np.ndarray:
        ids = ids.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).withColumnRenamed("doc_id", "_sampled")
        rows, words = with_word_statistics(docs.join(F.broadcast(ids), docs[doc_id] == ids["_sampled"]).select("_sampled", docs[text].alias("text")), "text")
        features = F.struct(*[c.alias(k) for k, c in text_features(F.col("text"), F.col(words)).items()])
        rows = rows.select("_sampled", features.alias("f")).groupBy("_sampled").agg(F.min("f").alias("f")).orderBy("_sampled")
        return np.array([tuple(r["f"]) for r in rows.collect()], float).reshape(-1, len(names))

    names = list(text_features(F.lit(""), F.struct(*[F.lit(0).alias(k) for k in ("n", "again", "distinct")])))
    p, u = sample(positives), sample(unlabelled)
    if not len(p) or not len(u):
        return QualityModel(names, np.zeros(len(names)), np.ones(len(names)), np.zeros(len(names)), 0.0, 0.5)
    mean, scale = u.mean(0), np.maximum(u.std(0), 1e-6)
    p, u = (p - mean) / scale, (u - mean) / scale
    w = _logistic(p, u)
    prior = estimate_prior(p @ w[:-1], u @ w[:-1])
    w = fit_non_negative(p, u, prior)
    return QualityModel(names, mean, scale, w[:-1], float(w[-1]), prior)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1 (null id: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_labels(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, doc_id: str = "doc_id", text: str = "text") -> QualityModel:
    """Positives: rows of ``labels`` (doc_id, quality) with quality 1 that aren't held out; unlabelled: documents that aren't held out."""
    good = labels.filter((labels["quality"] == 1) & ~held_out(labels["doc_id"])).select("doc_id")
    web = docs.filter(~held_out(docs[doc_id])).select(docs[doc_id].alias("doc_id"))
    return fit_quality(docs, good, web, max_rows, doc_id, text)


def score_quality(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 from 0.5). Null text scores as the empty one."""
    rows, words = with_word_statistics(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")), "text")
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(text_features(F.col("text"), F.col(words))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least 0.5, with their columns."""
    rows, words = with_word_statistics(docs, text)
    return rows.filter(model.score(text_features(F.col(text), F.col(words))) >= 0.5).select(*docs.columns)
