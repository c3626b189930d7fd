"""Aggregates over exported losses and embeddings."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_loss(losses: DataFrame, pad: int = 3, zero: int = -1) -> DataFrame:
    """Mean loss and accuracy of text labels that are pad and that are not; columns step, nll, label, hit (A5)."""
    return losses.groupBy("step").agg(*_text(F.lit(True), pad, zero))


def _text(here, pad: int = 3, zero: int = -1) -> list:
    real = here & ~F.col("label").isin(pad, zero)
    only = here & (F.col("label") == pad)
    return [
        F.avg(F.when(real, F.col("nll"))).alias("nonpad_loss"),
        F.avg(F.when(real, F.col("hit"))).alias("nonpad_acc"),
        F.avg(F.when(only, F.col("nll"))).alias("pad_loss"),
        F.count(F.when(real, 1)).alias("n_nonpad"),
        F.count(F.when(only, 1)).alias("n_pad"),
    ]


def combined_text(m: DataFrame, pad_weight: float = 0.5) -> DataFrame:
    """nonpad + weight * pad, each term only if there is one."""
    return m.withColumn("text_loss", F.coalesce("nonpad_loss", F.lit(0.0)) + pad_weight * F.coalesce("pad_loss", F.lit(0.0)))


# Groups of the audio label rows 1 to 16: the main speaker's codebooks 0 to 7, then the other side's.
AUDIO_GROUPS = {"semantic": (1, 1), "acoustic": (2, 8), "semantic_user": (9, 9), "acoustic_user": (10, 16)}


def _audio(zero: int, semantic_weight: float, acoustic_weight: float, user: bool) -> list:
    out, total, weights = [], F.lit(0.0), F.lit(0.0)
    for name, (first, last) in AUDIO_GROUPS.items():
        if name.endswith("_user") and not user:
            continue
        here = F.col("label_row").between(first, last) & (F.col("label") != zero)
        nll, n = F.when(here, F.col("nll")), F.count(F.when(here, 1))
        out += [F.avg(nll).alias(f"{name}_loss"), F.avg(F.when(here, F.col("hit"))).alias(f"{name}_acc"), n.alias(f"n_{name}")]
        weight = semantic_weight if name.startswith("semantic") else acoustic_weight
        total, weights = total + weight * F.coalesce(F.sum(nll), F.lit(0.0)), weights + weight * n
    return [*out, F.when(weights > 0, total / weights).otherwise(0.0).alias("audio_loss")]


def total_loss(losses: DataFrame, pad: int = 3, zero: int = -1, pad_weight: float = 0.5, semantic_weight: float = 100.0, acoustic_weight: float = 1.0, user: bool = True) -> DataFrame:
    """Means, accuracies and numbers of labels of text and of each audio group, the weighted text and audio losses
    and their sum, in one pass; columns step, label_row (0 is text), nll, label, hit (A5-A7)."""
    m = losses.groupBy("step").agg(*_text(F.col("label_row") == 0, pad, zero), *_audio(zero, semantic_weight, acoustic_weight, user))
    return combined_text(m, pad_weight).withColumn("total_loss", F.col("text_loss") + F.col("audio_loss"))


def nan_mean(metrics: DataFrame) -> DataFrame:
    """Mean of each key over the steps, NaN left out."""
    return metrics.groupBy("key").agg(F.avg(F.nanvl("value", F.lit(None).cast("double"))).alias("mean_value"), F.count(F.lit(1)).alias("n"))


def embedding_covariance(embeddings: DataFrame, dims: int | None = None) -> DataFrame:
    """Population covariance of all pairs of columns i <= j, and the means: i, j, cov, mean_i.

    Each task sums its vectors' products as a matrix, about a mean of its own, and sends one row for each pair.
    Vectors of another size than `dims` (the largest in the data unless given) are left out; a null element only
    takes its pairs out.
    """
    x = embeddings.select(F.col("embedding").cast("array<double>").alias("v"))
    if dims is None:
        dims = x.agg(F.max(F.size("v"))).first()[0] or 0

    def partial(frames: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd

        at = n = None
        for frame in frames:
            if not len(frame):
                continue
            has, v = np.stack(frame.has).astype(bool), np.stack(frame.v)
            if at is None:
                at = np.where(has.any(0), v.sum(0) / np.maximum(has.sum(0), 1), 0.0)
                n, a, b, ab = (np.zeros((dims, dims)) for _ in range(4))
            m, y = has.astype(float), np.where(has, v - at, 0.0)
            n, a, b, ab = n + m.T @ m, a + y.T @ m, b + m.T @ y, ab + y.T @ y
        if n is None:
            return
        i, j = np.triu_indices(dims)
        keep = n[i, j] > 0
        i, j = i[keep], j[keep]
        k = n[i, j]
        yield pd.DataFrame({"i": i.astype("int32"), "j": j.astype("int32"), "n": k, "ma": at[i] + a[i, j] / k, "mb": at[j] + b[i, j] / k, "c": ab[i, j] - a[i, j] * b[i, j] / k})

    # nulls come as NaN in a list of doubles, so their places go along
    x = x.filter(F.size("v") == dims).select(F.transform("v", lambda e: F.coalesce(e, F.lit(0.0))).alias("v"), F.transform("v", lambda e: e.isNotNull()).alias("has"))
    parts = x.mapInPandas(partial, "i int, j int, n double, ma double, mb double, c double")
    n, mean = F.sum("n"), lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    cov = (F.sum("c") + F.sum(F.col("n") * F.col("ma") * F.col("mb"))) / n - mean("ma") * mean("mb")
    return parts.groupBy("i", "j").agg(cov.alias("cov"), mean("ma").alias("mean_i"))
