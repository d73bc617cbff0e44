"""Evaluation metrics over prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnset.functions import tensors as X


def cross_entropy(logits: Column, soft_target: Column) -> Column:
    """``-sum(t * log_softmax)``."""
    return -X.total(F.zip_with(soft_target, X.log_softmax(logits), lambda t, l: t * l))


def label_smooth_loss(logits: Column, target: Column, classes: int, epsilon: float) -> Column:
    """Targets ``(1 - eps) * onehot + eps / C``."""
    soft = F.transform(X.one_hot(target, classes), lambda t: t * (1 - epsilon) + epsilon / classes)
    return cross_entropy(logits, soft)


def soft_smooth_loss(logits: Column, soft_target: Column, classes: int, smoothing: float) -> Column:
    """Targets ``t * (1 - s / C) + s / C``; also takes soft targets."""
    share = smoothing / classes
    return cross_entropy(logits, F.transform(soft_target, lambda t: t * (1 - share) + share))


def mixup_loss(logits: Column, t1: Column, t2: Column, lam: Column, classes: int, epsilon: float) -> Column:
    return lam * label_smooth_loss(logits, t1, classes, epsilon) + (F.lit(1.0) - lam) * label_smooth_loss(
        logits, t2, classes, epsilon)


def reduce_loss(df: DataFrame, loss: Column, reduction: str, groups: list[str] = ()) -> DataFrame:
    """mean, sum or none."""
    if reduction == "none":
        return df.withColumn("loss", loss)
    fn = {"mean": F.avg, "avg": F.avg, "sum": F.sum}[reduction]
    return df.groupBy(*groups).agg(fn(loss).alias("loss"))


def topk_accuracy(df: DataFrame, logits: str, target: str, ks: list[int], groups: list[str] = (), percent: bool = False) -> DataFrame:
    """Share (or percent) of rows whose target is among the k best, one pass."""
    ranked = df.withColumn("__rank", X.target_rank(F.col(logits), F.col(target)))
    scale = 100.0 if percent else 1.0
    return ranked.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        *[(F.avg((F.col("__rank") <= k).cast("double")) * scale).alias(f"top{k}") for k in ks])


def tta_metrics(preds: DataFrame, sample: str, loss: str, correct: str, batch: str | None = None) -> DataFrame:
    """Best over policies per sample, then means. ``batch`` switches to the
    form in which one minimum stands for a whole batch's losses."""
    best = preds.groupBy(sample).agg(F.min(loss).alias("loss"), F.max(correct).alias("correct"))
    if batch is None:
        return best.agg(
            F.count(F.lit(1)).alias("cnt"), (-F.sum("loss") / F.count(F.lit(1))).alias("minus_loss"),
            (F.sum("correct") / F.count(F.lit(1))).alias("top1_valid"))
    lows = preds.groupBy(batch).agg(F.min(loss).alias("low")).agg(F.sum("low").alias("lows"))
    return best.agg(F.count(F.lit(1)).alias("cnt"), F.sum("correct").alias("hits")).select(
        "cnt", (-lows.scalar() / F.col("cnt")).alias("minus_loss"), (F.col("hits") / F.col("cnt")).alias("top1_valid"))


def epoch_metrics(batches: DataFrame, metrics: list[str], size: str, groups: list[str]) -> DataFrame:
    """Batch means weighted by batch length."""
    return batches.groupBy(*groups).agg(
        F.sum(size).alias("cnt"), *[(F.sum(F.col(m) * F.col(size)) / F.sum(size)).alias(m) for m in metrics])


def best_epoch(df: DataFrame, epoch: str, metric: str | None, groups: list[str] = ()) -> DataFrame:
    """All metrics of the best epoch (first one on a tie), or of the last
    epoch when no metric is named."""
    order = F.struct(F.col(metric), -F.col(epoch)) if metric else F.col(epoch)
    rest = [c for c in df.columns if c not in groups]
    return df.groupBy(*groups).agg(F.max_by(F.struct(*rest), order).alias("b")).select(*groups, "b.*")
