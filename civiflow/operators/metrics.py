"""Binary classification metrics on prediction tables.

Predictions are rows with ``y_true`` (0/1) and ``score``. All metrics of a group
follow from counts per distinct score, so rows are combined before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiflow.functions.columns import predicted, ratio, score_bin
from civiflow.plans.ordered import running_sums

CONFUSION = ["tp", "fp", "fn", "tn"]


def score_counts(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Positives and negatives per distinct score."""
    return predictions.groupBy(*by, "score").agg(
        F.sum("y_true").cast("bigint").alias("pos"), F.sum(1 - F.col("y_true")).cast("bigint").alias("neg")
    )


def _bin_sums(pos: Column, neg: Column, score: Column, threshold: float) -> list[Column]:
    hit = predicted(score, threshold)
    return [
        F.sum(pos + neg).alias("n"),
        F.sum(pos).alias("sum_y"),
        F.sum((pos + neg) * score).alias("sum_s"),
        F.sum(pos * F.pow(score - 1, F.lit(2)) + neg * F.pow(score, F.lit(2))).alias("sum_sq"),
        F.sum(pos * hit).alias("tp"),
        F.sum(neg * hit).alias("fp"),
        F.sum(pos * (1 - hit)).alias("fn"),
        F.sum(neg * (1 - hit)).alias("tn"),
    ]


def bin_sums(predictions: DataFrame, by: list[str], threshold: float = 0.5, bins: int = 10) -> DataFrame:
    """Additive sums per (group, score bin); they can be summed to coarser groups."""
    y = F.col("y_true")
    tagged = predictions.withColumn("bin", score_bin(F.col("score"), bins))
    return tagged.groupBy(*by, "bin").agg(*_bin_sums(y, 1 - y, F.col("score"), threshold))


def fold_bins(sums: DataFrame, by: list[str], extra: list[Column] | None = None) -> DataFrame:
    """Confusion counts, Brier score and expected calibration error per group."""
    total = F.sum("n")
    return sums.groupBy(*by).agg(
        total.alias("n"),
        *[F.sum(c).alias(c) for c in CONFUSION],
        (F.sum("sum_sq") / total).alias("brier"),
        (F.sum(F.abs(F.col("sum_y") - F.col("sum_s"))) / total).alias("ece"),
        *(extra or []),
    )


def rates() -> dict[str, Column]:
    """Metric expressions over the columns tp, fp, fn, tn; 0 on empty denominators."""
    tp, fp, fn, tn = (F.col(c) for c in CONFUSION)
    f1_pos = ratio(2 * tp, 2 * tp + fp + fn)
    f1_neg = ratio(2 * tn, 2 * tn + fp + fn)
    has_pos = (tp + fp + fn > 0).cast("int")
    has_neg = (tn + fp + fn > 0).cast("int")
    support_pos, support_neg = tp + fn, tn + fp
    classes = (support_pos > 0).cast("int") + (support_neg > 0).cast("int")
    recall, specificity = ratio(tp, support_pos), ratio(tn, support_neg)
    return {
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "balanced_accuracy": ratio(recall + specificity, classes),
        "precision": ratio(tp, tp + fp),
        "recall": recall,
        "f1": f1_pos,
        "macro_f1": ratio(f1_pos + f1_neg, has_pos + has_neg),
        "weighted_f1": ratio(support_pos * f1_pos + support_neg * f1_neg, support_pos + support_neg),
        "fpr": fp / F.greatest(fp + tn, F.lit(1)),
        "fnr": fn / F.greatest(fn + tp, F.lit(1)),
    }


def _ranking_sums() -> list[Column]:
    """Terms of AUROC (ties count half) and average precision per distinct score."""
    pos, neg = F.col("pos"), F.col("neg")
    pairs = pos * (F.col("before_neg") + neg / F.lit(2.0))
    at_least_pos = F.col("total_pos") - F.col("before_pos")
    at_least_neg = F.col("total_neg") - F.col("before_neg")
    return [
        F.sum(pairs).alias("__pairs"),
        F.sum(pos.cast("double") * at_least_pos / (at_least_pos + at_least_neg)).alias("__ap"),
        F.max("total_pos").alias("__p"),
        F.max("total_neg").alias("__n"),
    ]


def _ranking() -> tuple[Column, Column]:
    p, n = F.col("__p"), F.col("__n")
    auroc = F.when((p > 0) & (n > 0), F.col("__pairs") / (p.cast("double") * F.nullif(n, F.lit(0))))
    auprc = F.when(p > 0, F.col("__ap") / F.nullif(p, F.lit(0))).otherwise(F.lit(0.0))
    return auroc, auprc


def ranking_metrics(predictions: DataFrame, by: list[str]) -> DataFrame:
    """AUROC and average precision per group; AUROC is NULL when a class is missing."""
    ranked = running_sums(score_counts(predictions, by), by, ["score"], ["pos", "neg"])
    auroc, auprc = _ranking()
    return ranked.groupBy(*by).agg(*_ranking_sums()).select(*by, auroc.alias("auroc"), auprc.alias("auprc"))


def _full(predictions: DataFrame, by: list[str], threshold: float) -> DataFrame:
    ranked = running_sums(score_counts(predictions, by), by, ["score"], ["pos", "neg"])
    binned = ranked.withColumn("bin", score_bin(F.col("score")))
    sums = binned.groupBy(*by, "bin").agg(
        *_bin_sums(F.col("pos"), F.col("neg"), F.col("score"), threshold), *_ranking_sums()
    )
    again = [
        F.sum("__pairs").alias("__pairs"),
        F.sum("__ap").alias("__ap"),
        F.max("__p").alias("__p"),
        F.max("__n").alias("__n"),
    ]
    return fold_bins(sums, by, again)


def binary_metrics(predictions: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Metric set of the experiment tables, one row per group."""
    auroc, auprc = _ranking()
    r = rates()
    return _full(predictions, by, threshold).select(
        *by,
        "n",
        *[r[m].alias(m) for m in ("accuracy", "precision", "recall", "macro_f1", "weighted_f1")],
        auroc.alias("auroc"),
        auprc.alias("auprc"),
        "brier",
        "ece",
    )


def subgroup_metrics(predictions: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Diagnostic metric set per subgroup, ranking metrics NULL when a class is missing.

    A missing group value is a group of its own.
    """
    auroc, auprc = _ranking()
    r = rates()
    both = (F.col("__p") > 0) & (F.col("__n") > 0)
    return _full(predictions, by, threshold).select(
        *by,
        "n",
        *[r[m].alias(m) for m in ("accuracy", "balanced_accuracy", "precision", "recall", "f1")],
        "brier",
        auroc.alias("roc_auc"),
        F.when(both, auprc).alias("pr_auc"),
    )


def reliability_bins(predictions: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Mean score, observed rate and size of every non-empty bin."""
    n = F.col("n")
    return bin_sums(predictions, by, bins=bins).select(
        *by,
        "bin",
        (F.col("sum_s") / n).alias("mean_predicted_probability"),
        (F.col("sum_y") / n).alias("observed_delay_rate"),
        "n",
    )


def calibration_by(predictions: DataFrame, by: list[str]) -> DataFrame:
    return fold_bins(bin_sums(predictions, by), by).select(*by, "brier", "ece", "n")


def mean_calibration(by_city: DataFrame, by: list[str]) -> DataFrame:
    """Unweighted mean over cities."""
    return by_city.groupBy(*by).agg(F.avg("brier").alias("brier"), F.avg("ece").alias("ece"))


def weighted_macro_f1(metrics: DataFrame, by: list[str], cities: list[str], rows: str = "n") -> DataFrame:
    """Macro-F1 over participating cities, weighted by their test rows."""
    kept = metrics.filter(F.col("city").isin(cities))
    return kept.groupBy(*by).agg(
        (F.sum(F.col("macro_f1") * F.col(rows)) / F.sum(rows)).alias("global_macro_f1")
    )
