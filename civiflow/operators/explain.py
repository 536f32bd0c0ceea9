"""Feature importance, rank stability and explanation drift."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from civiflow.functions.columns import sigmoid


def mean_absolute_importance(values: DataFrame, by: list[str], feature: str = "feature") -> DataFrame:
    """Mean absolute value per feature of a long attribution table."""
    return values.groupBy(*by, feature).agg(F.avg(F.abs("value")).alias("importance"))


def linear_score(features: Column, weights: list[float], bias: float) -> Column:
    """Raw score of a linear model over an array column."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    terms = F.zip_with(features, w, lambda x, y: x * y)
    return F.aggregate(terms, F.lit(float(bias)), lambda acc, t: acc + t)


def gradient_importance(
    rows: DataFrame, by: list[str], weights: list[float], bias: float, features: str = "features"
) -> DataFrame:
    """``mean(|ds/dx_j| |x_j|)`` of a linear model with sigmoid output, summing to 1.

    With s the score, ds/dx_j is s(1-s) w_j; the weighted L1 norms of all
    feature columns come from one aggregation of vectors.
    """
    score = sigmoid(linear_score(F.col(features), weights, bias))
    norms = (
        rows.withColumn("__g", score * (F.lit(1.0) - score))
        .groupBy(*by)
        .agg(
            vector_to_array(Summarizer.normL1(array_to_vector(F.col(features)), F.col("__g"))).alias("l1"),
            F.count(F.lit(1)).alias("rows"),
        )
    )
    w = F.array(*[F.lit(abs(float(x))) for x in weights])
    scaled = F.zip_with("l1", w, lambda a, b: a * b / F.col("rows"))
    total = F.greatest(F.aggregate(scaled, F.lit(0.0), lambda acc, x: acc + x), F.lit(1e-12))
    return norms.select(*by, F.posexplode(F.transform(scaled, lambda x: x / total)).alias("feature", "importance"))


def feature_means(rows: DataFrame, features: str = "features") -> list[float]:
    """Mean feature vector, as long as the model is wide."""
    mean = rows.agg(Summarizer.mean(array_to_vector(F.col(features))).alias("m")).first()["m"]
    return [float(x) for x in mean]


def linear_attributions(
    rows: DataFrame, keep: list[str], weights: list[float], means: list[float], features: str = "features"
) -> DataFrame:
    """Long table of ``w_j (x_j - mean_j)``, the exact attribution of a linear model."""
    pairs = F.array(
        *[
            F.struct(F.lit(float(w)).alias("w"), F.lit(float(m)).alias("m"))
            for w, m in zip(weights, means, strict=True)
        ]
    )
    parts = F.zip_with(features, pairs, lambda x, p: p["w"] * (x - p["m"]))
    return rows.select(*keep, F.posexplode(parts).alias("feature", "value"))


def top_features(importance: DataFrame, k: int) -> DataFrame:
    """Ranked head of every model's features; ties by feature."""
    w = Window.partitionBy("model").orderBy(F.desc("importance"), "feature")
    return importance.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _average_rank(value: str) -> Column:
    lowest = F.rank().over(Window.partitionBy("model").orderBy(value))
    peers = F.count(F.lit(1)).over(Window.partitionBy("model", value))
    return lowest + (peers - 1) / F.lit(2.0)


def rank_correlation(reference: DataFrame, candidates: DataFrame) -> DataFrame:
    """Spearman correlation with a reference (feature, importance) table per model.

    Features are matched by name; fewer than two in common give NULL. Windows
    run over one row per (model, feature).
    """
    ref = reference.select("feature", F.col("importance").alias("ref_importance"))
    joined = candidates.select("model", "feature", "importance").join(ref, "feature")
    ranked = joined.select(
        "model", _average_rank("importance").alias("r1"), _average_rank("ref_importance").alias("r2")
    )
    rho = F.when(F.count(F.lit(1)) >= 2, F.corr("r1", "r2"))
    return ranked.groupBy("model").agg(rho.alias("spearman_rank_correlation"))


def explanation_drift(importance: DataFrame, reference_model: str, k: int) -> DataFrame:
    """Stability and drift of every model's importance against a reference model."""
    reference = importance.filter(F.col("model") == reference_model)
    rho = rank_correlation(reference, importance)
    top = top_features(importance, k).select("model", "feature")
    ref_top = top.filter(F.col("model") == reference_model).select("feature")
    shared = top.join(ref_top, "feature").groupBy("model").agg(F.count(F.lit(1)).alias("shared"))
    r = F.col("spearman_rank_correlation")
    return rho.join(shared, "model", "left").select(
        F.lit(reference_model).alias("reference_model"),
        "model",
        r,
        (F.coalesce("shared", F.lit(0)) / F.lit(float(k))).alias("top_k_feature_overlap"),
        F.when(r.isNotNull(), F.greatest(r, F.lit(0.0))).alias("explanation_stability"),
        (F.lit(1.0) - r).alias("drift"),
    )
