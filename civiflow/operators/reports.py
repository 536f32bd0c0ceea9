"""Comparison tables, privacy and resource reports, and the trust scorecard.

Inputs are result tables with one row per model (and city or run), so joins and
windows here run over report-sized data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civiflow.functions.columns import megabytes, pct_overhead
from civiflow.functions.names import city_label, display_name, epsilon, find_col, table_columns

# Report order of the models.
MODEL_ORDER = [
    "Logistic Regression", "Random Forest", "XGBoost", "LightGBM", "CatBoost", "MLP",
    "Centralized", "Local-only", "FedAvg", "FedProx", "FedAvg + SecAgg",
    "FedAvg + DP eps=8", "FedAvg + DP eps=3", "FedAvg + DP eps=1", "FedProx + DP eps=3",
]

# Privacy component by level, and scorecard weights.
PRIVACY_BASE = {
    "None": 0.20,
    "Secure aggregation": 0.55,
    "Weak DP": 0.70,
    "Medium DP": 0.85,
    "Strong DP": 1.00,
}
SCORE_WEIGHTS = {
    "performance": 0.25,
    "privacy": 0.20,
    "xai_stability": 0.20,
    "fairness": 0.15,
    "efficiency": 0.10,
    "calibration": 0.10,
}


def model_rank(c: Column) -> Column:
    """Position in the report order, 999 for other models."""
    return F.coalesce(
        F.nullif(F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), c), F.lit(0)) - 1, F.lit(999)
    )


def order_models(df: DataFrame, model: str = "model") -> DataFrame:
    return df.orderBy(model_rank(F.col(model)), model)


def top_models(df: DataFrame, score: str = "trust_score", k: int = 4) -> DataFrame:
    return df.orderBy(F.desc(score), "model").limit(k)


def pivot_table(
    df: DataFrame, row: str, column: str, value: str, columns: list[str], how: str = "first", prefix: str = ""
) -> DataFrame:
    """One row per ``row`` value, one column per listed ``column`` value.

    ``first`` is for tables with one row per cell.
    """
    fold = {"first": F.max, "mean": F.avg}[how]
    cells = [fold(F.when(F.col(column) == c, F.col(value))).alias(f"{prefix}{column_key(c)}") for c in columns]
    return df.groupBy(row).agg(*cells)


def transfer_matrix(results: DataFrame, metric: str, rows: list[str], columns: list[str]) -> DataFrame:
    """Train city by test city, listed rows always present and in their order."""
    cells = pivot_table(results, "train_city", "test_city", metric, columns)
    listed = results.sparkSession.createDataFrame([(i, r) for i, r in enumerate(rows)], "position int, train_city string")
    return F.broadcast(listed).join(cells, "train_city", "left").orderBy("position")


def comparison_table(metrics: DataFrame, cities: list[str], external: str, rounds: DataFrame) -> DataFrame:
    """One row per model: macro-F1 by city and weighted over the participating ones.

    ``metrics`` has (model, city, macro_f1, n); ``rounds`` (model, best_round).
    """
    inside = F.col("city").isin(cities)
    weighted = F.sum(F.when(inside, F.col("macro_f1") * F.col("n"))) / F.sum(F.when(inside, F.col("n")))
    by_city = [
        F.max(F.when(F.col("city") == c, F.col("macro_f1"))).alias(f"{column_key(c)}_macro_f1")
        for c in [*cities, external]
    ]
    table = metrics.groupBy("model").agg(weighted.alias("global_macro_f1"), *by_city)
    return table.join(rounds.select("model", F.col("best_round").alias("rounds_to_converge")), "model")


def column_key(name: str) -> str:
    return name.lower().replace(" ", "_")


def resource_table(summaries: DataFrame) -> DataFrame:
    sizes = {
        "model_size_mb": "model_size_bytes",
        "upload_mb": "upload_bytes",
        "download_mb": "download_bytes",
        "secure_aggregation_extra_mb": "secure_aggregation_extra_bytes",
        "total_communication_mb": "total_bytes_with_overheads",
    }
    return summaries.select(
        "model",
        "training_time_sec",
        "memory_peak_mb",
        *[megabytes(F.col(c)).alias(n) for n, c in sizes.items()],
        "rounds_completed",
    )


def family_baseline(model: Column) -> Column:
    return F.when(model.startswith("FedProx"), "FedProx").otherwise("FedAvg")


def privacy_tradeoff(
    macro: DataFrame, summaries: DataFrame, calibration: DataFrame, fairness: DataFrame, drift: DataFrame, external: str
) -> DataFrame:
    """Utility, calibration, drift, fairness and overheads of every model."""
    resources = resource_table(summaries).select("model", "training_time_sec", "total_communication_mb")
    base = resources.select(
        F.col("model").alias("baseline"),
        F.col("training_time_sec").alias("base_sec"),
        F.col("total_communication_mb").alias("base_mb"),
    )
    gaps = fairness.filter("group_column = 'city'").select("model", "macro_f1_gap")
    return (
        macro.withColumn("baseline", family_baseline(F.col("model")))
        .join(summaries.select("model", "privacy_level", "target_epsilon", "noise_multiplier"), "model")
        .join(calibration, "model")
        .join(gaps, "model")
        .join(drift.select("model", "drift"), "model")
        .join(resources, "model")
        .join(base, "baseline")
        .select(
            "model",
            "privacy_level",
            "target_epsilon",
            "noise_multiplier",
            "global_macro_f1",
            F.col(f"{column_key(external)}_macro_f1").alias("external_macro_f1"),
            "brier",
            "ece",
            F.col("drift").alias("explanation_drift"),
            F.col("macro_f1_gap").alias("fairness_macro_f1_gap"),
            pct_overhead(F.col("training_time_sec"), F.col("base_sec")).alias("runtime_overhead_pct"),
            pct_overhead(F.col("total_communication_mb"), F.col("base_mb")).alias("communication_overhead_pct"),
        )
    )


def secure_aggregation_overhead(
    summaries: DataFrame, macro: DataFrame, model: str = "FedAvg + SecAgg", baseline: str = "FedAvg"
) -> DataFrame:
    """Cost of secure aggregation against the same algorithm without it."""
    facts = summaries.join(macro.select("model", "global_macro_f1"), "model").select(
        "model",
        "training_time_sec",
        "secure_aggregation_extra_bytes",
        "total_bytes_with_overheads",
        "rounds_completed",
        "global_macro_f1",
    )
    base = facts.filter(F.col("model") == baseline).select(
        F.lit(model).alias("model"), *[F.col(c).alias(f"b_{c}") for c in facts.columns if c != "model"]
    )
    return facts.filter(F.col("model") == model).join(base, "model").select(
        "model",
        pct_overhead(F.col("training_time_sec"), F.col("b_training_time_sec")).alias("extra_runtime_pct"),
        megabytes(F.col("secure_aggregation_extra_bytes")).alias("extra_communication_mb"),
        pct_overhead(F.col("total_bytes_with_overheads"), F.col("b_total_bytes_with_overheads")).alias(
            "communication_overhead_pct"
        ),
        (F.col("rounds_completed") - F.col("b_rounds_completed")).alias("rounds_change"),
        (F.col("global_macro_f1") - F.col("b_global_macro_f1")).alias("global_macro_f1_change"),
    )


def privacy_component(level: Column, advantage: Column) -> Column:
    """Level's base value, blended with the measured attack where there is one."""
    base = F.element_at(F.create_map(*[F.lit(x) for p in PRIVACY_BASE.items() for x in p]), level)
    measured = F.lit(0.65) * base + F.lit(0.35) * (F.lit(1.0) - F.least(advantage, F.lit(1.0)))
    return F.when(advantage.isNull(), base).otherwise(measured)


def scorecard(
    macro: DataFrame, summaries: DataFrame, calibration: DataFrame, fairness: DataFrame, drift: DataFrame, attacks: DataFrame
) -> DataFrame:
    """Six components per model and their weighted sum, best first."""
    gaps = fairness.filter("group_column = 'city'").select("model", "macro_f1_gap")
    resources = resource_table(summaries).select("model", "training_time_sec", "total_communication_mb")
    joined = (
        macro.select("model", "global_macro_f1")
        .join(summaries.select("model", "privacy_level"), "model")
        .join(calibration.select("model", "ece"), "model")
        .join(gaps, "model")
        .join(drift.select("model", "explanation_stability"), "model")
        .join(resources, "model")
        .join(attacks.select("model", "attack_advantage"), "model", "left")
    )
    parts = joined.select(
        "model",
        F.col("global_macro_f1").alias("performance"),
        privacy_component(F.col("privacy_level"), F.col("attack_advantage")).alias("privacy"),
        F.col("explanation_stability").alias("xai_stability"),
        (F.lit(1.0) - F.least("macro_f1_gap", F.lit(1.0))).alias("fairness"),
        (
            F.lit(1.0)
            / (F.lit(1.0) + F.col("training_time_sec") / F.lit(60.0) + F.col("total_communication_mb") / F.lit(100.0))
        ).alias("efficiency"),
        (F.lit(1.0) - F.least("ece", F.lit(1.0))).alias("calibration"),
    )
    total = reduce(lambda a, b: a + b, [F.lit(w) * F.col(c) for c, w in SCORE_WEIGHTS.items()])
    return parts.withColumn("trust_score", total).orderBy(F.desc("trust_score"), "model")


def dp_tradeoff(df: DataFrame, model: str = "model") -> DataFrame:
    """Models that name a privacy budget, by budget."""
    return df.withColumn("epsilon", epsilon(F.col(model))).filter("epsilon IS NOT NULL").orderBy("epsilon", model)


def main_comparison(central: DataFrame | None, federated: DataFrame | None, scores: DataFrame | None) -> DataFrame:
    """Headline metrics of all experiments; columns an experiment lacks are NULL.

    Column names are found by alias, results that are absent are skipped.
    """

    def part(df: DataFrame, experiment: str, wanted: dict[str, list[str]], shown: bool) -> DataFrame:
        named = table_columns(df)
        model = F.col(find_col(named, ["model", "classifier", "algorithm", "configuration", "method"]))
        found = {n: find_col(named, aliases, required=False) for n, aliases in wanted.items()}
        return named.select(
            F.lit(experiment).alias("experiment"),
            (display_name(model) if shown else model).alias("model"),
            *[F.col(c).alias(n) for n, c in found.items() if c],
        )

    parts = []
    if central is not None:
        wanted = {
            "pooled_auroc": ["auroc", "roc_auc"],
            "pooled_auprc": ["auprc", "average_precision"],
            "pooled_macro_f1": ["macro_f1"],
        }
        parts.append(part(central, "Centralized baseline", wanted, True))
    if federated is not None:
        wanted = {"pooled_macro_f1": ["global_macro_f1", "global"], "external_macro_f1": ["external_macro_f1"]}
        parts.append(part(federated, "Federated/privacy", wanted, False))
    if scores is not None:
        parts.append(part(scores, "Trustworthiness scorecard", {"trust_score": ["trust_score", "score"]}, False))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def figure_table(df: DataFrame, columns: dict[str, list[str]], shown: bool = False) -> DataFrame:
    """Report table: canonical names looked up by alias, models in report order.

    The first entry names the model column; columns that are absent are left out.
    """
    named = table_columns(df)
    found = {n: find_col(named, aliases, required=i == 0) for i, (n, aliases) in enumerate(columns.items())}
    picked = named.select(*[F.col(c).alias(n) for n, c in found.items() if c])
    model = next(iter(columns))
    if shown:
        picked = picked.withColumn(model, display_name(F.col(model)))
    return order_models(picked, model)


def calibration_table(calibration: DataFrame, cities: list[str]) -> DataFrame:
    """Brier score and calibration error of each model by city, in report order.

    ``calibration`` has one row per (model, city); a cell without a row is null.
    """
    cells = [
        F.max(F.when(F.col("city") == c, F.col(m))).alias(f"{m}_{column_key(c)}") for m in ("brier", "ece") for c in cities
    ]
    return order_models(calibration.groupBy("model").agg(*cells))


def labelled_matrix(matrix: DataFrame) -> DataFrame:
    """A transfer matrix with city names as headings."""
    kept = ("position", "train_city")
    return matrix.select(*[F.col(c) if c in kept else F.col(c).alias(city_label(c)) for c in matrix.columns])


def fairness_city_rows(fairness: DataFrame) -> DataFrame:
    return fairness.filter("group_column = 'city'")
