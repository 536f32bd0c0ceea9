"""Metrics, calibration, fairness, membership attack and explanation drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from civiflow.catalog.inputs import IMPORTANCE_CTES, PREDICTION_CTES, attributions, finish, predictions, table
from civiflow.functions.columns import attack_confidence, inner_edges, predicted, score_bin, sigmoid
from civiflow.operators import attack, explain, fairness, metrics
from civiflow.operators.attack import PROBS
from civiflow.plans.staging import stage

BY = ["model", "city"]
WIDTH = 64
WEIGHTS = [((i * 7) % 5 - 2) / 8 for i in range(WIDTH)]
BIAS = 0.25


def labelled_documents(spark, sf_dir):
    """Toxicity labels judged by a length score, with language and source."""
    d, y = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(y, "doc_id").select(
        "lang",
        "source",
        F.col("toxic").alias("y_true"),
        ((F.col("n_chars") % 97).cast("double") / F.lit(96.0)).alias("score"),
    )


def importance(spark, sf_dir):
    table_ = explain.mean_absolute_importance(attributions(spark, sf_dir), ["model"])
    return table_.withColumn("importance", F.round("importance", 6))


def attacks(spark, sf_dir, limit=400, rows=None):
    """Members are the earliest even orders per model and city, the odd ones are not."""
    p = (rows or predictions(spark, sf_dir)).withColumnRenamed("row_id", "request_id")
    sample = attack.attack_sample(p.filter("is_member = 1"), p.filter("is_member = 0"), limit)
    return attack.with_risk_reduction(attack.membership_attack(sample))


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label"), F.col("embedding").cast("array<double>").alias("features")
    )


def linear_attribution(spark, sf_dir):
    """Mean absolute exact attribution per feature of a given linear model."""
    rows = vectors(spark, sf_dir)
    values = explain.linear_attributions(rows, ["label"], WEIGHTS, explain.feature_means(rows))
    return finish(explain.mean_absolute_importance(values, ["label"]))


def aligned(spark, sf_dir):
    """Scores matched by key with the subgroup columns of the scored rows."""
    p = predictions(spark, sf_dir)
    rows = p.filter("model = 'FedAvg'").select("row_id", "city", "category", "area")
    scores = p.select("model", "row_id", "y_true", "score")
    out = fairness.align_predictions(scores, rows, ["row_id"])
    return finish(out.groupBy("model", "city", "area").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score")))


def scored_decisions(spark, sf_dir):
    p = predictions(spark, sf_dir)
    s = F.col("score")
    return finish(
        p.groupBy("model", predicted(s).alias("predicted"), score_bin(s).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(attack_confidence(s)).alias("confidence"),
            F.avg(sigmoid(s * 4 - 2)).alias("squashed"),
        )
    )


def aurocs(spark, sf_dir):
    return metrics.ranking_metrics(predictions(spark, sf_dir), BY)


QUERIES = {
    "binary_metrics": lambda s, d: finish(metrics.binary_metrics(predictions(s, d), BY)),
    "confusion_rates": lambda s, d: finish(
        metrics.fold_bins(metrics.bin_sums(predictions(s, d), ["model", "category"]), ["model", "category"]).select(
            "model", "category", *metrics.CONFUSION, *[metrics.rates()[r].alias(r) for r in ("fpr", "fnr", "balanced_accuracy")]
        )
    ),
    "auroc": lambda s, d: finish(aurocs(s, d).drop("auprc")),
    "average_precision": lambda s, d: finish(aurocs(s, d).drop("auroc")),
    "document_metrics": lambda s, d: finish(metrics.subgroup_metrics(labelled_documents(s, d), ["lang"])),
    "ece": lambda s, d: finish(metrics.calibration_by(predictions(s, d), ["model"])),
    "reliability_bins": lambda s, d: finish(metrics.reliability_bins(predictions(s, d), BY)),
    "calibration_by_city": lambda s, d: finish(metrics.calibration_by(predictions(s, d), BY)),
    "mean_calibration": lambda s, d: finish(
        metrics.mean_calibration(metrics.calibration_by(predictions(s, d), BY), ["model"])
    ),
    "subgroup_metrics": lambda s, d: finish(metrics.subgroup_metrics(predictions(s, d), ["area"])),
    "one_class_groups": lambda s, d: finish(
        metrics.ranking_metrics(
            predictions(s, d).withColumn("status_group", F.when(F.col("y_true") == 1, F.col("area"))), ["status_group"]
        )
    ),
    "fairness_summary": lambda s, d: finish(fairness.fairness_summary(predictions(s, d))),
    "fairness_small_groups": lambda s, d: finish(
        fairness.fairness_summary(labelled_documents(s, d).withColumn("model", F.lit("length")), ["lang", "source"], 60)
    ),
    "aligned_predictions": aligned,
    "scored_decisions": scored_decisions,
    "membership_attack": lambda s, d: finish(attacks(s, d)),
    "membership_attack_all_rows": lambda s, d: finish(
        attack.membership_attack(predictions(s, d).select("model", "score", "is_member"))
    ),
    "importance": lambda s, d: finish(importance(s, d)),
    "importance_rank": lambda s, d: finish(explain.top_features(importance(s, d), 10)),
    "rank_correlation": lambda s, d: finish(
        explain.rank_correlation(importance(s, d).filter("model = 'FedProx'"), importance(s, d))
    ),
    "explanation_drift": lambda s, d: finish(explain.explanation_drift(stage(importance(s, d)), "FedAvg", 20)),
    "gradient_importance": lambda s, d: finish(explain.gradient_importance(vectors(s, d), ["label"], WEIGHTS, BIAS)),
    "linear_attribution": linear_attribution,
}

_BIN = " + ".join(f"CAST(score > CAST('{e!r}' AS DOUBLE) AS INTEGER)" for e in inner_edges(10))


def metric_ctes(source: str, by: str, threshold: str = "0.5") -> str:
    """CTEs ``full_metrics``: every metric of ``source`` per group, computed row by row."""
    return f"""
binned AS (SELECT *, {_BIN} AS bin, CAST(score >= CAST({threshold} AS DOUBLE) AS BIGINT) AS hit FROM {source}),
bins AS (SELECT {by}, bin, count(*) AS k, avg(y_true) AS rate, avg(score) AS mean FROM binned GROUP BY ALL),
basics AS (
  SELECT {by}, count(*) AS n, count(*) FILTER (y_true = 1 AND hit = 1) AS tp, count(*) FILTER (y_true = 0 AND hit = 1) AS fp,
         count(*) FILTER (y_true = 1 AND hit = 0) AS fn, count(*) FILTER (y_true = 0 AND hit = 0) AS tn,
         avg((score - y_true) * (score - y_true)) AS brier FROM binned GROUP BY ALL),
eces AS (SELECT {by}, sum(k * abs(rate - mean)) / sum(k) AS ece FROM bins GROUP BY ALL),
per_score AS (
  SELECT {by}, score, sum(y_true) AS pos, count(*) - sum(y_true) AS neg FROM {source} GROUP BY ALL),
cumulated AS (
  SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY score) - neg AS neg_below,
         sum(pos) OVER (PARTITION BY {by} ORDER BY score DESC) AS pos_from,
         sum(pos + neg) OVER (PARTITION BY {by} ORDER BY score DESC) AS all_from FROM per_score),
rankings AS (
  SELECT {by},
         CASE WHEN sum(pos) > 0 AND sum(neg) > 0
           THEN sum(CAST(pos AS DOUBLE) * (neg_below + neg / CAST(2 AS DOUBLE))) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS auroc,
         CASE WHEN sum(pos) > 0 THEN sum(CAST(pos AS DOUBLE) * pos_from / all_from) / sum(pos) ELSE CAST(0 AS DOUBLE) END AS auprc
  FROM cumulated GROUP BY ALL),
rated AS (
  SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0 END AS f1_pos,
         CASE WHEN 2 * tn + fp + fn > 0 THEN CAST(2 * tn AS DOUBLE) / (2 * tn + fp + fn) ELSE 0 END AS f1_neg,
         CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision,
         CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall,
         CASE WHEN tn + fp > 0 THEN CAST(tn AS DOUBLE) / (tn + fp) ELSE 0 END AS specificity
  FROM basics),
full_metrics AS (
  SELECT {", ".join(f"r.{b}" for b in by.split(", "))}, n, tp, fp, fn, tn, brier, ece, auroc, auprc, precision, recall, f1_pos AS f1,
         CAST(tp + tn AS DOUBLE) / n AS accuracy,
         (recall + specificity) / (CAST(tp + fn > 0 AS INTEGER) + CAST(tn + fp > 0 AS INTEGER)) AS balanced_accuracy,
         (f1_pos + f1_neg) / (CAST(tp + fp + fn > 0 AS INTEGER) + CAST(tn + fp + fn > 0 AS INTEGER)) AS macro_f1,
         ((tp + fn) * f1_pos + (tn + fp) * f1_neg) / n AS weighted_f1,
         CAST(fp AS DOUBLE) / greatest(fp + tn, 1) AS fpr, CAST(fn AS DOUBLE) / greatest(fn + tp, 1) AS fnr
  FROM rated r JOIN eces e ON {" AND ".join(f"r.{b} IS NOT DISTINCT FROM e.{b}" for b in by.split(", "))}
       JOIN rankings a ON {" AND ".join(f"r.{b} IS NOT DISTINCT FROM a.{b}" for b in by.split(", "))})"""


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def fairness_sql(source: str, columns: list[str], minimum: int) -> str:
    union = " UNION ALL ".join(
        f"SELECT model, '{c}' AS group_column, CAST({c} AS VARCHAR) AS group_value, y_true, score FROM {source}"
        for c in columns
    )
    gaps = {
        "precision_gap": "precision",
        "recall_gap": "recall",
        "macro_f1_gap": "macro_f1",
        "false_positive_rate_gap": "fpr",
        "false_negative_rate_gap": "fnr",
        "equal_opportunity_difference": "recall",
        "calibration_ece_gap": "ece",
    }
    parts = ", ".join(
        f"round(max({m}) FILTER (n >= {minimum}) - min({m}) FILTER (n >= {minimum}), 6) AS {g}" for g, m in gaps.items()
    )
    return f"""grouped AS ({union}), {metric_ctes("grouped", "model, group_column, group_value")},
fairness AS (
  SELECT model, group_column, count(*) FILTER (n >= {minimum}) AS groups, {parts} FROM full_metrics GROUP BY ALL)"""


_DOCUMENTS = """scored AS (
  SELECT 'length' AS model, lang, source, toxic AS y_true, CAST(n_chars % 97 AS DOUBLE) / CAST(96 AS DOUBLE) AS score
  FROM documents JOIN labels USING (doc_id))"""

_THRESHOLDS = "[" + ", ".join(f"CAST('{p!r}' AS DOUBLE)" for p in PROBS) + "]"
_ACCURACIES = ", ".join(
    f"avg(CAST(CAST(conf >= q[{i}] AS INTEGER) = is_member AS INTEGER))" for i in range(1, len(PROBS) + 1)
)


def attack_ctes(source: str) -> str:
    return f"""
judged AS (SELECT model, is_member, greatest(score, 1 - score) AS conf FROM {source}),
quantiles AS (SELECT model, quantile_cont(conf, {_THRESHOLDS}) AS q FROM judged GROUP BY model),
best AS (SELECT model, greatest({_ACCURACIES}) AS attack_accuracy FROM judged JOIN quantiles USING (model) GROUP BY model),
members AS (
  SELECT model, conf, sum(is_member) AS m, count(*) - sum(is_member) AS o FROM judged GROUP BY 1, 2),
ordered AS (SELECT *, sum(o) OVER (PARTITION BY model ORDER BY conf) - o AS below FROM members),
aucs AS (
  SELECT model, sum(CAST(m AS DOUBLE) * (below + o / CAST(2 AS DOUBLE))) / (CAST(sum(m) AS DOUBLE) * sum(o)) AS auc
  FROM ordered GROUP BY model),
attacks AS (
  SELECT model, attack_accuracy, auc AS attack_auc, abs(auc - CAST(0.5 AS DOUBLE)) * 2 AS attack_advantage
  FROM best JOIN aucs USING (model)),
reduced AS (
  SELECT *, 100 * greatest(b - attack_advantage, 0) / greatest(b, 1e-12) AS privacy_risk_reduction_pct
  FROM attacks, (SELECT attack_advantage AS b FROM attacks WHERE model = 'FedAvg'))"""


SAMPLE_CTE = """sample AS (
  SELECT model, score, 1 AS is_member FROM (SELECT * FROM predictions WHERE is_member = 1
    QUALIFY row_number() OVER (PARTITION BY model, city ORDER BY created_date, row_id) <= 400)
  UNION ALL SELECT model, score, 0 FROM predictions WHERE is_member = 0)"""



def drift_ctes(reference: str) -> str:
    return f"""{IMPORTANCE_CTES},
paired AS (SELECT a.model, a.feature, a.importance AS x, b.importance AS y
           FROM importance a JOIN importance b USING (feature) WHERE b.model = '{reference}'),
pair_ranks AS (
  SELECT model, rank() OVER (PARTITION BY model ORDER BY x) + (count(*) OVER (PARTITION BY model, x) - 1) / CAST(2 AS DOUBLE) AS rx,
         rank() OVER (PARTITION BY model ORDER BY y) + (count(*) OVER (PARTITION BY model, y) - 1) / CAST(2 AS DOUBLE) AS ry
  FROM paired),
rho AS (SELECT model, corr(rx, ry) AS rho FROM pair_ranks GROUP BY model),
top AS (SELECT * FROM importance QUALIFY row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) <= 20),
overlap AS (SELECT a.model, count(*) AS k FROM top a JOIN top b USING (feature) WHERE b.model = '{reference}' GROUP BY a.model),
drift AS (
  SELECT '{reference}' AS reference_model, model, rho AS spearman_rank_correlation, COALESCE(k, 0) / CAST(20 AS DOUBLE) AS top_k_feature_overlap,
         greatest(rho, CAST(0 AS DOUBLE)) AS explanation_stability, 1 - rho AS drift
  FROM rho LEFT JOIN overlap USING (model))"""


_WEIGHT_LIST = "[" + ", ".join(f"CAST({w!r} AS DOUBLE)" for w in WEIGHTS) + "]"
_VECTORS = f"""vectors AS (SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(embedding AS DOUBLE[]) AS x, {_WEIGHT_LIST} AS w FROM embeddings),
scores AS (
  SELECT *, 1 / (1 + exp(-(list_sum([x[i] * w[i] FOR i IN range(1, {WIDTH + 1})]) + CAST({BIAS} AS DOUBLE)))) AS s FROM vectors)"""

_P = f"WITH {PREDICTION_CTES}, "
_BY_CITY = _P + metric_ctes("predictions", "model, city")
_SET = ("accuracy", "precision", "recall", "macro_f1", "weighted_f1", "auroc", "auprc", "brier", "ece")
_SUBGROUP = f"""n, {r6("accuracy", "balanced_accuracy", "precision", "recall", "f1", "brier")}, round(auroc, 6) AS roc_auc,
       round(CASE WHEN auroc IS NOT NULL THEN auprc END, 6) AS pr_auc FROM full_metrics"""

ORACLE = {
    "binary_metrics": f"{_BY_CITY} SELECT model, city, n, {r6(*_SET)} FROM full_metrics",
    "confusion_rates": _P
    + metric_ctes("predictions", "model, category")
    + f" SELECT model, category, tp, fp, fn, tn, {r6('fpr', 'fnr', 'balanced_accuracy')} FROM full_metrics",
    "auroc": f"{_BY_CITY} SELECT model, city, round(auroc, 6) AS auroc FROM full_metrics",
    "average_precision": f"{_BY_CITY} SELECT model, city, round(auprc, 6) AS auprc FROM full_metrics",
    "document_metrics": f"WITH {_DOCUMENTS}, {metric_ctes('scored', 'lang')} SELECT lang, {_SUBGROUP}",
    "ece": _P + metric_ctes("predictions", "model") + f" SELECT model, n, {r6('brier', 'ece')} FROM full_metrics",
    "reliability_bins": f"""{_BY_CITY}
SELECT model, city, CAST(bin AS BIGINT) AS bin, round(mean, 6) AS mean_predicted_probability,
       round(rate, 6) AS observed_delay_rate, k AS n FROM bins""",
    "calibration_by_city": f"{_BY_CITY} SELECT model, city, n, {r6('brier', 'ece')} FROM full_metrics",
    "mean_calibration": f"""{_BY_CITY}
SELECT model, round(avg(brier), 6) AS brier, round(avg(ece), 6) AS ece FROM full_metrics GROUP BY model""",
    "subgroup_metrics": f"{_P}{metric_ctes('predictions', 'area')} SELECT area, {_SUBGROUP}",
    "one_class_groups": f"""{_P}
classed AS (SELECT CASE WHEN y_true = 1 THEN area END AS status_group, y_true, score FROM predictions),
{metric_ctes("classed", "status_group")}
SELECT status_group, {r6("auroc", "auprc")} FROM full_metrics""",
    "fairness_summary": f"{_P}{fairness_sql('predictions', ['city', 'category', 'area'], 100)} SELECT * FROM fairness",
    "fairness_small_groups": f"WITH {_DOCUMENTS}, {fairness_sql('scored', ['lang', 'source'], 60)} SELECT * FROM fairness",
    "aligned_predictions": f"""WITH {PREDICTION_CTES}
SELECT model, city, area, count(*) AS n, round(sum(score), 6) AS score FROM predictions GROUP BY ALL""",
    "scored_decisions": f"""WITH {PREDICTION_CTES}
SELECT model, CAST(score >= CAST(0.5 AS DOUBLE) AS BIGINT) AS predicted, CAST({_BIN} AS BIGINT) AS bin, count(*) AS n,
       round(avg(greatest(score, 1 - score)), 6) AS confidence, round(avg(1 / (1 + exp(-(score * 4 - 2)))), 6) AS squashed
FROM predictions GROUP BY 1, 2, 3""",
    "membership_attack": f"""{_P}{SAMPLE_CTE}, {attack_ctes("sample")}
SELECT model, {r6("attack_accuracy", "attack_auc", "attack_advantage", "privacy_risk_reduction_pct")} FROM reduced""",
    "membership_attack_all_rows": f"""{_P}{attack_ctes("predictions")}
SELECT model, {r6("attack_accuracy", "attack_auc", "attack_advantage")} FROM attacks""",
    "importance": f"WITH {IMPORTANCE_CTES} SELECT model, feature, round(importance, 6) AS importance FROM importance",
    "importance_rank": f"""WITH {IMPORTANCE_CTES}
SELECT model, feature, round(importance, 6) AS importance, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS rank
FROM importance QUALIFY rank <= 10""",
    "rank_correlation": f"WITH {drift_ctes('FedProx')} "
    "SELECT model, round(rho, 6) AS spearman_rank_correlation FROM rho",
    "explanation_drift": f"""WITH {drift_ctes('FedAvg')}
SELECT reference_model, model, {r6("spearman_rank_correlation", "top_k_feature_overlap", "explanation_stability", "drift")}
FROM drift""",
    "gradient_importance": f"""WITH {_VECTORS},
cells AS (SELECT label, unnest(range({WIDTH})) AS feature, s * (1 - s) AS g, unnest(x) AS x, unnest(w) AS w FROM scores),
means AS (SELECT label, feature, avg(g * abs(w) * abs(x)) AS v FROM cells GROUP BY 1, 2)
SELECT label, feature, round(v / sum(v) OVER (PARTITION BY label), 6) AS importance FROM means""",
    "linear_attribution": f"""WITH {_VECTORS},
cells AS (SELECT label, unnest(range({WIDTH})) AS feature, unnest(x) AS x, unnest(w) AS w FROM scores),
shifted AS (SELECT label, feature, w * (x - avg(x) OVER (PARTITION BY feature)) AS v FROM cells)
SELECT label, feature, round(avg(abs(v)), 6) AS importance FROM shifted GROUP BY 1, 2""",
}
