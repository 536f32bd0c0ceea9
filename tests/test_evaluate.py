import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from civiflow.functions.columns import score_bin
from civiflow.operators import attack, averaging, explain, fairness, metrics, reports

P = "model string, city string, category string, area string, y_true int, score double"


def sample(n=600, seed=1, levels=40):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        y = int(rng.random() < 0.4)
        s = min(max(rng.gauss(0.35 + 0.25 * y, 0.2), 0), 1)
        out.append((rng.choice(["m1", "m2"]), rng.choice("AB"), rng.choice(["c", None]), rng.choice("xyz"), y, round(s * levels) / levels))
    return out


def auroc(y, s):
    pos, neg = [v for t, v in zip(y, s) if t], [v for t, v in zip(y, s) if not t]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def average_precision(y, s):
    total, ap, previous = sum(y), 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        picked = [a for a, b in zip(y, s) if b >= t]
        recall = sum(picked) / total
        ap += (recall - previous) * sum(picked) / len(picked)
        previous = recall
    return ap


def ece(y, s):
    ids = np.digitize(s, np.linspace(0, 1, 11)[1:-1], right=True)
    y, s = np.array(y), np.array(s)
    return sum((ids == b).mean() * abs(y[ids == b].mean() - s[ids == b].mean()) for b in range(10) if (ids == b).any())


def f1(y, p, c):
    tp = sum(a == c and b == c for a, b in zip(y, p))
    wrong = sum((a == c) != (b == c) for a, b in zip(y, p))
    return 2 * tp / (2 * tp + wrong) if tp + wrong else 0.0


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(s,) for s in (0.0, 0.1, 0.3, 0.30000000000000004, 0.31, 0.7, 1.0)], "s double")
    assert [r[0] for r in df.select(score_bin(F.col("s"))).collect()] == [0, 0, 2, 2, 3, 6, 9]


def test_metrics_against_plain_python(spark):
    rows = sample()
    got = {r["model"]: r for r in metrics.binary_metrics(spark.createDataFrame(rows, P), ["model"]).collect()}
    for m in ("m1", "m2"):
        y, s = [r[4] for r in rows if r[0] == m], [r[5] for r in rows if r[0] == m]
        p = [int(v >= 0.5) for v in s]
        want = {
            "n": len(y),
            "accuracy": sum(a == b for a, b in zip(y, p)) / len(y),
            "precision": sum(a and b for a, b in zip(y, p)) / sum(p),
            "recall": sum(a and b for a, b in zip(y, p)) / sum(y),
            "macro_f1": (f1(y, p, 0) + f1(y, p, 1)) / 2,
            "weighted_f1": ((len(y) - sum(y)) * f1(y, p, 0) + sum(y) * f1(y, p, 1)) / len(y),
            "auroc": auroc(y, s),
            "auprc": average_precision(y, s),
            "brier": sum((a - b) ** 2 for a, b in zip(s, y)) / len(y),
            "ece": ece(y, s),
        }
        for k, v in want.items():
            assert got[m][k] == pytest.approx(v), k


def test_one_class_groups(spark):
    rows = [("m", "A", "c", "x", 1, s) for s in (0.2, 0.9)] + [("m", "B", "c", "x", 0, s) for s in (0.2, 0.4)]
    got = {r["city"]: r for r in metrics.binary_metrics(spark.createDataFrame(rows, P), ["city"]).collect()}
    assert got["A"]["auroc"] is None and got["A"]["auprc"] == 1.0 and got["B"]["auprc"] == 0.0
    # Predicted and true labels of B are all negative: one label, F1 of 1.
    assert got["B"]["macro_f1"] == 1.0 and got["B"]["precision"] == 0.0
    sub = {r["city"]: r for r in metrics.subgroup_metrics(spark.createDataFrame(rows, P), ["city"]).collect()}
    assert sub["A"]["pr_auc"] is None and sub["A"]["balanced_accuracy"] == 0.5


def test_reversed_scores_mirror_auroc(spark):
    df = spark.createDataFrame(sample(seed=4), P)
    a = metrics.ranking_metrics(df, ["model"]).toPandas().set_index("model")["auroc"]
    b = metrics.ranking_metrics(df.withColumn("score", 1 - F.col("score")), ["model"]).toPandas().set_index("model")["auroc"]
    assert (a + b - 1).abs().max() < 1e-12


def test_reliability_bins_cover_all_rows(spark):
    df = spark.createDataFrame(sample(), P)
    assert metrics.reliability_bins(df, ["model", "city"]).agg(F.sum("n")).first()[0] == 600


def test_fairness_keeps_models_without_large_groups(spark):
    rows = sample() + [("tiny", "A", "c", "x", 1, 0.4)]
    out = {(r["model"], r["group_column"]): r for r in fairness.fairness_summary(spark.createDataFrame(rows, P), min_rows=50).collect()}
    assert len(out) == 9
    assert out[("tiny", "city")]["groups"] == 0 and out[("tiny", "city")]["macro_f1_gap"] is None
    mine = [r for r in rows if r[0] == "m1"]
    per_city = []
    for c in "AB":
        y, p = [r[4] for r in mine if r[1] == c], [int(r[5] >= 0.5) for r in mine if r[1] == c]
        per_city.append((f1(y, p, 0) + f1(y, p, 1)) / 2)
    assert out[("m1", "city")]["macro_f1_gap"] == pytest.approx(abs(per_city[0] - per_city[1]))
    # The missing category is a group.
    assert out[("m1", "category")]["groups"] == 2


def test_attack_against_plain_python(spark):
    rng = random.Random(2)
    rows = [("FedAvg", rng.random() ** 2, 1) for _ in range(150)] + [("FedAvg", rng.random(), 0) for _ in range(250)]
    rows += [("solo", 0.5, 1)]
    df = spark.createDataFrame(rows, "model string, score double, is_member int")
    got = {r["model"]: r for r in attack.with_risk_reduction(attack.membership_attack(df)).collect()}
    mine = [r for r in rows if r[0] == "FedAvg"]
    conf, label = np.array([max(s, 1 - s) for _, s, _ in mine]), np.array([m for _, _, m in mine])
    best = max(((conf >= t).astype(int) == label).mean() for t in np.quantile(conf, np.linspace(0.05, 0.95, 19)))
    assert got["FedAvg"]["attack_accuracy"] == pytest.approx(best)
    assert got["FedAvg"]["attack_auc"] == pytest.approx(auroc(list(label), list(conf)))
    assert got["FedAvg"]["privacy_risk_reduction_pct"] == 0.0
    assert got["solo"]["attack_auc"] is None and got["solo"]["privacy_risk_reduction_pct"] is None


def test_quantile_probabilities_equal_linspace():
    assert attack.PROBS == np.linspace(0.05, 0.95, 19).tolist()


def test_rank_correlation_with_ties(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"feature": [f"f{i}" for i in range(30)], "a": rng.integers(0, 8, 30).astype(float), "b": rng.integers(0, 8, 30).astype(float)})
    long = pd.concat([pdf[["feature"]].assign(model=m, importance=pdf[m]) for m in ("a", "b")])
    df = spark.createDataFrame(long)
    drift = {r["model"]: r for r in explain.explanation_drift(df, "a", 5).collect()}
    want = pdf["a"].rank().corr(pdf["b"].rank())
    assert drift["b"]["spearman_rank_correlation"] == pytest.approx(want)
    assert drift["b"]["explanation_stability"] == pytest.approx(max(want, 0.0))
    assert drift["a"]["drift"] == pytest.approx(0.0) and drift["a"]["top_k_feature_overlap"] == 1.0
    one = explain.rank_correlation(df.filter("model = 'a' and feature = 'f1'"), df).collect()
    assert all(r["spearman_rank_correlation"] is None for r in one)


def test_gradient_importance_sums_to_one(spark):
    df = spark.createDataFrame([(1, [1.0, -2.0, 0.0]), (1, [0.5, 1.0, 3.0])], "g int, features array<double>")
    w, b = [0.5, -1.0, 0.25], 0.1
    got = [r["importance"] for r in explain.gradient_importance(df, ["g"], w, b).orderBy("feature").collect()]
    x = np.array([[1.0, -2.0, 0.0], [0.5, 1.0, 3.0]])
    s = 1 / (1 + np.exp(-(x @ np.array(w) + b)))
    raw = (np.abs(np.array(w)) * np.abs(x) * (s * (1 - s))[:, None]).mean(axis=0)
    assert got == pytest.approx((raw / raw.sum()).tolist())


def test_early_stopping_on_a_plateau(spark):
    metric = [0.5, 0.50005, 0.5001, 0.50015, 0.7, 0.9]
    df = spark.createDataFrame([("r", i + 1, m) for i, m in enumerate(metric)], "run string, round int, metric double")
    row = averaging.stop_rounds(df, ["run"], patience=3).first()
    assert (row["best_round"], row["best_metric"], row["rounds_completed"]) == (6, 0.9, 6)
    row = averaging.stop_rounds(df, ["run"], patience=2).first()
    assert (row["best_round"], row["rounds_completed"]) == (1, 3)


def test_parameter_average_and_protection(spark):
    rows = [(1, "a", 0, 1.0, 10), (1, "b", 0, 4.0, 20), (1, "a", 1, 7.0, 10), (1, "b", 1, 7.0, 20)]
    df = spark.createDataFrame(rows, "run int, client string, idx int, value double, n int")
    shared = averaging.average_parameters(df, ["run"])
    assert {r["idx"]: r["value"] for r in shared.collect()} == {0: 3.0, 1: 7.0}
    same = averaging.protect_updates(df, shared, clip=100.0, noise_multiplier=0.0)
    assert sorted((r["client"], r["idx"], r["value"]) for r in same.collect()) == [("a", 0, 1.0), ("a", 1, 7.0), ("b", 0, 4.0), ("b", 1, 7.0)]
    cut = averaging.protect_updates(df, shared, clip=0.5, noise_multiplier=0.0)
    assert {(r["client"], r["idx"]): r["value"] for r in cut.collect()}[("a", 0)] == pytest.approx(2.5)
    noisy = averaging.protect_updates(df, shared, clip=0.5)
    again = averaging.protect_updates(df.repartition(3), shared, clip=0.5)
    assert sorted(map(str, noisy.collect())) == sorted(map(str, again.collect()))


def test_hashed_noise_is_normal(spark):
    z = spark.range(20000).select(averaging.hashed_normal(1, F.col("id")).alias("z")).toPandas()["z"]
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and abs((z.abs() < 1).mean() - 0.6827) < 0.02


def test_averaging_learns_a_separable_rule(spark):
    from pyspark.ml.functions import array_to_vector

    df = spark.range(900).select(
        F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("client"),
        array_to_vector(F.array(F.randn(1), F.randn(2))).alias("features"),
        (F.xxhash64("id") % 2).alias("unused"),
    )
    from pyspark.ml.functions import vector_to_array

    from civiflow.plans.staging import stage

    labelled = stage(df.withColumn("label", (F.get(vector_to_array("features"), F.lit(0)) > 0.2).cast("double")))
    config = averaging.AveragingConfig(rounds=6, local_passes=3, learning_rate=2.0, proximal_mu=0.01)
    weights, history = averaging.fit_by_averaging(labelled, labelled, config)
    assert weights[0] > 1 and abs(weights[1]) < 0.5 and weights[2] < 0
    assert [h["train_loss"] for h in history if h["client"] == "c0"] == sorted((h["train_loss"] for h in history if h["client"] == "c0"), reverse=True)
    assert averaging.client_macro_f1(averaging.linear_scores(labelled, weights))["c1"] > 0.9


def test_report_orders_and_missing_results(spark):
    df = spark.createDataFrame([("zeta", 0.1), ("FedAvg", 0.2), ("MLP", 0.3), ("alpha", 0.4)], "model string, trust_score double")
    assert [r["model"] for r in reports.order_models(df).collect()] == ["MLP", "FedAvg", "alpha", "zeta"]
    assert [r["model"] for r in reports.top_models(df, k=2).collect()] == ["alpha", "MLP"]
    only = reports.main_comparison(None, None, df)
    assert only.columns == ["experiment", "model", "trust_score"]
    shown = reports.figure_table(df.withColumnsRenamed({"trust_score": "Trust Score"}), {"model": ["model"], "score": ["trust-score"]})
    assert shown.columns == ["model", "score"]


def test_privacy_component(spark):
    df = spark.createDataFrame([("None", 0.1), ("Strong DP", None), ("Weak DP", 3.0)], "level string, adv double")
    got = [r[0] for r in df.select(reports.privacy_component(F.col("level"), F.col("adv"))).collect()]
    assert got == pytest.approx([0.65 * 0.2 + 0.35 * 0.9, 1.0, 0.65 * 0.7])
    assert math.isclose(sum(reports.SCORE_WEIGHTS.values()), 1.0)


def test_average_precision_of_billions_of_ties(spark):
    big = 4_000_000_000
    row = spark.range(1).select(*[F.lit(v).cast("long").alias(c) for c, v in {"pos": big, "neg": big, "before_pos": 0, "before_neg": 0, "total_pos": big, "total_neg": big}.items()])
    sums = row.agg(*metrics._ranking_sums()).first()
    assert sums["__ap"] == big / 2 and sums["__pairs"] == big * (big / 2.0)


def test_calibration_table_has_a_cell_for_each_city(spark):
    rows = spark.createDataFrame(
        [("FedProx", "B", 0.2, 0.1), ("FedAvg", "A", 0.3, 0.4), ("FedAvg", "B", 0.5, None)],
        "model string, city string, brier double, ece double",
    )
    found = [tuple(r) for r in reports.calibration_table(rows, ["A", "B"]).collect()]
    assert found == [("FedAvg", 0.3, 0.5, 0.4, None), ("FedProx", None, 0.2, None, 0.1)]
    assert reports.calibration_table(rows.limit(0), ["A"]).columns == ["model", "brier_a", "ece_a"]


def test_labelled_matrix_keeps_its_rows(spark):
    matrix = spark.createDataFrame([(0, "x", 0.5, None)], "position int, train_city string, nyc double, los_angeles double")
    shown = reports.labelled_matrix(matrix)
    assert shown.columns[:2] == ["position", "train_city"] and tuple(shown.first()) == (0, "x", 0.5, None)


def test_gradients_meet_only_entries(spark):
    """Mean gradient and loss per client of sparse and dense rows, against plain NumPy."""
    rng = np.random.default_rng(3)
    dense = np.where(rng.random((60, 9)) < 0.3, rng.normal(size=(60, 9)), 0.0)
    y, share = (rng.random(60) < 0.4).astype(float), rng.random(60) + 0.5
    rows = []
    for i, x in enumerate(dense):
        v = Vectors.dense(x.tolist()) if i % 5 == 0 else Vectors.sparse(9, [(int(j), float(x[j])) for j in np.flatnonzero(x)])
        rows.append(("ab"[i % 2], v, float(y[i]), float(share[i])))
    df = spark.createDataFrame(rows, ["client", "features", "label", "pos_weight_of_row"])
    weights = {"a": rng.normal(size=10), "b": rng.normal(size=10)}
    got = averaging._gradients(df, weights)
    for k, c in enumerate("ab"):
        x = np.hstack([dense[k::2], np.ones((30, 1))])
        p = 1 / (1 + np.exp(-x @ weights[c]))
        assert np.allclose(got[c][0], ((p - y[k::2]) * share[k::2]) @ x / 30)
        assert np.isclose(got[c][1], -(np.log(np.where(y[k::2] == 1, p, 1 - p)) * share[k::2]).mean())
    scores = [r["score"] for r in averaging.linear_scores(df.filter("client = 'a'"), weights["a"]).collect()]
    assert np.allclose(scores, 1 / (1 + np.exp(-np.hstack([dense[::2], np.ones((30, 1))]) @ weights["a"])))
    assert "vector_to_array" not in averaging.linear_scores(df, weights["a"])._jdf.queryExecution().toString()


def averaging_rows(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(900):
        x, c = rng.normal(size=3), i % 3
        v = Vectors.sparse(6, [(c, 1.0), (3, float(x[0])), (5, float(x[2]))])
        rows.append((f"c{c}", v, float(x[0] + 0.3 * rng.normal() > 0.4 * c)))
    return spark.createDataFrame(rows, ["client", "features", "label"]).persist()


def test_runs_side_by_side_equal_runs_alone(spark, monkeypatch):
    df = averaging_rows(spark)
    variants = {
        "plain": averaging.AveragingConfig(rounds=3, local_passes=2),
        "proximal": averaging.AveragingConfig(rounds=3, local_passes=2, proximal_mu=0.5),
        "noisy": averaging.AveragingConfig(rounds=2, noise_multiplier=1.0),
        "short": averaging.AveragingConfig(rounds=3, patience=1, min_delta=9.0),
    }
    alone = {run: averaging.fit_by_averaging(df, df, config, run) for run, config in variants.items()}
    passes = []
    real = averaging._gradients
    monkeypatch.setattr(averaging, "_gradients", lambda *a: passes.append(1) or real(*a))
    weights, history = averaging.variant_grid(df, df, variants)
    # Passes over the rows: as many as the longest run has.
    assert len(passes) == 6
    for run, (w, h) in alone.items():
        assert np.allclose(weights[run], w, atol=1e-12)
        got = [r.asDict() for r in history.filter(F.col("run") == run).orderBy("round", "client").collect()]
        assert [(r["round"], r["client"]) for r in got] == [(r["round"], r["client"]) for r in h]
        assert np.allclose([r["train_loss"] for r in got], [r["train_loss"] for r in h])
    assert max(r["round"] for r in alone["short"][1]) == 2


def test_noted_shift_equals_shifted_vectors(spark):
    """Numbers stored without their shift keep their zeros out, and give the same model and scores."""
    from civiflow.operators.prep import Preprocessor

    data = [("x", f"a{i % 4}", float(i % 7 == 0), float(i % 5), int(i % 7 == 0 or i % 4 == 1), f"c{i % 2}") for i in range(700)]
    df = spark.createDataFrame(data, "city string, agency string, a double, b double, delayed int, client string")
    prep = Preprocessor(scale=True, center=True).fit(df.drop("client"))
    label = F.col("delayed").cast("double").alias("label")
    shifted, noted = (prep.transform(df, noted=n).select("client", label, "features").persist() for n in (False, True))
    entries = [d.select(F.sum(F.size(averaging.entries()[0]))).first()[0] for d in (shifted, noted)]
    assert entries[1] < entries[0] and averaging.shift_of(shifted) is None
    config = averaging.AveragingConfig(rounds=3, local_passes=2)
    (w1, h1), (w2, h2) = (averaging.fit_by_averaging(d, d, config) for d in (shifted, noted))
    assert np.allclose(w1, w2, atol=1e-12) and h1 == [pytest.approx(r) for r in h2]
    one, two = ([r["score"] for r in averaging.linear_scores(d, w1).collect()] for d in (shifted, noted))
    assert np.allclose(one, two, atol=1e-12)
