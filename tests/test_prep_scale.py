"""Preparation of wide tables: one counting pass, vectors without joins, narrow scored tables."""

import numpy as np
from pyspark.sql import functions as F

from civiflow.catalog import features as catalog
from civiflow.catalog import report
from civiflow.operators import models, prep

SCHEMA = "city string, agency string, a double, b string, c int, d double, e double"


def rows():
    rng = np.random.default_rng(4)
    out = []
    for i in range(600):
        a = None if i % 7 == 0 else float("nan") if i % 11 == 0 else round(float(rng.normal()), 2)
        b = "x" if i % 5 == 0 else str(i % 13)
        out.append(("x", f"s{i % 9}", a, b, i % 3, 0.1, None))
    return out


def test_column_facts_equal_plain_numpy(spark):
    data = rows()
    numeric = ["a", "b", "c", "d", "e"]
    got = {r["feature"]: r for r in prep.column_facts(spark.createDataFrame(data, SCHEMA), numeric).collect()}
    for place, name in enumerate(numeric, start=2):
        x = np.array([np.nan if r[place] in (None, "x") else float(r[place]) for r in data])
        known = x[~np.isnan(x)]
        if not len(known):
            assert (got[name]["median"], got[name]["mean"], got[name]["std"]) == (None, 0.0, 0.0)
            continue
        filled = np.where(np.isnan(x), np.median(known), x)
        assert np.isclose(got[name]["median"], np.median(known))
        assert np.isclose(got[name]["mean"], filled.mean())
        assert got[name]["std"] == 0.0 if name == "d" else np.isclose(got[name]["std"], filled.std())


def test_values_that_are_their_own_labels_are_not_joined(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    fitted = prep.Preprocessor(min_frequency=20).fit(df)
    out = fitted.transform(df)
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    v = out.first()["features"]
    assert v.size == fitted.width == 1 + 9 + 5
    assert v[0] == 1.0 and v[1] == 1.0 and v.numNonzeros() <= 2 + 5


def test_categories_stand_in_javas_order(spark):
    names = ["\U0001F600", "￿", "a"]
    df = spark.createDataFrame([("x", n, 1.0) for n in names for _ in range(20)], "city string, agency string, a double")
    assert prep.Preprocessor().fit(df).labels["agency"] == ["a", "\U0001F600", "￿"]


def test_calibrated_rows_are_stored_without_features(spark, monkeypatch):
    stored = []
    keep = models.stage

    def watch(df, label="table"):
        stored.append((label, df.columns))
        return keep(df, label)

    monkeypatch.setattr(models, "stage", watch)
    df = spark.createDataFrame([(str(i), "x", float(i % 10), int(i % 10 > 4 or i % 7 == 0)) for i in range(400)], "request_id string, city string, a double, delayed int")
    out = models.isotonic_scores("logistic_regression", df, df, ["request_id"], maxIter=5)
    assert out.count() == 400 and out.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert [c for label, c in stored if label == "scored"] == [["request_id", "y_true", "score_0", "score_1", "score_2"]]


def test_results_without_features_compute_none(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("not in the result")

    monkeypatch.setattr(catalog.features, "with_workload", refuse)
    assert report.QUERIES["step_manifest"](spark, "/root/testdata/sf0.01").count() == 5


def test_numeric_facts_need_no_label(spark, monkeypatch):
    def refuse(*_):
        raise AssertionError("not in the result")

    monkeypatch.setattr(catalog, "labeled", refuse)
    assert catalog.QUERIES["impute_scale_stats"](spark, "/root/testdata/sf0.01").count() == len(catalog.STATS)


def test_trees_split_on_labels_as_categories(spark):
    """A label so rare that a sample of values would miss it is still told apart."""
    data = [("x", "rare" if i % 1000 < 2 else f"s{i % 3}", float(i % 5), int(i % 1000 < 2)) for i in range(30000)]
    df = spark.createDataFrame(data, "city string, agency string, a double, delayed int")
    fitted = models.fit_model("rf", df, numTrees=3, maxDepth=3, featureSubsetStrategy="all")
    assert fitted.score(df, ["agency"]).filter("(agency = 'rare') != (score > 0.5)").count() == 0
    assert len(fitted.preprocessor.attributes()["ml_attr"]["attrs"]["binary"]) == 5
