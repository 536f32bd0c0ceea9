import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from civiflow.plans.joins import lookup
from civiflow.plans.ordered import cut_keys, exact_quantiles, first_n, page, running_sums
from civiflow.plans.staging import shared_dir, stage


def test_stage_round_trip_in_shared_folder(spark):
    df = spark.range(100).withColumn("k", F.when(F.col("id") > 50, F.lit("a")))
    back = stage(df, "t", ["k"])
    assert back.count() == 100
    assert back.inputFiles()[0].removeprefix("file://").startswith(shared_dir(spark))


def test_running_sums_with_one_group_holding_most_rows(spark):
    rows = [("hot", float(i)) for i in range(3000)] + [(None, float(i)) for i in range(5)] + [("cold", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("n", F.lit(2))
    out = running_sums(df, ["g"], ["v"], ["n"]).toPandas()
    for key, part in out.groupby("g", dropna=False):
        part = part.sort_values("v")
        assert part["upto_n"].tolist() == np.cumsum(part["n"]).tolist(), key
        assert (part["before_n"] == part["upto_n"] - part["n"]).all()
        assert (part["total_n"] == part["n"].sum()).all()


@pytest.mark.parametrize("p", [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0])
def test_quantiles_equal_numpy(spark, p):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 501), "v": rng.integers(0, 60, 501).astype(float)})
    got = exact_quantiles(spark.createDataFrame(pdf), ["g"], "v", {"q": p}).toPandas().set_index("g")["q"]
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(np.quantile(part["v"], p), abs=1e-12)


def test_quantile_of_four(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, 10.0), (1, None)], "g int, v double")
    assert exact_quantiles(df, ["g"], "v", {"q": 0.75}).first()["q"] == 4.75


def test_cut_keys_and_missing_positions(spark):
    df = spark.createDataFrame([("a", i // 4, i) for i in range(20)] + [("b", 0, 0)], "g string, d int, i int")
    cuts = cut_keys(df, ["g"], ["d", "i"], {"x": lambda n: n - 7, "y": lambda n: n}).collect()
    found = {r["g"]: (r["x"] and tuple(r["x"]), r["y"]) for r in cuts}
    assert found["a"] == ((3, 13), None)


def test_first_n_and_page(spark):
    df = spark.createDataFrame([("a", 0, i) for i in range(30)] + [("b", 1, i) for i in range(3)], "g string, d int, i int")
    first = first_n(df, ["g"], ["d", "i"], 10)
    assert sorted((r["g"], r["i"]) for r in first.collect()) == [("a", i) for i in range(10)] + [("b", i) for i in range(3)]
    assert sorted(r["i"] for r in page(df.filter("g = 'a'"), ["d", "i"], 25, 10).collect()) == [25, 26, 27, 28, 29]
    assert first_n(df, ["g"], ["d", "i"], 0).count() == 0


def test_lookup_matches_null_keys(spark):
    left = spark.createDataFrame([("a",), (None,)], "k string")
    right = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    assert sorted(r["v"] for r in lookup(left, right, ["k"]).collect()) == [1, 2]


def test_cut_keys_stages_three_tables_and_takes_ties(spark, monkeypatch):
    from civiflow.plans import ordered

    staged = []
    monkeypatch.setattr(ordered, "stage", lambda df, label="t", *a: staged.append(label) or stage(df, label, *a))
    rows = [("hot", 7, None)] * 500 + [("hot", i, str(i % 3)) for i in range(300)] + [(None, 1, "x")]
    cuts = cut_keys(spark.createDataFrame(rows, "g string, d int, s string"), ["g"], ["d", "s"], {"x": lambda n: F.floor(n / 2)})
    ordered_rows = sorted(((d, s) for g, d, s in rows if g == "hot"), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    assert {r["g"]: tuple(r["x"]) for r in cuts.collect()} == {"hot": ordered_rows[400], None: (1, "x")}
    assert len(staged) <= 3


def test_cut_keys_of_repeated_first_values_reads_only_the_days_found(spark):
    rng = np.random.default_rng(5)
    rows = [(g, None if d == 0 else int(d), int(i)) for g in ("a", None) for i, d in enumerate(rng.integers(0, 6, 400))] + [("b", 7, 1)] * 3
    df = spark.createDataFrame(rows, "g string, d int, i int")
    positions = {"x": lambda n: F.floor(n * F.lit(0.02)), "y": lambda n: F.floor(n * F.lit(0.7)), "z": lambda n: n - 1, "none": lambda n: n}
    plain, coarse = (cut_keys(df, ["g"], ["d", "i"], positions, repeated=r) for r in (False, True))
    assert sorted(map(str, plain.collect())) == sorted(map(str, coarse.collect()))
    for g, part in (("a", rows[:400]), (None, rows[400:800])):
        keys = sorted([(d is not None, d, i) for _, d, i in part], key=lambda k: (k[0], k[1] or 0, k[2]))
        got = coarse.filter(F.col("g").eqNullSafe(F.lit(g))).first()
        assert [tuple(got[n]) for n in ("x", "y", "z")] == [keys[p][1:] for p in (8, 280, 399)] and got["none"] is None
