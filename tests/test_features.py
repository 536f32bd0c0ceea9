import datetime as dt
import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from civiflow.functions import columns
from civiflow.functions.text import feature_names, strip_accents, tokens, with_bigrams
from civiflow.operators import prep, split, tfidf, workload
from civiflow.plans.ordered import first_n
from civiflow.plans.staging import stage

D = dt.datetime
TOKEN = re.compile(r"(?u)\b[a-zA-Z][a-zA-Z0-9_/-]+\b")

TEXTS = [
    "Noise - Residential: loud/music a_b c-d- x9 9x",
    "Straße foo-ß ß-bar größer café ÉCOLE naïve",
    "ﬁre ½ № 5 ①x ²y Ǆabc été ﷺ done ... a/ b/",
    "Москва-city日本abc abc日本 _under under_ a-é/z",
    "don't stop 3rd_floor re-open--twice",
    "",
]


def plain(text):
    # The ASCII text is returned as it is, like every text decomposition leaves it.
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def expected_tokens(text):
    return TOKEN.findall(plain(text.lower()))


def expected_terms(text):
    t = expected_tokens(text)
    return t + [" ".join(p) for p in zip(t, t[1:])]


def test_accents_and_tokens(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select(strip_accents(F.col("t")).alias("p"), tokens(F.col("t")).alias("w")).collect()
    # Hangul and other letters without an ASCII form stay composed; none occur here.
    assert [r["w"] for r in got] == [expected_tokens(t) for t in TEXTS]
    assert [r["p"] for r in got][:2] == [plain(t) for t in TEXTS][:2]


def test_bigrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "w array<string>")
    got = [r[0] for r in df.select(with_bigrams(F.col("w"))).collect()]
    assert got == [["a", "b", "c", "a b", "b c"], ["a"], []]


def test_names_that_coincide():
    assert feature_names(["a/b", "a b", "Ab-"], "t__") == ["t__a_b", "t__a_b_2", "t__ab"]


def test_tfidf_against_plain_python(spark):
    docs = [f"{'water leak ' * (i % 3)} pot{'hole' if i % 2 else 'holes'} street {i}th" for i in range(30)] + [None, "zzz"]
    df = spark.createDataFrame(list(enumerate(docs)), "id int, text string")
    table = {r["term"]: r for r in tfidf.vocabulary(df, "text", min_df=5, max_features=6).collect()}
    counts, dfs = {}, {}
    for d in docs:
        found = expected_terms(d or "")
        for t in found:
            counts[t] = counts.get(t, 0) + 1
        for t in set(found):
            dfs[t] = dfs.get(t, 0) + 1
    best = sorted((t for t in dfs if dfs[t] >= 5), key=lambda t: (-counts[t], t))[:6]
    assert sorted(table) == sorted(best)
    for t in best:
        assert table[t]["idf"] == pytest.approx(math.log((1 + len(docs)) / (1 + dfs[t])) + 1)
    model = tfidf.TfidfModel.fit(df, "text", 5, 6)
    rows = {(r["id"], r["term"]): r["weight"] for r in model.weight_rows(df, "id", "text").collect()}
    wide = {r["id"]: r for r in model.with_columns(df, "text").collect()}
    for i, d in enumerate(docs):
        raw = [expected_terms(d or "").count(t) * table[t]["idf"] for t in model.terms]
        norm = math.sqrt(sum(x * x for x in raw)) or 1.0
        for t, name, x in zip(model.terms, model.names(), raw):
            assert rows.get((i, t), 0.0) == pytest.approx(x / norm)
            assert wide[i][name] == pytest.approx(x / norm, abs=1e-6)


def test_vocabulary_round_trip(spark, tmp_path):
    model = tfidf.TfidfModel(["a", "b c"], [1.5, 2.0])
    model.save(spark, str(tmp_path / "v"))
    assert tfidf.TfidfModel.load(spark, str(tmp_path / "v")) == model


def test_trailing_counts_at_ties(spark):
    times = [D(2024, 1, 1)] * 3 + [D(2024, 1, 8)] * 2 + [D(2024, 1, 8, 0, 0, 1)]
    df = spark.createDataFrame([("x", None, t, i) for i, t in enumerate(times)], "city string, area string, t timestamp_ntz, i int")
    out = workload.with_trailing_counts(df, ["city"], {"area": "n7"}, "t")
    assert [r["n7"] for r in out.orderBy("i").collect()] == [0, 0, 0, 3, 3, 2]


def test_trailing_counts_against_brute_force(spark):
    import random

    rng = random.Random(5)
    rows = [
        (rng.choice("xy"), rng.choice([None, "a", "b"]), D(2024, 1, 1) + dt.timedelta(hours=rng.choice([0, 1, 24 * rng.randrange(30), rng.randrange(700)])), i)
        for i in range(400)
    ]
    df = spark.createDataFrame(rows, "city string, area string, t timestamp_ntz, i int")
    got = {r["i"]: r["n"] for r in workload.with_trailing_counts(df, ["city"], {"area": "n"}, "t").collect()}
    week = dt.timedelta(days=7)
    for city, area, t, i in rows:
        assert got[i] == sum(1 for c, a, u, _ in rows if c == city and a == area and t - week <= u < t)


def make_rows(n, city="x"):
    return [(f"r{i:03d}", D(2024, 1, 1) + dt.timedelta(days=i // 4), city, i % 2) for i in range(n)]


SPLIT_SCHEMA = "request_id string, created_date timestamp_ntz, city string, delayed int"


def test_time_split_of_twenty(spark):
    rows = make_rows(20) + make_rows(7, "la") + make_rows(3, "other") + [(None, D(2024, 1, 1), "y", 0), ("a", D(2024, 1, 1), "y", 0)]
    out = split.time_split(spark.createDataFrame(rows, SPLIT_SCHEMA), ["x", "y"], "la").collect()
    counts = {}
    for r in out:
        counts[(r["city"], r["split"])] = counts.get((r["city"], r["split"]), 0) + 1
    assert counts == {("x", "train"): 14, ("x", "val"): 3, ("x", "test"): 3, ("la", "external_test"): 7, ("y", "train"): 1, ("y", "test"): 1}
    assert [r["request_id"] for r in out if r["city"] == "y" and r["split"] == "train"] == ["a"]
    ordered = sorted((r["created_date"], r["request_id"], r["split"]) for r in out if r["city"] == "x")
    assert [s for _, _, s in ordered] == ["train"] * 14 + ["val"] * 3 + ["test"] * 3


def test_split_does_not_move_rows(spark):
    df = spark.createDataFrame(make_rows(50), SPLIT_SCHEMA)
    plan = split.time_split(df, ["x"])._jdf.queryExecution().executedPlan().toString()
    big_side = plan.split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in big_side and "Exchange hashpartitioning" not in big_side


def test_samples_are_bounded_and_repeatable(spark):
    df = spark.createDataFrame(make_rows(60) + make_rows(5, "y"), SPLIT_SCHEMA)
    once = sorted(map(str, split.sample_rows(df, ["city"], 10, seed=1).collect()))
    assert len(once) == 15 and once == sorted(map(str, split.sample_rows(df.repartition(3), ["city"], 10, seed=1).collect()))
    assert once != sorted(map(str, split.sample_rows(df, ["city"], 10, seed=2).collect()))
    limited = first_n(df.withColumn("q", F.when(F.col("city") == "x", 2).otherwise(9)), ["city"], ["created_date", "request_id"], F.col("q"))
    assert limited.count() == 7


def test_preprocessor_infrequent_and_unseen(spark):
    schema = "request_id string, city string, category string, hour int, grid double, delayed int"
    train = [(str(i), "x", "a" if i < 5 else f"rare{i}", i, float(i) if i else None, i % 2) for i in range(7)]
    p = prep.Preprocessor(scale=False, min_frequency=2).fit(spark.createDataFrame(train, schema))
    test = [("t1", "x", "a", 1, 1.0, 0), ("t2", "x", "rare5", 1, 1.0, 0), ("t3", "x", "new", None, None, 0)]
    got = {r["request_id"]: r["features"].toArray().tolist() for r in p.transform(spark.createDataFrame(test, schema)).collect()}
    # City, then infrequent and 'a' in label order, then the numbers.
    assert got == {"t1": [1, 0, 1, 1, 1], "t2": [1, 1, 0, 1, 1], "t3": [1, 0, 0, 3, 3.5]}


def test_feature_lists_and_targets(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1, "b")], "opened_at int, delayed_resolution int, zip string")
    xy = prep.build_xy(df)
    assert xy.columns == ["zip", "delayed_resolution"] and xy.count() == 1


def test_most_frequent_prefers_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,)], "c string")
    assert prep.most_frequent(df, ["c"]).first()["value"] == "a"


def test_trailing_counts_of_a_hot_key_and_day_spread_over_slices(spark):
    start = dt.datetime(2024, 5, 1)
    hot = [("a", "hot", start + dt.timedelta(seconds=i)) for i in range(4000)]
    cold = [("a", f"k{i % 50}", start + dt.timedelta(minutes=7 * i)) for i in range(4000)]
    df = spark.createDataFrame(hot + cold, "city string, area string, ts timestamp_ntz")
    # Slices this small would be merged.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = workload.trailing_counts(df, ["city"], ["area"], "ts")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = out.filter("value = 'hot'").toPandas().sort_values("ts")
    assert rows["trailing"].tolist() == list(range(4000))
    slices = {int(f.split("part-")[1][:5]) for f in out.inputFiles()}
    assert len(slices) >= 4


def test_numbers_meet_no_pattern(spark, capsys):
    df = spark.sql("SELECT 1.5D AS x, CAST(2 AS DECIMAL(9, 2)) AS d, '3' AS s, true AS b, CAST('NaN' AS DOUBLE) AS n FROM range(1)")
    out = df.select(*[columns.to_double_or_null(F.col(c)).alias(c) for c in df.columns])
    assert tuple(out.first()) == (1.5, 2.0, 3.0, None, None)
    spark.range(1).select(columns.to_double_or_null(F.col("id")).alias("x")).explain()
    assert "RLIKE" not in capsys.readouterr().out


def test_split_reads_features_once(spark):
    rows = spark.createDataFrame(make_rows(20), SPLIT_SCHEMA)
    twice = rows.withColumn("delayed", F.lit(1))
    out = split.time_split(twice, ["x"], keys=rows)
    assert sorted(map(tuple, out.drop("delayed").collect())) == sorted(map(tuple, split.time_split(rows, ["x"]).drop("delayed").collect()))


def test_pooled_summary_scans_once(spark):
    rows = spark.createDataFrame(make_rows(20) + make_rows(8, "y"), SPLIT_SCHEMA)
    table = stage(split.time_split(rows, ["x", "y"]))
    out = split.pooled_summary(table, ["x", "y"])
    train = out.filter("split = 'train'").first()
    assert (train["rows"], train["city_rows"], train["delayed_rate"]) == (19, {"x": 14, "y": 5}, 9 / 19)
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") <= 1


def test_split_queries_compute_no_feature_they_do_not_return(spark, monkeypatch):
    from civiflow.catalog import features as catalog

    def refuse(*_):
        raise AssertionError("trailing counts are not in the result")

    monkeypatch.setattr(catalog.features, "with_workload", refuse)
    out = catalog.QUERIES["time_split"](spark, "/root/testdata/sf0.01")
    assert {r["split"] for r in out.select("split").distinct().collect()} == {"train", "val", "test", "external_test"}


def test_requests_are_not_moved_by_customer(spark):
    from civiflow.catalog.inputs import service_requests

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = service_requests(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.split("\n")
    by_order = next(i for i, x in enumerate(lines) if "l_orderkey" in x and "= o_orderkey" in x)
    by_customer = next(i for i, x in enumerate(lines) if "o_custkey" in x and "= c_custkey" in x)
    assert by_customer > by_order


def test_ascii_tokens_equal_the_general_rule(spark):
    """Random texts by both patterns, and marks after letters that have a plain form."""
    import random

    from civiflow.functions import text as X

    rng = random.Random(11)
    rows = [("".join(rng.choices("aZ9_-/ .é́ﬁßЖ½" if i % 2 else "aZ9_-/ .", k=rng.randint(0, 14))),) for i in range(4000)]
    df = spark.createDataFrame(rows, "t string")
    general = F.regexp_extract_all(X.let(F.lower("t"), X.strip_accents), F.lit(X.TOKEN), F.lit(0))
    assert df.filter(~X.tokens(F.col("t")).eqNullSafe(general)).count() == 0
    plans = df.select(X.tokens(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert X.ASCII_TOKEN in plans
    import unicodedata

    def expected(t):
        return "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x))

    got = df.select("t", X.let(F.col("t"), X.strip_accents).alias("s")).collect()
    # Only characters that become ASCII are decomposed.
    assert all(r["s"] == expected(r["t"]) for r in got)


def test_column_totals_make_no_row_of_a_cell(spark):
    from civiflow.operators import features

    rows = [("a", 1, 0.5, None), ("a", 0, None, None), (None, 3, 0.0, 2.0), ("b", None, -1.5, 0.0), (None, 2, 0.25, None)]
    df = spark.createDataFrame(rows, "city string, `x 1` int, y float, z double").repartition(3)
    columns = ["x 1", "y", "z"]
    got = {(r["city"], r["feature"]): (r["n"], r["total"]) for r in features.column_totals(df, "city", columns).collect()}
    want = df.groupBy("city").agg(*[f(F.col(f"`{c}`")) for c in columns for f in (lambda c: F.count_if(c != 0), F.sum)]).collect()
    assert got == {(r[0], c): (r[1 + 2 * i], r[2 + 2 * i]) for r in want for i, c in enumerate(columns)}


def test_feature_totals_store_no_features(spark, monkeypatch):
    from civiflow.catalog import learn

    stored = []
    monkeypatch.setattr(learn, "stage", lambda df, label="table": stored.append(label))
    out = learn.feature_totals(spark, "/root/testdata/sf0.01")
    assert not stored and out.filter("n > 0").count() > 0
