import datetime as dt

import pytest
from pyspark.sql import functions as F

from civiflow.functions import columns as C
from civiflow.functions.names import city_label, find_col, snake_case, snake_case_columns, table_columns
from civiflow.operators import clean, harmonize, label, starter

D = dt.datetime
SCHEMA = (
    "request_id string, created_date timestamp_ntz, closed_date timestamp_ntz, status string, category string,"
    " descriptor string, agency string, latitude double, longitude double, area string, city string"
)


def request(rid, created=D(2024, 1, 1), closed=D(2024, 1, 2), status="Closed", category="c", lat=1.0, lon=1.0, city="x"):
    return (rid, created, closed, status, category, "d", "a", lat, lon, "z", city)


def test_first_nonempty(spark):
    df = spark.createDataFrame([("  ", "B"), (" A ", "B"), (None, "")], "p string, q string")
    got = df.select(C.first_nonempty(df, ["p", "missing", "q"]).alias("v")).collect()
    assert [r["v"] for r in got] == ["B", "A", None]


def test_strip_takes_all_white_space(spark):
    df = spark.createDataFrame([(" \t x y　\n",), (" ",)], "v string")
    assert [r[0] for r in df.select(C.blank_to_null(F.col("v"))).collect()] == ["x y", None]


def test_harmonize_coerces_and_fills(spark):
    raw = spark.createDataFrame(
        [("1 ", "2024-02-30 00:00:00", "31/12/2023", "x", " ", "W1")],
        "unique_key string, created_date string, closed_date string, latitude string, community_board string, borough string",
    )
    mapping = harmonize.CityMapping(
        "nyc", harmonize.CITY_MAPPINGS["nyc"].sources, ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy"]
    )
    row = harmonize.harmonize(raw, mapping).first()
    assert row["request_id"] == "1" and row["created_date"] is None and row["closed_date"] == D(2023, 12, 31)
    assert row["latitude"] is None and row["area"] == "W1" and row["agency"] is None and row["city"] == "nyc"
    assert list(row.asDict()) == harmonize.TARGET_SCHEMA


def test_numbers(spark):
    df = spark.createDataFrame([("1.5",), (" 2 ",), ("x",), ("NaN",), (None,)], "v string")
    assert [r[0] for r in df.select(C.to_double_or_null(F.col("v"))).collect()] == [1.5, 2.0, None, None, None]


def test_mapping_columns_cover_sources():
    names = harmonize.CITY_MAPPINGS["boston"].columns()
    assert "subject" in names and "ward" in names and len(names) == len(set(names))


def test_cleaning_rules_in_sequence(spark):
    rows = [
        request("ok"),
        request("no-created", created=None),
        request("no-closed", closed=None),
        request("backwards", closed=D(2023, 1, 1)),
        # The earlier copy is not final, so the later final one goes with it.
        request("dup", status="Open"),
        request("dup", created=D(2024, 1, 1, 5)),
        request(None),
        request(None, created=D(2024, 1, 1, 1)),
        request("incomplete", status="Incomplete"),
        request("origin", lat=0.0, lon=0.0),
        request("far", lat=91.0),
        request("nowhere", lat=None),
        request("rare", category="r"),
        request("no-category-1", category=None),
        request("no-category-2", category=None),
        request("elsewhere", city="y"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    cleaned, report = clean.clean_with_report(df, min_category_samples=2)
    kept = {(r["city"], r["request_id"]) for r in cleaned.collect()}
    assert kept == {("x", "ok"), ("x", None), ("x", "no-category-1"), ("x", "no-category-2")}
    r = {row["city"]: row.asDict() for row in report.collect()}["x"]
    assert r.pop("city") == "x"
    assert r == {
        "input_rows": 15,
        "missing_created_date": 1,
        "missing_closed_date": 1,
        "closed_before_created": 1,
        "duplicate_request_id": 2,
        "cancelled_invalid_incomplete_status": 2,
        "impossible_coordinates": 3,
        "category_lt_100": 1,
        "output_rows": 4,
        "total_removed": 11,
    }
    again = {row["city"]: row["output_rows"] for row in clean.attrition(df, 2).collect()}
    assert again == {"x": 4, "y": 0}


def test_deduplication_limits_groups_before_the_shuffle(spark):
    plan = clean.deduplicated(spark.createDataFrame([request("a")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("Exchange", 1)
    assert "WindowGroupLimit" in above and "WindowGroupLimit" in below


def test_labels_use_strict_threshold_and_null_category(spark):
    rows = [request(str(h), closed=D(2024, 1, 1) + dt.timedelta(hours=h), category=c) for c in ("a", None) for h in (1, 2, 3, 10)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn(
        "resolution_hours", C.hours_between(F.col("created_date"), F.col("closed_date"))
    )
    out = label.label(df).collect()
    assert {(r["category"], r["delay_threshold_hours"]) for r in out} == {("a", 4.75), (None, 4.75)}
    assert sorted(r["request_id"] for r in out if r["delayed"] == 1) == ["10", "10"]
    tied = df.withColumn("resolution_hours", F.lit(5.0))
    assert {r["delayed"] for r in label.label(tied).collect()} == {0}
    assert label.labeling_summary(label.label(df)).first()["threshold_groups"] == 2


def test_routing_target(spark):
    df = spark.createDataFrame([(" A ", "c"), (" ", "c"), (None, None)], "agency string, category string")
    got = [r[0] for r in df.select(C.routing_target(F.col("agency"), F.col("category"))).collect()]
    assert got == ["A", "c", None]


def test_calendar_and_grid(spark):
    df = spark.createDataFrame([(D(2024, 1, 6), 1.239), (D(2024, 1, 8), -1.231)], "t timestamp_ntz, x double")
    got = df.select(C.day_of_week(F.col("t")), C.is_weekend(F.col("t")), C.grid(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [(5, 1, 1.23), (0, 0, -1.24)]


def test_names(spark):
    assert [city_label(c) for c in ("test_los_angeles", "nyc", "test_la")] == ["Los Angeles", "NYC", "LA"]
    assert snake_case(" Created  Date (UTC)!") == "created_date_utc"
    df = spark.createDataFrame([(1, 2)], "`Macro F1` int, `AU-ROC` int")
    assert table_columns(df).columns == ["macro_f1", "au_roc"]
    assert snake_case_columns(df).columns == ["macro_f1", "au_roc"]
    named = spark.createDataFrame([(1, 2)], "global_macro_f1 int, macro_f1 int")
    assert find_col(named, ["Macro-F1"]) == "macro_f1"
    assert find_col(named, ["global"]) == "global_macro_f1"
    assert find_col(named, ["zzz"], required=False) is None
    with pytest.raises(KeyError):
        find_col(named, ["zzz"])


def test_starter_frame(spark):
    raw = spark.createDataFrame(
        [("2024-01-01 00:00:00", "2024-02-15 12:00:00", None, "5"), ("2024-01-06 07:00:00", "2024-01-01 00:00:00", "3", "4")],
        "`Creation Date` string, `Resolved At` string, zip string, `Postal-Code` string",
    )
    late, backwards = starter.prepare(raw).collect()
    assert (late["delayed_resolution"], late["zip_code"], late["resolution_days"]) == (1, "5", 45.5)
    assert (backwards["delayed_resolution"], backwards["zip_code"], backwards["opened_dayofweek"]) == (None, "3", 5)
    with pytest.raises(KeyError):
        starter.with_resolution_days(raw)


def test_numbers_take_no_literal_suffix(spark):
    texts = ["12D", "3f", "0x1p3", "nan", "", None, " 12 ", "-1.5e3", ".5", "5.", "inf"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in df.select("i", C.to_double_or_null(F.col("t")).alias("n")).orderBy("i").collect()]
    assert got == [None] * 6 + [12.0, -1500.0, 0.5, 5.0, float("inf")]


def test_white_space_and_case_of_statuses(spark):
    texts = ["Closed", " COMPLETED\t", "\u00a0closed\u3000", "closed\n", "closed?", "closed canceled", "Canceled", "", None, "c\u043bosed", "\u2003x y\u2003"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [tuple(r) for r in df.select(C.has_final_status(F.col("s")), C.strip(F.col("s"))).collect()]
    assert got == [(None, None) if t is None else (t.strip().lower() in C.FINAL_STATUSES, t.strip()) for t in texts]
