import json
import os

import pytest
from pyspark.sql import functions as F

from civiflow.operators import models
from civiflow.sources import ckan, drift, quota, readers, sinks

HEAD = "srnumber,requestsource,owner"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_readers_by_suffix(spark, tmp_path):
    files = [
        write(tmp_path / "a.csv", "x,y\n1,u\n2,v\n"),
        write(tmp_path / "b.json", json.dumps([{"x": "3", "z": "w"}, {"x": "4", "z": "q"}], indent=1)),
        write(tmp_path / "c.jsonl", '{"x": "5"}\n{"x": "6"}\n'),
    ]
    extra = [write(tmp_path / "a2.csv", "y,x\nw,8\n"), write(tmp_path / "a3.csv", "x,y\n9,u\n")]
    more = readers.load_files(spark, [files[0], *extra]).select("x", "y", "source_file").collect()
    assert sorted(map(tuple, more)) == [("1", "u", "a.csv"), ("2", "v", "a.csv"), ("8", "w", "a2.csv"), ("9", "u", "a3.csv")]
    for path in extra:
        os.remove(path)
    write(tmp_path / "notes.txt", "no data")
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub" / "d.csv", "x\n7\n")
    listed = readers.list_files(spark, str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in listed] == ["a.csv", "b.json", "c.jsonl"]
    rows = readers.load_files(spark, files)
    assert sorted((r["x"], r["source_file"]) for r in rows.collect()) == [
        ("1", "a.csv"), ("2", "a.csv"), ("3", "b.json"), ("4", "b.json"), ("5", "c.jsonl"), ("6", "c.jsonl"),
    ]
    assert readers.read_table(spark, files[1]).count() == 2
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.xlsx")
    with pytest.raises(ValueError):
        readers.load_raw_city(spark, str(tmp_path), "atlantis")
    with pytest.raises(FileNotFoundError):
        readers.load_raw_city(spark, str(tmp_path), "Boston")
    with pytest.warns(UserWarning):
        assert readers.read_csv_if_exists(spark, str(tmp_path / "none.csv")) is None


def test_text_columns_of_quoted_pages(spark, tmp_path):
    write(tmp_path / "p1.csv", 'a,b,c\n1,"x\ny",2\n')
    write(tmp_path / "p2.csv", 'a,b,c\n3,"say ""hi""",4\n')
    rows = readers.read_text_columns(spark, str(tmp_path), ["b", "c"])
    assert sorted(tuple(r) for r in rows.collect()) == [('say "hi"', "4"), ("x\ny", "2")]


def test_drifting_rows(spark, tmp_path):
    path = write(tmp_path / "la.csv", f'\ufeff{HEAD}\n1,app,ann\n2,app,org,bob\n\n3,call,org,\n4,"multi\nline","q ""x"""\n5,web,"o,p",eve\n6,web,\n')
    got = drift.read_drifting_csv(spark, path, ["srnumber", "requestsource", "createdbyuserorganization", "owner"])
    assert sorted(tuple(r) for r in got.collect()) == [
        ("1", "app", None, "ann"),
        ("2", "app", "org", "bob"),
        ("3", "call", "org", None),
        ("4", "multi\nline", None, 'q "x"'),
        ("5", "web", "o,p", "eve"),
        ("6", "web", None, None),
    ]
    assert drift.read_drifting_csv(spark, path, ["srnumber", "elsewhere"]).filter("elsewhere IS NULL").count() == 6
    # Pruned scans find the widths as well.
    assert sorted(r[0] for r in drift.read_drifting_csv(spark, path, ["owner"]).collect() if r[0]) == ["ann", "bob", "eve", 'q "x"']


def test_drift_in_splittable_files(spark, tmp_path):
    path = write(tmp_path / "la.csv", f"{HEAD}\n1,app,ann\n2,app,org,bob\n3,call,org,\n")
    got = drift.read_drifting_csv(spark, path, ["srnumber", "owner"], line_breaks_in_fields=False)
    assert sorted(tuple(r) for r in got.collect()) == [("1", "ann"), ("2", "bob"), ("3", None)]


@pytest.mark.parametrize("line", ["1,2", "1,2,3,4,5"])
def test_other_widths_fail(spark, tmp_path, line):
    path = write(tmp_path / "bad.csv", f"{HEAD}\n1,app,ann\n{line}\n")
    with pytest.raises(Exception, match="neither 3 nor 4 fields"):
        drift.read_drifting_csv(spark, path, ["owner"]).collect()


def test_drift_needs_the_anchor_column(spark, tmp_path):
    with pytest.raises(ValueError):
        drift.read_drifting_csv(spark, write(tmp_path / "x.csv", "a,b\n1,2\n"), ["a"])


def test_response_pages(spark, tmp_path):
    def body(fields, records):
        return json.dumps({"result": {"fields": [{"id": f} for f in fields], "records": records}})

    write(tmp_path / "p0.txt", "Title: x\n\nMarkdown Content:\n" + body(["_id", "type"], [{"_id": 1, "type": "a"}]) + "\n")
    write(tmp_path / "p1.txt", body(["_id", "type", "new"], [{"_id": 2, "new": "n"}, {"_id": 3, "type": None}]))
    rows = ckan.flatten_pages(ckan.read_pages(spark, str(tmp_path)))
    assert rows.columns == ["_id", "type"]
    assert sorted(tuple(r) for r in rows.collect()) == [("1", "a"), ("2", None), ("3", None)]


def test_year_bounds_leave_out_fractions_after_the_last_second(spark):
    df = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ'2021-12-31 23:59:59'), (TIMESTAMP_NTZ'2021-12-31 23:59:59.5'), (TIMESTAMP_NTZ'2022-01-01 00:00:00') AS t(d)")
    assert [r["year"] for r in quota.in_years(df, "d", 2021, 2022).orderBy("d").collect()] == [2021, 2022]


def test_count_checks(spark):
    quota.require_count(spark.range(3), 3)
    with pytest.raises(RuntimeError):
        quota.require_count(spark.range(3), 4)


def test_parquet_by_city(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "city string, n int")
    for _ in range(2):
        sinks.write_parquet(df, str(tmp_path / "t"), ["city"])
    plan = spark.read.parquet(str(tmp_path / "t")).filter("city = 'y'")
    assert [r["n"] for r in plan.collect()] == [2]
    assert "PartitionFilters: [isnotnull(city" in plan._jdf.queryExecution().executedPlan().toString()


def test_rounding_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.00005, 1), ("a", float("nan"), 2)], "k string, x double, n int")
    assert {r["k"]: r["x"] for r in sinks.rounded(df).filter("k = 'b'").collect()} == {"b": 0.0}
    sinks.write_manifest(sinks.manifest(df, step="s"), str(tmp_path / "m"), sort_keys=True)
    text = next((tmp_path / "m").glob("*.json")).read_text()
    assert json.loads(text) == {"outputs": [{"k": "a", "x": None, "n": 2}, {"k": "b", "x": 0.00005, "n": 1}], "step": "s"}


def test_model_names():
    assert models.resolve_model("LightGBM") == "gradient_boosting" and models.resolve_model("lr") == "logistic_regression"
    with pytest.raises(ValueError):
        models.resolve_model("svm")


def test_models_fit_save_and_score(spark, tmp_path):
    df = spark.range(300).select(
        F.col("id").cast("string").alias("request_id"),
        F.lit("x").alias("city"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("category"),
        (F.col("id") % 24).cast("int").alias("hour"),
        (F.col("id") % 3 == 0).cast("int").alias("delayed"),
    )
    for name in ("lr", "rf", "xgboost", "mlp"):
        params = {"rf": {"numTrees": 5, "maxDepth": 3}, "xgboost": {"maxIter": 3, "maxDepth": 2}}.get(name, {"maxIter": 10})
        fitted, result = models.fit_and_evaluate(name, df, df, "centralized", "all", **params)
        row = result.first()
        assert row["test_rows"] == 300 and row["train_rows"] == 300 and row["auroc"] > 0.9, name
        fitted.save(spark, str(tmp_path / name))
        again = models.FittedModel.load(spark, str(tmp_path / name))
        one, two = (m.score(df, ["request_id"]).orderBy("request_id").collect() for m in (fitted, again))
        assert one == two


def test_csv_quotes_backslashes_and_line_breaks(spark, tmp_path):
    rows = [("1", 'say "hi", now', "9"), ("2", "ends in \\", "8"), ("3", "two\nlines", "7")]
    page = tmp_path / "page.csv"
    page.write_text('a,b,c\n1,"say ""hi"", now",9\n2,"ends in \\",8\n3,"two\nlines",7\n')
    assert sorted(tuple(r) for r in readers.read_table(spark, str(page)).collect()) == rows
    assert sorted(tuple(r)[:3] for r in readers.load_files(spark, [str(page)]).collect()) == rows
    assert sorted(r.b for r in readers.read_csv_if_exists(spark, str(page)).collect()) == sorted(r[1] for r in rows)
    sinks.write_csv(spark.createDataFrame(rows, "a string, b string, c string"), str(tmp_path / "out.csv"))
    assert sorted(tuple(r) for r in readers.read_table(spark, str(tmp_path / "out.csv")).collect()) == rows


def test_pages_are_matched_by_name(spark, tmp_path):
    (tmp_path / "a b.csv").write_text('id,text\n1,"x\ny"\n2,"say ""hi"""\n')
    (tmp_path / "c.csv").write_text("text,id,more\nb,3,0\n")
    (tmp_path / "d.csv").write_text("﻿id\n4\n")
    rows = readers.read_text_columns(spark, str(tmp_path), ["id", "text"]).collect()
    assert sorted(map(tuple, rows)) == [("1", "x\ny"), ("2", 'say "hi"'), ("3", "b"), ("4", None)]
    groups = {g.header: g.breaks for g in readers.csv_groups(spark, str(tmp_path))}
    assert groups == {("id", "text"): True, ("text", "id", "more"): False, ("id",): False}
    with pytest.raises(ValueError):
        readers.read_text_columns(spark, str(tmp_path), ["other"])


def test_headers_change_in_a_drifting_folder(spark, tmp_path):
    (tmp_path / "1.csv").write_text("id,requestsource,owner\n1,Call,x\n2,App,Org,y\n")
    (tmp_path / "2.csv").write_text("owner,id,requestsource,createdbyuserorganization\nz,3,App,Org\nw,4,Call\n")
    rows = drift.read_drifting_csv(spark, str(tmp_path), ["id", "createdbyuserorganization", "owner"]).collect()
    assert sorted(map(tuple, rows)) == [("1", None, "x"), ("2", "Org", "y"), ("3", "Org", "z"), ("4", None, "w")]


def test_first_page_is_that_of_the_lowest_number(spark):
    def page(fields, records):
        return json.dumps({"result": {"fields": [{"id": f} for f in fields], "records": records}})

    pages = [("p/page-10.json", page(["a"], [{"a": "1", "b": "2"}])), ("p/page-2.json", page(["a", "b"], [{"a": "3", "b": "4"}]))]
    rows = ckan.flatten_pages(spark.createDataFrame(pages, "page string, value string"))
    assert rows.columns == ["a", "b"] and sorted(map(tuple, rows.collect())) == [("1", "2"), ("3", "4")]
    failed = spark.createDataFrame([("page-1", '{"success": false}'), *pages], "page string, value string")
    assert ckan.flatten_pages(failed).columns == ["a", "b"]
