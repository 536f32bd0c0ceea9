"""Extracts derived from the tables, written out and read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from civiflow.catalog.inputs import finish, table
from civiflow.operators.clean import write_sorted
from civiflow.plans.staging import new_path
from civiflow.sources import ckan, drift, quota, readers, sinks

# Rows wanted per source and year.
QUOTAS = {"1-URGENT": 50, "2-HIGH": 100, "3-MEDIUM": 150, "4-NOT SPECIFIED": 200, "5-LOW": 100_000_000}


def quotas(spark, sf_dir):
    values = F.create_map(*[F.lit(x) for p in QUOTAS.items() for x in p])
    kinds = table(spark, sf_dir, "orders").select("o_orderpriority").distinct()
    return kinds.withColumn("quota", F.element_at(values, F.col("o_orderpriority")).cast("bigint"))


def yearly(spark, sf_dir):
    rows = quota.in_years(table(spark, sf_dir, "orders"), "o_orderdate", 1996, 1999)
    picked = quota.yearly_quota(rows, quotas(spark, sf_dir), "o_orderpriority", ["o_orderdate", "o_orderkey"])
    return finish(picked.select("o_orderpriority", "year", "o_orderdate", "o_orderkey"))


def checked(spark, sf_dir):
    """Counts against quotas, of which some are right, wrong or about absent sources."""
    o = table(spark, sf_dir, "orders")
    wanted = (
        o.groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.inline(
                F.array(
                    F.struct(F.col("o_orderpriority"), (F.col("n") + (F.length("o_orderpriority") % 2)).alias("quota")),
                    F.struct(F.concat("o_orderpriority", F.lit("?")).alias("o_orderpriority"), F.col("n").alias("quota")),
                )
            )
        )
    )
    return finish(quota.quota_check(o, wanted, "o_orderpriority"))


def order_text(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.concat(F.lit(' "'), "o_orderstatus", F.lit('", '), "o_orderpriority", F.lit(" ")).alias("note"),
        F.col("o_orderstatus"),
        F.col("o_orderpriority"),
    )


def csv_pages(spark, sf_dir):
    """A folder of CSV pages with columns in two orders, scanned for two of four by name."""
    path = new_path(spark, "pages")
    pages = order_text(spark, sf_dir).repartition(8, "o_orderkey")
    even = F.col("o_orderkey").cast("bigint") % 2 == 0
    for part in (pages.filter(even), pages.filter(~even).select("note", "o_orderpriority", "o_orderkey")):
        part.write.mode("append").option("header", True).option("escape", '"').option(
            "ignoreLeadingWhiteSpace", False
        ).option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.read_text_columns(spark, path, ["o_orderkey", "note"])


def loaded_files(spark, sf_dir):
    """CSV and parquet files of one city in one table, counted per kind of file."""
    root = new_path(spark, "raw")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string"), "c_mktsegment", "c_name")
    even = F.col("c_custkey").cast("bigint") % 2 == 0
    c.filter(even).drop("c_name").write.option("header", True).csv(f"{root}/nyc")
    c.filter(~even).write.mode("append").parquet(f"{root}/nyc")
    rows = readers.load_raw_city(spark, root, "NYC")
    kind = F.regexp_extract("source_file", r"\.([a-z]+)$", 1)
    return rows.groupBy(kind.alias("kind"), "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"), F.count("c_name").alias("names")
    )


def drifting_rows(spark, sf_dir):
    """Orders as CSV lines of two widths under the older header, aligned by name."""
    path = new_path(spark, "drift")
    quoted = F.concat(F.lit('"'), "o_orderstatus", F.lit(', ""'), "o_orderpriority", F.lit('"""'))
    older = F.concat_ws(
        ",", F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("Call"), quoted, F.col("o_custkey")
    )
    newer = F.concat_ws(
        ",", F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("App"), F.lit("Council"), quoted, F.lit("")
    )
    parts = 8
    lines = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % parts).alias("part"),
        F.lit(1).alias("position"),
        F.when(F.col("o_orderkey") % 3 == 0, newer).otherwise(older).alias("value"),
    )
    header = spark.range(parts).select(
        F.col("id").alias("part"),
        F.lit(0).alias("position"),
        # One file in four has the newer header, though older rows too.
        F.when(F.col("id") % 4 == 0, "srnumber,createddate,requestsource,createdbyuserorganization,requesttype,owner")
        .otherwise("srnumber,createddate,requestsource,requesttype,owner")
        .alias("value"),
    )
    together = lines.unionByName(header).repartition(parts, "part").sortWithinPartitions("part", "position")
    together.drop("position").write.partitionBy("part").text(path)
    return drift.read_drifting_csv(
        spark, f"{path}/part=*", ["srnumber", "createddate", "requestsource", "createdbyuserorganization", "requesttype", "owner"]
    )


def response_pages(spark, sf_dir):
    """Datastore responses of at most 500 orders each, some behind the proxy's marker."""
    # The lowest number announces all fields; as text, "page-10" would come before it.
    names = [F.struct(F.lit(n).alias("id")) for n in ("_id", "status", "priority")]
    fields = F.when(F.col("page") == F.lit("page-2"), F.array(*names)).otherwise(F.array(*names[:2]))
    record = F.create_map(
        F.lit("_id"), F.col("o_orderkey").cast("string"), F.lit("status"), F.col("o_orderstatus"),
        F.when(F.col("o_orderkey") % 5 == 0, "other").otherwise("priority"), F.col("o_orderpriority"),
    )
    pages = table(spark, sf_dir, "orders").groupBy(
        F.concat(F.lit("page-"), (F.floor(F.col("o_orderkey") / 500) + 2).cast("string")).alias("page")
    ).agg(
        F.collect_list(record).alias("records")
    )
    body = F.to_json(F.struct(F.struct(fields.alias("fields"), F.col("records")).alias("result")))
    title = F.when(F.col("page").endswith("2"), F.lit(f"Title: data\n\n{ckan.MARKER}")).otherwise("")
    return pages.select("page", F.concat(title, body, F.lit("\n")).alias("value"))


def saved_report(spark, sf_dir):
    """A rounded result table through its CSV file."""
    path = new_path(spark, "report")
    totals = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("mean_price")
    )
    sinks.save_table(totals, path, 4)
    report = readers.read_csv_if_exists(spark, path)
    return finish(report.select("o_orderpriority", F.col("n").cast("bigint").alias("n"), F.round("mean_price", 2).alias("mean_price")))


def city_files(spark, sf_dir):
    """Customers written as sorted city folders and read back."""
    path = new_path(spark, "cities")
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("city"), "c_custkey", "c_mktsegment")
    write_sorted(rows, path, ["c_custkey"])
    return readers.read_table(spark, path + "/*/*.parquet", basePath=path).select("city", "c_custkey", "c_mktsegment")


QUERIES = {
    "yearly_quota": yearly,
    "page_slice": lambda s, d: quota.page_slice(
        table(s, d, "orders").select("o_orderkey", "o_orderdate", "o_custkey"), ["o_orderdate", "o_orderkey"], 1200, 700
    ),
    "quota_check": checked,
    "csv_pages": csv_pages,
    "loaded_files": loaded_files,
    "drifting_rows": drifting_rows,
    "datastore_records": lambda s, d: ckan.flatten_pages(response_pages(s, d)),
    "saved_report": saved_report,
    "city_files": city_files,
}

_QUOTA_CASES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in QUOTAS.items())

ORACLE = {
    "yearly_quota": f"""SELECT o_orderpriority, CAST(year(o_orderdate) AS BIGINT) AS year, o_orderdate, o_orderkey FROM orders
WHERE (o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31 23:59:59')
   OR (o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31 23:59:59')
   OR (o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-12-31 23:59:59')
   OR (o_orderdate BETWEEN TIMESTAMP '1999-01-01' AND TIMESTAMP '1999-12-31 23:59:59')
QUALIFY row_number() OVER (PARTITION BY o_orderpriority, year(o_orderdate) ORDER BY o_orderdate, o_orderkey)
        <= CASE o_orderpriority {_QUOTA_CASES} END""",
    "page_slice": """SELECT o_orderkey, o_orderdate, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 700 OFFSET 1200""",
    "quota_check": """WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderpriority, n + length(o_orderpriority) % 2 AS quota, n AS records,
       CASE WHEN length(o_orderpriority) % 2 = 0 THEN 'verified' ELSE 'mismatch' END AS status FROM c
UNION ALL SELECT o_orderpriority || '?', n, 0, 'missing' FROM c""",
    "csv_pages": """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey,
       concat(' "', o_orderstatus, '", ', o_orderpriority, ' ') AS note FROM orders""",
    "loaded_files": """SELECT CASE WHEN c_custkey % 2 = 0 THEN 'csv' ELSE 'parquet' END AS kind, c_mktsegment, count(*) AS n,
       count(CASE WHEN c_custkey % 2 = 1 THEN c_name END) AS names FROM customer GROUP BY 1, 2""",
    "drifting_rows": """SELECT CAST(o_orderkey AS VARCHAR) AS srnumber, strftime(o_orderdate, '%Y-%m-%d') AS createddate,
       CASE WHEN o_orderkey % 3 = 0 THEN 'App' ELSE 'Call' END AS requestsource,
       CASE WHEN o_orderkey % 3 = 0 THEN 'Council' END AS createdbyuserorganization,
       concat(o_orderstatus, ', "', o_orderpriority, '"') AS requesttype,
       CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey AS VARCHAR) END AS owner FROM orders""",
    "datastore_records": """SELECT CAST(o_orderkey AS VARCHAR) AS _id, o_orderstatus AS status,
       CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS priority FROM orders""",
    "saved_report": """SELECT o_orderpriority, count(*) AS n, round(round_even(avg(o_totalprice), 4), 2) AS mean_price
FROM orders GROUP BY 1""",
    "city_files": """SELECT n_name AS city, c_custkey, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey""",
}
