"""Harmonisation, cleaning, labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from civiflow.catalog.inputs import (
    CLEAN_CTES,
    HOURS_SQL,
    LABEL_CTES,
    MIN_CATEGORY,
    RAW_CITY_CTE,
    SERVICE_REQUESTS_SQL,
    finish,
    raw_city_a,
    service_requests,
    table,
)
from civiflow.functions.columns import days_between, first_nonempty, routing_target
from civiflow.functions.names import snake_case_columns
from civiflow.operators import clean, harmonize, label, prep, starter

MAPPINGS = {
    # The columns of a known city, with a date format of its own.
    "city_a": harmonize.CityMapping("city_a", harmonize.CITY_MAPPINGS["nyc"].sources, ["yyyy-MM-dd HH:mm:ss"]),
    "city_b": harmonize.CityMapping(
        "city_b",
        {
            "request_id": lambda raw: F.concat(F.lit("b-"), F.col("case_id")),
            "created_date": "open_dt",
            "closed_date": "closed_dt",
            "status": "case_status",
            "category": "reason",
            "descriptor": "reason",
            "agency": ["subject", "department"],
            "latitude": "lat",
            "longitude": "lat",
            "area": ["neighborhood", "ward"],
        },
        ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy"],
    ),
}


def raw_city_b(spark, sf_dir):
    """The same kind of extract under other names and with two date formats."""
    return raw_city_a(spark, sf_dir).select(
        F.col("unique_key").alias("case_id"),
        F.when(
            F.col("unique_key").cast("bigint") % 3 == 0,
            F.date_format(F.to_timestamp("created_date", "yyyy-MM-dd HH:mm:ss"), "dd/MM/yyyy"),
        )
        .otherwise(F.col("created_date"))
        .alias("open_dt"),
        F.col("closed_date").alias("closed_dt"),
        F.col("status").alias("case_status"),
        F.col("complaint_type").alias("reason"),
        F.col("community_board").alias("department"),
        F.concat(F.lit("\t"), F.col("borough"), F.lit(" ")).alias("ward"),
        F.col("latitude").alias("lat"),
    )


def harmonized(spark, sf_dir):
    extracts = {"city_a": raw_city_a(spark, sf_dir), "city_b": raw_city_b(spark, sf_dir)}
    return harmonize.harmonize_all(extracts, MAPPINGS)


def cleaned(spark, sf_dir):
    return clean.clean(service_requests(spark, sf_dir), MIN_CATEGORY)


def labeled(spark, sf_dir):
    return label.label(cleaned(spark, sf_dir))


def delay_profile(spark, sf_dir, minimum=MIN_CATEGORY):
    """Requests, threshold and delayed rate per city and category."""
    rows = label.label(clean.clean(service_requests(spark, sf_dir), minimum))
    return rows.groupBy("city", "category").agg(
        F.count(F.lit(1)).alias("requests"),
        F.max("delay_threshold_hours").alias("delay_threshold_hours"),
        F.sum("delayed").alias("delayed"),
        F.avg("delayed").alias("delayed_rate"),
    )


def starter_source(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("l_orderkey").alias("Order Key"),
        F.col("l_linenumber").alias("Line-Number"),
        F.col("o_orderdate").cast("string").alias("Creation Date"),
        F.when(F.col("l_linenumber") != 3, F.col("l_shipdate").cast("string")).alias("Resolved At"),
        F.col("o_orderpriority").alias("Complaint  Type"),
        F.when(F.col("l_linenumber") > 2, F.col("l_returnflag")).alias("Zip"),
        F.col("l_linestatus").alias("Postal Code"),
    )


def starter_prepared(spark, sf_dir):
    return finish(
        starter.prepare(starter_source(spark, sf_dir)).select(
            "order_key", "line_number", "request_type", "zip_code",
            "resolution_days", "delayed_resolution", "opened_year", "opened_month", "opened_dayofweek", "opened_hour",
        )
    )


def category_frequency(spark, sf_dir):
    return service_requests(spark, sf_dir).groupBy("city", "category").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "delay_profile": lambda s, d: finish(delay_profile(s, d)),
    "harmonize_mapping": lambda s, d: finish(harmonized(s, d)),
    "harmonization_summary": lambda s, d: finish(harmonize.harmonization_summary(harmonized(s, d))),
    "first_nonempty_area": lambda s, d: raw_city_a(s, d).select(
        "unique_key",
        first_nonempty(raw_city_a(s, d), ["absent", "community_board", "borough"]).alias("area"),
    ),
    "column_names": lambda s, d: finish(
        snake_case_columns(starter_source(s, d)).groupBy("complaint_type").agg(F.count("zip").alias("n"))
    ),
    "clean_requests": lambda s, d: finish(cleaned(s, d)),
    "clean_attrition": lambda s, d: finish(clean.attrition(service_requests(s, d), MIN_CATEGORY)),
    "cleaning_summary": lambda s, d: finish(clean.cleaning_summary(cleaned(s, d))),
    "deduplicated_requests": lambda s, d: finish(
        clean.drop_duplicates(service_requests(s, d)).select("city", "request_id", "created_date", "closed_date", "area")
    ),
    "frequent_categories": lambda s, d: clean.frequent_categories(service_requests(s, d), 400),
    "category_frequency": lambda s, d: category_frequency(s, d),
    "delay_thresholds": lambda s, d: finish(label.delay_thresholds(cleaned(s, d))),
    "delayed_labels": lambda s, d: finish(labeled(s, d).select("request_id", "city", "delay_threshold_hours", "delayed")),
    "labeling_summary": lambda s, d: finish(label.labeling_summary(labeled(s, d))),
    "routing_target": lambda s, d: service_requests(s, d)
    .groupBy(routing_target(F.col("agency"), F.col("category")).alias("service_routing_target"))
    .agg(F.count(F.lit(1)).alias("n")),
    "resolution_durations": lambda s, d: finish(
        service_requests(s, d).select(
            "request_id", "city", "created_date",
            days_between(F.col("created_date"), F.col("closed_date")).alias("resolution_days"),
        )
    ),
    "fixed_delay_label": lambda s, d: finish(
        starter.with_fixed_delay_label(
            service_requests(s, d).withColumnsRenamed({"created_date": "opened_at", "closed_date": "closed_at"})
        )
        .groupBy("city", "delayed_resolution")
        .agg(F.count(F.lit(1)).alias("n"))
    ),
    "starter_frame": starter_prepared,
    "known_targets": lambda s, d: finish(
        prep.build_xy(starter.prepare(starter_source(s, d)))
        .groupBy("request_type", "delayed_resolution")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("order_key").alias("keys"))
    ),
}

_SUMMARY = "count(*) AS rows, min(created_date) AS created_date_min, max(created_date) AS created_date_max"

_HARMONIZED = f"""WITH {RAW_CITY_CTE},
mixed AS (
  SELECT *, CASE WHEN CAST(unique_key AS BIGINT) % 3 = 0
    THEN strftime(CAST(created_date AS TIMESTAMP), '%d/%m/%Y') ELSE created_date END AS open_dt FROM raw_city),
harmonized AS (
  SELECT unique_key AS request_id, TRY_CAST(created_date AS TIMESTAMP) AS created_date,
         TRY_CAST(closed_date AS TIMESTAMP) AS closed_date, NULLIF(trim(status), '') AS status,
         complaint_type AS category, CAST(NULL AS VARCHAR) AS descriptor, CAST(NULL AS VARCHAR) AS agency,
         TRY_CAST(latitude AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude,
         COALESCE(NULLIF(trim(community_board), ''), borough) AS area, 'city_a' AS city
  FROM raw_city
  UNION ALL
  SELECT 'b-' || unique_key, COALESCE(try_strptime(open_dt, '%Y-%m-%d %H:%M:%S'), try_strptime(open_dt, '%d/%m/%Y')),
         TRY_CAST(closed_date AS TIMESTAMP), NULLIF(trim(status), ''), complaint_type, complaint_type,
         NULLIF(trim(community_board), ''), TRY_CAST(latitude AS DOUBLE), TRY_CAST(latitude AS DOUBLE),
         borough, 'city_b'
  FROM mixed)
"""

STARTER = """WITH source AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line_number, o_orderdate AS opened_at,
         CASE WHEN l_linenumber <> 3 THEN l_shipdate END AS closed_at, o_orderpriority AS request_type,
         COALESCE(CASE WHEN l_linenumber > 2 THEN l_returnflag END, l_linestatus) AS zip_code
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
timed AS (
  SELECT *, CAST(epoch_us(closed_at) - epoch_us(opened_at) AS DOUBLE) / CAST(86400000000 AS DOUBLE) AS d FROM source),
prepared AS (
  SELECT *, CASE WHEN d >= 0 THEN d END AS days FROM timed)
"""

ORACLE = {
    "delay_profile": f"""WITH {LABEL_CTES}
SELECT city, category, count(*) AS requests, round(max(delay_threshold_hours), 6) AS delay_threshold_hours,
       CAST(sum(delayed) AS BIGINT) AS delayed, round(avg(delayed), 6) AS delayed_rate
FROM labeled GROUP BY city, category""",
    "harmonize_mapping": _HARMONIZED
    + """SELECT request_id, created_date, closed_date, status, category, descriptor, agency,
       round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, area, city FROM harmonized""",
    "harmonization_summary": _HARMONIZED
    + f"""SELECT city, {_SUMMARY}, count(*) FILTER (closed_date IS NULL) AS closed_date_missing,
       count(*) FILTER (latitude IS NULL) AS latitude_missing,
       count(*) FILTER (longitude IS NULL) AS longitude_missing FROM harmonized GROUP BY city""",
    "first_nonempty_area": f"""WITH {RAW_CITY_CTE}
SELECT unique_key, COALESCE(NULLIF(trim(community_board), ''), NULLIF(trim(borough), '')) AS area FROM raw_city""",
    "column_names": """SELECT o_orderpriority AS complaint_type,
       count(CASE WHEN l_linenumber > 2 THEN l_returnflag END) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
    "clean_requests": f"""WITH {CLEAN_CTES}
SELECT request_id, created_date, closed_date, status, category, descriptor, agency, round(latitude, 6) AS latitude,
       round(longitude, 6) AS longitude, area, city, round(resolution_hours, 6) AS resolution_hours FROM cleaned""",
    "clean_attrition": f"""WITH {CLEAN_CTES},
i AS (SELECT city, count(*) AS input_rows, count(*) FILTER (created_date IS NULL) AS missing_created_date,
        count(*) FILTER (created_date IS NOT NULL AND closed_date IS NULL) AS missing_closed_date,
        count(*) FILTER (closed_date < created_date) AS closed_before_created FROM service_requests GROUP BY city),
a AS (SELECT city, count(*) AS n FROM dated GROUP BY city),
b AS (SELECT city, count(*) AS n,
        count(*) FILTER (lower(trim(status)) IN ('closed', 'completed')) AS ok FROM deduplicated GROUP BY city),
v AS (SELECT city, count(*) AS n FROM valid GROUP BY city),
o AS (SELECT city, count(*) AS n FROM cleaned GROUP BY city)
SELECT i.*, a.n - b.n AS duplicate_request_id, b.n - b.ok AS cancelled_invalid_incomplete_status,
       b.ok - v.n AS impossible_coordinates, v.n - COALESCE(o.n, 0) AS category_lt_100,
       COALESCE(o.n, 0) AS output_rows, i.input_rows - COALESCE(o.n, 0) AS total_removed
FROM i JOIN a USING (city) JOIN b USING (city) JOIN v USING (city) LEFT JOIN o USING (city)""",
    "cleaning_summary": f"""WITH {CLEAN_CTES}
SELECT city, {_SUMMARY}, round(min(resolution_hours), 6) AS resolution_hours_min,
       round(max(resolution_hours), 6) AS resolution_hours_max, count(DISTINCT category) AS categories
FROM cleaned GROUP BY city""",
    "deduplicated_requests": f"""WITH service_requests AS ({SERVICE_REQUESTS_SQL})
SELECT city, request_id, created_date, closed_date, area FROM service_requests
QUALIFY row_number() OVER (PARTITION BY city, request_id
    ORDER BY created_date, closed_date, category, descriptor, agency, latitude, longitude, area, status) = 1""",
    "frequent_categories": f"""SELECT city, category, count(*) AS n FROM ({SERVICE_REQUESTS_SQL})
GROUP BY 1, 2 HAVING count(*) >= 400""",
    "category_frequency": f"SELECT city, category, count(*) AS n FROM ({SERVICE_REQUESTS_SQL}) GROUP BY 1, 2",
    "delay_thresholds": f"""WITH {LABEL_CTES}
SELECT city, category, round(delay_threshold_hours, 6) AS delay_threshold_hours, n FROM thresholds""",
    "delayed_labels": f"""WITH {LABEL_CTES}
SELECT request_id, city, round(delay_threshold_hours, 6) AS delay_threshold_hours, delayed FROM labeled""",
    "labeling_summary": f"""WITH {LABEL_CTES}
SELECT city, count(*) AS rows, CAST(sum(delayed) AS BIGINT) AS delayed_positive, round(avg(delayed), 6) AS delayed_rate,
       count(DISTINCT category) AS threshold_groups,
       count(DISTINCT service_routing_target) AS service_routing_target_classes,
       round(min(delay_threshold_hours), 6) AS threshold_min, round(max(delay_threshold_hours), 6) AS threshold_max
FROM labeled GROUP BY city""",
    "routing_target": f"""SELECT COALESCE(NULLIF(trim(agency), ''), category) AS service_routing_target, count(*) AS n
FROM ({SERVICE_REQUESTS_SQL}) GROUP BY 1""",
    "resolution_durations": f"""WITH r AS (SELECT *, {HOURS_SQL} / CAST(24 AS DOUBLE) AS d FROM ({SERVICE_REQUESTS_SQL}))
SELECT request_id, city, created_date, round(CASE WHEN d >= 0 THEN d END, 6) AS resolution_days FROM r""",
    "fixed_delay_label": f"""WITH r AS (SELECT *, {HOURS_SQL} / CAST(24 AS DOUBLE) AS d FROM ({SERVICE_REQUESTS_SQL}))
SELECT city, CASE WHEN d >= 0 THEN CAST(d > 30 AS BIGINT) END AS delayed_resolution, count(*) AS n FROM r GROUP BY 1, 2""",
    "starter_frame": STARTER
    + """SELECT order_key, CAST(line_number AS BIGINT) AS line_number, request_type, zip_code,
       round(days, 6) AS resolution_days, CASE WHEN days IS NOT NULL THEN CAST(days > 30 AS BIGINT) END AS delayed_resolution,
       CAST(year(opened_at) AS BIGINT) AS opened_year, CAST(month(opened_at) AS BIGINT) AS opened_month,
       CAST(isodow(opened_at) - 1 AS BIGINT) AS opened_dayofweek, CAST(hour(opened_at) AS BIGINT) AS opened_hour
FROM prepared""",
    "known_targets": STARTER
    + """SELECT request_type, CAST(days > 30 AS BIGINT) AS delayed_resolution, count(*) AS n,
       CAST(sum(order_key) AS BIGINT) AS keys FROM prepared WHERE days IS NOT NULL GROUP BY 1, 2""",
}
