"""Domain views over the given tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


CLIENTS = ["AFRICA", "AMERICA", "ASIA"]
EXTERNAL = "EUROPE"
CLIENTS_SQL = "('AFRICA', 'AMERICA', 'ASIA')"
MIN_CATEGORY = 100

# Model label, score multiplier, privacy level, budget.
MODELS = [
    ("FedAvg", 13, "None", None),
    ("FedProx", 29, "None", None),
    ("FedAvg + SecAgg", 41, "Secure aggregation", None),
    ("FedAvg + DP eps=8", 53, "Weak DP", 8.0),
    ("FedAvg + DP eps=3", 61, "Medium DP", 3.0),
    ("FedAvg + DP eps=1", 67, "Strong DP", 1.0),
    ("FedProx + DP eps=3", 37, "Medium DP", 3.0),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def finish(df: DataFrame) -> DataFrame:
    """Comparable output: fractions rounded to six digits, integers as bigint."""
    columns = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        columns.append(c.alias(f.name))
    return df.select(*columns)


def service_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as requests: region is the city, nation the area, brand the category."""
    li, o, c, n, r, p, s = (
        table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region", "part", "supplier")
    )
    li = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    # Orders meet their customers first, so line items are not moved by customer.
    placed = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
    )
    joined = (
        li.join(placed, li.l_orderkey == o.o_orderkey)
        .join(p, li.l_partkey == p.p_partkey)
        .join(s, li.l_suppkey == s.s_suppkey)
    )
    status = F.when(F.col("o_orderstatus") == "F", "Closed").when(F.col("o_orderstatus") == "O", " completed ")

    def scatter(factor: int, modulus: int, shift: float):
        return (F.col("o_custkey") * factor % modulus).cast("double") / F.lit(10.0) - F.lit(shift)

    return joined.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("request_id"),
        F.col("o_orderdate").alias("created_date"),
        F.col("l_shipdate").alias("closed_date"),
        status.otherwise("Canceled").alias("status"),
        F.col("p_brand").alias("category"),
        F.col("p_name").alias("descriptor"),
        F.when(F.col("l_suppkey") % 50 == 0, "").otherwise(F.col("s_name")).alias("agency"),
        scatter(37, 1900, 95.0).alias("latitude"),
        scatter(91, 3700, 185.0).alias("longitude"),
        F.col("n_name").alias("area"),
        F.col("r_name").alias("city"),
    )


SERVICE_REQUESTS_SQL = """
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS request_id,
       o_orderdate AS created_date, l_shipdate AS closed_date,
       CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'O' THEN ' completed ' ELSE 'Canceled' END AS status,
       p_brand AS category, p_name AS descriptor,
       CASE WHEN l_suppkey % 50 = 0 THEN '' ELSE s_name END AS agency,
       CAST((o_custkey * 37) % 1900 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(95 AS DOUBLE) AS latitude,
       CAST((o_custkey * 91) % 3700 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(185 AS DOUBLE) AS longitude,
       n_name AS area, r_name AS city
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
     JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
     JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
     JOIN supplier ON l_suppkey = s_suppkey"""

HOURS_SQL = "CAST(epoch_us(closed_date) - epoch_us(created_date) AS DOUBLE) / CAST(3600000000 AS DOUBLE)"

CLEAN_CTES = f"""
service_requests AS ({SERVICE_REQUESTS_SQL}),
dated AS (
  SELECT * FROM service_requests
  WHERE created_date IS NOT NULL AND closed_date IS NOT NULL AND closed_date >= created_date),
deduplicated AS (
  SELECT * FROM dated
  QUALIFY row_number() OVER (PARTITION BY city, request_id
    ORDER BY created_date, closed_date, category, descriptor, agency, latitude, longitude, area, status) = 1),
valid AS (
  SELECT * FROM deduplicated
  WHERE lower(trim(status)) IN ('closed', 'completed')
    AND latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180
    AND NOT (latitude = 0 AND longitude = 0)),
cleaned AS (
  SELECT *, {HOURS_SQL} AS resolution_hours FROM valid
  QUALIFY count(*) OVER (PARTITION BY city, category) >= {MIN_CATEGORY})"""

LABEL_CTES = f"""{CLEAN_CTES},
thresholds AS (
  SELECT city, category, quantile_cont(resolution_hours, 0.75) AS delay_threshold_hours, count(*) AS n
  FROM cleaned GROUP BY city, category),
labeled AS (
  SELECT c.*, t.delay_threshold_hours,
         CAST(c.resolution_hours > t.delay_threshold_hours AS BIGINT) AS delayed,
         COALESCE(NULLIF(trim(c.agency), ''), c.category) AS service_routing_target
  FROM cleaned c JOIN thresholds t ON c.city = t.city AND c.category IS NOT DISTINCT FROM t.category)"""


def trailing_sql(keys: str, ts: str) -> str:
    return (
        f"count(*) OVER (PARTITION BY {keys} ORDER BY {ts} RANGE BETWEEN INTERVAL '7' DAY PRECEDING "
        "AND INTERVAL '1' MICROSECOND PRECEDING)"
    )


FEATURE_CTES = f"""{LABEL_CTES},
features AS (
  SELECT request_id, created_date, city, category, descriptor, agency, area,
         CAST(hour(created_date) AS BIGINT) AS hour,
         CAST(isodow(created_date) - 1 AS BIGINT) AS day_of_week,
         CAST(month(created_date) AS BIGINT) AS month,
         CAST(CASE WHEN isodow(created_date) >= 6 THEN 1 ELSE 0 END AS BIGINT) AS is_weekend,
         floor(latitude * CAST(100 AS DOUBLE)) / CAST(100 AS DOUBLE) AS latitude_grid,
         floor(longitude * CAST(100 AS DOUBLE)) / CAST(100 AS DOUBLE) AS longitude_grid,
         {trailing_sql("city, area", "created_date")} AS area_request_count_7d,
         {trailing_sql("city, category", "created_date")} AS category_request_count_7d,
         {trailing_sql("city, agency", "created_date")} AS agency_request_count_7d,
         delayed, service_routing_target
  FROM labeled)"""

SPLIT_CTES = f"""{FEATURE_CTES},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY created_date, request_id) - 1 AS pos,
         count(*) OVER (PARTITION BY city) AS total
  FROM features WHERE city IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')),
split AS (
  SELECT * EXCLUDE (pos, total),
         CASE WHEN city = 'EUROPE' THEN 'external_test'
              WHEN pos < floor(total * CAST(0.7 AS DOUBLE)) THEN 'train'
              WHEN pos < floor(total * (CAST(0.7 AS DOUBLE) + CAST(0.15 AS DOUBLE))) THEN 'val'
              ELSE 'test' END AS split
  FROM numbered)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of seven models for every order; 101 distinct scores, so ties abound."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    o = o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    closed = F.col("o_orderstatus") == "F"
    multipliers = F.array(
        *[F.struct(F.lit(name).alias("model"), F.lit(a).alias("a")) for name, a, _, _ in MODELS]
    )
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select("*", F.inline(multipliers))
        .select(
            "model",
            F.col("o_orderkey").alias("row_id"),
            F.col("o_orderdate").alias("created_date"),
            F.col("r_name").alias("city"),
            F.col("o_orderpriority").alias("category"),
            F.col("n_name").alias("area"),
            F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(0).alias("is_member"),
            F.when(closed, 1).otherwise(0).alias("y_true"),
            (
                (F.when(closed, 30).otherwise(0) + (F.col("o_orderkey") * F.col("a") + F.col("o_custkey") * 7) % 71).cast(
                    "double"
                )
                / F.lit(100.0)
            ).alias("score"),
        )
    )


_MODEL_ROWS = " UNION ALL SELECT ".join(
    f"{i} AS i, '{name}' AS model, {a} AS a, '{level}' AS privacy_level, CAST({eps if eps else 'NULL'} AS DOUBLE) AS eps"
    for i, (name, a, level, eps) in enumerate(MODELS)
)

PREDICTION_CTES = f"""
models AS (SELECT {_MODEL_ROWS}),
predictions AS (
  SELECT m.model, o_orderkey AS row_id, o_orderdate AS created_date, r_name AS city, o_orderpriority AS category,
         n_name AS area, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS is_member,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y_true,
         CAST(CASE WHEN o_orderstatus = 'F' THEN 30 ELSE 0 END + (o_orderkey * m.a + o_custkey * 7) % 71 AS DOUBLE)
           / CAST(100 AS DOUBLE) AS score
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey CROSS JOIN models m)"""


def model_name(index: Column) -> Column:
    """Model label of an index column."""
    return F.get(F.array(*[F.lit(m[0]) for m in MODELS]), index.cast("int"))


def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records per model, from the orders whose key falls to that model."""
    n, rounds = F.count(F.lit(1)), (F.lit(5) + F.count(F.lit(1)) % 4)
    size = F.lit(80_000).cast("bigint")
    runs = (
        table(spark, sf_dir, "orders")
        .groupBy((F.col("o_orderkey") % len(MODELS)).alias("i"))
        .agg(
            (F.lit(10.0) + (n % 100) / F.lit(10.0)).alias("training_time_sec"),
            (F.lit(512.0) + F.max("o_custkey") / F.lit(8.0)).alias("memory_peak_mb"),
            rounds.alias("rounds_completed"),
            (F.lit(1) + F.max("o_custkey") % rounds).alias("best_round"),
        )
    )
    i = F.col("i").cast("int")
    level = F.get(F.array(*[F.lit(m[2]) for m in MODELS]), i)
    budget = F.get(F.array(*[F.lit(m[3]).cast("double") for m in MODELS]), i)
    moved = size * 3 * F.col("rounds_completed")
    secure = F.when(level == "Secure aggregation", moved).otherwise(F.lit(0).cast("bigint"))
    return runs.select(
        model_name(i).alias("model"),
        level.alias("privacy_level"),
        budget.alias("target_epsilon"),
        F.coalesce(F.lit(1.0) / budget, F.lit(0.0)).alias("noise_multiplier"),
        "training_time_sec",
        "memory_peak_mb",
        "rounds_completed",
        "best_round",
        size.alias("model_size_bytes"),
        moved.alias("upload_bytes"),
        moved.alias("download_bytes"),
        secure.alias("secure_aggregation_extra_bytes"),
        (moved * 2 + secure).alias("total_bytes_with_overheads"),
    )


SUMMARY_CTES = """
runs AS (
  SELECT o_orderkey % 7 AS i,
         CAST(10 AS DOUBLE) + CAST(count(*) % 100 AS DOUBLE) / CAST(10 AS DOUBLE) AS training_time_sec,
         CAST(512 AS DOUBLE) + CAST(max(o_custkey) AS DOUBLE) / CAST(8 AS DOUBLE) AS memory_peak_mb,
         5 + count(*) % 4 AS rounds_completed, 1 + max(o_custkey) % (5 + count(*) % 4) AS best_round
  FROM orders GROUP BY 1),
run_summaries AS (
  SELECT m.model, m.privacy_level, m.eps AS target_epsilon,
         COALESCE(CAST(1 AS DOUBLE) / m.eps, CAST(0 AS DOUBLE)) AS noise_multiplier,
         training_time_sec, memory_peak_mb, rounds_completed, best_round,
         CAST(80000 AS BIGINT) AS model_size_bytes, 240000 * rounds_completed AS upload_bytes,
         240000 * rounds_completed AS download_bytes,
         CASE WHEN m.privacy_level = 'Secure aggregation' THEN 240000 * rounds_completed ELSE 0 END
           AS secure_aggregation_extra_bytes,
         480000 * rounds_completed
           + CASE WHEN m.privacy_level = 'Secure aggregation' THEN 240000 * rounds_completed ELSE 0 END
           AS total_bytes_with_overheads
  FROM runs JOIN models m USING (i))"""


def round_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation metric per (model, round, client) with plateaus."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .filter(F.col("r_name").isin(CLIENTS))
    )
    closed = F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)
    return joined.groupBy(
        model_name(F.col("o_orderkey") % len(MODELS)).alias("run"),
        (F.col("o_custkey") % 8 + 1).alias("round"),
        F.col("r_name").alias("client"),
    ).agg(
        F.round(F.avg(closed), 2).alias("macro_f1"),
        F.round(F.avg(F.lit(1.0) - closed), 2).alias("train_loss"),
    )


HISTORY_CTES = f"""
client_rounds AS (
  SELECT m.model AS run, o_custkey % 8 + 1 AS round, r_name AS client,
         round(avg(CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 2) AS macro_f1,
         round(avg(CASE WHEN o_orderstatus = 'F' THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END), 2) AS train_loss
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey JOIN models m ON m.i = o_orderkey % 7
  WHERE r_name IN {CLIENTS_SQL} GROUP BY ALL)"""


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long attribution table: embedding components, one model per label."""
    e = table(spark, sf_dir, "embeddings")
    named = F.when(F.col("label") < len(MODELS), model_name(F.col("label"))).otherwise(
        F.concat(F.lit("Model "), F.col("label").cast("string"))
    )
    return e.select(named.alias("model"), F.posexplode("embedding").alias("feature", "v")).select(
        "model", "feature", F.col("v").cast("double").alias("value")
    )


IMPORTANCE_CTES = f"""
names AS (SELECT {" UNION ALL SELECT ".join(f"{i} AS i, '{m[0]}' AS model" for i, m in enumerate(MODELS))}),
attributions AS (
  SELECT COALESCE(n.model, 'Model ' || CAST(label AS VARCHAR)) AS model, unnest(range(len(embedding))) AS feature,
         CAST(unnest(embedding) AS DOUBLE) AS value
  FROM embeddings LEFT JOIN names n ON n.i = label),
importance AS (
  SELECT model, feature, round(avg(abs(value)), 6) AS importance FROM attributions GROUP BY 1, 2)"""


def raw_city_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unharmonised text columns with bad dates, bad numbers and blanks."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    date = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .select(
            F.col("o_orderkey").cast("string").alias("unique_key"),
            date.alias("created_date"),
            F.when(F.col("o_orderkey") % 17 == 0, "n/a").otherwise(date).alias("closed_date"),
            F.concat(F.lit(" "), "o_orderstatus", F.lit(" ")).alias("status"),
            F.col("o_orderpriority").alias("complaint_type"),
            F.when(F.col("o_custkey") % 5 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("community_board"),
            F.col("n_name").alias("borough"),
            F.when(F.col("o_custkey") % 11 == 0, "x").otherwise(F.col("c_acctbal").cast("string")).alias("latitude"),
        )
    )


RAW_CITY_CTE = """
raw_city AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS unique_key, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS created_date,
         CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS closed_date,
         concat(' ', o_orderstatus, ' ') AS status, o_orderpriority AS complaint_type,
         CASE WHEN o_custkey % 5 = 0 THEN '  ' ELSE c_mktsegment END AS community_board, n_name AS borough,
         CASE WHEN o_custkey % 11 = 0 THEN 'x' ELSE CAST(c_acctbal AS VARCHAR) END AS latitude
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
