"""Records inside datastore response pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: text that precedes the payload in proxied responses.
MARKER = "Markdown Content:\n"
RESPONSE = "result struct<fields: array<struct<id: string>>, records: array<map<string, string>>>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per response file, named by its path."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("page"), F.col("value")
    )


def flatten_pages(pages: DataFrame, page: str = "page", value: str = "value") -> DataFrame:
    """One row per record, in the column order of the first page.

    Pages are ordered by the last number in their name. Keys the first page does
    not announce are dropped, absent ones are NULL. Where the first page announces
    none, the first one that does stands for it. The field list is a handful of
    names, the only thing looked at up front.
    """
    at = F.instr(F.col(value), MARKER)
    payload = F.when(at > 0, F.substr(F.col(value), at + F.lit(len(MARKER)))).otherwise(F.col(value))
    parsed = pages.select(F.col(page), F.from_json(F.trim(payload), RESPONSE).alias("r"))
    number = F.regexp_extract(F.col(page).cast("string"), r"([0-9]+)[^0-9/]*$", 1).try_cast("bigint")
    place = F.struct(F.coalesce(number, F.lit(-1)), F.col(page))
    first = pages.agg(F.min_by(page, place).alias("p")).first()["p"]
    fields = parsed.filter(F.col(page) == F.lit(first)).select("r.result.fields").first()
    names = fields and fields[0]
    if names is None:
        names = parsed.filter("r.result.fields IS NOT NULL").agg(F.min_by("r.result.fields", place).alias("f")).first()["f"]
    if names is None:
        raise ValueError("no page announces its fields")
    records = parsed.select(F.explode("r.result.records").alias("record"))
    return records.select(*[F.try_element_at("record", F.lit(x["id"])).alias(x["id"]) for x in names])
