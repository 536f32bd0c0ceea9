"""CSV extracts whose rows come in two widths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civiflow.sources.readers import CsvGroup, csv_groups, text_schema

# The column newer rows carry, and the one it follows.
ADDED_COLUMN = "createdbyuserorganization"
AFTER_COLUMN = "requestsource"


def read_drifting_csv(
    spark: SparkSession,
    path: str,
    columns: list[str],
    added: str = ADDED_COLUMN,
    after: str = AFTER_COLUMN,
    line_breaks_in_fields: bool | None = None,
) -> DataFrame:
    """Align rows with and without the ``added`` column by name.

    Files are taken by their header line, which lists the older or the newer
    columns. Rows are parsed with the wider schema; those that do not fit are kept
    whole in the corrupt-record column and parsed again with the narrower one. A
    row fitting neither makes the query fail. Columns found in neither form of a
    header are NULL in its files.
    """
    groups = csv_groups(spark, path, line_breaks_in_fields)
    return reduce(DataFrame.unionByName, [_aligned(spark, g, columns, added, after) for g in groups])


def _aligned(spark: SparkSession, group: CsvGroup, columns: list[str], added: str, after: str) -> DataFrame:
    narrow = [c for c in group.header if c != added]
    if after not in narrow:
        raise ValueError(f"unexpected header: missing {after}")
    at = narrow.index(after) + 1
    wide = list(group.header) if added in group.header else [*narrow[:at], added, *narrow[at:]]
    bad, bad_again = "__bad", "__bad_again"
    schema = text_schema(wide).add(bad, T.StringType())
    # A pruned parser would not see how many fields a row has.
    rows = group.read(spark, schema, enforceSchema="true", columnPruning="false", columnNameOfCorruptRecord=bad)
    older = F.from_csv(
        F.col(bad),
        ", ".join(f"`{n}` STRING" for n in [*narrow, bad_again]),
        {"columnNameOfCorruptRecord": bad_again, "mode": "PERMISSIVE", "escape": '"', "multiLine": "true"},
    )
    parsed = rows.withColumn("__older", older)
    fits_neither = F.col(bad).isNotNull() & F.col(f"__older.{bad_again}").isNotNull()
    # Spark refuses scans of the corrupt-record column alone, so name the row too.
    first = F.coalesce(F.col(wide[0]), F.lit("?"))
    failure = F.raise_error(
        F.concat(F.lit(f"row has neither {len(narrow)} nor {len(wide)} fields: "), first, F.lit(" in "), F.col(bad))
    )
    chosen = []
    for c in columns:
        absent = F.lit(None).cast("string")
        old = F.col(f"__older.`{c}`") if c in narrow else absent
        new = F.col(c) if c in wide else absent
        chosen.append(
            F.when(fits_neither, failure.cast("string")).when(F.col(bad).isNull(), new).otherwise(old).alias(c)
        )
    return parsed.select(*chosen)
