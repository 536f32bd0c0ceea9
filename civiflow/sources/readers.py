"""File readers. Paths may be on any file system Spark can reach."""

from __future__ import annotations

import csv
import warnings
from dataclasses import dataclass
from functools import reduce
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Cities and readable suffixes.
CITIES = ("nyc", "chicago", "boston", "los_angeles")
SUFFIXES = (".csv", ".parquet", ".json", ".jsonl")

# The CSV dialect of all readers and of the writer: quotes are doubled inside quoted fields.
CSV = {"header": "true", "escape": '"'}


def resolve_city(city: str, cities: tuple[str, ...] = CITIES) -> str:
    key = city.lower()
    if key not in cities:
        raise ValueError(f"unknown city {city!r}, expected one of {sorted(cities)}")
    return key


def suffix_of(path: str) -> str:
    return PurePosixPath(path).suffix.lower()


@dataclass(frozen=True)
class CsvGroup:
    """Files that share a header line and can, or cannot, be cut at any line."""

    header: tuple[str, ...]
    breaks: bool
    paths: tuple[str, ...]

    def read(self, spark: SparkSession, schema: T.StructType | None = None, **options: str) -> DataFrame:
        """Rows of all files; every column is text unless ``schema`` says otherwise."""
        schema = schema or text_schema(self.header)
        reader = spark.read.schema(schema).options(**{**CSV, "multiLine": str(self.breaks).lower(), **options})
        return reader.csv(list(self.paths))


def text_schema(names: tuple[str, ...] | list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def header_names(line: str) -> tuple[str, ...]:
    """Column names of a header line; blank ones are numbered, repeated ones get their place added."""
    names = next(csv.reader([line.removeprefix("\ufeff")]), [])
    return tuple(f"_c{i}" if not n else f"{n}{i}" if names.count(n) > 1 else n for i, n in enumerate(names))


def csv_groups(spark: SparkSession, paths: str | list[str], breaks: bool | None = None) -> list[CsvGroup]:
    """The files below ``paths`` by header line, found in one scan of their lines.

    A line with an odd number of quotes tells that a field of its file holds a
    line break; such a file is read by one task, others are cut among tasks.
    ``breaks`` overrules that. One row per header comes back, naming its files.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.struct(F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at")).alias("place"),
        "value",
    )
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    files = lines.groupBy("path").agg(F.min_by("value", "place").alias("header"), F.max(odd).alias("breaks"))
    found = files.groupBy("header", "breaks").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    groups: dict[tuple, list[str]] = {}
    for r in found.collect():
        key = header_names(r["header"]), r["breaks"] if breaks is None else breaks
        groups.setdefault(key, []).extend(unquote(p) for p in r["paths"])
    return [CsvGroup(*key, tuple(sorted(files))) for key, files in sorted(groups.items())]


def read_table(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Read one file or folder by its suffix; ``.json`` holds a whole document."""
    suffix = suffix_of(path)
    reader = spark.read.options(**options)
    if suffix == ".csv":
        if "multiLine" not in options:
            options["multiLine"] = str(any(g.breaks for g in csv_groups(spark, path))).lower()
        return spark.read.options(**{**CSV, **options}).csv(path)
    if suffix == ".parquet":
        return reader.parquet(path)
    if suffix == ".json":
        return reader.option("multiLine", True).json(path)
    if suffix == ".jsonl":
        return reader.json(path)
    raise ValueError(f"unsupported file extension: {suffix!r}")


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Readable files directly inside a folder, sorted by path."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().toString() for s in fs.listStatus(path) if s.isFile()]
    return sorted(n for n in names if suffix_of(n) in SUFFIXES)


def load_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All files in one table with the name of the file each row came from.

    Self-describing files of one suffix share a scan, and so do CSV files with
    the same header; columns missing in some files are NULL there.
    """
    if not paths:
        raise FileNotFoundError("no raw files found")
    parts = []
    for suffix in SUFFIXES:
        group = [p for p in paths if suffix_of(p) == suffix]
        if suffix == ".csv" and group:
            parts += [_with_source(g.read(spark)) for g in csv_groups(spark, group)]
        elif group:
            reader = spark.read.option("mergeSchema", True).option("multiLine", suffix == ".json")
            parts.append(_with_source(reader.parquet(*group) if suffix == ".parquet" else reader.json(group)))
    unknown = [p for p in paths if suffix_of(p) not in SUFFIXES]
    if unknown:
        raise ValueError(f"unsupported files: {unknown}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _with_source(df: DataFrame) -> DataFrame:
    return df.select("*", F.col("_metadata.file_name").alias("source_file"))


def load_raw_city(spark: SparkSession, raw_root: str, city: str, paths: list[str] | None = None) -> DataFrame:
    key = resolve_city(city)
    return load_files(spark, list_files(spark, f"{raw_root}/{key}") if paths is None else paths)


def read_text_columns(
    spark: SparkSession, path: str, columns: list[str], line_breaks_in_fields: bool | None = None
) -> DataFrame:
    """CSV scan of the named columns, all as text; the parser skips the others.

    A folder of pages is read as one table. Pages are matched by the names in
    their own header line; a column a page lacks is NULL there, one that no page
    has is an error.
    """
    groups = csv_groups(spark, path, line_breaks_in_fields)
    unknown = set(columns).difference(*[g.header for g in groups])
    if unknown:
        raise ValueError(f"no file has the columns {sorted(unknown)}")
    absent = F.lit(None).cast("string")
    parts = [g.read(spark).select(*[F.col(f"`{c}`") if c in g.header else absent.alias(c) for c in columns]) for g in groups]
    return reduce(DataFrame.unionByName, parts)


def read_csv_if_exists(spark: SparkSession, path: str) -> DataFrame | None:
    """A result table, or None (with a warning) where the step has not been run."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        warnings.warn(f"missing file: {path}", stacklevel=2)
        return None
    return spark.read.options(**CSV, multiLine="true", inferSchema="true").csv(path)
