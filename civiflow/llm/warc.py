"""WARC archives with an index.

One record per page, each a gzip member of its own, so that a byte range reads
alone. Every task writes one archive under a name of its own and returns the
index rows (path, offset, length, url, digest); the index names the archives of
tasks that ended, so a repeated task leaves no wrong entry. Reads take the
selected records in offset order and join neighbouring byte ranges.

Null html is an empty payload, null url an empty field; line breaks in urls are
escaped. Of equal payloads of at least 100 bytes the smallest page_id is the
response and the rest are revisits without payload; null ids come last, ties go
to the smaller url, and of fully repeated rows exactly one is the response.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civiflow.plans.joins import lookup
from civiflow.plans.staging import new_path, stage

END = "\r\n\r\n"
# Fixed value of the format.
PROFILE = "http://netpreservation.org/warc/1.0/revisit/identical-payload-digest"
LEAST = 100
GAP = 64 * 1024
RUN = 16 * 1024 * 1024
LEVEL = 4
INDEX = "path string, offset long, length long, page_id long, url string, digest string"


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, kind and refers_to of every page; payloads are shuffled at most once."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%0A").alias("url"),
        F.coalesce("html", F.lit("")).alias("html"),
    ).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    key = ["page_id", "url", "digest"]
    narrow = stage(rows.where(F.octet_length("html") >= LEAST).select(*key), "payloads")
    # Partial sums make a payload of a third of all rows one row per task.
    best = F.min(F.struct(F.col("page_id").isNull(), "page_id", "url")).alias("first")
    firsts = narrow.groupBy("digest").agg(best, F.count("*").alias("n")).where("n > 1")
    again = narrow.join(firsts.select("digest", "first"), "digest")
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("url") == F.col("first.url"))
    # One row per key that occurs with a response elsewhere or several times.
    marks = again.groupBy(*key).agg(F.count("*").alias("times"), F.first(is_first).alias("is_first"), F.first("first.page_id").alias("first_id"))
    marks = stage(marks.where("not is_first or times > 1"), "revisits")
    joined = lookup(rows, marks, key)
    size = F.octet_length("html").alias("size")
    single = joined.where("times is null or not is_first")
    revisit = F.col("is_first").isNotNull()
    made = single.select(*key, F.when(~revisit, F.col("html")).otherwise("").alias("html"), size, F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("first_id")).alias("refers_to"))
    # Of fully repeated rows one payload a task moves on; the others become revisits as narrow
    # rows, all but the first one in the least of their partitions.
    several = joined.where("times is not null and is_first")
    kept = several.groupBy(*key).agg(F.first("html").alias("html")).select(*key, "html", size, F.lit("response").alias("kind"), F.lit(None).cast("long").alias("refers_to"))
    narrow = stage(several.select(*key, size, "first_id", F.spark_partition_id().alias("part")), "repeated")
    least = narrow.groupBy(*key).agg(F.min("part").alias("least"))
    place = F.row_number().over(Window.partitionBy(*key, "part").orderBy(F.lit(1)))
    others = lookup(narrow.withColumn("place", place), least, key).where("part <> least or place > 1")
    return made.unionByName(kept).unionByName(others.select(*key, F.lit("").alias("html"), "size", F.lit("revisit").alias("kind"), F.col("first_id").alias("refers_to")))


def record(page_id: int | None, url: str, html: str, size: int, digest: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """The bytes of one record; ``size`` is that of the full payload, which revisits leave out."""
    payload = b"" if kind == "revisit" else html.encode()
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8"]
    if kind == "revisit":
        head.append(f"WARC-Profile: {PROFILE}")
    if refers_to is not None:
        head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + END.encode() + payload + END.encode()


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(path)


def write(pages: DataFrame, path: str) -> DataFrame:
    """Write archives below ``path``/archives and return the index, written below ``path``/index."""
    spark = pages.sparkSession
    whole = lambda x: None if pd.isna(x) else int(x)

    def archive(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
        out, name, offset = None, f"{path}/archives/{uuid.uuid4().hex}.warc.gz", 0
        try:
            for batch in batches:
                if len(batch) and out is None:
                    store, inner = opened(name)
                    store.create_dir(inner.rsplit("/", 1)[0])
                    out = store.open_output_stream(inner, compression=None)
                index = []
                for r in batch.itertuples(index=False):
                    data = gzip.compress(record(whole(r.page_id), r.url, r.html, int(r.size), r.digest, r.kind, whole(r.refers_to), date), LEVEL, mtime=0)
                    out.write(data)
                    index.append((name, offset, len(data), whole(r.page_id), r.url, r.digest))
                    offset += len(data)
                table = pd.DataFrame(index, columns=["path", "offset", "length", "page_id", "url", "digest"])
                yield table.astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    decided(pages).mapInPandas(archive, INDEX).write.parquet(f"{path}/index")
    return spark.read.schema(INDEX).parquet(f"{path}/index")


def ranges(rows: pd.DataFrame) -> Iterator[tuple[int, int, pd.DataFrame]]:
    """Runs of neighbouring records: first byte, end byte, their rows."""
    start, end, at = 0, 0, 0
    offsets, lengths = rows["offset"].tolist(), rows["length"].tolist()
    for i, (o, n) in enumerate(zip(offsets, lengths)):
        if i > at and (o - end > GAP or o + n - start > RUN):
            yield start, end, rows.iloc[at:i]
            at = i
        if i == at:
            start = o
        end = o + n
    if offsets:
        yield start, end, rows.iloc[at:]


def parse(record: bytes) -> tuple:
    """page_id, length and digest of the full payload, type, refers_to of one record."""
    head, payload = gzip.decompress(record).split(END.encode(), 1)
    payload = payload[: -len(END)]
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda text: int(text[len("<urn:page:") : -1]) if text[len("<urn:page:") : -1] else None
    size, digest = int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].split(":", 1)[1]
    if len(payload) != int(fields["Content-Length"]):
        raise ValueError("record cut short")
    if fields["WARC-Type"] == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    refers = number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
    return number(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], refers


def read(selected: DataFrame) -> DataFrame:
    """Parse the records of the selected index rows (path, offset, length)."""

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, file = None, None
        for batch in batches:
            for path, rows in batch.groupby("path", sort=False):
                if path != name:
                    if file is not None:
                        file.close()
                    store, inner = opened(path)
                    name, file = path, store.open_input_file(inner)
                for start, end, run in ranges(rows):
                    data = file.read_at(end - start, start)
                    out = [parse(data[o - start : o - start + n]) for o, n in zip(run["offset"], run["length"])]
                    table = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
                    yield table.astype({"page_id": "Int64", "refers_to": "Int64"})

    slices = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = selected.select("path", "offset", "length").repartitionByRange(slices, "path", "offset").sortWithinPartitions("path", "offset")
    return ordered.mapInPandas(fetch, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages and read every record back through the index."""
    return read(write(pages, new_path(spark, "warc")))
