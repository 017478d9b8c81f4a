"""Writing report tables and metrics."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from reviewops.session import add_line, kept, stored_lines


def safe_name(name: Column) -> Column:
    """Name with everything but letters, digits, spaces, _ and - replaced by _. For display: different names may share one."""
    return F.regexp_replace(name, r"[^\p{L}\p{N} _-]", "_")


def bucket_of(name: Column) -> Column:
    """The report folder of a hotel: the first two digits of its name's MD5."""
    return F.concat(F.lit("h"), F.substring(F.md5(F.coalesce(name, F.lit("")).cast("binary")), 1, 2))


_COMMITS = "number bigint, version string, buckets array<string>, schema string"


def _current(spark: SparkSession, folder: str) -> tuple[dict[str, str], T.StructType | None, int]:
    """Of each bucket the version that counts, the columns of the last commit, and how many commits there are."""
    commits = sorted(stored_lines(spark, f"{folder}/commits", _COMMITS), key=lambda c: (c.number, c.version))
    versions = {b: c.version for c in commits for b in c.buckets}
    return versions, T.StructType.fromJson(json.loads(commits[-1].schema)) if commits else None, len(commits)


def _rows_of(spark: SparkSession, folder: str, fmt: str, versions: Mapping[str, str], schema: T.StructType) -> DataFrame:
    """Rows (columns, bucket) of the given buckets, at most 256 folders."""
    whole = T.StructType([*schema.fields, T.StructField("bucket", T.StringType())])
    paths = [f"{folder}/version={v}/bucket={b}" for b, v in sorted(versions.items())]
    if not paths:
        return spark.createDataFrame([], whole)
    reader = spark.read.schema(whole).option("basePath", folder).format(fmt)
    return (reader.option("header", True) if fmt == "csv" else reader).load(paths).select(*(F.col(f"`{c}`") for c in whole.names))


def write_report(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet", by: str = "Hotel_Name",
                 stamp: str | None = None) -> list[str]:
    """Write each section below ``path`` and return the folders.

    Rows keep their hotel's full name, so no two hotels can be taken for one. They lie in 256
    buckets by a hash of the name, however many hotels there are. Only the buckets of the hotels given are
    written, as a new version, with the other hotels they held; files of other buckets aren't touched.
    The line that makes the version count is added last, so a write that fails on the way
    changes nothing. Older versions stay until ``clear_report``. ``stamp`` keeps reports of different times apart.
    """
    folders = []
    for section, table in tables.items():
        spark = table.sparkSession
        folder = "/".join(p for p in (path, stamp, section) if p)
        versions, _, commits = _current(spark, folder)
        rows = kept(table.withColumn("bucket", bucket_of(F.col(by))), "report-section")
        touched = sorted(r.bucket for r in rows.select("bucket").distinct().collect())  # 256 at most
        shared = {b: versions[b] for b in touched if b in versions}
        if shared:
            names = rows.select(F.col(by).alias("_name")).distinct()
            others = _rows_of(spark, folder, fmt, shared, table.schema).join(names, F.col(by).eqNullSafe(F.col("_name")), "left_anti")
            rows = rows.unionByName(others)
        version = uuid.uuid4().hex
        writer = rows.repartition("bucket").write.partitionBy("bucket").format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(f"{folder}/version={version}")
        add_line(spark, f"{folder}/commits", _COMMITS, (commits + 1, version, touched, table.schema.json()))
        folders.append(folder)
    return folders


def read_report(spark: SparkSession, folder: str, hotel: str | None = None, fmt: str = "parquet", by: str = "Hotel_Name") -> DataFrame:
    """A section written by ``write_report``, with the columns last written; of one hotel, only its bucket is read."""
    versions, schema, commits = _current(spark, folder)
    if not commits:
        raise FileNotFoundError(f"no report is stored in {folder}")
    if hotel is not None:
        bucket = "h" + hashlib.md5(hotel.encode()).hexdigest()[:2]
        versions = {b: v for b, v in versions.items() if b == bucket}
    table = _rows_of(spark, folder, fmt, versions, schema)
    return (table if hotel is None else table.filter(F.col(by) == hotel)).drop("bucket")


def clear_report(spark: SparkSession, folder: str) -> int:
    """Delete the buckets of older versions, which nobody may be reading any more; returns how many."""
    versions, _, _ = _current(spark, folder)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = hadoop.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [s.getPath() for s in files.globStatus(hadoop.Path(f"{folder}/version=*/bucket=*"))
           if versions.get(s.getPath().getName().removeprefix("bucket=")) != s.getPath().getParent().getName().removeprefix("version=")]
    for path in old:
        files.delete(path, True)
    return len(old)


def write_metrics(metrics: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a metrics table, a few rows, as one JSON or CSV file."""
    writer = metrics.coalesce(1).write.mode("overwrite").format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
