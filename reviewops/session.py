"""Session helpers."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, memory: str = "8g", shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine. On a cluster the session is given.

    Splits are small here, as the tables are: a cluster keeps Spark's default of 128 MB.
    """
    return (SparkSession.builder.master(f"local[{cores}]").appName("reviewops")
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
            .config("spark.sql.files.maxPartitionBytes", "2m")
            .config("spark.driver.memory", memory)
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one beside the warehouse's tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
        if folder.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            warnings.warn(f"spark.checkpoint.dir is not set, and {folder} must be shared by all machines", stacklevel=2)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write the frame as a Parquet table in the shared folder and go on from there.

    Lineage ends: lost executors cost no upstream work. Spark also knows the size of what it
    rereads, so small tables are broadcast by its own check of
    ``spark.sql.autoBroadcastJoinThreshold`` and large ones are not.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_lines(spark: SparkSession, path: str, schema: str) -> list:
    """The lines of a small JSON table, such as a list of versions; none if there is no such folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return []
    return spark.read.schema(schema).json(path).collect()


def add_line(spark: SparkSession, path: str, schema: str, line: tuple) -> None:
    """Add a line to such a table: it is there as a whole or not at all."""
    spark.createDataFrame([line], schema).coalesce(1).write.mode("append").json(path)
