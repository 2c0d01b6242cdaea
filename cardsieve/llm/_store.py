"""Tables and files in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset and the session is a local one (tests), a new local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Inside, Spark drops a query's shuffle files as soon as the query has ended."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str, compression: str = "zstd", per_file: int = 0) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives the loss of any executor."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", compression)
    if per_file:
        writer = writer.option("maxRecordsPerFile", per_file)
    with shuffle_cleanup(spark):
        writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def remove(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` has written, when nothing reads them any more."""
    for table in tables:
        system, base = file_system(table.stored_at)
        if system.get_file_info(base).type == pafs.FileType.Directory:
            system.delete_dir(base)


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow file system and path of a URI, the same in every task: file, hdfs, s3 and others."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}" if uri.startswith("/") else uri)


def mapped_file(uri: str, name: str):
    """A file's bytes: mapped where the file system is a local one, else read."""
    system, base = file_system(uri)
    if isinstance(system, pafs.LocalFileSystem):
        return pa.memory_map(f"{base}/{name}").read_buffer()
    with system.open_input_file(f"{base}/{name}") as file:
        return file.read_buffer()


def put_file(uri: str, name: str, chunks) -> int:
    """Write one file whole: under a name of this attempt, then renamed, so that a repeated task leaves one good copy."""
    system, base = file_system(uri)
    system.create_dir(base, recursive=True)
    trial, size = f"{base}/.{name}.{uuid.uuid4().hex}", 0
    with system.open_output_stream(trial) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    system.move(trial, f"{base}/{name}")
    return size
