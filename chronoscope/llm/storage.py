"""Stage tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where none is set, a scratch folder is made, but only for
    a local master (tests): on a cluster the executors could not read it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="chronoscope-llm-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """A query that runs inside deletes its shuffle files at its end. Else they stay until the driver happens to
    collect its garbage, which it does no more often for large inputs than for small ones."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def stored(df: DataFrame, name: str, *read: DataFrame) -> DataFrame:
    """Writes df as a compressed table under the shared folder and reads it back: cuts the lineage,
    and a lost executor costs only a new read. read: stored tables that nothing reads from then on."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    with without_leftovers(spark):
        df.write.parquet(path)
    drop_stored(*read)
    table = spark.read.schema(schema).parquet(path)
    table.stored_at = path
    return table


def drop_stored(*tables: DataFrame) -> None:
    """Deletes the files of tables that `stored` returned; others are left alone."""
    for table in tables:
        path = vars(table).pop("stored_at", None)
        if path:
            place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


BROADCAST_ROWS = 200_000


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Marks a narrow table of counted rows for broadcast up to BROADCAST_ROWS; beyond, the join is
    left to a shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
