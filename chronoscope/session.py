"""Session helpers.

On a cluster the session is created by the platform; we only read settings from it.
`get_session` is for tests, benches and local runs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int = 8) -> SparkSession:
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    master = master or os.environ.get("CHRONOSCOPE_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName("chronoscope")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CHRONOSCOPE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # broadcast only what we mark explicitly (all broadcast sides have a size bound)
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 << 20))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster (spark.checkpoint.dir).

    Only where none is set, and only on a local master (tests, local runs), a scratch folder is made:
    on a cluster the executors could not read a folder of the driver's machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() if hasattr(sc, "getCheckpointDir") else None
    if not current:
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            current = tempfile.mkdtemp(prefix="chronoscope-ckpt-")
        sc.setCheckpointDir(current)
    return current


def materialize(df):
    """Cut lineage at a stage boundary: reliable checkpoint into the cluster's shared
    spark.checkpoint.dir (set only when the session has none). Survives executor loss,
    and later stages stop re-running the upstream plan (scalar subqueries included)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_counted(df, name: str):
    """`materialize`, with the number of rows as observed by the job itself. The metric stands at the top of
    the plan, in the stage that writes, so a stage that runs again does not count twice."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F
    seen = Observation(name)
    out = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def materialize_bucketed(df, key: str, name: str):
    """Write `df` as a table bucketed (and sorted) by `key` under the shared checkpoint folder and
    read it back. Later joins, windows and aggregates keyed by `key` read co-located buckets: the
    large side never shuffles again (a plain checkpoint forgets its hash partitioning). Bucket
    count = spark.sql.shuffle.partitions, so a small non-bucketed side is shuffled to match. The rows are
    dealt by the key first, so that each bucket is one file."""
    import os
    import uuid
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"chronoscope_{name}_{uuid.uuid4().hex[:12]}"
    path = os.path.join(checkpoint_dir(spark), table)
    (df.repartition(n, key).write.mode("overwrite").bucketBy(n, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table))
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the catalogue forgets the name; files and the resolved relation stay
    return out
