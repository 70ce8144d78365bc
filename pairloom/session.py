"""Session helpers: a tuned local session for tests and benches, table
loading with column pruning, and the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "pairloom",
                  extra: dict | None = None) -> SparkSession:
    """Session for tests and local benches.  On a cluster, use the
    session the platform gives you; every operator here reads its knobs
    from the session instead of hard-coding them."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.default.parallelism", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PAIRLOOM_DRIVER_MEMORY", "16g"))
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
        # checkpointed tables are deleted once nothing references them
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the platform and is a shared filesystem;
    it is only filled in here when unset (local tests)."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not current and sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set: name a shared folder (HDFS, object store) for materialised tables"
            )
        # local runs and tests only: one JVM, so a local folder is shared
        current = tempfile.mkdtemp(prefix="pairloom-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return current


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as parquet under the shared checkpoint folder and
    read it back.  Lineage is cut and lost executors cost nothing, as with
    ``checkpoint``; in addition later scans read only their columns, and the
    size is known when joins are planned."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pairloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Has the files of finished shuffles deleted.  They go once the driver
    finds their plans unused, which one with heap to spare may put off for
    hours; the first collection lets go of what holds the plans."""
    gc.collect()  # Python's own handles on plans
    for wait in (0.3, 0):
        spark._jvm.System.gc()
        time.sleep(wait)


def discard(*tables: DataFrame) -> None:
    """Delete the files of ``materialized`` tables that nothing reads again."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.getName().startswith("pairloom-"):
                path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read one driver table; naming the columns prunes the parquet scan."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df
