"""Spark session helpers shared by the library, tests and bench."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the jobs rely on.  AQE re-plans joins with runtime sizes (a join
# side is broadcast only when its measured size is under the threshold) and
# splits skewed shuffle partitions.
SESSION_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # a join may reuse a hash partitioning on a subset of its keys, e.g. posts
    # partitioned by (topic, page) joined on (topic, page, pos)
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # a task lists many folders (the buckets of the first-key index, stored documents)
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    "spark.ui.enabled": "false",
    # Arrow batches into the parse: pages can be large, keep a batch bounded
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "threadsmith", extra: dict | None = None) -> SparkSession:
    """Session with the defaults the jobs rely on.  The master is the given
    one, else $THREADSMITH_MASTER, else the submitted one, else ``local[8]``.
    Under spark-submit the submitted master, shuffle partitions and driver
    memory stay unless the caller names others."""
    master = master or os.environ.get("THREADSMITH_MASTER")
    # spark-submit starts Python with a gateway that already holds its settings
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ
    b = SparkSession.builder.appName(app_name)
    if master or not submitted:
        b = b.master(master or "local[8]")
    for k, v in SESSION_DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions or not submitted:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    if not submitted:
        b = b.config("spark.driver.memory", os.environ.get("THREADSMITH_DRIVER_MEM", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options the jobs rely on (safe on any session)."""
    for k, v in SESSION_DEFAULTS.items():
        if k.startswith("spark.sql."):
            try:
                spark.conf.set(k, v)
            except Exception:  # pragma: no cover - static conf on some clusters
                pass
    return spark


_LOCAL_CKPT: list[str] = []


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there and it is always used; only when
    it is unset a local run (tests) gets a folder of its own, once per
    process; a run on several machines is refused, as they would not see it."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
        return d
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _LOCAL_CKPT:
        _LOCAL_CKPT.append(tempfile.mkdtemp(prefix="threadsmith-ckpt-"))
    d = _LOCAL_CKPT[0]
    try:
        spark.conf.set("spark.checkpoint.dir", d)
    except Exception:  # noqa: BLE001 - some deployments refuse to set core settings at runtime
        pass
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh directory under the shared checkpoint folder (for written
    intermediate tables, stream sinks and checkpoints)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def scratch_mark() -> int:
    """Position in the scratch registry (see ``release_scratch``)."""
    return len(_SCRATCH)


def release_scratch(spark: SparkSession, since: int) -> int:
    """Delete the intermediate tables written after ``scratch_mark()``
    returned ``since``.  Call it once the outputs that read them are written,
    e.g. at the end of a stream micro-batch.  Returns the folders removed."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    while len(_SCRATCH) > since:
        p = jvm.org.apache.hadoop.fs.Path(_SCRATCH.pop())
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            fs.delete(p, True)
            n += 1
    return n


def release_shuffles(spark: SparkSession) -> None:
    """Have the shuffle files of finished jobs deleted: Spark does it once the
    driver has collected what names them, which can take many batches."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialize(df, name: str, partition_by: list[str] | None = None, codec: str | None = None):
    """Write ``df`` under the shared checkpoint folder and read it back.

    Used where one intermediate result feeds several branches of a plan: it
    is computed once, later stages read a compact parquet table, and the
    lineage is cut (a lost executor does not recompute upstream stages).
    ``partition_by`` lets branches that filter on those columns read only
    their partitions."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    w = df.write.mode("overwrite")
    if codec:
        w = w.option("compression", codec)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    # the writer's schema keeps partition-column types (discovery would read
    # booleans back as strings)
    return spark.read.schema(df.schema).parquet(path)
