"""Incremental ingest with Structured Streaming.

Newly crawled pages land as parquet files in a folder.  A file stream with
``trigger(availableNow=True)`` (or a processing-time trigger for a
long-running job) parses them and hands them to a keyed state in the state store
(``topics``): one record per topic with its header, the pages it has and those
that wait.  What it releases goes to ``foreachBatch``, which runs the batch
selection and commits:

* outputs into folders named by the batch id, written with overwrite, and story
  chunks under the batch's name, so a batch replayed after a failure replaces
  its own part (T3);
* the changed state rows as version ``batch_id + 1``.

A page that comes again is known by the record and not read twice (T3), a page
after a gap or before its topic's header waits there, parsed, until it can be
read, and the work of a batch follows its pages and topics: nothing scans what
earlier batches wrote, but for the buckets of the first-key index that the
batch's topics lie in and the narrow topic state (for free file names).

Kept-text dedup restarts every batch, as in the original tool, unless
``cfg.dedup_across_runs`` (T4).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import CurationConfig
from ..operators import state as ST
from ..session import materialize, release_scratch, release_shuffles, scratch_mark, scratch_path
from . import topics


def file_stream(spark: SparkSession, landing: str, schema: StructType, glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(landing)


def run_available(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything available now, batch by batch, then stop."""
    q = (stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def enable_rocksdb(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB (on local disk of each executor,
    checkpointed to the shared folder) instead of the JVM heap.  A batch commits
    the changes of its keys; whole snapshots follow in the background."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def page_ingest(spark: SparkSession, landing: str, schema: StructType, base: str,
                cfg: CurationConfig, checkpoint: str | None = None, profile_rows=None,
                prepare: Callable[[DataFrame], DataFrame] | None = None, glob: str | None = None,
                image_targets: DataFrame | None = None, assets=None, max_files: int | None = None,
                every: str | None = None, wait_limit_s: int | None = None):
    """Pages landing in ``landing`` -> the tables of ``plans.outputs``
    under ``base``, in folders named by the batch id.  ``prepare`` maps the
    landing rows to ``topic_id, link, page_no, html[, status]``;
    ``image_targets`` and ``assets`` as in ``curate.run``.  Everything available
    is processed, and ``base`` returned; ``every`` (``"30 seconds"``) keeps the
    query running at that pace instead and returns it, and then ``wait_limit_s``
    sets timers that report a page which still waits after so many seconds."""
    from ..plans import curate, outputs
    if wait_limit_s is not None and every is None:
        # with timers of processing time a query has always another batch to run
        raise ValueError("timers need a query that keeps running (every=...)")
    checkpoint = checkpoint or f"{base}/_checkpoint"

    def handle(rows: DataFrame, batch_id: int) -> None:
        mark = scratch_mark()
        state = ST.read_state(spark, f"{base}/state", at_most=batch_id)
        got = materialize(rows, "released", codec="zstd")     # the stateful operator runs once
        r = topics.reading(got, state, cfg)
        earlier = None
        if cfg.dedup_across_runs:
            earlier = outputs.first_keys_of(spark, base, r.known, batch_id)
        out = curate.finish(r, cfg, state, f"batch-{batch_id}", image_targets, assets, earlier_keys=earlier,
                            wait=False)
        outputs.write_run(spark, base, out, cfg, batch_id + 1, f"batch_id={batch_id}", f"batch-{batch_id}", earlier)
        release_scratch(spark, mark)    # the batch's intermediate tables
        release_shuffles(spark)

    enable_rocksdb(spark)
    stream = file_stream(spark, landing, schema, glob, max_files)
    if prepare is not None:
        stream = prepare(stream)
    rows = topics.released(stream, cfg, profile_rows, wait_limit_s)
    if every is not None:
        return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint) \
            .trigger(processingTime=every).start()
    run_available(rows, handle, checkpoint)
    return base


def event_ingest(spark: SparkSession, landing: str, glob: str | None, base: str | None = None,
                 key: str = "user_id", id_col: str = "event_id", ts_col: str = "ts",
                 max_files: int | None = None, dedup_within: str | None = None) -> DataFrame:
    """Posts arriving as events (topic = ``key``): each row counts once
    (streaming dedup on ``id_col``) and a per-topic counter (posts, last post
    time) is kept by a streaming aggregation in the state store.  Every
    micro-batch emits only the topics it changed (update mode) into a folder
    named by its batch id; the current state is the latest change per topic.
    Per-batch work is proportional to the batch, not to the history.

    ``dedup_within`` (e.g. ``"1 hour"``) bounds the dedup state with an
    event-time watermark (``dropDuplicatesWithinWatermark``): a copy arriving
    later than that after the newest event seen is no longer recognised.
    Without it the dedup is exact and its state holds every key."""
    base = base or scratch_path(spark, "event-ingest")
    sample = spark.read.parquet(landing if not glob else f"{landing.rstrip('/')}/{glob}")
    changes = f"{base}/changes"

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{changes}/batch_id={batch_id}")

    enable_rocksdb(spark)
    stream = file_stream(spark, landing, sample.schema, glob, max_files)
    if dedup_within:
        # watermarks need TIMESTAMP (the test tables carry TIMESTAMP_NTZ)
        stream = stream.withColumn("_wm", F.col(ts_col).cast("timestamp")).withWatermark("_wm", dedup_within) \
            .dropDuplicatesWithinWatermark([id_col])
    else:
        stream = stream.dropDuplicates([id_col])
    agg = stream.groupBy(key).agg(F.count(F.lit(1)).alias("n_posts"), F.max(ts_col).alias("last_ts"))
    q = (agg.writeStream.outputMode("update").foreachBatch(handle)
         .option("checkpointLocation", f"{base}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    latest = spark.read.parquet(changes).groupBy(key).agg(
        F.max_by(F.struct("n_posts", "last_ts"), "batch_id").alias("s"))
    return latest.select(key, F.col("s.n_posts").cast("long").alias("n_posts"), F.col("s.last_ts").alias("last_ts"))
