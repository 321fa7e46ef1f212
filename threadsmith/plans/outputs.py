"""Where a run's tables go (S9-S11, S14): one folder per run and table, written
with overwrite, the story chunks committed by ``StoryStore``, the state last.  A
run that is tried again replaces its own part."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CurationConfig
from ..operators import dedup as D
from ..operators import ledger as L
from ..operators import render as R
from ..operators import state as ST
from ..sources.stories import StoryStore, write_segments
from .curate import RunOutputs


def together(jobs: list) -> list:
    """Run independent Spark jobs at the same time (the tables are small beside
    the cluster; one after another, each would wait for its slowest task)."""
    with ThreadPoolExecutor(max_workers=4) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(j)) for j in jobs]]


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = ST._fs(spark, path)
    return fs.exists(p)


def first_keys_of(spark: SparkSession, base: str, pages: DataFrame, version: int) -> DataFrame | None:
    """The first-key index, of the buckets that the topics of ``pages`` lie in."""
    log = D.first_key_log(spark, f"{base}/first_keys")
    if log.latest(version) is None:
        return None
    return log.read(version, buckets=log.buckets(pages.select("topic_key").distinct()))


def write_run(spark: SparkSession, base: str, out: RunOutputs, cfg: CurationConfig, version: int, tag: str,
              run_id: str | None = None, earlier: DataFrame | None = None) -> int:
    """Write a run's tables under ``base``: ``story_posts``, ``metrics``,
    ``rejects``, ``quarantine``, ``frontier`` and ``touched`` in folders ``tag``,
    the chunks and document segments of its stories, then ledger, waiting pages,
    first keys and state as ``version``.  Returns the number of the run in the
    story store."""
    store = StoryStore(spark, f"{base}/story_table")
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{base}/{name}/{tag}")

    def stories() -> int:
        put(out.touched, "touched")
        touched = spark.read.parquet(f"{base}/touched/{tag}")
        names = touched.select(F.col("story_key").alias("topic_id"), F.col("file_path").alias("story"))
        # kept posts are written once; the story chunks are rendered from them
        put(out.story_posts.drop("frames").join(names, "topic_id"), "story_posts")
        seq = store.append(R.render_chunks(spark.read.parquet(f"{base}/story_posts/{tag}")), touched, run_id)
        write_segments(store, f"{base}/stories", seq)
        return seq

    def first_keys() -> None:
        new = out.kept_keys if earlier is None else D.merged_first_keys(earlier, out.kept_keys)
        D.first_key_log(spark, f"{base}/first_keys").append(
            new.filter(F.col("topic_key").isNotNull()).groupBy("topic_key", "kind", "key").agg(F.min("ord").alias("ord")), version)

    def ledger() -> None:
        L.ledger_log(spark, f"{base}/ledger").append(out.ledger, version)

    def waiting() -> None:
        out.waiting.write.mode("overwrite").parquet(f"{base}/waiting/version={version}")

    # the longest first; the stories wait for their names meanwhile
    jobs = [stories, *([first_keys] if cfg.dedup_across_runs else []), *[partial(put, df, name) for df, name in (
        (out.metrics, "metrics"), (out.rejects, "rejects"), (out.quarantine, "quarantine"), (out.frontier, "frontier"))]]
    jobs += [ledger] if cfg.use_state and out.ledger is not None else []
    jobs += [waiting] if cfg.use_state and out.waiting is not None else []
    seq = together(jobs)[0]
    if cfg.use_state:
        ST.write_changes(out.changes, f"{base}/state", version)     # last: the run counts from here on
    return seq
