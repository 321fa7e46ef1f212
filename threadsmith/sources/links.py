"""Topic link input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ws_trim


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """One link per line, stripped, blank lines dropped, file order kept
    in ``link_no`` (increasing, not contiguous)."""
    t = spark.read.text(path)
    return t.select(ws_trim("value").alias("link")).filter(F.length("link") > 0) \
        .withColumn("link_no", F.monotonically_increasing_id())


def links_source(spark: SparkSession, links: list[str]) -> DataFrame:
    """A single existing path is a links file, anything else is the list
    of links itself."""
    if len(links) == 1:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(links[0])
        try:
            if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(p):
                return read_links(spark, links[0])
        except Exception:  # noqa: BLE001 - not a path
            pass
    return spark.createDataFrame([(l, i) for i, l in enumerate(links)], "link string, link_no long")
