"""The page ledger: which pages of a topic have been delivered.

One record per topic: the header read from its first page, the delivered pages
as intervals without gaps (islands), and the pages that were not full when they
were read.  A run adds the pages it gets; a topic is read up to the end of the
island that holds the page it resumes at, so pages may come in any split over
runs, and the header or resume page need not come again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .keyed_log import KeyedLog

INTERVAL = StructType([StructField("lo", IntegerType()), StructField("hi", IntegerType())])
OPEN_PAGE = StructType([StructField("page_no", IntegerType()), StructField("last_pos", IntegerType())])
HEADER = ["domain", "link", "topic_author", "total_pages", "title"]
LEDGER_SCHEMA = StructType([
    StructField("topic_key", StringType()),
    StructField("topic_id", StringType()),
    StructField("domain", StringType()),
    StructField("link", StringType()),               # of the first page; null: header not read yet
    StructField("topic_author", StringType()),
    StructField("total_pages", IntegerType()),       # as the header says
    StructField("title", StringType()),
    StructField("pages", ArrayType(INTERVAL)),       # delivered, ascending, without overlap or touch
    StructField("open", ArrayType(OPEN_PAGE)),       # read when not full
])


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def ledger_log(spark: SparkSession, base: str) -> KeyedLog:
    return KeyedLog(spark, base, LEDGER_SCHEMA, ["topic_key"])


def islands(pages: DataFrame, key: str = "topic_id") -> DataFrame:
    """(key, pages): the page numbers of each key as intervals.  Begins and
    ends are found by anti joins on (key, page), so a topic with very many
    pages is no single group; only its islands meet."""
    p = pages.select(key, "page_no").distinct()
    shifted = lambda d: p.select(key, (F.col("page_no") + d).alias("page_no"))
    los = p.join(shifted(1), [key, "page_no"], "left_anti").withColumn("lo", F.lit(True))
    his = p.join(shifted(-1), [key, "page_no"], "left_anti").withColumn("lo", F.lit(False))
    both = los.unionByName(his).groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(F.col("lo"), F.col("page_no")))).alias("l"),
        F.array_sort(F.collect_list(F.when(~F.col("lo"), F.col("page_no")))).alias("h"))
    return both.select(key, F.zip_with("l", "h", lambda x, y: F.struct(
        x.cast("int").alias("lo"), y.cast("int").alias("hi"))).alias("pages"))


def _intervals(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast(ArrayType(INTERVAL)))


def merged(a, b) -> Column:
    """The union of two interval arrays."""
    def add(acc, x):
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (x["lo"] <= F.when(F.size(acc) > 0, last["hi"]) + 1)
        longer = F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))) \
            .otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(F.concat(_intervals(a), _intervals(b))), F.array().cast(ArrayType(INTERVAL)), add)


def read_to(pages, start) -> Column:
    """End of the island that holds page ``start`` (``start - 1``: not there)."""
    s = F.col(start) if isinstance(start, str) else start
    inside = F.filter(_intervals(pages), lambda x: (x["lo"] <= s) & (x["hi"] >= s))
    return F.coalesce(F.get(inside, F.lit(0))["hi"], s - 1).cast("int")


def gaps(pages, start, total) -> Column:
    """Intervals of the pages ``start..total`` that are in no interval."""
    s = F.col(start) if isinstance(start, str) else start
    t = F.col(total) if isinstance(total, str) else total
    p = _intervals(pages)
    los = F.concat(F.array(s.cast("int")), F.transform(p, lambda x: x["hi"] + 1))
    his = F.concat(F.transform(p, lambda x: x["lo"] - 1), F.array(t.cast("int")))
    cut = F.zip_with(los, his, lambda a, b: F.struct(F.greatest(a, s).cast("int").alias("lo"),
                                                     F.least(b, t).cast("int").alias("hi")))
    return F.filter(cut, lambda x: x["lo"] <= x["hi"])


def missing_pages(topics: DataFrame, pages: str = "pages", start: str = "start_page", total: str = "total_pages") -> DataFrame:
    """G1: one row per page to fetch (``page_no``)."""
    return topics.withColumn("_g", F.explode(gaps(pages, start, total))) \
        .withColumn("page_no", F.explode(F.sequence(F.col("_g.lo"), F.col("_g.hi")))).drop("_g")


def open_pages(old: str, read: str, posts_per_page: int) -> Column:
    """``open`` after a run: the pages in ``read`` (array of ``page_no``,
    ``last_pos``) that are not full, and the old ones that it didn't read."""
    none = F.array().cast(ArrayType(OPEN_PAGE))
    now = F.coalesce(F.col(read), none)
    before = F.filter(F.coalesce(F.col(old), none), lambda x: ~F.exists(now, lambda y: y["page_no"] == x["page_no"]))
    return F.array_sort(F.concat(before, F.filter(now, lambda y: y["last_pos"] < posts_per_page - 1)))
