"""Map the driver's test tables onto the library's input schemas.

These functions only rename and reshape columns; every rule runs later in
the operators.  Mapping (one post per row):

* ``conversations``: topic = ``conv_id``, order = ``turn`` (page =
  turn div posts-per-page + 1, position = turn mod posts-per-page),
  author = ``role``, content = ``text``;
* ``documents``: topic = ``source`` (or ``lang``), order = ``doc_id``,
  author = ``source``, content = ``text``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _text_post_columns(text: str) -> list:
    t = F.col(text)
    paras = lines(text)
    return [
        t.alias("post_text"), t.alias("content_text"), t.alias("content_html"),
        paras.alias("post_paragraphs"), paras.alias("paragraphs"),
        F.lit(0).alias("n_hosted"), F.lit(0).alias("content_n_hosted"),
        F.lit(0).alias("n_post_links"), F.lit(0).alias("n_links"),
        F.lit(False).alias("post_has_blockquote"), F.lit(False).alias("content_has_blockquote"),
    ]


def conversation_posts(conv: DataFrame, posts_per_page: int) -> DataFrame:
    return conv.select(
        F.col("conv_id").alias("topic_id"),
        (F.floor(F.col("turn") / posts_per_page) + 1).cast("int").alias("page_no"),
        F.pmod(F.col("turn"), F.lit(posts_per_page)).cast("int").alias("pos"),
        F.col("role").alias("post_author"),
        *_text_post_columns("text"),
    )


def document_posts(docs: DataFrame, posts_per_page: int, topic_col: str = "source") -> DataFrame:
    return docs.select(
        F.col(topic_col).alias("topic_id"),
        (F.floor(F.col("doc_id") / posts_per_page) + 1).cast("int").alias("page_no"),
        F.pmod(F.col("doc_id"), F.lit(posts_per_page)).cast("int").alias("pos"),
        F.col("source").alias("post_author"),
        *_text_post_columns("text"),
    )
