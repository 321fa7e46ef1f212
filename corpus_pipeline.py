"""The corpus pipeline: stages over ``documents``, each written as Parquet and
read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from threadsmith.llm import byte_bpe, jaccard, mixing, suffixes, toxicity
from threadsmith.llm.common import prepare, table
from threadsmith.session import scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar rejects go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    prepare(spark)
    return jaccard.one_of_each(docs)


# A passage of 50 words is a repeat: about 300 bytes of prose, 240 where words are
# short.  (The query of this operator has a limit of its own, 400.)
PASSAGE_BYTES = 240


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat anywhere in what is left go."""
    prepare(spark)
    return suffixes.without_repeats(docs, length=PASSAGE_BYTES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    prepare(spark)
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what the corpus has become, with the ids
    (in small blocks and with a small memory of chunks: the ids of a block are
    held beside its texts, in workers that have served four stages)."""
    prepare(spark)
    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN,
                           with_ids=True, block_chars=1_000_000, cache_entries=40_000)


STAGES = [("toxicity", drop_toxic), ("jaccard_join", drop_near_copies), ("suffix_dedup", drop_repeats),
          ("mix_sources", mix_sources), ("encode_tokens", encode_tokens)]
# Learned scores and hash-named shingles can't be stated in SQL: tests/llm/
# test_pipeline.py holds run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
