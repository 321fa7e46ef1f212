"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

# Fixed value of the contracts: a word is a run of characters that are not
# ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

# Documents per Arrow batch: a batch of long documents stays small.
ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings the Arrow operators rely on: bounded batches and a
    shared checkpoint folder."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ensure_checkpoint_dir(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a written intermediate table that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def plain_names(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns but ``doc_id`` and ``text`` named by their
    place, so that none has a name that an operator uses inside."""
    return docs.toDF(*[c if c in ("doc_id", "text") else f"_c{i}" for i, c in enumerate(docs.columns)])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_of(col: str) -> Column:
    """crc32 of the decimal text of an integer column (null ids: of '')."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def unit_hash(col: str, seed: str) -> Column:
    """Deterministic number in [0, 1) from a column and a seed (32 bits of
    md5, so that SQL engines can compute the same value)."""
    text = F.concat(F.lit(seed), F.coalesce(F.col(col).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def give_back() -> None:
    """Return to the system the memory that this Python worker has freed (a
    worker serves many operators, and its allocators keep what they freed)."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):   # another C library
        pass


def per_worker(bc, build: Callable):
    """What ``build(value)`` returns for a broadcast ``{"value": ...}``, built
    once per Python worker (a worker keeps its broadcast values between
    tasks)."""
    holder = bc.value
    if "built" not in holder:
        give_back()     # an operator begins: what the one before it freed
        holder["built"] = build(holder["value"])
    return holder["built"]


def rows_to_batch(cols: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in schema], schema=schema)


def text_blocks(batches: Iterable[pa.RecordBatch], max_chars: int) -> Iterator[tuple[list, list]]:
    """(ids, texts) of the first two columns, in blocks of about
    ``max_chars`` characters; a null text is None."""
    ids: list = []
    texts: list = []
    size = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t) if t else 1
            if size >= max_chars:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
