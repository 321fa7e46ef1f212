"""A keyed table kept as a log of changed rows.

Layout under ``base``::

    full/version=N      the whole table as of version N
    changes/version=N   the rows whose key changed in version N

A version counts once its folder has ``_SUCCESS``; a retry overwrites the
folder of its own version.  A run writes the rows it changed and nothing else,
so the bytes it writes follow the changed keys.  A reader takes the newest whole
table and, of each key that changed after it, the newest row (merge on read).
When the changes since the last whole table exceed ``COMPACT_SHARE`` of its
bytes, the next whole table is written; old versions stay until ``vacuum``.

With ``bucket_of``, whole tables and changes are partitioned by a hash of those
key columns, and a reader that names its buckets reads no others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

COMPACT_SHARE = 0.5     # changes (bytes) per whole table (bytes) that start a compaction
BUCKETS = 64


@dataclass
class KeyedLog:
    spark: SparkSession
    base: str
    schema: StructType
    keys: list[str]
    bucket_of: list[str] = field(default_factory=list)
    compact_share: float = COMPACT_SHARE

    # -- folders ---------------------------------------------------------------
    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([self.base.rstrip("/"), *parts]))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self, kind: str, at_most: int | None = None) -> list[int]:
        """Committed versions of a kind, ascending (a listing, no data read)."""
        fs, p = self._fs(), self._path(kind)
        if not fs.exists(p):
            return []
        out = []
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if st.isDirectory() and name.startswith("version=") and fs.exists(self._path(kind, name, "_SUCCESS")):
                out.append(int(name.split("=", 1)[1]))
        return sorted(v for v in out if at_most is None or v <= at_most)

    def _bytes(self, kind: str, versions: list[int]) -> int:
        fs = self._fs()
        return sum(fs.getContentSummary(self._path(kind, f"version={v}")).getLength() for v in versions)

    def latest(self, at_most: int | None = None) -> int | None:
        """Newest committed version, optionally not above ``at_most``."""
        return max([*self._versions("full", at_most), *self._versions("changes", at_most)], default=None)

    # -- reading ---------------------------------------------------------------
    @property
    def _stored(self) -> StructType:
        extra = [StructField("bucket", IntegerType())] if self.bucket_of else []
        return StructType([*self.schema.fields, StructField("version", IntegerType()), *extra])

    def _load(self, kind: str, versions: list[int], buckets: list[int] | None) -> DataFrame:
        root = f"{self.base.rstrip('/')}/{kind}"
        df = self.spark.read.schema(self._stored).option("basePath", root) \
            .parquet(*[f"{root}/version={v}" for v in versions])
        return df if buckets is None or not self.bucket_of else df.filter(F.col("bucket").isin(buckets))

    def read(self, at_most: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """One row per key as of the newest version not above ``at_most``."""
        full = self._versions("full", at_most)[-1:]
        changes = [v for v in self._versions("changes", at_most) if not full or v > full[0]]
        cols = [f.name for f in self.schema.fields]
        old = self._load("full", full, buckets).select(*cols) if full else None
        if not changes:
            return old if old is not None else self.spark.createDataFrame([], self.schema)
        new = self._load("changes", changes, buckets)
        if len(changes) > 1:
            rest = [c for c in cols if c not in self.keys]
            new = new.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "version").alias("_b")) \
                .select(*self.keys, *[F.col("_b")[c].alias(c) for c in rest])
        new = new.select(*cols)
        return new if old is None else old.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new)

    def buckets(self, rows: DataFrame) -> list[int]:
        """The buckets that the keys of ``rows`` lie in (at most ``BUCKETS``)."""
        return sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.bucket_of), F.lit(BUCKETS)).cast("int")

    # -- writing ---------------------------------------------------------------
    def _write(self, rows: DataFrame, kind: str, version: int) -> str:
        path = f"{self.base.rstrip('/')}/{kind}/version={version}"
        out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        if self.bucket_of:
            # a bucket's rows come from a few tasks, whatever the size of the bucket
            b = out.withColumn("bucket", self._bucket())
            b.repartition("bucket", F.pmod(F.xxhash64(*self.keys), F.lit(4))).write.mode("overwrite") \
                .partitionBy("bucket").parquet(path)
        else:
            out.write.mode("overwrite").parquet(path)
        return path

    def replace(self, rows: DataFrame, version: int) -> str:
        """The whole table as of ``version``."""
        return self._write(rows, "full", version)

    def append(self, changed: DataFrame, version: int) -> bool:
        """The rows (one per key) that ``version`` inserts or replaces.  True
        if this started a compaction."""
        self._write(changed, "changes", version)
        full = self._versions("full", version)[-1:]
        since = [v for v in self._versions("changes", version) if not full or v > full[0]]
        if self._bytes("changes", since) <= self.compact_share * self._bytes("full", full):
            return False
        self._write(self.read(version), "full", version)
        return True

    def vacuum(self) -> int:
        """Delete the versions before the newest whole table; how many."""
        full, fs, n = self._versions("full"), self._fs(), 0
        for kind in ("full", "changes"):
            for v in self._versions(kind, full[-1] if full else -1):
                if kind == "changes" or v < full[-1]:
                    n += fs.delete(self._path(kind, f"version={v}"), True)
        return n
