"""Story storage and export.

``StoryStore`` keeps a story as ordered chunks.  A run adds its chunks as one
folder and commits it with a log row per story (run, chunk range, counts, hash
of the content); a folder without its commit is not read, and a run of the same
name replaces its own folder.  So a retry, also after a kill between two writes,
leaves every post once.

Documents are header + segments + footer.  A run writes segments of its own
chunks only: text files that Spark range-partitions by (story, chunk), so a
story of any size spans as many tasks as its share of the bytes asks for, under
the name of its story (``author-title-N``).  The manifest gives the segments'
order, sizes and byte offsets.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import BIG_STORY_BYTES, BLOCKS_PER_PART, STORY_FOOTER, STORY_HEADER, CurationConfig
from ..operators.render import ordered_concat, story_parts

HEADER_BYTES = len(STORY_HEADER.encode())
FOOTER_BYTES = len(STORY_FOOTER.encode())
COMMIT = ("run_id string, mode string, story string, story_key string, first_chunk long, last_chunk long, n_chunks long, "
          "n_posts long, n_bytes long, content_hash long")
CHUNK = "story string, story_key string, chunk_no long, html string, n_posts long, n_bytes long, hash long"


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _runs(spark: SparkSession, base: str) -> list[int]:
    """``run_seq`` of the committed folders under ``base`` (a listing)."""
    fs, p = _path(spark, base)
    if not fs.exists(p):
        return []
    names = [(st.getPath(), st.getPath().getName()) for st in fs.listStatus(p) if st.isDirectory()]
    jvm = spark.sparkContext._jvm
    return sorted(int(n.split("=", 1)[1]) for q, n in names
                  if n.startswith("run_seq=") and fs.exists(jvm.org.apache.hadoop.fs.Path(q, "_SUCCESS")))


def _read_runs(spark: SparkSession, base: str, runs: list[int], schema: str) -> DataFrame:
    if not runs:
        return spark.createDataFrame([], schema + ", run_seq int")
    return spark.read.schema(schema + ", run_seq int").option("basePath", base) \
        .parquet(*[f"{base}/run_seq={r}" for r in runs])


@dataclass
class StoryStore:
    """Chunks and commits of stories under ``base``."""
    spark: SparkSession
    base: str

    def _dir(self, kind: str) -> str:
        return f"{self.base.rstrip('/')}/{kind}"

    def runs(self) -> list[int]:
        return _runs(self.spark, self._dir("commits"))

    def commits(self) -> DataFrame:
        return _read_runs(self.spark, self._dir("commits"), self.runs(), COMMIT)

    def chunks(self, runs: list[int] | None = None) -> DataFrame:
        """The chunks of the committed runs (or of some of them)."""
        done = self.runs()
        return _read_runs(self.spark, self._dir("chunks"), [r for r in done if runs is None or r in runs], CHUNK)

    def names(self) -> DataFrame:
        """The run names, one row per committed run."""
        return _read_runs(self.spark, self._dir("runs"), _runs(self.spark, self._dir("runs")), "run_id string")

    def sequence(self, run_id: str | None) -> int:
        """The number of a run: its own if it was committed before, else the
        next one (a folder that was left without commit is overwritten)."""
        done = self.runs()
        if run_id is not None:
            own = self.names().filter(F.col("run_id") == run_id).agg(F.max("run_seq")).first()[0]
            if own is not None:
                return own
        return done[-1] + 1 if done else 1

    def append(self, chunks: DataFrame, names: DataFrame, run_id: str | None = None) -> int:
        """Add a run's chunks (``story_key, chunk_no, html,
        n_posts``) to the stories that ``names(story_key, file_path, mode)``
        gives them, and commit.  Returns the run's number."""
        seq = self.sequence(run_id)
        run_id = run_id or f"run-{seq}"
        n = names.select("story_key", F.col("file_path").alias("story"), "mode")
        c = chunks.join(n, "story_key").select(
            "story", "story_key", F.col("chunk_no").cast("long").alias("chunk_no"), "html",
            F.col("n_posts").cast("long").alias("n_posts"), F.octet_length("html").cast("long").alias("n_bytes"),
            F.xxhash64("story", "chunk_no", "html").alias("hash"))
        c.repartitionByRange("story", "chunk_no").sortWithinPartitions("story", "chunk_no") \
            .write.mode("overwrite").parquet(f"{self._dir('chunks')}/run_seq={seq}")
        own = self.spark.read.schema(CHUNK).parquet(f"{self._dir('chunks')}/run_seq={seq}")
        log = own.groupBy("story", "story_key").agg(
            F.min("chunk_no").alias("first_chunk"), F.max("chunk_no").alias("last_chunk"),
            F.count(F.lit(1)).alias("n_chunks"), F.sum("n_posts").alias("n_posts"), F.sum("n_bytes").alias("n_bytes"),
            F.bit_xor("hash").alias("content_hash"))
        log = log.join(n.select("story", "mode"), "story").select(
            F.lit(run_id).alias("run_id"), "mode", "story", "story_key", "first_chunk", "last_chunk", "n_chunks", "n_posts",
            "n_bytes", "content_hash")
        self.spark.createDataFrame([(run_id,)], "run_id string").write.mode("overwrite") \
            .parquet(f"{self._dir('runs')}/run_seq={seq}")
        log.write.mode("overwrite").parquet(f"{self._dir('commits')}/run_seq={seq}")
        return seq


def stories_of(store: StoryStore) -> DataFrame:
    """``story, n_bytes, n_chunks, n_posts`` of every committed story's
    document."""
    return store.commits().groupBy("story").agg(
        (F.sum("n_bytes") + F.lit(HEADER_BYTES + FOOTER_BYTES)).cast("long").alias("n_bytes"),
        F.sum("n_chunks").alias("n_chunks"), F.sum("n_posts").alias("n_posts"))


SEGMENT = "story string, part long, path string, n_bytes long"


def write_segments(store: StoryStore, out_dir: str, run_seq: int, parts: int | None = None) -> DataFrame:
    """The document segments of one run's chunks, and their manifest
    (``story, run_seq, part, path, n_bytes``).  Other runs' segments stay as
    they are.

    A run has a file per story and task, so nothing here costs more per file than
    the file: the tasks write them and say what they wrote, which is the manifest;
    no file is committed by the driver, listed or opened again."""
    spark, out_dir = store.spark, out_dir.rstrip("/")
    c = store.chunks([run_seq]).select("story", "chunk_no", "html")
    # a number of its own: by bytes alone, thousands of small stories (a file each) would fall to one task
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = c.repartitionByRange(parts, "story", "chunk_no").sortWithinPartitions("story", "chunk_no")
    at = f"{out_dir}/segments/run_seq={run_seq}"
    fs, p = _path(spark, at)
    root = fs.makeQualified(p).toString()       # tasks see the folder that Spark means
    if _arrow_opens(root):
        fs.delete(p, True)      # a run that is tried again replaces its own
        fs.mkdirs(p)
        m = by.select("story", "html").mapInArrow(_segment_writer(root), SEGMENT)
    else:
        m = _segments_by_spark(by, at)
    m.write.mode("overwrite").parquet(f"{out_dir}/manifest/run_seq={run_seq}")
    return manifest(spark, out_dir)


def _arrow_uri(root: str) -> str:
    return root if "://" in root else root.replace("file:", "file://", 1)


def _arrow_opens(root: str) -> bool:
    """Can tasks write below ``root`` with pyarrow (else only Spark can)?"""
    from pyarrow import fs as pafs
    try:
        pafs.FileSystem.from_uri(_arrow_uri(root))
    except (pa.ArrowException, OSError, ImportError):
        return False
    return True


def _folder(story: str | None) -> str:
    """``story=`` with the characters escaped that Spark escapes in the name of a
    partition's folder."""
    if not story:
        return "story=__HIVE_DEFAULT_PARTITION__"
    return "story=" + "".join(f"%{ord(x):02X}" if ord(x) < 32 or x in "\"#%'*/:=?\\\x7f{[]^" else x for x in story)


def _segment_writer(root: str):
    """Rows ``story, html`` in order -> a file per story, SEGMENT rows.  A file is
    written under a name of the attempt and renamed, so a task that runs twice
    leaves one whole file."""
    schema = pa.schema([("story", pa.string()), ("part", pa.int64()), ("path", pa.string()), ("n_bytes", pa.int64())])

    def run(batches):
        from pyarrow import fs as pafs
        out, base = pafs.FileSystem.from_uri(_arrow_uri(root))
        part, mine = TaskContext.get().partitionId(), f".attempt-{TaskContext.get().taskAttemptId()}"
        name = f"part-{part:05d}.txt"
        story, file, size, rows = None, None, 0, []

        def close() -> None:
            file.close()
            at = f"{base}/{_folder(story)}"
            try:
                out.move(f"{at}/{mine}", f"{at}/{name}")
            except OSError:     # some stores keep the file of an earlier attempt
                out.delete_file(f"{at}/{name}")
                out.move(f"{at}/{mine}", f"{at}/{name}")
            rows.append((story, part, f"{root}/{_folder(story)}/{name}", size))

        for b in batches:
            for s, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if file is None or s != story:
                    if file is not None:
                        close()
                    story, size = s, 0
                    out.create_dir(f"{base}/{_folder(s)}")
                    file = out.open_output_stream(f"{base}/{_folder(s)}/{mine}")
                data = ((html or "") + "\n").encode()
                file.write(data)
                size += len(data)
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)
                rows.clear()
        if file is not None:
            close()
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return run


def _segments_by_spark(by: DataFrame, at: str) -> DataFrame:
    """The same by Spark's writer, for a store that only Spark can write; its files
    are found by a listing (no content is read)."""
    by.select("story", F.col("html").alias("value")) \
        .write.mode("overwrite").option("lineSep", "\n").partitionBy("story").text(at)
    listed = by.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", "part-*").load(at).select("path", F.col("length").alias("n_bytes"))
    return listed.select(F.url_decode(F.regexp_extract("path", r"/story=([^/]+)/", 1)).alias("story"),
                         F.regexp_extract("path", r"/part-(\d+)", 1).cast("long").alias("part"), "path", "n_bytes")


def manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """``story, run_seq, part, path, n_bytes, at``: the segments of every
    document in order, with their byte offset in it (header first)."""
    base = f"{out_dir.rstrip('/')}/manifest"
    m = _read_runs(spark, base, _runs(spark, base), SEGMENT)
    # a story has one row per run and task that wrote it
    before = Window.partitionBy("story").orderBy("run_seq", "part").rowsBetween(Window.unboundedPreceding, -1)
    return m.withColumn("at", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)) + F.lit(HEADER_BYTES))


def whole_documents(store: StoryStore, threshold: int = BIG_STORY_BYTES) -> DataFrame:
    """G2 + G3: ``name, html`` of the documents below ``threshold`` bytes (so
    each is a bounded group)."""
    small = stories_of(store).filter(F.col("n_bytes") < threshold).select("story")
    c = store.chunks().join(small, "story", "left_semi")
    return c.groupBy("story").agg(F.concat(F.lit(STORY_HEADER), ordered_concat(["run_seq", "chunk_no"], "html"),
                                           F.lit(STORY_FOOTER)).alias("html")).withColumnRenamed("story", "name")


def big_parts(store: StoryStore, posts: DataFrame, cfg: CurationConfig, threshold: int = BIG_STORY_BYTES) -> DataFrame:
    """G3 + W7: ``name, html`` of the parts of the documents of ``threshold``
    bytes or more, ``blocks_per_part`` posts each.  ``posts``: kept posts with
    ``story``."""
    big = stories_of(store).filter(F.col("n_bytes") >= threshold).select("story")
    blocks = posts.join(big, "story", "left_semi").select("story", "page_no", "pos", "content_html")
    step = cfg.blocks_per_part
    part = F.concat(F.col("story_key"), F.lit("-part-"), (F.col("part_no") * step).cast("string"), F.lit("-to-"),
                    ((F.col("part_no") + 1) * step).cast("string"))
    return story_parts(blocks, cfg, key="story").select(part.alias("name"), "html")


def write_named(docs: DataFrame, out_dir: str, suffix: str = ".html") -> DataFrame:
    """Write each row's ``html`` to ``out_dir/<name>.html`` from the tasks, by
    way of a file of the attempt that is renamed, so a task that runs twice
    leaves one whole file.  Returns the written files (``name, path, n_bytes``)
    as a table of its own."""
    spark = docs.sparkSession
    fs, p = _path(spark, out_dir)
    fs.mkdirs(p)
    root = fs.makeQualified(p).toString()       # tasks see the folder that Spark means
    schema = pa.schema([("name", pa.string()), ("path", pa.string()), ("n_bytes", pa.int64())])

    def run(batches):
        from pyarrow import fs as pafs
        out, base = pafs.FileSystem.from_uri(_arrow_uri(root))
        mine = f".attempt-{TaskContext.get().taskAttemptId()}-"
        for b in batches:
            rows = []
            for name, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                data = (html or "").encode()
                safe = name.replace("/", "_")
                with out.open_output_stream(f"{base}/{mine}{safe}") as f:
                    f.write(data)
                out.move(f"{base}/{mine}{safe}", f"{base}/{safe}{suffix}")
                rows.append((name, f"{root}/{safe}{suffix}", len(data)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(zip(*rows), schema.types, strict=True)],
                                                 schema=schema)

    from ..session import materialize
    return materialize(docs.select("name", "html").mapInArrow(run, "name string, path string, n_bytes long"), "written-files")


def read_story_files(spark: SparkSession, folder: str | None = None, named: list[str] | None = None,
                     glob: str = "*.html") -> DataFrame:
    """S4 + G2: stored story documents (``*.html`` of a folder) plus the
    documents named by the user, as ``(path, html, n_bytes)``."""
    frames = []
    if folder:
        # no partition discovery: beside story_key= folders it would leave out the folder's own files
        frames.append(spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
                      .text(folder, wholetext=True))
    if named:
        frames.append(spark.read.text(named, wholetext=True))
    if not frames:
        return spark.createDataFrame([], "path string, html string, n_bytes long")
    out = None
    for f in frames:
        f = f.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"),
                     F.col("_metadata.file_size").alias("n_bytes"))
        out = f if out is None else out.unionByName(f)
    return out


def documents(spark: SparkSession, folder: str | None = None, named: list[str] | None = None) -> DataFrame:
    """S4 + G2: stored ``*.html`` documents of a folder and documents named by
    the user, ``(name, path, html, n_bytes)``.  A folder without documents is
    an error."""
    stored = read_story_files(spark, folder, named)
    if folder and stored.limit(1).count() == 0:
        raise ValueError(f"no story documents in {folder}")
    return stored.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.html?$", "").alias("name"),
                         "path", "html", "n_bytes")


def split_big(stored: DataFrame, threshold: int = BIG_STORY_BYTES) -> tuple[DataFrame, DataFrame]:
    """G3 + U19: (normal, big) documents by file size (every document is
    tested; none is skipped)."""
    big = F.col("n_bytes") >= threshold
    return stored.filter(~big), stored.filter(big)


def export_parts(big: DataFrame, per_part: int = BLOCKS_PER_PART) -> DataFrame:
    """W7 + A7 on stored documents: top-level ``div`` blocks of the body in
    parts of ``per_part``.  One document is parsed in one task (a stored file
    is one row); the chunk table is the scalable path for new stories."""
    from pyspark.sql.types import ArrayType, StringType

    @F.pandas_udf(ArrayType(StringType()))
    def blocks(html):
        from ..functions import html as H

        def top_divs(doc):
            root = H.parse(doc)
            body = H.select_one(root, "body") or root
            return [n.html() for n in body.elements() if n.tag == "div"]
        return html.map(top_divs)

    b = big.select("path", F.posexplode(blocks("html")).alias("i", "block"))
    return b.groupBy("path", F.floor(F.col("i") / per_part).cast("long").alias("part_no")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "block"))), lambda x: x["block"]), "")
        .alias("html"), F.count(F.lit(1)).alias("n_blocks"))
