"""Token ids in flat binary files.

The documents are range-partitioned and sorted by id; each partition is one
pair of files: ``part-N.bin`` (ids as unsigned integers, 16 bits when the
vocabulary fits) and ``part-N.idx`` (64-bit offsets of the documents, one
more than documents, then the 64-bit document ids).  A small manifest (one
row per file pair) gives each part its base by a prefix sum, so a document's
place among all ids is base + offset.  Readers map the files into memory.

A task writes its files under a name of its attempt and renames them, so a
task that runs twice (lost executor, speculation) leaves one whole pair.

The tokenizer sees every distinct pre-token of a worker once: the normaliser
and the pre-tokenizer never join anything across a blank or a line feed, so
the ids of a text are those of its blank-separated chunks in order, and those
of a chunk are its pre-tokens' (cut by the tokenizer file's own pattern).
Each pre-token ends with a token that ends a word, so many are encoded as one
text and told apart by these.

Defined cases: null or empty text has the end id alone; null ids come first
and stay null; rows with one id are written one after another; an empty table
gives an empty manifest; further columns are not read.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import per_worker, rows_to_batch, shuffle_partitions, text_blocks

BLOCK_CHARS = 4_000_000      # characters tokenized at once
CACHE_CHUNKS = 300_000       # chunks, and pre-tokens, a worker remembers (then it starts anew)
JOINED = 512                 # unseen pre-tokens that are encoded as one text

MANIFEST = "part int, path string, n_docs long, n_null long, n_tokens long, width int"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


class ChunkEncoder:
    """Ids (little-endian bytes) of texts by a remembered table of chunks."""

    def __init__(self, tokenizer_json: str, width: int):
        import regex
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.no_truncation()
        self.dtype = np.dtype("<u2" if width == 2 else "<u4")
        spec = json.loads(tokenizer_json)
        split = [p["pattern"]["Regex"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
                 if p["type"] == "Split" and "Regex" in p["pattern"]]
        suffix = spec["model"].get("end_of_word_suffix")
        self.cut = regex.compile(split[0]) if split and suffix else None
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        if suffix:
            self.ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.special = sorted({t["content"][:2] for t in spec.get("added_tokens", [])})
        self.seen: dict[str, bytes] = {"": b""}
        self.pre: dict[str, bytes] = {}

    def _special(self, text: str) -> bool:
        for x in self.special:
            if x in text:
                return True
        return False

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _learn(self, chunks: set[str]) -> None:
        cut, words, new = {}, {}, set()
        for c in chunks:
            if self.cut is None or not (c.isascii() or _latin(c)) or self._special(c):
                self.seen[c] = self._whole(c)
            elif c.isalpha():  # letters only: one pre-token
                words[c] = c.lower()
            else:
                cut[c] = ps = self.cut.findall(c.lower())
                new.update(ps)
        new.update(words.values())
        new.difference_update(self.pre)
        todo = list(new)
        groups = [todo[i:i + JOINED] for i in range(0, len(todo), JOINED)]
        for part, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups],
                                                              add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.dtype)
            at = np.flatnonzero(self.ends[ids]) + 1
            if len(at) == len(part) and (not len(at) or at[-1] == len(ids)):
                data, size, i = ids.tobytes(), self.dtype.itemsize, 0
                for p, j in zip(part, (at * size).tolist(), strict=True):
                    self.pre[p] = data[i:j]
                    i = j
            else:
                self.pre.update((p, self._whole(p)) for p in part)
        get = self.pre.__getitem__
        self.seen.update(zip(words, map(get, words.values()), strict=True))
        for c, ps in cut.items():
            self.seen[c] = b"".join(map(get, ps))

    def _chunks(self, text: str) -> list[str]:
        if _latin(text) and not self._special(text):
            text = text.lower()  # the normaliser does the same to these characters
        return text.replace("\n", " ").split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.seen) > CACHE_CHUNKS:
            self.seen = {"": b""}
        if len(self.pre) > CACHE_CHUNKS:
            self.pre = {}
        split = [self._chunks(t) if t else [] for t in texts]
        unseen: set[str] = set()
        for c in split:
            unseen.update(c)
        unseen.difference_update(self.seen)
        if unseen:
            self._learn(unseen)
        get = self.seen.__getitem__
        return [b"".join(map(get, c)) for c in split]


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _open_fs(path: str):
    from pyarrow import fs
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if not path.startswith("file:/") or path.startswith("file://")
                                  else "file://" + path[5:])


def _writer(bc, out_dir: str, end_id: int, width: int):
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_null", pa.int64()),
                        ("n_tokens", pa.int64()), ("width", pa.int32())])

    def run(batches):
        enc = per_worker(bc, lambda js: ChunkEncoder(js, width))
        fs, base = _open_fs(out_dir)
        ctx = TaskContext.get()
        part = ctx.partitionId()
        name = f"{base}/part-{part:06d}"
        mine = f"{base}/.attempt-{part:06d}-{ctx.taskAttemptId()}"
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        offsets, ids, n_null, at = [0], [], 0, 0
        out = None
        for doc_ids, texts in text_blocks(batches, BLOCK_CHARS):
            if out is None:
                out = fs.open_output_stream(mine + ".bin")
            for data in enc.encode(texts):
                out.write(data)
                out.write(end)
                at += len(data) // width + 1
                offsets.append(at)
            n_null += sum(i is None for i in doc_ids)
            ids.extend(0 if i is None else i for i in doc_ids)
        if out is None:
            return
        out.close()
        with fs.open_output_stream(mine + ".idx") as x:
            x.write(np.array(offsets, dtype="<i8").tobytes())
            x.write(np.array(ids, dtype="<i8").tobytes())
        for kind in (".bin", ".idx"):
            fs.move(mine + kind, name + kind)
        yield rows_to_batch({"part": [part], "path": [f"{out_dir}/part-{part:06d}"], "n_docs": [len(ids)],
                             "n_null": [n_null], "n_tokens": [at], "width": [width]}, schema)

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, out_dir: str | None = None, end_id: int = 1,
                      parts: int | None = None) -> DataFrame:
    """Write the files in ascending ``doc_id`` order and return the manifest:
    part, path, n_docs, n_null, n_tokens, width, base.  ``out_dir`` is by
    default a new folder under the shared checkpoint folder."""
    spark = docs.sparkSession
    out_dir = out_dir or scratch_path(spark, "tokens")
    with open(tokenizer_path, encoding="utf-8") as f:
        js = f.read()
    from tokenizers import Tokenizer
    width = 2 if Tokenizer.from_str(js).get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(out_dir)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    bc = spark.sparkContext.broadcast({"value": js})
    parts = parts or shuffle_partitions(spark)
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, F.asc_nulls_first("doc_id")) \
        .sortWithinPartitions(F.asc_nulls_first("doc_id"))
    manifest = materialize(ordered.mapInArrow(_writer(bc, out_dir, end_id, width), MANIFEST), "token-manifest")
    # one row per file pair: the prefix sum is over as many rows as files
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _mapped(path: str) -> np.ndarray:
    """Bytes of a file: memory-mapped when it is local, else read."""
    fs, p = _open_fs(path)
    if fs.type_name == "local":
        return np.memmap(p, dtype=np.uint8, mode="r") if os.path.getsize(p) else np.zeros(0, np.uint8)
    with fs.open_input_file(p) as f:
        return np.frombuffer(f.read(), dtype=np.uint8)


def _reader(rows_per_batch: int = 4096):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                n, dtype = r["n_docs"], "<u2" if r["width"] == 2 else "<u4"
                idx = _mapped(r["path"] + ".idx").view("<i8")
                ids = _mapped(r["path"] + ".bin").view(dtype)
                offsets, doc_ids = idx[:n + 1], idx[n + 1:]
                for i in range(0, n, rows_per_batch):
                    j = min(n, i + rows_per_batch)
                    yield rows_to_batch({
                        "doc_id": [None if k < r["n_null"] else int(doc_ids[k]) for k in range(i, j)],
                        "start": offsets[i:j] + r["base"], "n_tokens": np.diff(offsets[i:j + 1]),
                        "ids_crc32": [zlib.crc32(ids[offsets[k]:offsets[k + 1]].astype("<u4").tobytes())
                                      for k in range(i, j)]}, schema)

    return run


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    spark = manifest.sparkSession
    return manifest.repartitionByRange(shuffle_partitions(spark), "part").mapInArrow(_reader(), READ)
