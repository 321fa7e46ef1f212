"""The keyed state of a page stream (T1-T3): one record per topic.

``transformWithState`` keeps for each topic, in the state store, the header read
from its first page, the pages it has as intervals, the pages that were not full
when they were read, and the pages that wait with their parsed posts.  A page
is released, once, when the topic's header is known and (where the state orders
pages) every page before it has come; a page that was not full is released again
when it comes with more posts, from the first new one on.  A timer reports pages
that have waited for longer than a limit.

The record's logic sees numbers and a text per page (its posts as JSON), never
the posts themselves; those are read from the text by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..config import ARCHIVE_HOST, CurationConfig
from ..functions.urls import domain as domain_of
from ..functions.urls import topic_key as topic_key_of
from ..operators import extract as X
from ..operators import ledger as L
from ..session import materialize

_HEADER = "domain string, link string, topic_key string, topic_author string, total_pages int, title string"
RECORD = _HEADER + ", pages string, open string, read_to int"
WAITING = "last_pos int, payload string"
# read: a page to read; wait: one that waits now; late: one that has waited too
# long; broken: what the parse could not use; topic: the record after the batch
RELEASED = "kind string, topic_id string, page_no int, after int, reason string, " + RECORD + ", payload string"
_POST = StructType([StructField("pos", IntegerType()),
                    *[f for f in X.WAITING_SCHEMA.fields if f.name not in ("topic_id", "page_no", "pos", "domain")],
                    StructField("reason", StringType())])


class Pages:
    """A set of page numbers as sorted intervals, written ``1-5,7-7``."""

    def __init__(self, text: str = ""):
        self.parts = [[int(x) for x in p.split("-")] for p in text.split(",")] if text else []

    def __contains__(self, n: int) -> bool:
        return any(lo <= n <= hi for lo, hi in self.parts)

    def add(self, n: int) -> None:
        if n in self:
            return
        self.parts.append([n, n])
        self.parts.sort()
        out: list[list[int]] = []
        for lo, hi in self.parts:
            if out and lo <= out[-1][1] + 1:
                out[-1][1] = max(out[-1][1], hi)
            else:
                out.append([lo, hi])
        self.parts = out

    def end_of(self, n: int) -> int:
        """End of the interval that holds ``n`` (``n - 1``: none does)."""
        return next((hi for lo, hi in self.parts if lo <= n <= hi), n - 1)

    def __str__(self) -> str:
        return ",".join(f"{lo}-{hi}" for lo, hi in self.parts)


class Record:
    """One topic: what is known of it and what a batch's pages change."""

    def __init__(self, stored: dict | None, per_page: int, ordered_host: bool = True):
        s = stored or {}
        self.head = {k: s.get(k) for k in ("domain", "link", "topic_key", "topic_author", "total_pages", "title")}
        self.pages = Pages(s.get("pages") or "")
        self.open = {int(p): int(v) for p, v in (x.split(":") for x in (s.get("open") or "").split(",") if x)}
        self.read_to = s.get("read_to") or 0
        self.per_page, self.use_state, self.known = per_page, ordered_host, stored is not None

    @property
    def ready(self) -> bool:
        return self.head["topic_author"] is not None

    @property
    def ordered(self) -> bool:
        return self.use_state and self.head["domain"] != ARCHIVE_HOST

    def take_header(self, page: dict) -> None:
        for k in self.head:
            if page["topic_author"] is not None or self.head[k] is None and k in ("domain", "topic_key", "link"):
                self.head[k] = page[k]

    def may_read(self, n: int) -> bool:
        return self.ready and (not self.ordered or n <= self.read_to + 1)

    def read(self, n: int, last_pos: int) -> int | None:
        """Mark page ``n`` as read; the position after which it is new (None:
        nothing of it is)."""
        old = self.open.get(n)
        if n in self.pages and old is None:
            return None
        if old is not None and last_pos <= old:
            return None
        self.pages.add(n)
        if last_pos < self.per_page - 1:
            self.open[n] = last_pos
        else:
            self.open.pop(n, None)
        self.read_to = self.pages.end_of(1)
        return -1 if old is None else old

    def stored(self) -> dict:
        return {**self.head, "pages": str(self.pages), "open": ",".join(f"{p}:{v}" for p, v in sorted(self.open.items())),
                "read_to": self.read_to}


class TopicState(StatefulProcessor):
    def __init__(self, per_page: int, use_state: bool, wait_limit_s: int | None):
        self.per_page, self.use_state, self.wait_limit_s = per_page, use_state, wait_limit_s

    def init(self, handle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", RECORD)
        self.waiting = handle.getMapState("waiting", "page_no int", WAITING)

    # every call of a state variable is a message to the JVM, so a topic reads its
    # record and the numbers of its waiting pages once, and writes its record once
    def _load(self) -> Record:
        got = self.record.get()
        stored = None if got is None else dict(zip([f.split()[0] for f in RECORD.split(", ")], got, strict=True))
        return Record(stored, self.per_page, self.use_state)

    def _waits(self) -> set[int]:
        return {k[0] for k in self.waiting.keys()}

    @staticmethod
    def _row(kind: str, topic: str, page_no: int | None = None, after: int | None = None, reason: str | None = None,
             record: dict | None = None, payload: str | None = None) -> Row:
        r = record or {}
        return Row(kind=kind, topic_id=topic, page_no=page_no, after=after, reason=reason,
                   **{f.split()[0]: r.get(f.split()[0]) for f in RECORD.split(", ")}, payload=payload)

    def _read(self, topic: str, rec: Record, page_no: int, after: int, payload: str) -> Row:
        return self._row("read", topic, page_no, after, record={"domain": rec.head["domain"]}, payload=payload)

    def handleInputRows(self, key, rows, timerValues):
        topic, rec, new, found = key[0], self._load(), set(), False
        # the record of a topic that is new says so: nothing of it can wait
        waits = self._waits() if rec.known else set()
        for row in rows:
            page = row.asDict()
            if page["reason"] is not None:
                yield self._row("broken", topic, page["page_no"], reason=page["reason"])
            if page["kind"] != "page":
                continue
            found = True
            if page["page_no"] == 1 and page["reason"] is not None and not rec.ready:
                continue        # a first page without a usable header can't be read
            rec.take_header(page)
            n = page["page_no"]
            if rec.may_read(n):
                after = rec.read(n, page["last_pos"])
                if after is not None:
                    yield self._read(topic, rec, n, after, page["payload"])
            elif n not in rec.pages:
                self.waiting.updateValue((n,), (page["last_pos"], page["payload"]))
                new.add(n)
                waits.add(n)
        if not found:
            return
        if rec.ready:
            for n in sorted(waits):
                if not rec.may_read(n):
                    break
                last_pos, payload = self.waiting.getValue((n,))
                after = rec.read(n, last_pos)
                self.waiting.removeKey((n,))
                waits.discard(n)
                if after is not None:
                    yield self._read(topic, rec, n, after, payload)
        still = sorted(new & waits)
        for n in still:
            yield self._row("wait", topic, n, reason="page_gap" if rec.ready else "header_page_missing")
        if still and self.wait_limit_s is not None and not list(self.handle.listTimers()):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.wait_limit_s)
        kept = rec.stored()
        self.record.update(tuple(kept[f.split()[0]] for f in RECORD.split(", ")))
        held = Pages(kept["pages"])
        for n in waits:
            held.add(n)
        # the pages that wait are there, too: nobody needs to fetch them
        yield self._row("topic", topic, record=kept | {"pages": str(held)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        rec = self._load()
        late = sorted(self._waits())
        for n in late:
            yield self._row("late", key[0], n, reason="page_gap_late" if rec.ready else "header_page_late")
        if late:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.wait_limit_s)

    def close(self) -> None:
        pass


def released(stream: DataFrame, cfg: CurationConfig, profile_rows=None, wait_limit_s: int | None = None) -> DataFrame:
    """Landed pages (``topic_id, link, page_no, html[, domain, status]``) ->
    RELEASED rows of each batch."""
    p = stream
    if "domain" not in p.columns:
        p = p.withColumn("domain", domain_of("link"))
    p = p.withColumn("topic_key", topic_key_of("link", cfg.page_digit_run))
    if "status" in p.columns:      # a failed fetch must not hide the page that comes later
        p = p.filter(X.page_outcome("domain", "status").isin(*X.PARSED))
    r = X.page_records(p, profile_rows)
    head = F.col("reason").isNull()
    rows = r.select(
        "topic_id", "kind", "page_no", "reason", (F.col("n_posts") - 1).cast("int").alias("last_pos"), "domain", "link",
        "topic_key", *[F.when(head, F.col(c)).alias(c) for c in ("topic_author", "total_pages", "title")],
        F.to_json("posts").alias("payload"))
    return rows.groupBy("topic_id").transformWithState(
        TopicState(cfg.posts_per_page, cfg.use_state, wait_limit_s), RELEASED, "append",
        "none" if wait_limit_s is None else "processingTime")


def _intervals(text: str):
    """``1-5,7-7`` -> the interval array of a ledger row."""
    parts = F.filter(F.split(text, ","), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.split_part(x, F.lit("-"), F.lit(1)).cast("int").alias("lo"),
                                                 F.split_part(x, F.lit("-"), F.lit(2)).cast("int").alias("hi")))


def reading(got: DataFrame, state: DataFrame, cfg: CurationConfig):
    """What a batch reads, for ``curate.finish``.  The payloads are read once, into
    the columns of posts, and every table of the batch follows from those and from
    the topics, each written once."""
    from ..plans.curate import Reading
    from ..plans.outputs import together
    every = got.filter("kind = 'read'").select(
        "topic_id", "page_no", "after", "domain", F.explode(F.from_json("payload", ArrayType(_POST))).alias("p")) \
        .select("topic_id", "page_no", "after", "domain", "p.*")
    t = got.filter("kind = 'topic'").select(
        "topic_id", *[F.col(c) for c in ("topic_key", *L.HEADER)], "read_to", F.col("pages").alias("_pages"))
    st = state.select("topic_key", F.col("total_pages").alias("sp"), F.col("post_cursor").alias("sc"),
                      F.col("file_path").alias("st_path"))
    known = t.join(st, "topic_key", "left").select(
        "topic_id", "topic_key", *L.HEADER, "read_to", "sp", "sc", "st_path",
        (F.lit(cfg.use_state) & (F.col("domain") != ARCHIVE_HOST) & F.col("topic_key").isNotNull()).alias("ordered"),
        F.col("topic_author").isNotNull().alias("has_header"), F.col("link").alias("_any_link"),
        F.lit(1).alias("start_page"), _intervals("_pages").alias("pages"))
    every, known = together([lambda: materialize(every, "posts", codec="zstd"), lambda: materialize(known, "topics")])
    broken = got.filter("kind in ('broken', 'late')").select("topic_id", "page_no", F.lit(None).cast("int").alias("pos"), "reason")
    broken = broken.unionByName(every.filter("reason is not null").select("topic_id", "page_no", "pos", "reason"))
    topics = known.filter("has_header").select("topic_id", "topic_key", *L.HEADER)
    # a page says itself after which post it is new: it may come twice in a batch, the second time with more
    posts = every.filter("reason is null and pos > after").withColumn("src", F.lit(0).cast(LongType()))
    pages = got.filter("kind = 'wait'").select(
        "topic_id", "page_no", F.when(F.col("reason") == "page_gap", "gap").otherwise("headless").alias("fate"))
    return Reading(topics, posts.select(*X.POST_COLS), None, known, pages, broken, None, None)
