"""URL scalars: domain, page links, topic key, archive links, asset names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ARCHIVE_HOST, PAGE_DIGIT_RUN
from .text import DIGIT, NON_DIGIT

# --- fixed values ------------------------------------------------------------
# RFC 3986 appendix B split: scheme, authority, path, query, fragment.
URI_PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
WATCH_PATH = "/watch?v="
# -----------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def domain(url) -> Column:
    """Third ``/`` segment with every ``www`` + any char removed."""
    return F.regexp_replace(F.get(F.split(_c(url), "/", -1), 2), "www.", "")


def _run_pattern(n: int) -> str:
    # group 1: text before the n-th digit run; group 2: text after it
    # possessive runs: a digit run is never split in two by backtracking
    return rf"(?s)^((?:{NON_DIGIT}*{DIGIT}++){{{n - 1}}}{NON_DIGIT}*){DIGIT}++(.*)$"


def page_link(link, page_no, n: int = PAGE_DIGIT_RUN) -> Column:
    """The link with its n-th digit run replaced by ``page_no``.
    Links with fewer than n digit runs give null (quarantined by callers)."""
    pat = _run_pattern(n)
    l = _c(link)
    ok = l.rlike(pat)
    return F.when(ok, F.concat(F.regexp_extract(l, pat, 1), _c(page_no).cast("string"),
                               F.regexp_extract(l, pat, 2)))


def topic_key(link, n: int = PAGE_DIGIT_RUN) -> Column:
    """U4: the link up to its n-th digit run, lower-cased (the state key).
    Null when the link has fewer than n digit runs."""
    pat = _run_pattern(n)
    l = _c(link)
    return F.when(l.rlike(pat), F.lower(F.regexp_extract(l, pat, 1)))


def archive_page_link(link, page_no) -> Column:
    """Page 1 keeps the link; page n replaces the last ``/`` segment by
    ``/n/``."""
    l = _c(link)
    n = _c(page_no)
    return F.when(n == 1, l).otherwise(
        F.concat(F.regexp_replace(l, r"/[^/]*\z", ""), F.lit("/"), n.cast("string"), F.lit("/")))


def topic_page_link(link, page_no, dom, n: int = PAGE_DIGIT_RUN) -> Column:
    """Page link for any supported site (archive links use U3)."""
    return F.when(_c(dom) == ARCHIVE_HOST, archive_page_link(link, page_no)).otherwise(
        page_link(link, page_no, n))


def is_archive(link) -> Column:
    """U5."""
    return F.contains(_c(link), F.lit(ARCHIVE_HOST))


def strip_archive(link) -> Column:
    """Drop the archive prefix (keep ``/`` segments from index 5 on)."""
    a = F.split(_c(link), "/", -1)
    return F.array_join(F.slice(a, 6, F.size(a)), "/")


def clean_asset_url(src) -> Column:
    """Archive image links are stripped, others kept."""
    s = _c(src)
    return F.when(is_archive(s), strip_archive(s)).otherwise(s)


def asset_name(link) -> Column:
    """U8: text after the last ``/``; a link without ``/`` gives ''."""
    l = _c(link)
    return F.when(F.instr(l, "/") > 0, F.substring_index(l, "/", -1)).otherwise(F.lit(""))


def asset_local_path(folder: str, name) -> Column:
    """Image source rewritten to the local asset folder."""
    return F.concat(F.lit(folder.rstrip("/") + "/"), _c(name))


def video_watch_url(embed) -> Column:
    """Video embed link -> watch link: the id is the last path segment,
    the query is dropped and a fragment kept."""
    e = _c(embed)
    scheme = F.regexp_extract(e, URI_PARTS, 1)
    auth = F.regexp_extract(e, URI_PARTS, 2)
    path = F.regexp_extract(e, URI_PARTS, 3)
    frag = F.regexp_extract(e, URI_PARTS, 5)
    vid = F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", -1)).otherwise(F.lit(""))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")),
        F.when(auth != "", F.concat(F.lit("//"), auth)).otherwise(F.lit("")),
        F.lit(WATCH_PATH), vid,
        F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(F.lit("")),
    )
