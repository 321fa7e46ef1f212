"""Text scalars on post content (all JVM-side ``Column`` expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEDUP_PREFIX_CHARS, EXCERPT_CHARS, IDENTIFIER_WINDOW, SHORT_POST_CHARS

# --- fixed values ------------------------------------------------------------
# Characters Python's ``str.strip()`` removes (``str.isspace``), as one regex
# class that both Java and RE2 accept.
WS_CLASS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
# The same characters as a plain string (for ``btrim``).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")
# The ASCII part of it (what ``\s`` means once a string is ASCII only).
ASCII_WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F ]"
# Unicode decimal digit (Python's ``\d`` on str).
DIGIT = r"\p{Nd}"
NON_DIGIT = r"\P{Nd}"
# Typographic apostrophe replaced in rendered stories.
TYPO_APOSTROPHE = "’"
# -----------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ws_trim(c) -> Column:
    """Python ``str.strip()``: strip Unicode whitespace at both ends (a
    native char-set trim, no regex scan over long texts)."""
    return F.btrim(_c(c), F.lit(WS_CHARS))


def text_length(c) -> Column:
    """Length in code points (both Python and Spark count code points)."""
    return F.length(_c(c)).cast("long")


def stripped_len(c) -> Column:
    """Length of the stripped text with newlines removed (short-post test)."""
    return F.length(F.replace(ws_trim(c), F.lit("\n"), F.lit(""))).cast("long")


def is_short(c, min_chars: int = SHORT_POST_CHARS) -> Column:
    """Stripped text without newlines has fewer than ``min_chars``."""
    return stripped_len(F.coalesce(_c(c), F.lit(""))) < F.lit(min_chars)


def identifier_pattern(identifiers) -> str:
    """User identifiers joined as alternatives, case-insensitive (Unicode)."""
    return "(?iu)" + "|".join(identifiers)


def has_identifier(first_paragraph, identifiers, window: int = IDENTIFIER_WINDOW,
                   has_blockquote=None) -> Column:
    """P5: an identifier occurs in the first ``window`` chars of the first
    paragraph, and the post has no quote; no paragraph -> false."""
    p = _c(first_paragraph)
    hit = F.substring(p, 1, window).rlike(identifier_pattern(identifiers))
    res = F.coalesce(hit, F.lit(False))
    if has_blockquote is not None:
        res = res & ~F.coalesce(_c(has_blockquote), F.lit(False))
    return res


def dedup_key(c, prefix: int = DEDUP_PREFIX_CHARS) -> Column:
    """First ``prefix`` chars, lower-cased."""
    return F.lower(F.substring(_c(c), 1, prefix))


def quote_norm(c) -> Column:
    """Typographic apostrophe -> ASCII apostrophe."""
    return F.replace(_c(c), F.lit(TYPO_APOSTROPHE), F.lit("'"))


def _excerpt_one(p: Column, n: int) -> Column:
    return F.replace(ws_trim(F.substring(p, 1, n)), F.lit("\n"), F.lit(""))


def excerpt(paragraphs, n: int = EXCERPT_CHARS) -> Column:
    """Excerpt of the first paragraph; when blank and there is a second
    paragraph, of the second; null when still blank (an image post)."""
    arr = _c(paragraphs)
    first = F.nullif(_excerpt_one(F.get(arr, 0), n), F.lit(""))
    second = F.nullif(_excerpt_one(F.get(arr, 1), n), F.lit(""))
    return F.coalesce(first, second)


def author_root(c) -> Column:
    """Author name with every decimal digit removed."""
    return F.regexp_replace(_c(c), DIGIT, "")


def lines(c) -> Column:
    """Split a plain text into its lines (paragraphs of a text post)."""
    return F.split(_c(c), "\n", -1)
