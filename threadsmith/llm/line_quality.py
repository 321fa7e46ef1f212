"""Line-first cleaning, with DataFrame functions only.

Every line is judged by itself (end punctuation, navigation, symbols,
boilerplate); lines that fail are removed; a document is rejected when too
little of its text is left, or when the base rules (words, repetition) fail.

Everything stays inside the row: no shuffle and no join.  A value used more
than once inside an expression is bound by ``_let`` so that it is computed
once.

Defined cases: a null text has no words and no lines, fails the base rule and
is not kept; an empty text likewise; repeated rows give repeated rows; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
SPACES = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"       # what lies between words
# Rules of the lines.
LINE_END = ".!?…:;,\"'”»)]"
NAV_MARKS = "|›»•>"
MAX_NAV_MARKS = 3            # at least so many marks, and one per NAV_CHARS characters
NAV_CHARS = 20
SYMBOL_SHARE = 10            # one symbol per so many characters fails the line
UNENDED_WORDS = 6            # a line without end punctuation needs so many words
# A part of every phrase, in small letters: texts without any are not searched.
BOILER_PARTS = ("cookie", "javascript", "all rights reserved", "privacy policy", "terms of ", "sign in", "log in",
                "click here", "subscribe", "lorem ipsum", "copyright ", "share this", "read more")
BOILERPLATE = (r"(?i)(^|[^a-z])(cookies?|javascript|all rights reserved|privacy policy|terms of (use|service)|"
               r"sign in|log in|click here|subscribe|lorem ipsum|copyright [0-9]{4}|share this|read more)([^a-z]|$)")
KEEP_SHARE = 50              # per cent of the characters in words that must be left


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    """The words of a text (null: none)."""
    return F.array_remove(F.split(text, GAP, -1), "")


def _letters(words: Column) -> Column:
    """Code points of all words."""
    return F.length(F.concat_ws("", words)).cast("long")


def _marks(text: Column, marks: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{marks}]")).cast("long")


def _filled(line: Column) -> Column:
    """Whether a line has a word."""
    return F.trim(line, F.lit(SPACES)) != ""


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows found twice or more.  Windows are compared
    by a 64-bit hash.  Rows without a repeated window stop after the
    duplicate check; the others sort (window, position) pairs, so the cost is
    n log n for any text."""
    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                         lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
        same = lambda s: F.filter(s, lambda e, k: F.coalesce(F.get(s, k - 1)["v"] == e["v"], F.lit(False))
                                  | F.coalesce(F.get(s, k + 1)["v"] == e["v"], F.lit(False)))
        spread = lambda f: F.size(F.array_distinct(F.flatten(F.transform(
            f, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))))
        return _let(pairs, lambda s: spread(same(s)))

    return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def line_fails(line: Column, marked: Column, parts: Column) -> Column:
    """Whether a line (white space trimmed) is to be removed.  ``marked``
    tells whether its text has any symbol or navigation mark, ``parts`` which
    of BOILER_PARTS it has."""
    chars = F.length(line)
    nav = _marks(line, NAV_MARKS)
    return (marked & (((nav >= MAX_NAV_MARKS) & (nav * NAV_CHARS >= chars))
                      | (_marks(line, SYMBOLS) * SYMBOL_SHARE >= chars))) \
        | (F.exists(parts, lambda p: F.contains(F.lower(line), p)) & line.rlike(BOILERPLATE)) \
        | (~F.right(line, F.lit(1)).isin(*LINE_END) & (F.size(_words(line)) < UNENDED_WORDS))


def clean_lines(text: Column) -> Column:
    """The lines of a text that pass, in order."""
    parts = _let(F.lower(text), lambda low: F.filter(F.array(*map(F.lit, BOILER_PARTS)), lambda p: F.contains(low, p)))
    told = F.struct(text.rlike(f"[{SYMBOLS}{NAV_MARKS}]").alias("m"), parts.alias("b"))
    trimmed = F.transform(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(SPACES)))
    return _let(told, lambda f: F.filter(trimmed, lambda x: (x != "") & ~line_fails(x, f["m"], f["b"])))


def clean(docs: DataFrame) -> DataFrame:
    """Kept documents with the failing lines removed from ``text``."""
    q = quality(docs, extra=[c for c in docs.columns if c not in ("doc_id", "text")], text="_clean")
    rest = [F.col("_clean").alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return q.where("kept").select(*rest)


def quality(docs: DataFrame, extra: list[str] | None = None, text: str | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, kept_chars (characters in words of the lines left);
    ``extra`` columns are carried and ``text`` names a column for the cleaned
    text."""
    extra = list(extra or [])
    t = F.coalesce(F.col("text"), F.lit(""))
    cols = [F.col(c) for c in extra]
    d = docs.select("doc_id", *cols, t.alias("_t"))
    lines = F.filter(F.split(F.col("_t"), "\n", -1), _filled)
    d = d.select(
        "doc_id", *cols,
        _marks(F.col("_t"), SYMBOLS).alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        _let(_words(F.col("_t")), lambda w: F.struct(
            F.size(w).cast("long").alias("n"), _letters(w).alias("c"), repeated_words(w).cast("long").alias("r"))).alias("_w"),
        _let(clean_lines(F.col("_t")), lambda x: F.struct(
            _letters(_words(F.concat_ws("\n", x))).alias("c"),
            (F.concat_ws("\n", x) if text else F.lit("")).alias("t"))).alias("_l"))
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    d = d.select("doc_id", *cols, F.col("_w.n").alias("n_words"), F.col("_w.c").alias("word_chars"), "n_symbols", "n_dup_lines",
                 F.col("_w.r").alias("n_repeat_words"), F.col("_l.c").alias("kept_chars"),
                 *([F.col("_l.t").alias(text)] if text else []))
    return d.withColumn("base_failed", base) \
        .withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") * 100 >= F.col("word_chars") * KEEP_SHARE))
