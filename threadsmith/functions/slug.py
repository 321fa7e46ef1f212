"""Story file names.

Spark has no Unicode normalisation function, so NFKD/NFKC runs in one
Arrow-batched pandas UDF; every other step is a built-in expression.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import STORY_TAG
from .text import ASCII_WS_CLASS, WS_CLASS, ws_trim


@F.pandas_udf(StringType())
def nfkd_ascii(s: pd.Series) -> pd.Series:
    """NFKD, then drop every non-ASCII char (``encode('ascii','ignore')``)."""
    return s.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKC")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def slugify(c, title: bool = False, allow_unicode: bool = False,
            tag: str = STORY_TAG) -> Column:
    """U10.  ``title=True`` first removes ``[tag]`` (any case), strips and
    turns spaces into dashes."""
    s = _c(c)
    if title:
        s = F.replace(ws_trim(F.regexp_replace(s, rf"(?iu)\[{tag}\]", "")), F.lit(" "), F.lit("-"))
    if allow_unicode:
        s = F.lower(nfkc(s))
        s = F.regexp_replace(s, rf"(?U)[^\w{WS_CLASS[1:-1]}-]", "")
        s = F.regexp_replace(s, rf"(?:-|{WS_CLASS})+", "-")
    else:
        s = F.lower(nfkd_ascii(s))
        s = F.regexp_replace(s, rf"[^A-Za-z0-9_{ASCII_WS_CLASS[1:-1]}-]", "")
        s = F.regexp_replace(s, rf"(?:-|{ASCII_WS_CLASS})+", "-")
    return F.btrim(s, F.lit("-_"))


def story_stem(author, title, version, tag: str = STORY_TAG) -> Column:
    """``author-title-N`` file stem."""
    return F.concat_ws("-", slugify(author), slugify(title, title=True, tag=tag),
                       _c(version).cast("string"))
