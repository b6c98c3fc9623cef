"""Keys of videos and topics: Column functions that stay in the JVM, plus one Arrow function for Unicode forms."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Blanks: every Unicode white space (tabs, line ends and no-break spaces included).
BLANK = r"(?U)\s"


def strip_blanks(value: Column) -> Column:
    """Value without the blanks around it."""
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def video_key(value: Column) -> Column:
    """The 11-character id that value consists of (blanks around it aside) or that the address in it points to.

    An address gives its v= parameter, or without one the last part of its path. NULL for anything else.
    """
    bare = strip_blanks(value)
    plain = F.regexp_extract(bare, r"^([A-Za-z0-9_-]{11})$", 1)
    is_address = bare.rlike(r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//|^[a-z0-9-]+(?:\.[a-z0-9-]+)+/")
    parameter = F.regexp_extract(bare, r"[?&]v=([A-Za-z0-9_-]{11})(?=[&#]|$)", 1)
    last_part = F.regexp_extract(bare, r"^[^?#]*/([A-Za-z0-9_-]{11})/?(?:[?#].*)?$", 1)
    has_parameter = bare.rlike(r"[?&]v=")
    found = (
        F.when(plain != "", plain)
        .when(is_address & has_parameter & (parameter != ""), parameter)
        .when(is_address & ~has_parameter & (last_part != ""), last_part)
    )
    return found


def is_blank(value: Column) -> Column:
    """True for NULL, the empty text and texts of blanks only."""
    return value.isNull() | value.rlike(r"(?U)^\s*$")


def fold_topic(name: str) -> str:
    """A topic's key: without letter case, Unicode form, blanks, dots, underscores and hyphens."""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKD", name).casefold())
    return "".join(c for c in folded if not (c.isspace() or c in "._-‐‑­"))


@F.pandas_udf(T.StringType())
def topic_key_udf(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """fold_topic over Arrow batches; meant for distinct values."""
    for batch in values:
        yield batch.map(fold_topic, na_action="ignore")
