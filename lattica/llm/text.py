"""Text expressions that several operators share (DataFrame functions only)."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of all contracts: space and the controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def whole(col: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def one_spaced(text: Column) -> Column:
    """Each run of white space becomes one space."""
    return F.regexp_replace(text, SPACE + "+", " ")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are.

    ``lower`` does the same for texts of ASCII alone and is much faster there.
    """
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )
