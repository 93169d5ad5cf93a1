"""Words as the text operators of this package understand them.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return, which is what ``bytes.split`` separates on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the pattern of a word.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """Number of words of a text column; zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_bytes(cell) -> bytes:
    """UTF-8 bytes of an Arrow string cell; empty for null."""
    return cell.as_buffer().to_pybytes() if cell.is_valid else b""
