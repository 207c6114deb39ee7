"""Contents as text: which media types are legible, and cuts that leave whole characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_text(encoding: Column) -> Column:
    """Whether a media type holds legible text; false for a null one."""
    return F.coalesce(encoding.rlike(r"\A(text/|message/|application/(json|xml)\z)|\+(json|xml)\z"), F.lit(False))


def cut(text: Column, most: int) -> Column:
    """The longest beginning of a text that takes so many bytes of UTF-8 at most, and ends with a whole character. Null stays null."""
    raw = text.cast("binary")
    # a character takes four bytes at most: the byte behind the cut begins a character at one of four places
    begins = lambda n: F.lit(n == 0) | (F.hex(F.substring(raw, n + 1, 1)) < "80") | (F.hex(F.substring(raw, n + 1, 1)) >= "C0")
    places = [most - k for k in range(min(3, most) + 1)]
    ends = F.coalesce(*(F.when(begins(n), F.lit(n)) for n in places))
    return F.when(F.octet_length(text) <= most, text).otherwise(F.substring(raw, F.lit(1), ends).cast("string"))
