"""Small helpers shared by the column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, at either end of a string.
_OUTER_WS = r"(?U)\A\s+|\s+\z"


def col(x: Column | str) -> Column:
    """A column from a name or a column."""
    return F.col(x) if isinstance(x, str) else x


def trim_ws(x: Column | str) -> Column:
    """Trim any Unicode white space; Spark's ``trim`` removes U+0020 only."""
    return F.regexp_replace(col(x), _OUTER_WS, "")


def utf16_length(x: Column | str) -> Column:
    """Length in UTF-16 code units; Spark's ``length`` counts code points."""
    return (F.octet_length(F.encode(col(x), "UTF-16BE")) / 2).cast("bigint")
