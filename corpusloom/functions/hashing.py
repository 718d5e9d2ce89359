"""Hashes that every engine computes alike, and orders made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_key(*parts: Column | str | int) -> Column:
    """MD5 of the parts joined by ``|``; strings name columns, other values are literals. Nulls count as empty."""
    cast = [F.coalesce((F.col(p) if isinstance(p, str) else p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws("|", *cast))


def h32(*parts: Column | str | int) -> Column:
    """The first 32 bits of ``hex_key`` as a non-negative BIGINT."""
    return F.conv(F.substring(hex_key(*parts), 1, 8), 16, 10).cast("long")


def unit(*parts: Column | str | int) -> Column:
    """A number in [0, 1) that is a pure function of the parts."""
    return h32(*parts) / F.lit(4294967296.0)
