"""Columnar tables: nested records as columns, and rows by list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def flattened(df: DataFrame, separator: str = "_") -> DataFrame:
    """Every field of every nested struct as a column of its own, named by its path; only the fields that are used are read."""

    def fields(schema: StructType, path: list[str]) -> list[Column]:
        out: list[Column] = []
        for f in schema:
            here = [*path, f.name]
            if isinstance(f.dataType, StructType):
                out += fields(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{x}`" for x in here)).alias(separator.join(here)))
        return out

    return df.select(*fields(df.schema, []))


def taken(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key is in a list."""
    return df.join(rows.select(key), key, "left_semi")
