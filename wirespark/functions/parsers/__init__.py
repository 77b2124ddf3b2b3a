"""Parsers of bytes: plain functions that never raise on bad input (they give None), and columns made of them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def field_names(ddl: str) -> list[str]:
    """Names of the fields of a struct: what stands first between commas that no bracket holds."""
    depth, parts, at = 0, [], 0
    for i, c in enumerate(ddl + ","):
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            parts.append(ddl[at:i].split()[0].strip("`"))
            at = i + 1
    return parts


def array_of(ddl: str) -> str:
    return f"array<struct<{ddl}>>"


def column(parse, kind: str, struct: bool | None = None):
    """A parser of one value as a column function, by Arrow batches. kind: DDL of a type, or of the fields of a struct."""
    struct = " " in kind.split("<")[0].strip() if struct is None else struct

    def values(x: pd.Series) -> list:
        return [None if v is None else parse(bytes(v) if isinstance(v, (bytes, bytearray, memoryview)) else v) for v in x]

    def udf():
        """The function for spark.udf.register."""
        if struct:
            names = field_names(kind)

            @F.pandas_udf(kind)
            def run(x: pd.Series) -> pd.DataFrame:
                rows = [v or {} for v in values(x)]
                return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

        else:

            @F.pandas_udf(kind)
            def run(x: pd.Series) -> pd.Series:
                return pd.Series(values(x), dtype=object)

        return run

    def of(value: Column | str) -> Column:
        return udf()(value)

    of.udf = udf
    return of
