"""Sort orders with the marketplace's NULL placement and a total tie-break.

Descending puts NULL first and ascending puts NULL last, the opposite of Spark's
defaults. Listings have no tie-break of their own, so every limit is cut on a
total order: the remaining projected columns, ascending.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def newest(*columns: str) -> list[Column]:
    return [F.desc_nulls_first(c) for c in columns]


def ascending(*columns: str) -> list[Column]:
    return [F.asc_nulls_last(c) for c in columns]


def by_name(column: str = "name", collation: str | None = None) -> list[Column]:
    """Ascending by name, NULL last: by bytes, or as a collation of Spark's has it.

    `UNICODE` puts letters in their alphabet's order, whatever their case and accents. Names
    that a collation holds equal (`UNICODE_CI` holds `a` and `A`) are told apart by bytes, so
    that the order is total.
    """
    if collation is None:
        return ascending(column)
    return [F.asc_nulls_last(F.collate(F.col(column), collation)), *ascending(column)]


def top(df: DataFrame, keys: Iterable[Column], columns: list[str],
        limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows in `keys` order, ties broken by `columns`, cut to one page, projected to `columns`."""
    ordered = df.orderBy(*keys, *ascending(*columns))
    if offset:
        ordered = ordered.offset(offset)
    if limit is not None:
        ordered = ordered.limit(limit)
    return ordered.select(*columns)
