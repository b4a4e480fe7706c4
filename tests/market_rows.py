"""The clock and row helpers that the tests of the marketplace share."""

from datetime import datetime

NOW = datetime(2024, 6, 15, 12)


def dicts(df, *columns):
    chosen = df.select(*columns) if columns else df
    return [r.asDict() for r in chosen.collect()]


def by(df, key, *columns):
    return {r[key]: r.asDict() for r in (df.select(key, *columns) if columns else df).collect()}
