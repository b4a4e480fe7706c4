"""A caller's columns kept out of an operator's way."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Carried:
    """`rows`: the `needed` columns of a table, and all others in one struct.

    Operators add columns by names that the table may have too, in any case; inside the struct
    these clash with nothing.
    """

    def __init__(self, table: DataFrame, *needed: str):
        self.columns = table.columns
        self.needed = [c for c in needed if c in table.columns]
        rest = [c for c in table.columns if c not in self.needed]
        self.name = "__rest" + "_" * max([len(c) for c in rest] or [0])
        held = [F.struct(*[F.col(_quoted(c)) for c in rest]).alias(self.name)] if rest else []
        self.rows = table.select(*self.needed, *held)

    def back(self, rows: DataFrame) -> DataFrame:
        """The table's columns out of what an operator made of `rows`."""
        return rows.select(*[F.col(c) if c in self.needed else F.col(self.name)[c].alias(c)
                             for c in self.columns])
