"""The tables' constraints as checks that report what breaks them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V


def bad_subscription_status() -> Column:
    return F.col("status").isNull() | ~F.col("status").isin(*V.SUBSCRIPTION_STATUSES)


def bad_payment_status(old: bool = False) -> Column:
    """A missing status is allowed; the older rule does not know 'processing'."""
    return ~F.col("status").isin(*(V.PAYMENT_STATUSES_OLD if old else V.PAYMENT_STATUSES))


def _long(line: DataFrame, name: str, value: str) -> DataFrame:
    """A one-row frame of counts as (name, value) rows."""
    pairs = ", ".join(f"'{c}', {c}" for c in line.columns)
    return line.selectExpr(f"stack({len(line.columns)}, {pairs}) as ({name}, {value})")


def status_violations(subscriptions: DataFrame, payments: DataFrame) -> DataFrame:
    """Number of rows that break each status rule, zero included: one pass per table."""
    own = subscriptions.agg(F.count_if(bad_subscription_status()).alias("subscription_status"))
    paid = payments.agg(F.count_if(bad_payment_status()).alias("payment_status"),
                        F.count_if(bad_payment_status(old=True)).alias("payment_status_old"))
    return _long(own, "check_name", "violations").unionByName(
        _long(paid, "check_name", "violations"))


def status_distribution(subscriptions: DataFrame) -> DataFrame:
    """Rows per status and whether the status is allowed."""
    return subscriptions.groupBy("status").agg(F.count("*").alias("n")).select(
        "status", "n",
        F.coalesce(F.col("status").isin(*V.SUBSCRIPTION_STATUSES), F.lit(False)).alias("allowed"))


def duplicate_subscriptions(subscriptions: DataFrame) -> DataFrame:
    """Groups with more than one row for a (user, package, status); NULLs are equal."""
    return subscriptions.groupBy("user_id", "package_id", "status").agg(
        F.count("*").alias("n")).filter("n > 1")


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose reference points nowhere; a NULL reference is fine."""
    known = parent.select(F.col(key).alias(column)).distinct()
    return child.filter(F.col(column).isNotNull()).join(known, column, "left_anti")


def foreign_keys(subscriptions: DataFrame, packages: DataFrame, payments: DataFrame,
                 profiles: DataFrame) -> DataFrame:
    """Orphaned references of the subscriptions table: rows and distinct missing values.

    References are counted per value before the parent is joined, so a value held
    by many rows is one row of the join.
    """
    lines = []
    for column, parent in (("package_id", packages), ("payment_id", payments),
                           ("user_id", profiles)):
        values = subscriptions.groupBy(column).agg(F.count("*").alias("n"))
        missing = orphans(values, column, parent)
        lines.append(missing.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"),
            F.count("*").alias("orphan_values"),
        ).select(F.lit(column).alias("reference"), "orphan_rows", "orphan_values"))
    return lines[0].unionByName(lines[1]).unionByName(lines[2])


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs per column that must not have any, in one pass."""
    line = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return _long(line, "column_name", "nulls")


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Fill NULLs the way column defaults fill missing input."""
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})
