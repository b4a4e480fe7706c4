"""Who may see and change which rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P


def is_admin(profiles: DataFrame, principal) -> Column:
    """Whether one principal has an admin role, as a scalar of the plan."""
    found = profiles.filter(P.equals("id", principal)).agg(F.coalesce(
        F.bool_or(P.is_admin()), F.lit(False)))
    return found.scalar()


def visible_rows(table: str, df: DataFrame, profiles: DataFrame, principal) -> DataFrame:
    """Rows of a protected table that `principal` (None: not signed in) may read.

    Policies of one table are OR-ed: subscriptions are seen by their user and by
    admins, packages by all when active and by admins, payment settings by admins,
    profiles by their owner.
    """
    admin = is_admin(profiles, principal) if principal is not None else F.lit(False)
    nobody = F.lit(False)
    rules = {
        "subscriptions": (P.equals("user_id", principal) if principal is not None else nobody) | admin,
        "packages": P.truthy("is_active") | admin,
        "payment_settings": admin,
        "user_profiles": P.equals("id", principal) if principal is not None else nobody,
    }
    return df.filter(rules[table])


def writable_rows(action: str, subscriptions: DataFrame, profiles: DataFrame, principal) -> DataFrame:
    """Subscriptions that `principal` may insert, update or delete: users insert their
    own, admins update and delete."""
    if action == "insert":
        own = P.equals("user_id", principal) if principal is not None else F.lit(False)
        return subscriptions.filter(own)
    admin = is_admin(profiles, principal) if principal is not None else F.lit(False)
    return subscriptions.filter(admin)


def own_rows(df: DataFrame, principals: DataFrame) -> DataFrame:
    """Rows each principal sees by owning them. Admins see every row, so they are
    not listed row by row here; `visible_counts` tells how many each principal sees."""
    return df.join(principals.select(F.col("id").alias("user_id")), "user_id", "left_semi")


def visible_counts(subscriptions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Number of subscriptions each profile may read: all for admins, else their own."""
    total = subscriptions.agg(F.count("*")).scalar()
    own = subscriptions.groupBy("user_id").agg(F.count("*").alias("own"))
    return profiles.select(F.col("id").alias("user_id"), "role").join(own, "user_id", "left").select(
        "user_id", "role",
        F.when(P.is_admin(), total).otherwise(F.coalesce("own", F.lit(0))).alias("visible_rows"),
    )


def with_actor(requests: DataFrame, profiles: DataFrame, rule: Column) -> DataFrame:
    """Add `_allowed`: whether the actor's role passes `rule`. Unknown actors do not.

    Only the ids of profiles that pass are joined, straight from the table, so one
    actor behind most requests can still be split over tasks.
    """
    passing = profiles.filter(rule).select(
        F.col("id").alias("actor_id"), F.lit(True).alias("_allowed"))
    return requests.join(passing, "actor_id", "left").withColumn(
        "_allowed", P.truthy("_allowed"))
