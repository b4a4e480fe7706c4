"""Which package is a user on, until when, and what it allows.

Two generations of the rule live side by side, chosen by `basis`:

* "subscriptions": the newest live subscription by start.
* "payments": the newest completed payment for a package that is not disabled,
  whether or not it has run out. An expired newest payment hides an older one
  that still runs.

Users are handled all at once: one shuffle by user id, cut to one row per user
and input partition before it (Spark's window group limit).
"""

from datetime import datetime
from typing import Literal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions import predicates as P
from ..functions.clock import moment, plus_days
from ..functions.ordering import ascending, newest

Basis = Literal["subscriptions", "payments"]

ENTITLEMENT = ["user_id", "payment_id", "package_id", "started_at", "expires_at"]


def newest_per_user(df: DataFrame, started: str) -> DataFrame:
    order = [*newest(started), *ascending("id")]
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")


def live_subscriptions(subscriptions: DataFrame, as_of: datetime) -> DataFrame:
    return subscriptions.filter(P.live(moment(as_of, subscriptions, "expires_at")))


def paid_packages(payments: DataFrame, packages: DataFrame) -> DataFrame:
    """Completed payments with the terms of their package, disabled packages left out."""
    terms = packages.filter(P.package_enabled()).select(
        F.col("id").alias("package_id"), F.col("name").alias("package_name"),
        "duration_days", "max_places", "priority_weight",
    )
    days = F.coalesce(F.col("duration_days"), F.lit(V.DURATION_DEFAULT_PAYMENTS))
    return (
        payments.filter(P.equals("status", "completed") & F.col("completed_at").isNotNull())
        .select("id", "user_id", "package_id", F.col("completed_at").alias("started_at"))
        .join(terms, "package_id")
        .withColumn("expires_at", plus_days(F.col("started_at"), days))
        .withColumn("payment_id", F.col("id"))
    )


def latest_entitlement(basis: Basis, source: DataFrame, packages: DataFrame | None,
                       as_of: datetime) -> DataFrame:
    """One row per entitled user: payment, package, start and expiry.

    `source` is the subscriptions or the payments table. The subscriptions rule
    does not look at packages.
    """
    if basis == "payments":
        rows = paid_packages(source.filter(F.col("user_id").isNotNull()), packages)
    else:
        rows = live_subscriptions(source, as_of)
    return newest_per_user(rows.select("id", *ENTITLEMENT), "started_at").select(*ENTITLEMENT)


def active_package(basis: Basis, source: DataFrame, packages: DataFrame,
                   as_of: datetime) -> DataFrame:
    """Entitlement with the terms of its package; users without a package row drop out."""
    if basis == "payments":
        rows = paid_packages(source, packages)
    else:
        terms = packages.select(
            F.col("id").alias("package_id"), F.col("name").alias("package_name"),
            "duration_days", "max_places", "priority_weight",
        )
        rows = live_subscriptions(source, as_of).select(
            "id", "user_id", "package_id", "status", "started_at", "expires_at", "payment_id"
        ).join(terms, "package_id")
    best = newest_per_user(rows.filter(F.col("user_id").isNotNull()), "started_at")
    if basis == "payments":
        return best.withColumn("is_active", P.still_paid(moment(as_of, best, "expires_at")))
    return best.withColumn("is_active", F.lit(True))


def user_package(users: DataFrame, basis: Basis, source: DataFrame, packages: DataFrame,
                 as_of: datetime) -> DataFrame:
    """One row for each user asked for; all NULL and not active when there is no package."""
    fields = ["package_id", "package_name", "duration_days", "started_at", "expires_at"]
    found = active_package(basis, source, packages, as_of).select("user_id", *fields, "is_active")
    return users.select("user_id").join(found, "user_id", "left").select(
        "user_id", *fields, P.truthy("is_active").alias("is_active")
    )


def user_active_subscription(subscriptions: DataFrame, packages: DataFrame,
                             as_of: datetime) -> DataFrame:
    """The live subscription of each user that has one."""
    return active_package("subscriptions", subscriptions, packages, as_of).select(
        "user_id", F.col("id").alias("subscription_id"), "package_id", "package_name",
        "duration_days", "started_at", "expires_at", "is_active", "status",
    )


def place_quota(users: DataFrame, basis: Basis, source: DataFrame, packages: DataFrame,
                as_of: datetime) -> DataFrame:
    """Places each user may list and the name of the tier; free users may list one."""
    on_package = active_package(basis, source, packages, as_of).filter("is_active").select(
        "user_id",
        F.coalesce(F.col("max_places"), F.lit(V.FREE_PLACES)).alias("max_places"),
        F.coalesce(F.col("package_name"), F.lit(V.UNNAMED_TIER)).alias("tier"),
    )
    return users.select("user_id").join(on_package, "user_id", "left").select(
        "user_id",
        F.coalesce(F.col("max_places"), F.lit(V.FREE_PLACES)).alias("max_places"),
        F.coalesce(F.col("tier"), F.lit(V.FREE_TIER)).alias("tier"),
    )


def places_per_user(providers: DataFrame) -> DataFrame:
    """Places of any status per owner, and those that are active."""
    return providers.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(
        F.count("*").alias("places"),
        F.count_if(P.equals("status", "active")).alias("active_places"),
    )


def can_add_provider(users: DataFrame, providers: DataFrame, basis: Basis, source: DataFrame,
                     packages: DataFrame, as_of: datetime) -> DataFrame:
    """Whether each user may list one more place; places of any status count."""
    quota = place_quota(users, basis, source, packages, as_of)
    used = places_per_user(providers).select("user_id", "places")
    return quota.join(used, "user_id", "left").select(
        "user_id",
        (F.coalesce("places", F.lit(0)) < F.col("max_places")).alias("allowed"),
        F.coalesce("places", F.lit(0)).cast("int").alias("current_count"),
        "max_places", "tier",
    )


def known_users(providers: DataFrame, source: DataFrame) -> DataFrame:
    """Distinct users that own a place or appear in the entitlement source."""
    owners = providers.select("user_id").union(source.select("user_id"))
    return owners.filter(F.col("user_id").isNotNull()).distinct()


def user_active_package(providers: DataFrame, basis: Basis, source: DataFrame,
                        packages: DataFrame, as_of: datetime) -> DataFrame:
    """Every known user with their package, if any.

    On the payments basis an expired package stays with `is_active` false; on
    the subscriptions basis it is gone and `is_active` is true or NULL.
    """
    names = packages.select(F.col("id").alias("package_id"), F.col("name").alias("package_name"))
    best = latest_entitlement(basis, source, packages, as_of).join(names, "package_id", "left")
    joined = known_users(providers, source).join(best, "user_id", "left")
    now = moment(as_of, joined, "expires_at")
    if basis == "payments":
        running = P.still_paid(now)
    else:
        # a matched row is live by construction; an unmatched one stays NULL
        running = F.when(F.col("package_id").isNotNull(), F.lit(True))
    return joined.select("user_id", "package_id", "package_name", "started_at", "expires_at",
                         running.alias("is_active"))


def excess_places(requests: DataFrame, providers: DataFrame, packages: DataFrame) -> DataFrame:
    """For each (user, package) asked for: active places beyond what the package allows.

    Only active places count here, unlike the cut made on activation.
    """
    used = places_per_user(providers).select("user_id", "active_places")
    allowed = packages.select(
        F.col("id").alias("package_id"),
        F.coalesce(F.col("max_places"), F.lit(V.FREE_PLACES)).alias("max_places_allowed"),
    )
    pairs = requests.select("user_id", "package_id").distinct()
    joined = pairs.join(allowed, "package_id").join(used, "user_id", "left")
    current = F.coalesce(F.col("active_places"), F.lit(0))
    excess = F.greatest(current - F.col("max_places_allowed"), F.lit(0))
    return joined.select(
        "user_id", "package_id", (excess > 0).alias("has_warning"),
        current.alias("current_places"), "max_places_allowed", excess.alias("excess_places"),
    )
