"""Admin reports and lookups."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Cut, as_is
from ..functions import fixed_values as V
from ..functions import predicates as P
from ..functions.clock import plus_days
from ..functions.ordering import ascending, newest
from ..sources.ranks import RANGES, RankIndex, build
from .entitlement import Basis, active_package, latest_entitlement

SMALL_PAGE = 10_000
#: Groups that rows without a key are dealt to in a join.
NULL_SALTS = 1024


# --- users ------------------------------------------------------------------------

def places_and_services(providers: DataFrame, services: DataFrame,
                        narrowed: bool = False) -> DataFrame:
    """Places and services per owner. Services are counted per place first, so a
    place with most of the services reaches the join as one row. `narrowed`: `providers` are
    some owners' places, and only their services are counted."""
    if narrowed:
        services = services.join(providers.select(F.col("id").alias("provider_id")), "provider_id",
                                 "left_semi")
    per_place = services.groupBy(F.col("provider_id").alias("id")).agg(F.count("*").alias("n"))
    places = providers.filter(F.col("user_id").isNotNull()).select("id", "user_id")
    return places.join(per_place, "id", "left").groupBy("user_id").agg(
        F.count("*").alias("places_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("services_count"))


def users_with_stats(profiles: DataFrame, providers: DataFrame, services: DataFrame, basis: Basis,
                     source: DataFrame, packages: DataFrame, as_of: datetime,
                     user_id=None) -> DataFrame:
    """Every profile with its package, places and services; `user_id` narrows it to one.

    The narrowing happens before anything is counted.
    """
    if user_id is not None:
        profiles = profiles.filter(P.equals("id", user_id))
        providers = providers.filter(P.equals("user_id", user_id))
        source = source.filter(P.equals("user_id", user_id))
    people = profiles.select(F.col("id").alias("user_id"), "full_name", "role", "email")
    names = packages.select(F.col("id").alias("package_id"), F.col("name").alias("package_name"))
    package = latest_entitlement(basis, source, packages, as_of).join(names, "package_id", "left")
    owned = places_and_services(providers, services, user_id is not None)
    return people.join(package, "user_id", "left").join(owned, "user_id", "left").select(
        "user_id", "full_name", "role", "email", "package_id", "package_name", "started_at",
        "expires_at", F.coalesce("places_count", F.lit(0)).alias("places_count"),
        F.coalesce("services_count", F.lit(0)).alias("services_count"))


def people_search(users: DataFrame, text: str | None, collation: str | None = None) -> DataFrame:
    return users.filter(P.name_contains(text, collation=collation))


# --- counts -----------------------------------------------------------------------

def provider_status_counts(providers: DataFrame) -> DataFrame:
    """Pending (a missing status included) and active places, in one pass."""
    return providers.agg(
        F.count_if(P.awaiting()).alias("pending_count"),
        F.count_if(P.equals("status", "active")).alias("active_count"),
    )


def providers_per_package(providers: DataFrame, basis: Basis, source: DataFrame,
                          packages: DataFrame, as_of: datetime) -> DataFrame:
    """Places per running package of their owner, the rest as free, biggest first.

    Places are counted per owner before the join, so all places without an owner are
    one row of it; they count as free, and so does a package named like the free tier.
    """
    names = active_package(basis, source, packages, as_of).filter("is_active").select(
        "user_id", "package_name")
    owned = providers.groupBy("user_id").agg(F.count("*").alias("n"))
    counted = owned.join(names, "user_id", "left")
    tier = F.coalesce(F.col("package_name"), F.lit(V.FREE_TIER)).alias("package_name")
    return counted.groupBy(tier).agg(F.sum("n").alias("providers_count")).orderBy(
        *newest("providers_count"), *ascending("package_name"))


def site_stats(providers: DataFrame, payments: DataFrame) -> DataFrame:
    """Five numbers about the site: one pass over places, one over payments."""
    completed = payments.agg(F.count_if(P.equals("status", "completed")).alias("n"))
    return providers.agg(
        F.count("*").alias("total_providers"),
        F.count_if(P.awaiting()).alias("pending_providers"),
        F.count_if(P.equals("status", "active")).alias("active_providers"),
        F.count_distinct("user_id").alias("total_users"),
    ).withColumn("total_payments_completed", completed.scalar())


# --- subscriptions and payments -----------------------------------------------------

def _lookup(rows: DataFrame, dim: DataFrame, key: str, columns: list[Column],
            small: bool) -> DataFrame:
    """Left join to a table with one row per `id`.

    When `rows` is a cut page, the table is first reduced to the page's keys, so
    neither side is shuffled however big the table is. Else rows without a key, which may be
    all of them, are spread by a salt that no row of the table has, not sent to one task.
    """
    dim = dim.select(F.col("id").alias(key), *columns)
    if small:
        keys = rows.select(key).filter(F.col(key).isNotNull()).distinct()
        dim = F.broadcast(dim.join(F.broadcast(keys), key, "left_semi"))
        return rows.join(dim, key, "left")
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(NULL_SALTS)).cast("int") + F.lit(1)
    salted = rows.withColumn("_salt", F.when(F.col(key).isNull(), spread).otherwise(F.lit(0)))
    # not a plain literal: Spark would take it out of the join's keys
    dim = dim.withColumn("_salt", F.explode(F.array(F.lit(0))))
    return salted.join(dim, [key, "_salt"], "left").drop("_salt")


def _page(rows: DataFrame, columns: list[str], status: str | None, limit: int | None,
          offset: int | None) -> tuple[DataFrame, bool]:
    """Newest rows first, cut before any lookup: lookups keep every row."""
    rows = rows.filter(P.equals_if_given("status", status)).select(*columns)
    order = [*newest("created_at"), *ascending(*columns)]
    page = rows.orderBy(*order)
    if offset and limit is None:
        # all but the first rows: those are few, the rest is never put through one task
        skipped = page.limit(offset).select("id")
        page = rows.join(skipped, "id", "left_anti").orderBy(*order)
    elif offset:
        page = page.offset(offset)
    if limit is not None:
        page = page.limit(limit)
    return page, limit is not None and limit <= SMALL_PAGE


def _known_as(name: str = "full_name") -> Column:
    return F.coalesce(F.col(name), F.lit(V.UNKNOWN_USER)).alias("user_name")


SUBSCRIPTION_OWN = {
    "subscriptions": ["id", "user_id", "package_id", "amount", "status", "started_at",
                      "expires_at", "created_at", "payment_id", "auto_renew", "notes"],
    "payments": ["id", "user_id", "package_id", "amount", "status", "created_at",
                 "completed_at"],
}


def all_subscriptions(basis: Basis, source: DataFrame, profiles: DataFrame, packages: DataFrame,
                      status: str | None = None, limit: int | None = V.SUBSCRIPTIONS_LIMIT,
                      offset: int | None = 0, cut: Cut = as_is) -> DataFrame:
    """Subscriptions (or payments) with user and package, newest first.

    On the payments basis the expiry is derived, and is NULL unless both the
    completion and the package's duration are known. A page is needed once per
    lookup; `cut=config.settle` sorts it out once.
    """
    page, small = _page(source, SUBSCRIPTION_OWN[basis], status, limit, offset)
    return _named(basis, cut(page) if small else page, profiles, packages, small)


def subscriptions_index(basis: Basis, source: DataFrame, path: str, status: str | None = None,
                        ranges: int = RANGES) -> RankIndex:
    """The order of `all_subscriptions` as a rank index, for pages at any depth."""
    rows = source.filter(P.equals_if_given("status", status)).select(*SUBSCRIPTION_OWN[basis])
    return build(rows, path, ["-created_at"], ranges)


def subscriptions_at(index: RankIndex, basis: Basis, profiles: DataFrame, packages: DataFrame,
                     limit: int | None = V.SUBSCRIPTIONS_LIMIT, offset: int | None = 0,
                     cut: Cut = as_is) -> DataFrame:
    """A page of `all_subscriptions` read from its index: only the ranges it lies in."""
    page, small = index.page(limit, offset), limit is not None and limit <= SMALL_PAGE
    return _named(basis, cut(page) if small else page, profiles, packages, small)


def _named(basis: Basis, page: DataFrame, profiles: DataFrame, packages: DataFrame,
           small: bool) -> DataFrame:
    """Subscriptions or payments beside user and package, newest first."""
    own = SUBSCRIPTION_OWN[basis]
    joined = _lookup(page, profiles, "user_id", [F.col("full_name"), F.col("email")], small)
    joined = _lookup(joined, packages, "package_id",
                     [F.col("name").alias("package_name"), F.col("duration_days")], small)
    id_name = "subscription_id" if basis == "subscriptions" else "payment_id"
    rest = own[3:] if basis == "subscriptions" else [*own[3:], "expires_at"]
    if basis == "payments":
        joined = joined.withColumn("expires_at",
                                   plus_days(F.col("completed_at"), F.col("duration_days")))
    return joined.orderBy(*newest("created_at"), *ascending("id")).select(
        F.col("id").alias(id_name), "user_id", _known_as(), F.col("email").alias("user_email"),
        "package_id", "package_name", *rest)


def pending_subscriptions(basis: Basis, source: DataFrame, profiles: DataFrame,
                          packages: DataFrame, payments: DataFrame | None = None) -> DataFrame:
    """All requests that await activation, with user, package and receipt, newest first."""
    own = ["id", "user_id", "package_id", "amount", "status", "created_at"]
    if basis == "subscriptions":
        own += ["payment_id", "notes"]
    else:
        own += ["payment_receipt_url"]
    rows = source.filter(P.equals("status", "pending")).select(*own)
    joined = _lookup(rows, profiles, "user_id", [F.col("full_name"), F.col("email")], False)
    joined = _lookup(joined, packages, "package_id", [F.col("name").alias("package_name")], False)
    columns = [F.col("user_id"), _known_as(), F.col("email").alias("user_email"),
               F.col("package_id"), F.col("package_name"), F.col("amount"), F.col("status"),
               F.col("created_at")]
    if basis == "subscriptions":
        receipts = [F.col("payment_receipt_url")]
        joined = _lookup(joined, payments, "payment_id", receipts, False)
        columns = [F.col("id").alias("subscription_id"), *columns, F.col("payment_id"),
                   F.col("payment_receipt_url"), F.col("notes")]
    else:
        columns = [F.col("id").alias("payment_id"), *columns, F.col("payment_receipt_url")]
    return joined.orderBy(*newest("created_at"), *ascending("id")).select(*columns)


# --- payment instructions -----------------------------------------------------------

SETTINGS = ["bank_account", "bank_name", "account_name", "mobile_wallet", "instructions"]


def latest_settings(settings: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """The newest payment settings, or `defaults` when there are none: always one row."""
    fields = F.struct(*SETTINGS)
    order = F.struct(F.coalesce(F.col("updated_at").isNull(), F.lit(False)), "updated_at", "id")
    fallback = F.struct(*[F.lit((defaults or {}).get(c)).cast("string").alias(c) for c in SETTINGS])
    newest_row = settings.agg(F.max_by(fields, order).alias("s"))
    return newest_row.select(F.coalesce(F.col("s"), fallback).alias("s")).select("s.*")


def payment_instructions(packages: DataFrame, settings: DataFrame,
                         defaults: dict[str, str] | None = None) -> DataFrame:
    """How to pay for each open package, as columns and as one JSON document.

    A package that does not exist or is closed has no row.
    """
    info = latest_settings(settings, defaults).select(F.struct(*SETTINGS)).scalar()
    rows = packages.filter(P.package_open()).select(
        F.col("id").alias("package_id"), F.col("name").alias("package_name"),
        F.col("price").alias("amount"), F.lit("info").alias("status"),
        F.lit(V.PAYMENT_INFO_ONLY).alias("message"), info.alias("payment_info"),
    )
    return rows.withColumn("item", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))
