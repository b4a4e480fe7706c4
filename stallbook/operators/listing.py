"""Listings of places, services, ads and packages.

Every listing with a limit is cut on a total order, so Spark runs it as a
distributed top-k. Lookups against big tables happen after the cut: the cut page
is bounded by its limit, which is what makes it safe to broadcast.
"""

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Cut, as_is
from ..functions import fixed_values as V
from ..functions import predicates as P
from ..functions.clock import moment
from ..functions.ordering import ascending, by_name, newest, top
from ..functions.scalars import (
    blank_to_null, normalize_url, place_fields, place_page, recency, service_page,
)
from ..sources import trigrams
from ..sources.ranks import RANGES, RankIndex, build
from .entitlement import Basis, active_package
from .skew import join_unique
from .visits import visits_per_page

# --- fixed values: columns of each listing --------------------------------------
CARD = ["id", "name", "category", "city", "address", "phone", "website", "image_url", "description"]
RANKED_CARD = [*CARD, "status", "priority"]
PROVIDER_DETAIL = [
    "id", "name", "category", "city", "address", "phone", "website", "whatsapp", "map_url",
    "description", "image_url", "lat", "lng", "type", "delivery", "area", "user_id",
    "activity_id", "status", "created_at", "updated_at",
]
SERVICE_DETAIL = ["id", "provider_id", "name", "description", "price", "image_url", "delivery",
                  "online", "created_at"]
SERVICE_CARD = ["id", "provider_id", "name", "description", "price", "image_url", "delivery",
                "online"]
AD_CARD = ["id", "provider_id", "service_id", "title", "description", "start_date", "end_date",
           "created_at", "status"]
PLACE_CARD = ["id", "name", "category", "city", "address", "phone", "website", "whatsapp",
              "map_url", "description", "image_url"]
PACKAGE_CARD = ["id", "name", "price", "duration_days", "ads_limit", "image_limit", "video_limit",
                "is_active", "created_at", "description"]
SEARCH_CARD = ["id", "name", "city", "category", "status", "created_at"]
REVIEW_CARD = ["id", "provider_id", "service_id", "user_id", "rating", "comment", "created_at"]

SMALL_PAGE = 10_000  # rows of a cut page that may be broadcast


# --- places ---------------------------------------------------------------------

def owner_weights(basis: Basis, source: DataFrame, packages: DataFrame,
                  as_of: datetime) -> DataFrame:
    """The weight of each user's package; on the payments basis whether or not it has expired."""
    return active_package(basis, source, packages, as_of).select(
        "user_id", F.coalesce(F.col("priority_weight"), F.lit(0)).cast("bigint").alias("_weight"))


def with_priority(providers: DataFrame, basis: Basis, source: DataFrame, packages: DataFrame,
                  as_of: datetime) -> DataFrame:
    """Add `priority`: weight of the owner's package plus a bonus for new places.

    A place without an owner has priority 0, however new. On the payments basis
    the weight ignores expiry.
    """
    weights = owner_weights(basis, source, packages, as_of)
    bonus = recency(F.col("created_at"), moment(as_of, providers, "created_at"))
    priority = F.when(F.col("user_id").isNull(), F.lit(0).cast("bigint")).otherwise(
        F.coalesce(F.col("_weight"), F.lit(0).cast("bigint")) + bonus
    )
    joined = join_unique(providers, weights, "user_id", "id")
    return joined.withColumn("priority", priority).drop("_weight")


def provider_priority(providers: DataFrame, basis: Basis, source: DataFrame, packages: DataFrame,
                      as_of: datetime) -> DataFrame:
    """Priority of every place."""
    narrow = providers.select("id", "user_id", "created_at")
    return with_priority(narrow, basis, source, packages, as_of).select("id", "priority")


def latest_providers(providers: DataFrame, limit: int | None = V.LISTING_LIMIT) -> DataFrame:
    """First-generation listing: newest places that are active or have no status."""
    return top(providers.filter(P.visible_or_unset()), newest("created_at"), CARD, limit)


def ranked_providers(providers: DataFrame, basis: Basis, source: DataFrame, packages: DataFrame,
                     as_of: datetime, status: str | None = "active",
                     limit: int | None = V.LISTING_LIMIT, offset: int | None = 0) -> DataFrame:
    """Places by priority, then newest. `status=None` lists all; a NULL status is pending.

    A missing or negative limit shows one row, a negative offset none skipped.
    Ranking moves ids, owners and dates only; the full rows are fetched for the
    finished page, without a shuffle when the page is small.
    """
    rows = max(1, limit or 0)
    status_of = F.coalesce(F.col("status"), F.lit("pending"))
    shown = providers.filter(P.equals_if_given(status_of, status)).select(
        "id", "user_id", "created_at")
    ranked = with_priority(shown, basis, source, packages, as_of)
    order = newest("priority", "created_at")
    page = top(ranked, order, ["id", "priority", "created_at"], rows, max(0, offset or 0))
    cards = providers.select(*CARD, "status").join(
        F.broadcast(page) if rows <= SMALL_PAGE else page, "id")
    return top(cards, order, RANKED_CARD, rows)


def ranked_index(providers: DataFrame, basis: Basis, source: DataFrame, packages: DataFrame,
                 as_of: datetime, path: str, status: str | None = "active",
                 ranges: int = RANGES) -> RankIndex:
    """The order of `ranked_providers` as a rank index, for pages at any depth.

    Priorities are those of `as_of`: build a new one for each day.
    """
    status_of = F.coalesce(F.col("status"), F.lit("pending"))
    shown = providers.filter(P.equals_if_given(status_of, status)).select(
        "id", "user_id", "created_at")
    ranked = with_priority(shown, basis, source, packages, as_of)
    return build(ranked.select("id", "priority", "created_at"), path,
                 ["-priority", "-created_at"], ranges)


def ranked_at(index: RankIndex, providers: DataFrame, limit: int | None = V.LISTING_LIMIT,
              offset: int | None = 0) -> DataFrame:
    """A page of `ranked_providers` read from its index: only the ranges it lies in."""
    rows = max(1, limit or 0)
    page = index.page(rows, offset)
    cards = providers.select(*CARD, "status").join(
        F.broadcast(page) if rows <= SMALL_PAGE else page, "id")
    return top(cards, newest("priority", "created_at"), RANKED_CARD, rows)


def provider_search(providers: DataFrame, status: str | None = None, text: str | None = None,
                    limit: int = V.SEARCH_LIMIT) -> DataFrame:
    """Newest places with optional status and name search; the limit applies after both."""
    found = providers.filter(P.equals_if_given("status", status) & P.name_like(text))
    return top(found, newest("created_at"), SEARCH_CARD, limit)


def provider_search_indexed(providers: DataFrame, index: str, status: str | None = None,
                            text: str | None = None, limit: int = V.SEARCH_LIMIT) -> DataFrame:
    """`provider_search` through the trigrams of the names, stored in the folder `index`."""
    found = trigrams.like(providers.select(*SEARCH_CARD), index, text)
    return top(found.filter(P.equals_if_given("status", status)), newest("created_at"),
               SEARCH_CARD, limit)


def details(table: DataFrame, ids: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Rows of `table` whose `id` is among `ids[key]`."""
    wanted = ids.select(F.col(key).alias("id")).distinct()
    return table.select(*columns).join(wanted, "id", "left_semi")


def by_id(table: DataFrame, row_id, columns: list[str]) -> DataFrame:
    return table.filter(P.equals("id", row_id)).select(*columns).limit(1)


def projection(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.select(*columns)


# --- services and ads -------------------------------------------------------------

def latest_services(services: DataFrame, limit: int | None = V.LISTING_LIMIT) -> DataFrame:
    return top(services, newest("created_at"), SERVICE_DETAIL, limit)


def active_ads(ads: DataFrame, limit: int | None = V.LISTING_LIMIT) -> DataFrame:
    return top(ads.filter(P.equals("status", "active")), newest("created_at"), AD_CARD, limit)


def categories(activities: DataFrame, collation: str | None = None) -> DataFrame:
    """All categories by name: by bytes, or in the order of a collation."""
    columns = ["id", "name", "description", "created_at"]
    return top(activities, by_name("name", collation), columns)


def providers_by_name(providers: DataFrame, collation: str | None = None,
                      limit: int | None = V.LISTING_LIMIT, offset: int = 0) -> DataFrame:
    """A page of all places by name: by bytes, or in the order of a collation."""
    return top(providers, by_name("name", collation), SEARCH_CARD, limit, offset)


def images_of(ads: DataFrame, images: DataFrame, cut: Cut = as_is) -> DataFrame:
    """A listing of ads beside their images: a row per image, in the order of the listing
    and then of the images, and one with a NULL image for an ad without any.

    The images are cut to the listing before they are sorted. With `cut=config.keep` the
    listing is a written table whose size Spark knows: a short one is broadcast, a long one
    shuffled.
    """
    page = cut(ads)
    shown = images.select(F.col("ad_id").alias("id"), F.col("id").alias("image_id"), "image_url")
    rows = page.join(shown, "id").unionByName(
        page.join(shown.select("id"), "id", "left_anti"), allowMissingColumns=True)
    order = [*newest("created_at"), *ascending(*ads.columns, "image_url", "image_id")]
    return rows.orderBy(*order).select(*ads.columns, "image_id", "image_url")


def ad_image_rows(ads: DataFrame, images: DataFrame) -> DataFrame:
    """Active ads of the whole table beside their images, one row per image and one
    with a NULL image for an ad without any.

    Matched and unmatched ads are joined apart: Spark can split the many images of
    one ad over tasks in an inner join but not on the right of a left join.
    """
    shown = ads.filter(P.equals("status", "active")).select("id", "title")
    urls = images.select(F.col("ad_id").alias("id"), "image_url")
    bare = shown.join(urls.select("id").distinct(), "id", "left_anti")
    return shown.join(urls, "id").unionByName(
        bare.withColumn("image_url", F.lit(None).cast("string")))


def services_of_provider(services: DataFrame, provider_id=None, only: str | None = None,
                         sort: str = "latest") -> DataFrame:
    """Services of one place (or of all), filtered by `delivery` or `online`, sorted
    newest first or by price with a missing price counted as 0."""
    rows = services.filter(P.equals_if_given("provider_id", provider_id))
    if only is not None:
        rows = rows.filter(P.truthy(only))
    price = F.coalesce(F.col("price"), F.lit(0).cast(services.schema["price"].dataType))
    keys: list[Column] = {"latest": [], "price_asc": [price.asc()], "price_desc": [price.desc()]}[sort]
    return rows.orderBy(*keys, *newest("created_at"), *ascending(*SERVICE_CARD)).select(*SERVICE_CARD)


def service_with_provider(services: DataFrame, providers: DataFrame) -> DataFrame:
    """Every service beside the name and city of its place."""
    places = providers.select(
        F.col("id").alias("provider_id"), F.col("name").alias("provider_name"),
        F.col("city").alias("provider_city"),
    )
    return services.select("id", "provider_id", "name", "price").join(places, "provider_id", "left")


# --- what belongs to a user ---------------------------------------------------------

def favorites_of(favorites: DataFrame, providers: DataFrame, user_id=None) -> DataFrame:
    """Favourite places of one user (or of every user), each once."""
    mine = favorites.filter(P.equals_if_given("user_id", user_id))
    pairs = mine.select("user_id", F.col("provider_id").alias("id")).distinct()
    return pairs.join(providers.select("id", "name", "category"), "id")


def providers_of(providers: DataFrame, user_id=None) -> DataFrame:
    return _owned(providers, user_id).select("user_id", "id", "name")


def services_of(services: DataFrame, providers: DataFrame, user_id=None) -> DataFrame:
    """Services of the places a user owns."""
    places = _owned(providers, user_id).select("user_id", F.col("id").alias("provider_id"))
    return services.select("id", "provider_id", "name", "price").join(places, "provider_id")


def ads_of(ads: DataFrame, providers: DataFrame, user_id=None) -> DataFrame:
    """Ads of the places a user owns."""
    places = _owned(providers, user_id).select("user_id", F.col("id").alias("provider_id"))
    return ads.select("id", "provider_id", "title", "status").join(places, "provider_id")


def _owned(providers: DataFrame, user_id) -> DataFrame:
    return providers.filter(F.col("user_id").isNotNull() & P.equals_if_given("user_id", user_id))


# --- packages -----------------------------------------------------------------------

def open_packages(packages: DataFrame) -> DataFrame:
    """Packages on offer, cheapest first."""
    rows = packages.filter("is_active")
    return rows.orderBy(*ascending("price"), *ascending("id"))


def newest_packages(packages: DataFrame) -> DataFrame:
    return packages.orderBy(*newest("created_at"), *ascending("id"))


def pending_packages(subscriptions: DataFrame, user_id=None) -> DataFrame:
    """Packages each user has asked for and that await activation."""
    rows = subscriptions.filter(P.equals("status", "pending")
                                & P.equals_if_given("user_id", user_id))
    return rows.select("user_id", "package_id").distinct()


def package_cards(packages: DataFrame, entitled: DataFrame, pending: DataFrame) -> DataFrame:
    """State of the open packages for each user: subscribed, expired or pending.

    Packages a user has no row for are available to them; that state is left
    implicit so the result grows with entitlements and requests, not with
    users times packages. `entitled` is a `user_package` frame.
    """
    held = entitled.filter(F.col("package_id").isNotNull()).select(
        "user_id", "package_id",
        F.when(F.col("is_active"), "subscribed").otherwise("expired").alias("held"),
    )
    asked = pending.withColumn("asked", F.lit(True))
    state = F.when(F.col("held") == "subscribed", "subscribed").when(
        F.col("asked"), "pending").otherwise(F.col("held"))
    offered = packages.filter("is_active").select(
        F.col("id").alias("package_id"), F.col("name").alias("package_name"), "price")
    return held.join(asked, ["user_id", "package_id"], "full").join(offered, "package_id").select(
        "user_id", "package_id", "package_name", "price", state.alias("state"))


def package_cards_of(packages: DataFrame, states: DataFrame, user_id) -> DataFrame:
    """All open packages as one user sees them, cheapest first."""
    mine = states.filter(P.equals("user_id", user_id)).select("package_id", "state")
    cards = open_packages(packages).select(F.col("id").alias("package_id"), "name", "price")
    return cards.join(mine, "package_id", "left").select(
        "package_id", "name", "price", F.coalesce("state", F.lit("available")).alias("state")
    ).orderBy(*ascending("price", "package_id"))


# --- badges -------------------------------------------------------------------------

def with_badges(page: DataFrame, visits: DataFrame, as_of: datetime, page_of=place_page,
                cut: Cut = as_is) -> DataFrame:
    """Add total and today's visits of each row's page to a limited listing.

    The visits are cut to the listing's pages before they are counted. The listing is
    needed twice: `cut=config.keep` ranks it once, and as a written table it has a size
    that Spark knows, so it broadcasts the page keys of a short listing and shuffles those
    of a long one.
    """
    keyed = cut(page.withColumn("page", page_of(F.col("id"))))
    hits = visits.join(keyed.select("page").distinct(), "page", "left_semi")
    stats = visits_per_page(hits, as_of)
    return keyed.join(stats, "page", "left").select(
        *keyed.columns,
        F.coalesce("total_visits", F.lit(0)).alias("total_visits"),
        F.coalesce("today_visits", F.lit(0)).alias("today_visits"),
    )


def service_badges(page: DataFrame, visits: DataFrame, as_of: datetime,
                   cut: Cut = as_is) -> DataFrame:
    return with_badges(page, visits, as_of, service_page, cut)


def all_badges(table: DataFrame, visits: DataFrame, as_of: datetime, page_of) -> DataFrame:
    """Badges for a whole table: visits are counted per page first, then joined."""
    keyed = table.withColumn("page", page_of(F.col("id")))
    return keyed.join(visits_per_page(visits, as_of), "page", "left").select(
        *keyed.columns,
        F.coalesce("total_visits", F.lit(0)).alias("total_visits"),
        F.coalesce("today_visits", F.lit(0)).alias("today_visits"),
    )


def home_page(providers: DataFrame, services: DataFrame, ads: DataFrame) -> dict[str, DataFrame]:
    """First rows of each section of the home page, from the already ranked listings."""
    return {
        "providers": providers.limit(V.HOME_PROVIDERS),
        "services": services.limit(V.HOME_SERVICES),
        "ads": ads.limit(V.HOME_ADS),
    }


def newest_rows(table: DataFrame, columns: Iterable[str], limit: int = 10) -> DataFrame:
    """The newest rows of a table, for a look at recent data."""
    return top(table, newest("created_at"), list(columns), limit)


def fallback_rows(table: DataFrame, columns: Iterable[str], status: str | None = None) -> DataFrame:
    """Short plain listing for when the ranked one is not to be had."""
    return newest_rows(table.filter(P.equals_if_given("status", status)) if status else table,
                       columns, V.FALLBACK_LIMIT)


def with_category(rows: DataFrame, activities: DataFrame) -> DataFrame:
    """Set `category` to the name of the row's activity; NULL without a known one."""
    names = activities.select(F.col("id").alias("activity_id"), F.col("name").alias("category"))
    return rows.drop("category").join(names, "activity_id", "left")


def place_requests(forms: DataFrame, activities: DataFrame) -> DataFrame:
    """Turn filled-in forms into requests for new places.

    Blank fields become NULL, the website gets its scheme, the activity gives the
    category, and a place without premises (`physical` false) gets the online
    address and type and no map.
    """
    place = place_fields(F.col("physical"), F.col("address"), F.col("map_url"))
    blank = ["city", "phone", "whatsapp", "description", "image_url"]
    return with_category(forms, activities).select(
        "request_id", "user_id", "name", "activity_id", "category",
        *[blank_to_null(F.col(c)).alias(c) for c in blank if c in forms.columns],
        blank_to_null(normalize_url(F.col("website"))).alias("website"),
        *[column.alias(name) for name, column in place.items()])
