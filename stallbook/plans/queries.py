"""Registered queries: each takes a session and a folder of test tables.

Every query reads its tables whole. Requests for the change operators are made
from the tables too, one per row, so the work grows with the data.
"""

import uuid
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import keep, keep_counted, shared_folder
from ..functions import predicates as P
from ..functions import scalars as S
from ..operators import bounded as N
from ..operators import entitlement as E
from ..operators import listing as L
from ..operators import owners as O
from ..operators import quality as Q
from ..operators import reports as R
from ..operators import security as X
from ..operators import visits as W
from ..operators.changes import base as B
from ..operators.changes import dense as D
from ..operators.changes import lifecycle as C
from ..operators.changes import quota as K
from ..sources import buckets as BU
from ..sources import tables as T
from ..sources import trigrams as TG
from ..sources.adapters import AS_OF, AS_OF_VISITS, Market
from ..streaming import calendar as SC
from ..streaming import expiry as SE
from ..streaming import rollup as SR
from ..streaming import visits as SV

DENSE_STANDALONE = {"providers": [("services", "provider_id"), ("results", "provider_id")],
                    "services": [("results", "service_id")]}

Query = Callable[[Market], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def both(fn: Callable[[Market, str], DataFrame]) -> None:
    """Register a query once per entitlement basis, as `_v1` and `_v2`."""
    for version, basis in (("v1", "payments"), ("v2", "subscriptions")):
        QUERIES[f"{fn.__name__}_{version}"] = lambda m, basis=basis: fn(m, basis)


def source(m: Market, basis: str) -> DataFrame:
    return m.payments if basis == "payments" else m.subscriptions


def users(m: Market) -> DataFrame:
    return m.user_profiles.select(F.col("id").alias("user_id"))


# --- entitlement ------------------------------------------------------------------------

@both
def latest_entitlement(m, basis):
    return E.latest_entitlement(basis, source(m, basis), m.packages, AS_OF)


@both
def user_package(m, basis):
    return E.user_package(users(m), basis, source(m, basis), m.packages, AS_OF)


@query
def user_active_subscription(m):
    return E.user_active_subscription(m.subscriptions, m.packages, AS_OF)


@both
def place_quota(m, basis):
    return E.place_quota(users(m), basis, source(m, basis), m.packages, AS_OF)


@both
def can_add_provider(m, basis):
    return E.can_add_provider(users(m), m.providers, basis, source(m, basis), m.packages, AS_OF)


@both
def user_active_package(m, basis):
    return E.user_active_package(m.providers, basis, source(m, basis), m.packages, AS_OF)


@query
def known_users(m):
    return E.known_users(m.providers, m.payments)


@query
def excess_place_warning(m):
    return E.excess_places(L.pending_packages(m.subscriptions), m.providers, m.packages)


# --- listings ---------------------------------------------------------------------------

@both
def provider_priority(m, basis):
    return L.provider_priority(m.providers, basis, source(m, basis), m.packages, AS_OF)


@both
def ranked_providers(m, basis):
    return L.ranked_providers(m.providers, basis, source(m, basis), m.packages, AS_OF)


@query
def providers_page(m):
    return L.ranked_providers(m.providers, "subscriptions", m.subscriptions, m.packages, AS_OF,
                              status="pending", limit=20, offset=40)


@both
def ranked_by_bounds(m, basis):
    return N.ranked_providers(m.providers, basis, source(m, basis), m.packages, AS_OF)


@query
def providers_page_by_bounds(m):
    return N.ranked_providers(m.providers, "subscriptions", m.subscriptions, m.packages, AS_OF,
                              status="pending", limit=20, offset=40)


@query
def providers_deep_page(m):
    index = L.ranked_index(m.providers, "subscriptions", m.subscriptions, m.packages, AS_OF,
                           f"{shared_folder(m.spark)}/ranks-{uuid.uuid4().hex}", ranges=64)
    return L.ranked_at(index, m.providers, offset=index.rows // 2)


@query
def latest_providers(m):
    return L.latest_providers(m.providers)


@query
def listing_with_badges(m):
    ranked = L.ranked_providers(m.providers, "subscriptions", m.subscriptions, m.packages, AS_OF)
    return L.with_badges(ranked, m.visits, AS_OF_VISITS, cut=keep)


@query
def provider_badges(m):
    return L.all_badges(m.providers.select("id", "name"), m.visits, AS_OF_VISITS, S.place_page)


@query
def services_with_badges(m):
    page = L.latest_services(m.services).select("id", "provider_id", "name", "price", "created_at")
    return L.service_badges(page, m.visits, AS_OF_VISITS, cut=keep)


@query
def provider_search(m):
    return L.provider_search(m.providers, status="active", text=" A%e ")


@query
def provider_search_indexed(m):
    index = f"{shared_folder(m.spark)}/names-{uuid.uuid4().hex}"
    TG.add(m.providers, index)
    return L.provider_search_indexed(m.providers, index, status="active", text=" BL_E bo%T ")


@query
def providers_by_name(m):
    accented = F.expr("translate(initcap(name), 'aeiB', 'áéíb')").alias("name")
    places = m.providers.select("id", accented, "city", "category", "status", "created_at")
    return L.providers_by_name(places, "UNICODE", offset=100)


@query
def people_search_collated(m):
    return R.people_search(m.user_profiles, " CÚSTOMÊR#00000001 ", "UNICODE_CI_AI")


@query
def provider_details(m):
    return L.details(m.providers.withColumns({
        c: F.lit(None).cast(t) for c, t in (
            ("whatsapp", "string"), ("map_url", "string"), ("lat", "decimal(9,6)"),
            ("lng", "decimal(9,6)"), ("type", "string"), ("delivery", "boolean"),
            ("area", "string"), ("activity_id", "bigint"))
    }), m.services, L.PROVIDER_DETAIL, key="provider_id")


@query
def service_details(m):
    pages = m.visits.select(F.substring_index("page", "/", -1).cast("bigint").alias("id"))
    return L.details(m.services, pages, L.SERVICE_DETAIL)


@query
def latest_services(m):
    return L.latest_services(m.services)


@query
def active_ads(m):
    return L.active_ads(m.ads)


@query
def active_ads_with_images(m):
    return L.images_of(L.active_ads(m.ads), m.ads_images, cut=keep).select(
        "id", "title", "created_at", "image_url")


@query
def ad_image_rows(m):
    return L.ad_image_rows(m.ads, m.ads_images)


@query
def categories(m):
    return L.categories(m.activities)


@query
def services_by_price(m):
    return L.services_of_provider(m.services, only="delivery", sort="price_desc")


@query
def service_with_provider(m):
    return L.service_with_provider(m.services, m.providers)


@query
def favorites(m):
    return L.favorites_of(m.favorites, m.providers)


@query
def user_providers(m):
    return L.providers_of(m.providers)


@query
def user_services(m):
    return L.services_of(m.services, m.providers)


@query
def user_ads(m):
    return L.ads_of(m.ads, m.providers)


@query
def open_packages(m):
    return L.open_packages(m.packages)


@query
def newest_packages(m):
    return L.newest_packages(m.packages).select("id", "name", "created_at")


@query
def pending_packages(m):
    return L.pending_packages(m.subscriptions)


@query
def package_cards(m):
    entitled = E.user_package(users(m), "subscriptions", m.subscriptions, m.packages, AS_OF)
    return L.package_cards(m.packages, entitled, L.pending_packages(m.subscriptions))


@query
def newest_rows(m):
    return L.newest_rows(m.providers.filter(F.col("user_id").isNotNull()),
                         ["id", "name", "status", "user_id", "created_at", "category", "city"], 5)


@query
def offers(m):
    return L.projection(m.offers, ["id", "price", "provider_id"])


@query
def reviews(m):
    return L.projection(m.reviews, L.REVIEW_CARD)


@query
def place_requests(m):
    """Requests for new places out of forms made from the parts."""
    forms = m.providers.select(
        F.col("id").alias("request_id"), "user_id", "name", F.expr("id % 12").alias("activity_id"),
        F.expr("case when id % 3 = 0 then '' else city end").alias("city"),
        F.expr("case when id % 5 = 0 then '' else phone end").alias("phone"), "description",
        F.expr("case id % 4 when 0 then '' when 1 then ' ' || website when 2 then 'http://' || website "
               "else 'none' end").alias("website"),
        F.expr("id % 2 = 0").alias("physical"), "address", F.col("image_url").alias("map_url"))
    return L.place_requests(forms, m.activities)


@query
def fallback_ads(m):
    return L.fallback_rows(m.ads, ["id", "title", "description", "provider_id", "status", "created_at"],
                           status="active")


@query
def home_sections(m):
    ranked = L.ranked_providers(m.providers, "subscriptions", m.subscriptions, m.packages, AS_OF)
    home = L.home_page(ranked, L.latest_services(m.services), L.active_ads(m.ads))
    parts = [df.select(F.lit(name).alias("section"), "id") for name, df in home.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- visits -----------------------------------------------------------------------------

@query
def site_visit_stats(m):
    return W.site_visits(m.visits, AS_OF_VISITS)


@query
def page_visit_stats(m):
    return W.visits_per_page(m.visits, AS_OF_VISITS)


@query
def pages_visit_stats(m):
    pages = m.providers.select(F.col("id").alias("position"), S.place_page(F.col("id")).alias("page"))
    return W.pages_visits(pages, m.visits, AS_OF_VISITS)


@query
def pages_visit_stats_repeated(m):
    pages = m.services.select(F.col("id").alias("position"),
                              S.service_page(F.col("provider_id")).alias("page"))
    return W.pages_visits(pages, m.visits, AS_OF_VISITS, count_repeats=True)


def event_stream(m: Market) -> DataFrame:
    """The event table as a stream; the table is one file or a folder of files."""
    return m.spark.readStream.schema(m.raw("events").schema).parquet(f"{m.sf_dir}/events.parque[t]")


def streamed_visits(m: Market, counts_of, keys: list[str]) -> DataFrame:
    """Run a streaming count over the visit table and read it back after the last batch."""
    run = f"{shared_folder(m.spark)}/visits-{uuid.uuid4().hex}"
    visits = event_stream(m).select(
        F.when(F.col("event_type").isin("view", "click"), S.place_page(F.col("user_id")))
        .otherwise(S.service_page(F.col("user_id"))).alias("page"),
        SV.utc_instant(F.col("ts")).alias("created_at"))
    counts = counts_of(visits)
    SV.write_changes(counts, f"{run}/counts", f"{run}/progress").awaitTermination()
    return SV.current_counts(m.spark, f"{run}/counts", counts.schema, keys)


@query
def visits_stream(m):
    return streamed_visits(m, lambda v: SV.daily_visits(v).select(
        SV.utc_day().alias("day"), "page", "visits"), ["day", "page"])


@query
def visits_stream_totals(m):
    return streamed_visits(m, SV.total_visits, ["page"])


def rolled_visits(m: Market) -> str:
    """Visits in three deliveries, every fourth one again in the delivery after; each covers all days,
    so those after the first bring late ones. Two deliveries are merged, the last is beyond the mark."""
    run = f"{shared_folder(m.spark)}/rollup-{uuid.uuid4().hex}"
    first = m.visits.select("id", "page", "created_at", (F.col("id") % 2).alias("delivery"))
    again = first.where("id % 4 = 0").withColumn("delivery", F.col("delivery") + 1)
    for n in range(3):
        rows = first.unionByName(again).where(F.col("delivery") == n).drop("delivery")
        rows.write.mode("append").parquet(f"{run}/in")
        arriving = m.spark.readStream.schema(rows.schema).parquet(f"{run}/in")
        SR.stream(arriving, f"{run}/rollup", f"{run}/progress", every=2, buckets=8).awaitTermination()
    return f"{run}/rollup"


@query
def rollup_page_days(m):
    """Visits per page and day from the rollup."""
    return SR.page_days(m.spark, rolled_visits(m)).groupBy("day", "page").agg(F.sum("visits").alias("visits"))


@query
def rollup_pages_visit_stats(m):
    """As `pages_visit_stats`, from the rollup."""
    pages = m.providers.select(F.col("id").alias("position"), S.place_page(F.col("id")).alias("page"))
    return W.pages_visits(pages, SR.page_days(m.spark, rolled_visits(m)), AS_OF_VISITS)


@query
def rollup_listing_with_badges(m):
    """As `listing_with_badges`, from the rollup."""
    ranked = L.ranked_providers(m.providers, "subscriptions", m.subscriptions, m.packages, AS_OF)
    return L.with_badges(ranked, SR.page_days(m.spark, rolled_visits(m)), AS_OF_VISITS, cut=keep)


@query
def expiry_stream(m):
    """The sweep, driven by a stream of events, over the whole table at each trigger."""
    run = f"{shared_folder(m.spark)}/expiry-{uuid.uuid4().hex}"

    def save(rows, batch_id):
        rows.write.mode("overwrite").parquet(f"{run}/expired/batch={batch_id}")

    SE.sweep_stream(event_stream(m), lambda: m.subscriptions, lambda: AS_OF, save,
                    f"{run}/progress").awaitTermination()
    columns = m.subscriptions.schema
    expired = m.spark.read.schema(columns).parquet(f"{run}/expired").select(*columns.names)
    return SE.latest_versions(expired)


@query
def expiry_calendar(m):
    """Two triggers over a stream of versions, the clock moving between them: first all
    subscriptions, then renewals of some beside older versions that come late. Of each
    trigger's rows only those due are opened."""
    run = f"{shared_folder(m.spark)}/calendar-{uuid.uuid4().hex}"
    whole = m.subscriptions.withColumn("updated_at", F.col("created_at"))
    renewed = whole.filter("id % 5 = 0").withColumns({
        "expires_at": F.expr("expires_at + interval 400 days"),
        "updated_at": F.expr("updated_at + interval 1 day")})
    stale = whole.filter("id % 7 = 0").withColumns({
        "status": F.lit("active"), "expires_at": F.expr("created_at - interval 10 days"),
        "updated_at": F.expr("updated_at - interval 1 day")})
    start = AS_OF - timedelta(days=200)
    for rows, now, since in ((whole, start, start), (renewed.unionByName(stale), AS_OF, start)):
        rows.write.mode("append").parquet(f"{run}/in")
        source = m.spark.readStream.schema(rows.schema).parquet(f"{run}/in")
        SC.stream(source, f"{run}/tables", f"{run}/days", lambda now=now: now, lambda since=since: since,
                  lambda ids, batch_id: None, f"{run}/progress").awaitTermination()
    return SC.current(m.spark, f"{run}/tables").select("id", "user_id", "status", "expires_at")


# --- reports ----------------------------------------------------------------------------

@both
def providers_per_package(m, basis):
    return R.providers_per_package(m.providers, basis, source(m, basis), m.packages, AS_OF)


@both
def users_with_stats(m, basis):
    return R.users_with_stats(m.user_profiles, m.providers, m.services, basis, source(m, basis),
                              m.packages, AS_OF)


@query
def people_search(m):
    return R.people_search(m.user_profiles, " R#0000 ")


@query
def people_search_indexed(m):
    index = f"{shared_folder(m.spark)}/people-{uuid.uuid4().hex}"
    TG.add(m.user_profiles, index, name="full_name")
    return TG.containing(m.user_profiles, index, " R#000000012 ")


@query
def provider_status_counts(m):
    return R.provider_status_counts(m.providers)


@query
def admin_site_stats(m):
    return R.site_stats(m.providers, m.payments)


@both
def all_subscriptions(m, basis):
    return R.all_subscriptions(basis, source(m, basis), m.user_profiles, m.packages, cut=keep)


@both
def subscriptions_deep_page(m, basis):
    index = R.subscriptions_index(basis, source(m, basis),
                                  f"{shared_folder(m.spark)}/ranks-{uuid.uuid4().hex}", ranges=64)
    return R.subscriptions_at(index, basis, m.user_profiles, m.packages, offset=index.rows // 2, cut=keep)


@query
def all_subscriptions_unlimited(m):
    return R.all_subscriptions("subscriptions", m.subscriptions, m.user_profiles, m.packages,
                               status="active", limit=None, offset=None)


@both
def pending_subscriptions(m, basis):
    return R.pending_subscriptions(basis, source(m, basis), m.user_profiles, m.packages, m.payments)


@query
def payment_instructions(m):
    return R.payment_instructions(m.packages, m.payment_settings).select(
        "package_id", "package_name", "amount", "status", "message", "payment_info.*")


@query
def table_overview(m):
    return T.row_counts(m.tables())


@query
def table_preview(m):
    return T.preview(m.user_profiles, 100, order="id")


@query
def table_as_json(m):
    return T.as_json(m.favorites)


# --- row functions ----------------------------------------------------------------------

@query
def normalize_urls(m):
    """Addresses as found, without their scheme, padded, and as a bare host."""
    bare = F.regexp_replace("url", "^https?://", "")
    forms = {
        "as_is": F.col("url"), "no_scheme": bare, "padded": F.concat(F.lit(" \t"), bare, F.lit("\n ")),
        "host": F.substring_index(bare, "/", 1),
    }
    return m.raw("pages").select("page_id", *[
        S.normalize_url(column).alias(name) for name, column in forms.items()])


@query
def profile_names(m):
    """Defaults for names, roles and status texts over the profiles."""
    given = F.when(F.col("role") == "admin", F.lit("")).otherwise(F.col("full_name"))
    email = F.when(F.col("role").isNotNull(), F.col("email"))
    return m.user_profiles.select(
        "id", S.display_name(F.when(F.col("role").isNotNull(), given), email).alias("display_name"),
        S.name_from_email(F.col("email")).alias("email_name"),
        S.normalize_role(F.concat(F.lit(" "), F.upper("role"), F.lit(" "))).alias("role"),
        S.blank_to_null(F.col("role")).alias("role_or_null"))


@query
def status_texts(m):
    return m.ads.select("id", S.status_text(F.col("status")).alias("status_text"))


@query
def place_forms(m):
    """Form defaults of new places, taken from the parts: even sizes are physical places."""
    raw = m.raw("part")
    size = F.col("p_size")
    fields = S.place_fields(size % 2 == 0, F.when(size % 3 == 0, F.lit("")).otherwise(F.col("p_brand")),
                            F.col("p_type"))
    text = F.when(size % 5 == 0, F.lit("0")).when(size % 5 == 1, F.lit("")).when(
        size % 5 == 2, F.lit("x")).otherwise(size.cast("string"))
    return raw.select("p_partkey", *[c.alias(n) for n, c in fields.items()],
                      S.number_or(text, "int", 30).alias("duration_days"),
                      S.number_or(text, "int", 1).alias("max_places"))


# --- visibility and data quality ----------------------------------------------------------

@query
def visible_subscriptions(m):
    plain = m.user_profiles.filter(F.col("role").isNull() | ~P.is_admin())
    return X.own_rows(m.subscriptions.select("id", "user_id", "package_id", "status"), plain)


@query
def visible_subscription_counts(m):
    return X.visible_counts(m.subscriptions, m.user_profiles)


@query
def visible_payment_settings(m):
    """The settings as an admin sees them, with the admin taken from the table."""
    return X.visible_rows("payment_settings", m.payment_settings, m.user_profiles,
                          first_admin(m)).select("id", "bank_name")


def first_admin(m: Market):
    return m.user_profiles.filter(P.is_admin()).agg(F.min("id")).scalar()


@query
def visible_packages(m):
    return X.visible_rows("packages", m.packages, m.user_profiles, None).select("id", "name")


@query
def dq_status(m):
    wrong = F.expr("case id % 9 when 0 then 'odd' when 1 then null when 2 then 'processing' else status end")
    return Q.status_violations(m.subscriptions.withColumn("status", wrong),
                               m.payments.withColumn("status", wrong))


@query
def dq_status_distribution(m):
    return Q.status_distribution(m.subscriptions)


@query
def dq_unique(m):
    return Q.duplicate_subscriptions(m.subscriptions)


@query
def dq_fk(m):
    return Q.foreign_keys(m.subscriptions, m.packages, m.payments,
                          m.raw("part").select(F.col("p_partkey").alias("id")))


@query
def dq_nulls(m):
    return Q.null_counts(m.subscriptions, ["id", "user_id", "package_id", "status", "amount",
                                           "created_at", "expires_at", "notes"])


# --- changes ------------------------------------------------------------------------------

def activation_requests(m: Market) -> DataFrame:
    return m.subscriptions.select(
        F.col("id").alias("request_id"), F.col("user_id").alias("actor_id"),
        F.col("id").alias("subscription_id"),
        F.expr("case id % 4 when 0 then id when 1 then id + 1000000000 end").alias("payment_id"))


def activation(m: Market) -> B.Change:
    return C.activate(m.subscriptions, m.payments, m.packages, m.providers, m.user_profiles,
                      activation_requests(m), AS_OF, cut=keep_counted)


@query
def activate_results(m):
    return activation(m).results


@query
def activate_subscriptions(m):
    return activation(m).state["subscriptions"]


@query
def activate_payments(m):
    return activation(m).state["payments"]


@query
def activate_providers(m):
    return activation(m).state["providers"]


def creation_requests(m: Market) -> DataFrame:
    return m.subscriptions.select(
        F.col("id").alias("request_id"),
        F.expr("case when id % 10 <> 9 then user_id end").alias("actor_id"),
        F.expr("(id * 7) % 27").alias("package_id"))


def creation(m: Market) -> B.Change:
    return C.create(m.subscriptions, m.packages, m.providers, m.user_profiles,
                    creation_requests(m), AS_OF, cut=keep_counted)


@query
def create_results(m):
    return creation(m).results.select(
        "request_id", "ok", "error", "message", "subscription_id", "user_id", "package_id",
        "package_name", "amount", "has_active_subscription", "current_package_name",
        "places_warning.has_warning", "places_warning.excess_places",
        F.col("places_warning.message").alias("warning_message"))


@query
def create_subscriptions(m):
    return creation(m).state["subscriptions"]


def payment_requests(m: Market) -> DataFrame:
    return m.payments.select(F.col("id").alias("request_id"), F.col("user_id").alias("actor_id"),
                             F.col("id").alias("payment_id"))


@query
def activate_v1(m):
    return C.activate_payments(m.payments, m.user_profiles, payment_requests(m), AS_OF,
                               cut=keep_counted).state["payments"]


@query
def cancel_v1_results(m):
    return C.cancel_payments(m.payments, m.user_profiles, payment_requests(m), AS_OF,
                             cut=keep_counted).results


@query
def create_v1(m):
    return C.create_payments(m.payments, m.packages, m.user_profiles, creation_requests(m),
                             AS_OF).state["payments"]


@query
def create_v1_paid_results(m):
    return C.create_payments(m.payments, m.packages, m.user_profiles, creation_requests(m),
                             AS_OF, paid=True).results


def cancellation(m: Market) -> B.Change:
    requests = m.subscriptions.select(
        F.col("id").alias("request_id"), F.col("user_id").alias("actor_id"),
        F.expr("case when id % 11 = 0 then id + 1000000000 else id end").alias("subscription_id"),
        F.col("notes").alias("reason"))
    return C.cancel(m.subscriptions, m.payments, m.user_profiles, requests, AS_OF, cut=keep_counted)


@query
def cancel_results(m):
    return cancellation(m).results


@query
def cancel_subscriptions(m):
    return cancellation(m).state["subscriptions"]


@query
def cancel_payments(m):
    return cancellation(m).state["payments"]


def one_of_each(m: Market) -> DataFrame:
    """Subscriptions as the uniqueness rule has them: of a user's rows of one package and status, that
    of the lowest id."""
    first = m.subscriptions.groupBy("user_id", "package_id", "status").agg(F.min("id").alias("id"))
    return keep_counted(m.subscriptions.join(first.select("id"), "id", "left_semi").select(
        *m.subscriptions.columns), "subscriptions")


def unique_activation(m: Market) -> B.Change:
    return C.activate(one_of_each(m), m.payments, m.packages, m.providers, m.user_profiles,
                      activation_requests(m), AS_OF, cut=keep_counted, unique=True)


def unique_creation(m: Market) -> B.Change:
    return C.create(one_of_each(m), m.packages, m.providers, m.user_profiles, creation_requests(m),
                    AS_OF, cut=keep_counted, unique=True)


def unique_cancellation(m: Market) -> B.Change:
    requests = m.subscriptions.select(
        F.col("id").alias("request_id"), F.col("user_id").alias("actor_id"),
        F.col("id").alias("subscription_id"), F.col("notes").alias("reason"))
    return C.cancel(one_of_each(m), m.payments, m.user_profiles, requests, AS_OF, cut=keep_counted, unique=True)


_VERDICT, _STATUS = ("request_id", "ok", "error"), ("id", "user_id", "package_id", "status")


@query
def unique_activate_results(m):
    return unique_activation(m).results.select(*_VERDICT)


@query
def unique_activate_subscriptions(m):
    return unique_activation(m).state["subscriptions"].select(*_STATUS)


@query
def unique_create_results(m):
    return unique_creation(m).results.select(*_VERDICT)


@query
def unique_create_subscriptions(m):
    return unique_creation(m).state["subscriptions"].select(*_STATUS)


@query
def unique_cancel_results(m):
    return unique_cancellation(m).results.select(*_VERDICT)


@query
def unique_cancel_subscriptions(m):
    return unique_cancellation(m).state["subscriptions"].select(*_STATUS)


@query
def unique_expire(m):
    """The sweep as one call, over the whole table as it is: rows that share a status refuse it."""
    return C.expire_unique(m.subscriptions, AS_OF, cut=keep_counted).results


def linking(m: Market) -> B.Change:
    requests = m.subscriptions.select(
        F.col("id").alias("request_id"), F.col("id").alias("subscription_id"),
        F.expr("case when id % 3 = 0 then id else id + 1 end").alias("payment_id"))
    return C.link_payments(m.subscriptions, m.payments, requests, AS_OF, cut=keep_counted)


@query
def link_results(m):
    return linking(m).results


@query
def link_subscriptions(m):
    return linking(m).state["subscriptions"]


@query
def expire_sweep(m):
    return C.expire(m.subscriptions, AS_OF)


@query
def expire_count(m):
    return C.expired_count(m.subscriptions, AS_OF)


def quota_requests(m: Market) -> DataFrame:
    return m.subscriptions.select(
        F.col("id").alias("request_id"),
        F.expr("case when id % 7 <> 0 then user_id - user_id % 4 end").alias("user_id"),
        F.expr("'new ' || cast(id as string)").alias("name"))


def quota_inserted(m: Market) -> B.Change:
    return K.insert_providers(m.providers, quota_requests(m), "subscriptions", m.subscriptions,
                              m.packages, AS_OF, cut=keep_counted)


@query
def quota_insert_results(m):
    return quota_inserted(m).results


@query
def quota_insert(m):
    return quota_inserted(m).state["providers"].select(
        "id", "name", "user_id", "status", "created_at")


def provider_patches(m: Market) -> DataFrame:
    return m.subscriptions.select(
        F.col("id").alias("request_id"), F.expr("id % 2500").alias("id"),
        F.expr("case when id % 3 <> 0 then id % 2500 - id % 4 end").alias("user_id"),
        F.expr("case when id % 2 = 0 then 'patched ' || cast(id as string) end").alias("name"),
        F.expr("case when id % 5 = 0 then status end").alias("city"))


@query
def patch_providers(m):
    return B.patch_providers(m.providers, provider_patches(m), AS_OF).state["table"]


@query
def patch_results(m):
    return B.patch_providers(m.providers, provider_patches(m), AS_OF).results


def stored_after(m: Market, name: str, rows: DataFrame, requests: DataFrame, change,
                 state: str = "table") -> tuple[DataFrame, DataFrame]:
    """A bucketed table of `rows` after a change that rewrites only the buckets it touches, and
    the change's results."""
    root = f"{shared_folder(m.spark)}/stored-{uuid.uuid4().hex}"
    BU.create(rows, root, name, buckets=32)
    results = BU.change_rows(m.spark, root, name, requests, change, version=2, state=state)
    return BU.stored(m.spark, root, name).rows(), results


def stored_patch(m: Market) -> tuple[DataFrame, DataFrame]:
    return stored_after(m, "providers", m.providers, provider_patches(m),
                        lambda rows, requests: B.patch_providers(rows, requests, AS_OF))


@query
def stored_patch_providers(m):
    return stored_patch(m)[0]


@query
def stored_patch_results(m):
    return stored_patch(m)[1]


@query
def stored_delete_providers(m):
    return stored_after(m, "providers", m.providers, provider_deletes(m), B.delete_providers)[0].select(
        "id", "name", "user_id")


def stored_upsert(m: Market) -> tuple[DataFrame, DataFrame]:
    return stored_after(
        m, "packages", m.packages, package_requests(m),
        lambda rows, requests: B.upsert_packages(rows, m.user_profiles, requests, AS_OF), "packages")


@query
def stored_upsert_packages(m):
    return stored_upsert(m)[0]


@query
def stored_set_status(m):
    requests = m.subscriptions.select(
        F.col("id").alias("request_id"), F.col("user_id").alias("actor_id"),
        F.expr("id % 2500").alias("id"), "status")
    return stored_after(m, "providers", m.providers, requests, lambda rows, asked: B.set_provider_status(
        rows, m.user_profiles, asked, AS_OF))[0].select("id", "status", "updated_at")


@query
def stored_added_activities(m):
    """Rows with new ids, added to a bucketed table twice and then compacted."""
    root = f"{shared_folder(m.spark)}/stored-{uuid.uuid4().hex}"
    new = m.activities.withColumn("id", F.col("id") + 1000)
    BU.create(m.activities, root, "activities", buckets=32)
    BU.add_rows(new.where("id % 2 = 0"), root, "activities", version=2)
    BU.add_rows(new.where("id % 2 = 1"), root, "activities", version=3)
    BU.compact(m.spark, root, "activities", version=4, most=1)
    return BU.stored(m.spark, root, "activities").rows()


@query
def appended_rows(m):
    """The new activities as the table's folder holds them after they were appended to it."""
    root = f"{shared_folder(m.spark)}/appended-{uuid.uuid4().hex}"
    m.activities.write.parquet(f"{root}/activities")
    added = T.append_rows(m.activities.withColumn("id", F.col("id") + 1000), root, "activities")
    return m.spark.read.schema(added.schema).parquet(f"{root}/activities")


def provider_deletes(m: Market) -> DataFrame:
    return m.user_profiles.select(
        F.col("id").alias("request_id"), F.expr("id - id % 2").alias("id"),
        F.expr("case when id % 2 = 0 then id - id % 8 end").alias("user_id"))


@query
def delete_providers(m):
    return B.delete_providers(m.providers, provider_deletes(m)).state["table"].select(
        "id", "name", "user_id")


@query
def delete_results(m):
    return B.delete_providers(m.providers, provider_deletes(m)).results


def package_requests(m: Market) -> DataFrame:
    return m.user_profiles.select(
        F.col("id").alias("request_id"), F.col("id").alias("actor_id"),
        F.expr("case when id % 5 <> 0 then id % 30 end").alias("id"),
        F.expr("'package ' || cast(id as string)").alias("name"),
        F.expr("cast(id as decimal(18,2))").alias("price"),
        F.expr("cast(id % 90 as int)").alias("duration_days"),
        F.expr("case when id % 3 = 0 then false end").alias("is_active"),
        F.expr("case when id % 2 = 0 then email end").alias("description"),
        F.expr("case when id % 4 = 0 then cast(id % 7 as int) end").alias("max_places"),
        F.expr("case when id % 6 = 0 then cast(id % 9 as int) end").alias("priority_weight"))


@query
def upsert_packages(m):
    return B.upsert_packages(m.packages, m.user_profiles, package_requests(m), AS_OF).state["packages"]


@query
def upsert_packages_results(m):
    return B.upsert_packages(m.packages, m.user_profiles, package_requests(m), AS_OF).results


@query
def enable_packages(m):
    return B.enable_packages(m.packages)


@query
def set_provider_status(m):
    requests = m.subscriptions.select(
        F.col("id").alias("request_id"), F.col("user_id").alias("actor_id"),
        F.expr("id % 2500").alias("id"), "status")
    return B.set_provider_status(m.providers, m.user_profiles, requests, AS_OF).state["table"].select(
        "id", "status", "updated_at")


@query
def set_user_role(m):
    requests = m.subscriptions.select(
        F.col("id").alias("request_id"), F.col("user_id").alias("actor_id"),
        F.expr("user_id + 1").alias("id"), F.col("notes").alias("role"))
    return B.set_user_role(m.user_profiles, requests).state["table"]


@query
def touched_providers(m):
    return B.touch(m.providers, B.approve_pending(m.providers), AS_OF).select("id", "status", "updated_at")


@query
def appended_activities(m):
    rows = m.activities.withColumn("id", F.col("id") + 1000)
    return B.append_rows(m.activities, rows).state["table"]


@query
def approve_pending(m):
    return B.approve_pending(m.providers).select("id", "status")


@query
def fill_roles(m):
    return B.fill_roles(m.user_profiles).select("id", "role")


@query
def append_providers(m):
    requests = m.favorites.select(
        F.col("id").alias("request_id"), F.expr("'place ' || cast(id as string)").alias("name"),
        "user_id", F.expr("id % 2 = 0").alias("online"))
    return B.append_providers(m.providers, requests, AS_OF).state["providers"].select(
        "id", "name", "user_id", "status", "created_at")


def spaced_requests(m):
    """A request per favourite, their numbers rising with gaps."""
    return m.favorites.select(F.expr("id * 7 + user_id % 5").alias("request_id"), "user_id",
                              F.expr("'service ' || cast(id as string)").alias("name"))


@query
def dense_standalone(m):
    change = B.append_standalone_services(m.providers, m.services, spaced_requests(m), AS_OF)
    return D.dense(change, {"providers": m.providers, "services": m.services}, DENSE_STANDALONE,
                   f"{shared_folder(m.spark)}/dense-{uuid.uuid4().hex}", 16).results


@query
def dense_services(m):
    change = B.append_standalone_services(m.providers, m.services, spaced_requests(m), AS_OF)
    return D.dense(change, {"providers": m.providers, "services": m.services}, DENSE_STANDALONE,
                   f"{shared_folder(m.spark)}/dense-{uuid.uuid4().hex}", 16).state["services"].select(
        "id", "provider_id", "name")


def owner_parts(m):
    """The owners' bitmaps, made in two deliveries, as a table of days."""
    run = f"{shared_folder(m.spark)}/owners-{uuid.uuid4().hex}"
    early = F.coalesce(F.col("created_at") < F.lit(AS_OF - timedelta(days=20)), F.lit(False))
    known = keep(O.number_owners(m.providers.filter(early), f"{run}/1", ranges=16))
    numbers = keep(O.number_owners(m.providers, f"{run}/2", known, ranges=16))
    parts = [keep(O.owner_days(m.providers.filter(early), known)),
             keep(O.owner_days(m.providers.filter(~early), numbers))]
    return parts[0].unionByName(parts[1])


@query
def total_owners(m):
    return O.owners(owner_parts(m))


@query
def owners_per_status(m):
    return O.owners(owner_parts(m), ["status"], until=(AS_OF - timedelta(days=7)).date())


@query
def append_services(m):
    requests = m.favorites.select(
        F.col("id").alias("request_id"), "provider_id",
        F.expr("'service ' || cast(id as string)").alias("name"),
        F.expr("case when id % 3 = 0 then cast(id as decimal(18,2)) end").alias("price"))
    return B.append_services(m.services, requests, AS_OF).state["services"].select(
        "id", "provider_id", "name", "price", "delivery", "online", "created_at")


@query
def append_standalone(m):
    requests = m.favorites.select(
        F.col("id").alias("request_id"), F.expr("'service ' || cast(id as string)").alias("name"),
        F.expr("case when id % 2 = 0 then 'place ' || cast(id as string) end").alias("provider_name"),
        "user_id")
    return B.append_standalone_services(m.providers, m.services, requests, AS_OF).results


@query
def append_profiles(m):
    visitors = m.favorites.select((F.col("user_id") * 20).alias("id"))
    return B.append_profiles(m.user_profiles, visitors, AS_OF).select("id", "full_name", "role")


@query
def append_settings(m):
    requests = m.user_profiles.select(
        F.col("id").alias("request_id"), F.col("id").alias("actor_id"),
        F.col("full_name").alias("bank_name"), F.col("email").alias("bank_account"),
        F.lit(None).cast("string").alias("account_name"),
        F.lit(None).cast("string").alias("mobile_wallet"), F.col("role").alias("instructions"))
    return B.append_settings(m.payment_settings, m.user_profiles, requests, AS_OF).state["payment_settings"]


@query
def manual_payments(m):
    requests = m.subscriptions.select(
        F.col("id").alias("request_id"), F.col("user_id").alias("actor_id"),
        F.expr("user_id + 1").alias("user_id"), F.expr("id % 30").alias("package_id"),
        F.expr("case when id % 2 = 0 then amount end").alias("amount"))
    return B.append_manual_payments(m.payments, m.packages, m.user_profiles, requests,
                                    AS_OF).state["payments"].select(
        "id", "user_id", "package_id", "status", "amount", "completed_at")


@query
def record_visits(m):
    requests = m.favorites.select(F.col("id").alias("request_id"),
                                  S.place_page(F.col("provider_id")).alias("page"))
    return B.record_visits(m.visits, requests, AS_OF_VISITS, cut=keep).results


# --- one user, one page, one place; forms; policies; deletes -------------------------------

ONE_USER, ONE_ADMIN, ONE_PLACE = 40, 20, 7


@query
def user_stats_of_one(m):
    return R.users_with_stats(m.user_profiles, m.providers, m.services, "subscriptions", m.subscriptions,
                              m.packages, AS_OF, user_id=ONE_USER)


@query
def visits_of_one_page(m):
    return W.page_visits(m.visits, f"/place/{ONE_PLACE}", AS_OF_VISITS)


@query
def visits_of_listed_pages(m):
    pages = W.pages_frame(m.spark, ["/place/7", "/service/3", "/none"])
    return W.pages_visits(pages, m.visits, AS_OF_VISITS).withColumn("position", F.col("position").cast("int"))


def _services_of_place(sort: str) -> Query:
    return lambda m: L.services_of_provider(m.services, ONE_PLACE, only="online", sort=sort)


QUERIES |= {f"services_of_place_{sort}": _services_of_place(sort)
            for sort in ("latest", "price_asc", "price_desc")}


@query
def package_cards_of_one(m):
    entitled = E.user_package(users(m), "subscriptions", m.subscriptions, m.packages, AS_OF)
    states = L.package_cards(m.packages, entitled, L.pending_packages(m.subscriptions, ONE_USER))
    return L.package_cards_of(m.packages, states, ONE_USER)


@query
def provider_by_id(m):
    return L.by_id(m.providers, ONE_PLACE, L.CARD)


@query
def place_cards(m):
    return L.projection(m.providers, [c for c in L.PLACE_CARD if c in m.providers.columns])


@query
def package_terms(m):
    return L.projection(m.packages, [c for c in L.PACKAGE_CARD if c in m.packages.columns
                                     and not c.endswith("_limit")])


@query
def fallback_places(m):
    return L.fallback_rows(m.providers, ["id", "name", "city", "category", "status", "created_at"], "active")


@query
def fallback_services(m):
    return L.fallback_rows(m.services, L.SERVICE_DETAIL)


@query
def known_tables(m):
    return T.known_tables(m.spark, m.tables())


def _of_two(m: Market, rows_of) -> DataFrame:
    frames = [rows_of(p).withColumn("principal", F.lit(p).cast("bigint")) for p in (ONE_ADMIN, ONE_USER)]
    return frames[0].unionByName(frames[1])


@query
def subscriptions_seen_by_two(m):
    return _of_two(m, lambda p: X.visible_rows(
        "subscriptions", m.subscriptions, m.user_profiles, p).select("id", "user_id"))


@query
def subscriptions_written_by_two(m):
    def written(principal):
        parts = [X.writable_rows(a, m.subscriptions, m.user_profiles, principal).select(
            F.lit(a).alias("action"), "id") for a in ("insert", "update", "delete")]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    return _of_two(m, written)


@query
def profile_seen_by_owner(m):
    return X.visible_rows("user_profiles", m.user_profiles, m.user_profiles, ONE_USER).select(
        "id", "full_name")


@query
def payment_instructions_default(m):
    wallets = m.payment_settings.filter("mobile_wallet is not null")
    defaults = {"bank_name": "House bank", "bank_account": "0001", "instructions": "ask at the desk"}
    return R.payment_instructions(m.packages, wallets, defaults).select(
        "package_id", "package_name", "amount", "status", "message", "payment_info.*")


@query
def service_forms(m):
    forms = m.services.select(
        F.col("id").alias("request_id"), F.col("provider_id").cast("string").alias("provider_id"), "name",
        F.expr("case when description = 'N' then '' else description end").alias("description"),
        F.expr("case when id % 5 = 0 then '' when id % 5 = 1 then '0' when id % 5 = 2 then 'free' "
               "else cast(price as string) end").alias("price"),
        F.lit("").alias("image_url"))
    return B.append_services(m.services, B.service_requests(forms), AS_OF).state["services"].select(
        "id", "provider_id", "name", "description", "price", "image_url")


@query
def payment_instructions_json(m):
    return R.payment_instructions(m.packages, m.payment_settings).select("package_id", "item")


@query
def create_profiles(m):
    return creation(m).state["user_profiles"].select("id", "full_name", "role")


@query
def create_payment_info(m):
    change = C.create(m.subscriptions, m.packages, m.providers, m.user_profiles, creation_requests(m),
                      AS_OF, settings=m.payment_settings, cut=keep_counted)
    return change.results.filter("ok").select("request_id", "payment_info.bank_name",
                                              "payment_info.bank_account")


def standalone(m: Market) -> B.Change:
    requests = m.favorites.select(
        F.col("id").alias("request_id"), "user_id",
        F.concat(F.lit("service "), F.col("id").cast("string")).alias("name"))
    return B.append_standalone_services(m.providers, m.services, requests, AS_OF)


@query
def standalone_providers(m):
    return standalone(m).state["providers"].select("id", "name", "user_id", "status")


@query
def standalone_services(m):
    return standalone(m).state["services"].select("id", "provider_id", "name")


@query
def default_packages(m):
    admin = m.user_profiles.filter(P.is_admin()).agg(F.min("id")).scalar()
    requests = B.default_packages(m.spark).withColumn("actor_id", admin)
    return B.upsert_packages(m.packages, m.user_profiles, requests, AS_OF).state["packages"].select(
        "id", "name", "price", "duration_days", "max_places", "priority_weight", "is_active", "description")


@query
def toggle_packages(m):
    ids = m.user_profiles.select(F.col("id").alias("request_id"), F.col("id").alias("actor_id"),
                                 F.expr("id % 25").alias("id"))
    requests = B.toggle_requests(m.packages, ids)
    return B.upsert_packages(m.packages, m.user_profiles, requests, AS_OF).state["packages"].select(
        "id", "name", "price", "duration_days", "is_active", "description", "max_places", "priority_weight")


@query
def patch_services(m):
    requests = m.subscriptions.select(
        F.col("id").alias("request_id"), "id", F.col("notes").alias("name"),
        F.expr("case when id % 3 = 0 then amount end").alias("price"),
        F.expr("case when id % 2 = 0 then true end").alias("online"))
    return B.patch_services(m.services, requests).state["table"].select(
        "id", "provider_id", "name", "price", "online")


@query
def delete_services(m):
    requests = m.subscriptions.select(F.col("id").alias("request_id"), "id")
    return B.delete(m.services, requests).state["table"].select("id", "provider_id")


def package_deletes(m: Market) -> B.Change:
    requests = m.user_profiles.select(F.col("id").alias("request_id"), F.col("id").alias("actor_id"),
                                      F.expr("id % 30").alias("id"))
    return B.delete_packages(m.packages, m.user_profiles, requests, m.subscriptions)


@query
def delete_packages(m):
    return package_deletes(m).state["packages"].select("id", "name")


@query
def delete_packages_results(m):
    return package_deletes(m).results


@query
def delete_payments(m):
    requests = m.user_profiles.select(F.col("id").alias("request_id"), "id")
    return B.delete_payments(m.payments, m.subscriptions, requests).state["subscriptions"].select(
        "id", "payment_id")


@query
def delete_profiles(m):
    requests = m.user_profiles.filter(P.is_admin()).select(F.col("id").alias("request_id"), "id")
    return B.delete_profiles(m.user_profiles, m.subscriptions, requests).state["subscriptions"].select(
        "id", "user_id")


@query
def package_defaults(m):
    defaults = {"is_active": F.lit(True), "max_places": F.lit(1), "priority_weight": F.lit(0)}
    return Q.with_defaults(m.packages, defaults).select("id", *defaults)


@query
def package_forms(m):
    forms = m.user_profiles.select(
        F.col("id").alias("request_id"), F.col("id").alias("actor_id"), F.col("full_name").alias("name"),
        F.col("email").alias("price"),
        F.expr("case when id % 3 = 0 then 'x' else cast(id as string) end").alias("duration_days"),
        F.lit("").alias("description"), F.lit("").alias("max_places"), F.lit("0").alias("priority_weight"))
    return B.package_requests(forms).select("request_id", "name", "price",
                                            F.col("duration_days").cast("bigint").alias("duration_days"))


def prepared(spark: SparkSession) -> SparkSession:
    """Times of day are UTC whatever the machine's zone is."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        name: lambda spark, sf_dir, fn=fn: fn(Market(prepared(spark), sf_dir))
        for name, fn in QUERIES.items()
    }
