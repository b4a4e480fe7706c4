"""Append, patch, delete, upsert and bulk rules."""

from collections.abc import Callable, Mapping
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ...config import Cut, as_is
from ...functions import fixed_values as V
from ...functions import predicates as P
from ...functions.clock import stamp
from ...functions.scalars import blank_to_null, normalize_role, number_or
from ..security import with_actor
from ..visits import visits_per_page


class State(Mapping):
    """New state frames by table name, each planned when first asked for."""

    def __init__(self, **frames: Callable[[], DataFrame]):
        self._plans = frames
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._plans[name]()
        return self._frames[name]

    def __iter__(self):
        return iter(self._plans)

    def __len__(self) -> int:
        return len(self._plans)


class Change(NamedTuple):
    """New state frames by table name, and one result row per request."""

    state: Mapping[str, DataFrame]
    results: DataFrame


# --- ids and rows -------------------------------------------------------------------

def new_ids(table: DataFrame, requests: DataFrame, request_id: str = "request_id") -> Column:
    """Ids for new rows: above the table's highest, in request order.

    The distance of each request from the first of its batch is added to the
    highest id, so ids are unique and rising with no sort, no shuffle and no
    numbering on one task. Requests that add no row leave a gap, as a database
    sequence does.
    """
    highest = table.agg(F.coalesce(F.max("id"), F.lit(0).cast("bigint"))).scalar()
    first = requests.agg(F.min(request_id)).scalar()
    return highest + (F.col(request_id) - first) + F.lit(1).cast("bigint")


def rows_like(table: DataFrame, source: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Rows shaped like `table`: given values, the rest NULL."""
    return source.select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema.fields
    ])


def param(requests: DataFrame, name: str, default: Column | None = None) -> Column:
    """A call parameter; one left out of the batch takes its default."""
    if name not in requests.columns:
        return default if default is not None else F.lit(None)
    return F.col(name)


def result(allowed: Column, error: Column) -> list[Column]:
    """The `ok` and `error` columns of a results frame."""
    problem = F.when(~allowed, F.lit(V.FORBIDDEN)).otherwise(error)
    return [problem.isNull().alias("ok"), problem.alias("error")]


def no_error() -> Column:
    return F.lit(None).cast("string")


# --- appends ------------------------------------------------------------------------

PROVIDER_FIELDS = [
    "name", "category", "city", "address", "phone", "website", "whatsapp", "map_url",
    "description", "image_url", "lat", "lng", "type", "area", "user_id", "activity_id",
    "package_id",
]


def append_rows(table: DataFrame, rows: DataFrame) -> Change:
    """Append given rows as they are and return them."""
    added = rows_like(table, rows, {c: F.col(c) for c in rows.columns})
    return Change({"table": table.unionByName(added)}, added)


def append_providers(providers: DataFrame, requests: DataFrame, as_of: datetime,
                     batch: DataFrame | None = None) -> Change:
    """New places wait for approval, whatever the caller asks for.

    `batch` is the whole batch when `requests` is only the accepted part of it.
    """
    keyed = requests.withColumn("_id", new_ids(providers, requests if batch is None else batch))
    no = F.lit(False)
    values = {c: param(requests, c) for c in PROVIDER_FIELDS if c in providers.columns}
    values |= {
        "id": F.col("_id"), "status": F.lit("pending"),
        "delivery": param(requests, "delivery", no),
        "online_service": param(requests, "online", no),
        "created_at": stamp(as_of, providers.schema["created_at"].dataType),
    }
    added = rows_like(providers, keyed, values)
    results = keyed.select("request_id", F.lit(True).alias("ok"), no_error().alias("error"),
                           F.col("_id").alias("provider_id"))
    return Change({"providers": providers.unionByName(added)}, results)


def append_services(services: DataFrame, requests: DataFrame, as_of: datetime) -> Change:
    keyed = requests.withColumn("_id", new_ids(services, requests))
    results = keyed.select("request_id", F.lit(True).alias("ok"), no_error().alias("error"),
                           F.col("_id").alias("service_id"))
    added = _service_rows(services, keyed, requests, F.col("provider_id"), as_of)
    return Change({"services": services.unionByName(added)}, results)


def _service_rows(services: DataFrame, keyed: DataFrame, requests: DataFrame,
                  provider_id: Column, as_of: datetime) -> DataFrame:
    no = F.lit(False)
    return rows_like(services, keyed, {
        "id": F.col("_id"), "provider_id": provider_id, "name": F.col("name"),
        "description": param(requests, "description"), "price": param(requests, "price"),
        "image_url": param(requests, "image_url"), "delivery": param(requests, "delivery", no),
        "online": param(requests, "online", no),
        "created_at": stamp(as_of, services.schema["created_at"].dataType),
    })


def append_standalone_services(providers: DataFrame, services: DataFrame, requests: DataFrame,
                               as_of: datetime) -> Change:
    """Each request makes an online place and a service that belongs to it."""
    keyed = requests.withColumn("_provider", new_ids(providers, requests)).withColumn(
        "_id", new_ids(services, requests))
    place = rows_like(providers, keyed, {
        "id": F.col("_provider"),
        "name": F.coalesce(param(requests, "provider_name"), F.col("name")),
        "city": param(requests, "city"), "category": param(requests, "category"),
        "status": F.lit("pending"), "user_id": param(requests, "user_id"),
        "created_at": stamp(as_of, providers.schema["created_at"].dataType),
        "online_service": F.lit(True),
    })
    service = _service_rows(services, keyed, requests, F.col("_provider"), as_of)
    results = keyed.select("request_id", F.lit(True).alias("ok"), no_error().alias("error"),
                           F.col("_provider").alias("provider_id"), F.col("_id").alias("service_id"))
    return Change({"providers": providers.unionByName(place),
                   "services": services.unionByName(service)}, results)


def append_profiles(profiles: DataFrame, users: DataFrame, as_of: datetime) -> DataFrame:
    """Profiles for users that have none; existing ones are left alone.

    `users` has `id` and may have `full_name`, which defaults to a fixed name.
    """
    name = F.coalesce(param(users, "full_name"), F.lit(V.NEW_USER))
    fresh = users.filter(F.col("id").isNotNull()).withColumn("_name", name).groupBy("id").agg(
        F.min("_name").alias("_name")).join(profiles.select("id"), "id", "left_anti")
    values = {"id": F.col("id"), "full_name": F.col("_name"), "role": F.lit(V.DEFAULT_ROLE)}
    if "created_at" in profiles.columns:
        values["created_at"] = stamp(as_of, profiles.schema["created_at"].dataType)
    return profiles.unionByName(rows_like(profiles, fresh, values))


def append_settings(settings: DataFrame, profiles: DataFrame, requests: DataFrame,
                    as_of: datetime) -> Change:
    """New versions of the payment settings; the newest is the one in force."""
    judged = with_actor(requests, profiles, P.is_admin()).withColumn(
        "_id", new_ids(settings, requests))
    fields = ["bank_name", "bank_account", "account_name", "mobile_wallet", "instructions"]
    added = rows_like(settings, judged.filter("_allowed"), {
        "id": F.col("_id"), **{c: F.col(c) for c in fields},
        "updated_at": stamp(as_of, settings.schema["updated_at"].dataType),
    })
    results = judged.select("request_id", *result(F.col("_allowed"), no_error()),
                            F.when(F.col("_allowed"), F.col("_id")).alias("id"))
    return Change({"payment_settings": settings.unionByName(added)}, results)


#: Requests of a page that stand in one window, by request_id.
VISIT_BLOCK = 100_000


def record_visits(visits: DataFrame, requests: DataFrame, as_of: datetime,
                  cut: Cut = as_is) -> Change:
    """Append visits; each result carries its page's counts as its call finds them, its own
    visit and those of earlier calls of the batch included.

    A page's calls are numbered in blocks of request ids, and a block starts from what the
    blocks before it add up to, so the calls of one page spread over tasks. With
    `cut=config.keep` the counts are written tables, which lets Spark split the joins too.
    """
    fields = ["page", "ip_address", "device", "source", "country"]
    keyed = requests.withColumn("_id", new_ids(visits, requests))
    added = rows_like(visits, keyed, {
        "id": F.col("_id"), **{c: param(requests, c) for c in fields if c in visits.columns},
        "created_at": stamp(as_of, visits.schema["created_at"].dataType),
    })
    state = visits.unionByName(added)
    asked = requests.select("request_id", "page", F.floor(
        F.col("request_id") / VISIT_BLOCK).alias("_block"))
    sizes = asked.groupBy("page", "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("page").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sizes.select("page", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0))
                              .alias("_start")).join(
        visits_per_page(visits.join(requests.select("page"), "page", "left_semi"), as_of),
        "page", "left").withColumnsRenamed({"page": "_page", "_block": "_in"}))
    place = F.row_number().over(Window.partitionBy("page", "_block").orderBy("request_id"))
    count = F.col("_start") + F.col("_place")
    counted = asked.withColumn("_place", place).join(
        starts, F.col("page").eqNullSafe(F.col("_page")) & (F.col("_block") == F.col("_in")))
    known = F.col("page").isNotNull()
    results = counted.select(
        "request_id", F.lit(True).alias("ok"), no_error().alias("error"), "page",
        *[F.when(known, F.coalesce(c, F.lit(0)) + count).otherwise(F.lit(0)).alias(c)
          for c in ("total_visits", "today_visits")])
    return Change({"visits": state}, results)


def append_manual_payments(payments: DataFrame, packages: DataFrame, profiles: DataFrame,
                           requests: DataFrame, as_of: datetime) -> Change:
    """An admin grants a package: a completed payment at the given amount or the price."""
    prices = packages.select(F.col("id").alias("package_id"), F.col("price").alias("_price"))
    judged = with_actor(requests, profiles, P.is_admin()).join(
        prices, "package_id", "left").withColumn("_id", new_ids(payments, requests))
    unknown = F.when(F.col("_price").isNull(), F.concat(
        F.lit(V.UNKNOWN_PACKAGE_ID), F.coalesce(F.col("package_id").cast("string"), F.lit("<NULL>"))))
    ok = F.col("_allowed") & F.col("_price").isNotNull()
    added = rows_like(payments, judged.filter(ok), {
        "id": F.col("_id"), "user_id": F.col("user_id"), "package_id": F.col("package_id"),
        "status": F.lit("completed"), "amount": F.coalesce("amount", "_price"),
        "completed_at": stamp(as_of, payments.schema["completed_at"].dataType),
    })
    results = judged.select("request_id", *result(F.col("_allowed"), unknown),
                            F.when(ok, F.col("_id")).alias("payment_id"))
    return Change({"payments": payments.unionByName(added)}, results)


# --- patch and delete ---------------------------------------------------------------

PROVIDER_PATCH = [
    "name", "category", "city", "address", "phone", "website", "whatsapp", "map_url",
    "description", "image_url", "lat", "lng", "type", "delivery", "area",
]
SERVICE_PATCH = ["name", "description", "price", "image_url", "delivery", "online"]


def _matched(state: DataFrame, requests: DataFrame, owner: str | None) -> DataFrame:
    """Requests with `_found`: whether their row exists and, if asked, has that owner.

    The table meets one row per id and owner asked for, however many requests there
    are for it; the answers go back to the requests as rows of a plain join.
    """
    keys = ["id"] if owner is None or owner not in requests.columns else ["id", owner]
    asked = requests.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    rows = asked.join(state.select(*[F.col(c).alias(f"_state_{c}") for c in keys]),
                      F.col("_id") == F.col("_state_id"))
    if owner in keys:
        mine = F.col(f"_{owner}")
        rows = rows.filter(mine.isNull() | (mine == F.col(f"_state_{owner}")))
    found = rows.select(*[f"_{c}" for c in keys]).distinct().withColumn("_found", F.lit(True))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys]
    return requests.join(found, same, "left").drop(*[f"_{c}" for c in keys]).withColumn(
        "_found", P.truthy("_found"))


def patch(state: DataFrame, requests: DataFrame, fields: list[str], owner: str | None = None,
          touched_at: str | None = None, as_of: datetime | None = None) -> Change:
    """Set the given fields where the request has a value; NULL leaves a field alone.

    Several patches of one row act in request order: per field the last value
    given wins, found by one aggregate.
    """
    fields = [c for c in fields if c in requests.columns and c in state.columns]
    judged = _matched(state, requests, owner)
    last = judged.filter("_found").groupBy("id").agg(
        F.lit(True).alias("_hit"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("request_id"))).alias(f"_{c}")
          for c in fields])
    changed = {c: F.coalesce(F.col(f"_{c}"), F.col(c)).cast(state.schema[c].dataType)
               for c in fields}
    if touched_at is not None:
        now = stamp(as_of, state.schema[touched_at].dataType)
        changed[touched_at] = F.when(F.col("_hit"), now).otherwise(F.col(touched_at))
    new = state.join(last, "id", "left").select(
        *[changed.get(c, F.col(c)).alias(c) for c in state.columns])
    results = judged.select("request_id", "id", F.col("_found").alias("found"))
    return Change({"table": new}, results)


def patch_providers(providers: DataFrame, requests: DataFrame, as_of: datetime) -> Change:
    """A request that names a user only reaches that user's own place."""
    touched = "updated_at" if "updated_at" in providers.columns else None
    return patch(providers, requests, PROVIDER_PATCH, "user_id", touched, as_of)


def patch_services(services: DataFrame, requests: DataFrame) -> Change:
    return patch(services, requests, SERVICE_PATCH)


def delete(state: DataFrame, requests: DataFrame, owner: str | None = None) -> Change:
    """Remove rows by id; only the first request for a row finds it."""
    judged = _matched(state, requests, owner)
    first = judged.filter("_found").groupBy("id").agg(F.min("request_id").alias("request_id"))
    hit = first.select("request_id").withColumn("found", F.lit(True))
    results = judged.select("request_id", "id").join(hit, "request_id", "left").select(
        "request_id", "id", P.truthy("found").alias("found"))
    return Change({"table": state.join(first.select("id"), "id", "left_anti")}, results)


def delete_providers(providers: DataFrame, requests: DataFrame) -> Change:
    return delete(providers, requests, "user_id")


PACKAGE_IN_USE = "the package is in use"


def delete_packages(packages: DataFrame, profiles: DataFrame, requests: DataFrame,
                    subscriptions: DataFrame) -> Change:
    """Admins delete packages; one that a subscription refers to cannot go."""
    judged = with_actor(requests, profiles, P.is_admin())
    used = subscriptions.groupBy(F.col("package_id").alias("id")).agg(F.lit(True).alias("_used"))
    asked = judged.filter("_allowed").select("id").distinct().join(used, "id", "left")
    held = asked.filter("_used").select(F.col("id").alias("_held"))
    gone = asked.filter("_used IS NULL").select("id")
    error = F.when(F.col("_held").isNotNull(), F.lit(PACKAGE_IN_USE))
    results = judged.join(held, judged["id"] == held["_held"], "left").select(
        "request_id", "id", *result(F.col("_allowed"), error))
    return Change({"packages": packages.join(gone, "id", "left_anti")}, results)


def delete_payments(payments: DataFrame, subscriptions: DataFrame, requests: DataFrame) -> Change:
    """Remove payments by id; subscriptions that name one lose the reference."""
    change = delete(payments, requests)
    gone = requests.select(F.col("id").alias("payment_id")).distinct().withColumn(
        "_gone", F.lit(True))
    kept = F.when(F.col("_gone").isNull(), F.col("payment_id"))
    state = subscriptions.join(gone, "payment_id", "left").withColumn("payment_id", kept)
    return Change({"payments": change.state["table"],
                   "subscriptions": state.select(*subscriptions.columns)}, change.results)


def delete_profiles(profiles: DataFrame, subscriptions: DataFrame, requests: DataFrame) -> Change:
    """Remove profiles by id; their subscriptions go with them."""
    change = delete(profiles, requests)
    gone = requests.select(F.col("id").alias("user_id")).distinct()
    return Change({"user_profiles": change.state["table"],
                   "subscriptions": subscriptions.join(gone, "user_id", "left_anti")},
                  change.results)


# --- admin settings -----------------------------------------------------------------

def upsert_packages(packages: DataFrame, profiles: DataFrame, requests: DataFrame,
                    as_of: datetime) -> Change:
    """A request without id adds a package, one with an id replaces its terms.

    On replacement a NULL keeps the old value for `is_active`, `max_places` and
    `priority_weight` only; the other terms become NULL. Several requests for a
    package act in request order.
    """
    terms = ("name", "price", "duration_days", "description")
    replaced = [c for c in terms if c in packages.columns and c in requests.columns]
    kept = ["is_active", "max_places", "priority_weight"]
    judged = with_actor(requests, profiles, P.is_admin()).withColumn(
        "_new", new_ids(packages, requests))
    allowed = judged.filter("_allowed")

    defaults = {"is_active": F.lit(True), "max_places": F.lit(V.FORM_MAX_PLACES),
                "priority_weight": F.lit(V.FORM_WEIGHT)}
    values = {"id": F.col("_new"), **{c: F.col(c) for c in replaced},
              **{c: F.coalesce(F.col(c), d) for c, d in defaults.items()}}
    if "created_at" in packages.columns:
        values["created_at"] = stamp(as_of, packages.schema["created_at"].dataType)
    added = rows_like(packages, allowed.filter(F.col("id").isNull()), values)

    last = allowed.filter(F.col("id").isNotNull()).groupBy("id").agg(
        F.lit(True).alias("_hit"),
        F.max_by(F.struct(*replaced), "request_id").alias("_terms"),
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("request_id"))).alias(f"_{c}")
          for c in kept])
    changed = {c: F.when(F.col("_hit"), F.col(f"_terms.{c}")).otherwise(F.col(c)) for c in replaced}
    changed |= {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in kept}
    updated = packages.join(last, "id", "left").select(*[
        changed.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name)
        for f in packages.schema.fields])

    known = packages.select("id", F.col("id").alias("_known"))
    results = judged.join(known, "id", "left").select(
        "request_id", *result(F.col("_allowed"), no_error()),
        F.when(F.col("_allowed"), F.when(F.col("id").isNull(), F.col("_new")).otherwise(
            F.col("_known"))).alias("package_id"))
    return Change({"packages": updated.unionByName(added)}, results)


def package_requests(forms: DataFrame) -> DataFrame:
    """Upsert requests for new packages out of form texts: blank, unreadable and zero
    numbers take their defaults, a blank description none, a blank name drops the form."""
    name = F.trim("name")
    return forms.filter(name != "").select(
        "request_id", "actor_id", F.lit(None).cast("bigint").alias("id"), name.alias("name"),
        number_or(F.col("price"), "decimal(18,2)", V.FORM_PRICE).alias("price"),
        number_or(F.col("duration_days"), "int", V.FORM_DURATION).alias("duration_days"),
        F.lit(True).alias("is_active"),
        blank_to_null(F.trim("description")).alias("description"),
        number_or(F.col("max_places"), "int", V.FORM_MAX_PLACES).alias("max_places"),
        number_or(F.col("priority_weight"), "int", V.FORM_WEIGHT).alias("priority_weight"))


def service_requests(forms: DataFrame) -> DataFrame:
    """Requests for new services out of form texts; a price of zero is no price."""
    return forms.select(
        "request_id", F.col("provider_id").try_cast("bigint").alias("provider_id"), "name",
        blank_to_null(F.col("description")).alias("description"),
        number_or(F.col("price"), "decimal(18,2)", None).alias("price"),
        blank_to_null(F.col("image_url")).alias("image_url"))


def toggle_requests(packages: DataFrame, ids: DataFrame) -> DataFrame:
    """Upsert requests that flip `is_active`; `ids` has request_id, actor_id and id."""
    rows = ids.join(packages, "id").withColumn("is_active", ~P.truthy("is_active"))
    if "description" in packages.columns:
        rows = rows.withColumn("description", blank_to_null(F.col("description")))
    return rows.withColumns({
        "max_places": F.coalesce("max_places", F.lit(V.FORM_MAX_PLACES)),
        "priority_weight": F.coalesce("priority_weight", F.lit(V.FORM_WEIGHT)),
    })


def default_packages(spark: SparkSession) -> DataFrame:
    """The three packages a new marketplace starts with, as upsert parameters."""
    return spark.createDataFrame(
        [(i, None, *row) for i, row in enumerate(V.DEFAULT_PACKAGES, 1)],
        "request_id bigint, id bigint, name string, price string, duration_days int,"
        " max_places int, priority_weight int, is_active boolean, description string",
    ).withColumn("price", F.col("price").cast("decimal(18,2)"))


def set_field(table: DataFrame, profiles: DataFrame, requests: DataFrame, field: str, rule: Column,
              touched_at: str | None = None, as_of: datetime | None = None) -> Change:
    """Set one field by id, the last request for a row wins. Roles are read as they
    were before the batch."""
    judged = with_actor(requests, profiles, rule)
    last = judged.filter("_allowed").groupBy("id").agg(
        F.max_by(F.struct(field), "request_id").alias("_last"))
    hit = F.col("_last").isNotNull()
    changed = {field: F.when(hit, F.col(f"_last.{field}")).otherwise(F.col(field))}
    if touched_at is not None and touched_at in table.columns:
        now = stamp(as_of, table.schema[touched_at].dataType)
        changed[touched_at] = F.when(hit, now).otherwise(F.col(touched_at))
    new = table.join(last, "id", "left").select(
        *[changed.get(c, F.col(c)).alias(c) for c in table.columns])
    results = judged.select("request_id", "id", *result(F.col("_allowed"), no_error()))
    return Change({"table": new}, results)


def set_provider_status(providers: DataFrame, profiles: DataFrame, requests: DataFrame,
                        as_of: datetime) -> Change:
    return set_field(providers, profiles, requests, "status", P.is_admin(), "updated_at", as_of)


def set_user_role(profiles: DataFrame, requests: DataFrame) -> Change:
    """Only the role that edits roles may; the other admin role may not."""
    return set_field(profiles, profiles, requests, "role", P.edits_roles())


# --- bulk rules ---------------------------------------------------------------------

def approve_pending(providers: DataFrame) -> DataFrame:
    return providers.withColumn("status", F.when(
        P.equals("status", "pending"), F.lit("active")).otherwise(F.col("status")))


def fill_roles(profiles: DataFrame) -> DataFrame:
    missing = F.col("role").isNull() | P.equals("role", "")
    return profiles.withColumn("role", F.when(missing, F.lit(V.DEFAULT_ROLE)).otherwise(F.col("role")))


def enable_packages(packages: DataFrame) -> DataFrame:
    """Enable every package that is not; missing limits of those take their defaults."""
    off = ~P.truthy("is_active")
    if "description" in packages.columns:
        packages = packages.withColumn("description", F.when(
            off, blank_to_null(F.col("description"))).otherwise(F.col("description")))
    return packages.withColumns({
        "max_places": F.when(off, F.coalesce("max_places", F.lit(V.FORM_MAX_PLACES))).otherwise(
            F.col("max_places")),
        "priority_weight": F.when(off, F.coalesce("priority_weight", F.lit(V.FORM_WEIGHT))).otherwise(
            F.col("priority_weight")),
        "is_active": F.lit(True),
    })


def admin_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles that pass the admin gate, which reads roles case-blind and trimmed."""
    return profiles.filter(normalize_role(F.col("role")).isin(*V.ADMIN_ROLES))


def touch(before: DataFrame, after: DataFrame, as_of: datetime, column: str = "updated_at") -> DataFrame:
    """Set `column` on every row of `after` that differs from the row with its id in `before`."""
    fields = [c for c in before.columns if c not in ("id", column)]
    old = before.select("id", F.struct(*fields).alias("_old"))
    now = stamp(as_of, after.schema[column].dataType)
    same = F.col("_old").eqNullSafe(F.struct(*fields))
    return after.join(old, "id", "left").withColumn(
        column, F.when(F.col("_old").isNull() | same, F.col(column)).otherwise(now)
    ).select(*after.columns)
