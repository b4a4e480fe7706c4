"""New places against the owner's quota."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...config import Cut, as_is
from ...functions import fixed_values as V
from ...functions.scalars import fill
from ..entitlement import Basis, places_per_user, place_quota
from ..skew import first_per_key, join_unique
from .base import Change, State, append_providers, new_ids


def insert_providers(providers: DataFrame, requests: DataFrame, basis: Basis, source: DataFrame,
                     packages: DataFrame, as_of: datetime, cut: Cut = as_is) -> Change:
    """Add new places as far as each owner's quota goes, in request order.

    Places without an owner are always added. A rejected request reports the
    owner's places at that point (the quota, once the batch has used it up). Requests
    are used several times; `cut=config.settle` derives them once.
    """
    requests = cut(requests)
    owners = requests.filter(F.col("user_id").isNotNull()).select("user_id").distinct()
    quota = place_quota(owners, basis, source, packages, as_of)
    used = places_per_user(providers).select("user_id", "places")
    room = quota.join(used, "user_id", "left").select(
        "user_id", "max_places", "tier", F.coalesce("places", F.lit(0)).alias("places"))

    judged = cut(join_unique(requests, room, "user_id", "request_id"))
    left = F.greatest(F.col("max_places") - F.col("places"), F.lit(0))
    owned = judged.filter(F.col("user_id").isNotNull()).withColumn("_left", left)
    fits = first_per_key(owned.select("request_id", "user_id", "_left"), "user_id", "_left",
                         [F.col("request_id").asc()], "request_id")
    accepted = fits.select("request_id").withColumn("_fits", F.lit(True))
    verdict = judged.join(accepted, "request_id", "left").withColumn(
        "_ok", F.col("user_id").isNull() | F.coalesce("_fits", F.lit(False)))

    accepted_rows = verdict.filter("_ok")
    seen = F.greatest(F.col("places"), F.col("max_places").cast("bigint"))
    error = F.when(~F.col("_ok"), fill(V.QUOTA_EXCEEDED, seen, F.col("max_places"), F.col("tier")))
    new_id = F.when(F.col("_ok"), new_ids(providers, requests)).alias("provider_id")
    results = verdict.select("request_id", "user_id", F.col("_ok").alias("ok"),
                             error.alias("error"), new_id)
    state = State(providers=lambda: append_providers(
        providers, accepted_rows, as_of, batch=requests).state["providers"])
    return Change(state, results)
