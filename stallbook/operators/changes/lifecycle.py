"""Subscription lifecycle: create, activate, cancel, expire, link.

The calls of a batch count as made one after the other, in the order of request_id, and
one call can change what the next one for the same user or row sees. Every request is
judged, and verdicts and state are those of the calls made one by one. Each rule has a
form that needs no loop: which requests succeed follows from the first valid one per row
(or per user and package, or from the one before it), and what they add up to per user
is bounded by the number of packages. What a payment_id names is looked up before the batch:
the ids that a batch gives to new payments are known only when it is done.

Outputs share the judged requests. Pass `cut=config.keep` to write them once to the shared
folder instead of deriving them again for every output; joins to them are then joins of
plain tables, which Spark splits for users behind most of the rows.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ...config import Cut, as_is
from ...functions import fixed_values as V
from ...functions import predicates as P
from ...functions.clock import moment, plus_days, stamp
from ...functions.scalars import append_note, fill
from ..entitlement import live_subscriptions, places_per_user
from ..reports import SETTINGS, latest_settings
from ..security import with_actor
from ..skew import first_per_key, join_unique
from .base import Change, State, append_profiles, new_ids, rows_like

#: Requests of a user that stand in one window, by request_id.
TURN_BLOCK = 100_000


def first_requests(requests: DataFrame, *key: Column | str) -> DataFrame:
    """The first request for each key. Spark cuts each partition to one row per key
    before the shuffle, so a key behind most requests costs one row per partition."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("request_id"))
    return requests.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def _look_up(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join of requests to a table by `key`, in two steps.

    The inner join lets Spark broadcast a small batch instead of shuffling the table,
    or split a key that most requests share; its matches come back by request id.
    """
    hits = requests.select("request_id", key).join(table, key).drop(key)
    return requests.join(hits, "request_id", "left")


def _who(user: Column, row: Column) -> Column:
    """Whose rows a call can touch: the user's, or the one row if it has no user."""
    return F.when(user.isNull(), F.concat(F.lit("row "), row)).otherwise(
        F.concat(F.lit("user "), user.cast("string")))


def _by_turn(found: DataFrame, key: str, open_: Column, then: str, cut: Cut) -> DataFrame:
    """Add `_now`, the status a request finds: that of its row, or `then` once the first
    request that found the row open has been served."""
    firsts = cut(found.filter(open_).groupBy(key).agg(F.min("request_id").alias("_first")))
    return found.join(firsts, key, "left").withColumn(
        "_now", F.when(F.col("_first") < F.col("request_id"), F.lit(then)).otherwise(F.col("status")))


def _verdicts(requests: DataFrame, denials: list[tuple[Column, str]], judged: DataFrame,
              columns: list[str]) -> DataFrame:
    """One result row per request: denied or judged."""
    verdict = judged.select("request_id", F.col("error").alias("_error"),
                            *[F.col(c).alias(f"_{c}_") for c in columns])
    error = F.when(F.lit(False), F.lit(""))
    for denied, text in denials:
        error = error.when(denied, F.lit(text))
    error = error.otherwise(F.col("_error"))
    ok = error.isNull()
    return requests.join(verdict, "request_id", "left").select(
        "request_id", ok.alias("ok"), error.alias("error"),
        *[F.when(ok, F.col(f"_{c}_")).alias(c) for c in columns])


def _changed(df: DataFrame, changes: dict[str, Column], changed: Column, columns: list[str],
             as_of: datetime) -> DataFrame:
    """Apply `changes` and stamp `updated_at` on the rows that `changed` marks."""
    types = {c: df.schema[c].dataType for c in columns}
    if "updated_at" in columns:
        changes = changes | {"updated_at": F.when(changed, stamp(as_of, types["updated_at"]))
                             .otherwise(F.col("updated_at"))}
    return df.select(*[changes.get(c, F.col(c)).cast(types[c]).alias(c) for c in columns])


# --- activate -----------------------------------------------------------------------

def activate(subscriptions: DataFrame, payments: DataFrame, packages: DataFrame,
             providers: DataFrame, profiles: DataFrame, requests: DataFrame, as_of: datetime,
             cut: Cut = as_is, unique: bool = False) -> Change:
    """Admins turn pending subscriptions into active ones.

    `requests`: request_id, actor_id, subscription_id, payment_id (NULL: a completed
    payment is made). Other pending requests for the package and other live
    subscriptions of the user are cancelled. When the user has more places, of
    any status, than the package allows, that many of their oldest active places go
    back to pending; the note about it is written even when none was active. `unique`: a user
    has one row per package and status, and a call that would make a second one is refused.
    """
    acted = with_actor(requests, profiles, P.is_admin())
    found = cut(_asked_activation(acted, subscriptions, payments, packages))
    valid = found.filter("_valid")
    firsts = _unique_activations(valid, subscriptions, as_of, cut) if unique else first_requests(
        valid, "_who", "package_id")
    wins = cut(_activations(firsts, subscriptions, payments, providers, requests, as_of))
    by_user = cut(wins.groupBy("_who").agg(F.sort_array(F.collect_list(F.struct(
        "request_id", "package_id", "subscription_id", "package_name", "_payment_id", "expires_at",
        "_note", "_until", "_by"))).alias("_wins")))
    judged = _judge_activation(found, wins, by_user, subscriptions, as_of)
    if unique:
        refused = F.when(F.col("subscription_id").isNull(), F.lit(V.DUPLICATE_STATUS))
        judged = judged.withColumn("error", F.coalesce("error", refused))
    judged = cut(judged)
    state = State(
        subscriptions=lambda: _activated_subscriptions(subscriptions, by_user, as_of),
        payments=lambda: _activated_payments(payments, wins, as_of),
        providers=lambda: _activated_providers(providers, wins, as_of, cut),
    )
    columns = ["message", "subscription_id", "payment_id", "user_id", "package_id", "started_at",
               "expires_at", "places_deactivated", "warning"]
    denials = [(~F.col("_allowed"), V.FORBIDDEN),
               (F.col("subscription_id").isNull(), V.SUBSCRIPTION_MISSING)]
    return Change(state, _verdicts(acted, denials, judged, columns))


def _asked_activation(acted: DataFrame, subscriptions: DataFrame, payments: DataFrame,
                      packages: DataFrame) -> DataFrame:
    """Allowed requests with their subscription, its package's terms and whether the payment is
    there; `_valid` if the row is pending before the batch and nothing else is missing."""
    terms = packages.select(
        F.col("id").alias("package_id"), F.col("name").alias("package_name"),
        F.coalesce("duration_days", F.lit(V.DURATION_DEFAULT_ACTIVATION)).alias("_days"),
        F.coalesce("max_places", F.lit(V.FREE_PLACES)).alias("_max"))
    asked = acted.filter(F.col("_allowed") & F.col("subscription_id").isNotNull()).select(
        "request_id", "subscription_id", F.col("payment_id").alias("_given"))
    targets = subscriptions.select(
        F.col("id").alias("subscription_id"), "user_id", "package_id", "status", "amount",
        F.col("expires_at").alias("_expires")).join(terms, "package_id")
    paid = payments.select(F.col("id").alias("_given"), F.lit(True).alias("_paid"))
    payable = F.col("_given").isNull() | F.col("_paid").isNotNull()
    return _look_up(_look_up(asked, targets, "subscription_id"), paid, "_given").withColumns({
        "_payable": payable, "_valid": P.equals("status", "pending") & payable,
        "_who": _who(F.col("user_id"), F.col("subscription_id"))})


def _occupied(subscriptions: DataFrame, as_of: datetime) -> DataFrame:
    """Per `_who` and package_id: how many rows are pending, `_live`, active but run out (`_dead`)
    and cancelled before the batch."""
    live = P.live(moment(as_of, subscriptions, "expires_at"))
    return subscriptions.groupBy(
        _who(F.col("user_id"), F.col("id")).alias("_who"), "package_id").agg(
        F.count_if(P.equals("status", "pending")).alias("_pending"), F.count_if(live).alias("_live"),
        F.count_if(P.equals("status", "active") & ~F.coalesce(live, F.lit(False))).alias("_dead"),
        F.count_if(P.equals("status", "cancelled")).alias("_cancelled"))


def _unique_activations(valid: DataFrame, subscriptions: DataFrame, as_of: datetime,
                        cut: Cut) -> DataFrame:
    """The valid requests that succeed where a user may have one row per package and status.

    A success needs its package's place among the active rows, and cancels the user's live row,
    which needs that package's place among the cancelled ones; so:

    - while a live row has a cancelled one beside it, nothing succeeds for the user;
    - else the first success is the first request for a package without active rows. It
      cancels all live rows, which leaves their packages free for later requests;
    - from then on the first request for each free package succeeds, until one becomes live
      beside a cancelled row of its package: that row can't be cancelled, so all later calls fail.

    Other pending rows of the package are cancelled too, which takes that place once. Every step is
    a minimum or a count per user and package; only a user's packages stand in one window.
    """
    taken = cut(_occupied(subscriptions, as_of).join(
        valid.select("_who").distinct(), "_who", "left_semi"))
    stuck = taken.filter("_live > 1 OR (_live > 0 AND _cancelled > 0)").select("_who").distinct()
    free = taken.join(stuck, "_who", "left_anti").filter("_dead = 0").select(
        "_who", "package_id", "_live", "_cancelled", (F.col("_pending") - 1).alias("_others"))
    # pending rows beside the one asked for need the one place among the cancelled rows
    rows = cut(valid.join(free, ["_who", "package_id"]).filter(
        "_others = 0 OR (_others = 1 AND _cancelled = 0 AND _live = 0)"))
    first = cut(rows.filter("_live = 0").groupBy("_who").agg(F.min("request_id").alias("_first")))
    open_ = rows.join(first, "_who").filter("_live = 0 OR request_id > _first")
    turns = first_requests(open_, "_who", "package_id")
    now = moment(as_of, subscriptions, "started_at")
    blocks = (plus_days(now, F.col("_days")) > now) & (
        (F.col("_cancelled") > 0) | (F.col("_live") > 0) | (F.col("_others") > 0))
    order = Window.partitionBy("_who").orderBy("request_id")
    before = F.max(F.when(blocks, 1)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return turns.withColumn("_blocked", before).filter("_blocked IS NULL").select(*valid.columns)


def _activations(firsts: DataFrame, subscriptions: DataFrame, payments: DataFrame,
                 providers: DataFrame, requests: DataFrame, as_of: datetime) -> DataFrame:
    """The requests that succeed, with everything they set.

    `firsts`: of the valid requests for a user and package the first succeeds: it cancels the
    other pending rows of that package and touches no pending row of another. So a
    user has at most one success per package, and the window over a user's
    successes is that short. `_until` and `_by` are the request and the package name of the
    success that ends this one, unless it has run out by then.
    """
    rows = firsts.join(places_per_user(providers), "user_id", "left")
    now = moment(as_of, subscriptions, "started_at")
    expires = plus_days(now, F.col("_days"))
    total = F.coalesce("places", F.lit(0))
    active = F.coalesce("active_places", F.lit(0))
    over = total > F.col("_max")
    turns = Window.partitionBy("_who").orderBy("request_id")
    user = Window.partitionBy("_who")
    earlier = F.coalesce(F.sum("_excess").over(turns.rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    off = F.least(F.col("_excess"), F.greatest(active - earlier, F.lit(0)))
    lives = expires > now
    rows = rows.withColumn("_excess", F.when(over, total - F.col("_max")).otherwise(F.lit(0))).select(
        "request_id", "subscription_id", "user_id", "_who", "package_id", "package_name", "amount",
        "_given", F.coalesce("_given", new_ids(payments, requests)).alias("_payment_id"),
        now.alias("started_at"), expires.alias("expires_at"),
        off.cast("int").alias("places_deactivated"),
        F.when(lives, F.lead("request_id").over(turns)).alias("_until"),
        F.when(lives, F.lead("package_name").over(turns)).alias("_by"),
        F.row_number().over(turns).alias("_turn"),
        F.greatest(active - F.sum("_excess").over(user), F.lit(0)).alias("_keep"),
        (F.sum("_excess").over(user) > 0).alias("_some_off"),
        F.when(over, fill(V.NOTE_PLACES_SWITCHED_OFF, off, F.col("_max"), total)).alias("_note"),
        F.when(over, fill(V.WARN_PLACES_SWITCHED_OFF, off, total, F.col("_max"))).alias("_warn"),
    )
    return rows.withColumns({
        "message": F.concat(F.lit(V.ACTIVATED), F.coalesce("_warn", F.lit(""))),
        "warning": F.when(F.col("places_deactivated") > 0, F.col("_warn")),
    })


def _judge_activation(found: DataFrame, wins: DataFrame, by_user: DataFrame,
                      subscriptions: DataFrame, as_of: datetime) -> DataFrame:
    """Every request of `found` with its error, or with what it sets.

    The status that a request finds is that of its row before the batch, unless an
    earlier success of the user has changed it.
    """
    now = moment(as_of, subscriptions, "expires_at")
    rows = found.select("request_id", "subscription_id", "package_id", "status", "_expires", "_payable",
                        "_who").join(by_user, "_who", "left")
    same = F.get(F.filter("_wins", lambda w: w["package_id"] == F.col("package_id")), F.lit(0))
    since = F.get("_wins", F.lit(0))["request_id"]
    turn = F.col("request_id")
    ended = same["_until"] < turn
    held = (same["subscription_id"] == F.col("subscription_id")) & ~F.coalesce(ended, F.lit(False))
    was_live = P.live(now, expires="_expires")
    status = (
        F.when(P.equals("status", "pending") & (same["request_id"] < turn),
               F.when(held, F.lit("active")).otherwise(F.lit("cancelled")))
        .when(was_live & (since < turn), F.lit("cancelled"))
        .otherwise(F.col("status"))
    )
    error = (
        F.when(F.col("status").isNull(), F.lit(V.SUBSCRIPTION_MISSING))
        .when(F.col("_now") != "pending", F.concat(F.lit(V.NOT_PENDING), F.col("_now")))
        .when(~F.col("_payable"), F.lit(V.ACTIVATION_PAYMENT_MISSING))
    )
    done = wins.withColumnRenamed("_payment_id", "payment_id").select(
        "request_id", "message", "subscription_id", "payment_id", "user_id", "package_id",
        "started_at", "expires_at", "places_deactivated", "warning")
    return rows.withColumn("_now", status).select("request_id", error.alias("error")).join(
        done, "request_id", "left")


def _activated_subscriptions(subscriptions: DataFrame, by_user: DataFrame,
                             as_of: datetime) -> DataFrame:
    df = subscriptions.withColumn("_who", _who(F.col("user_id"), F.col("id"))).join(
        by_user, "_who", "left")
    now = moment(as_of, subscriptions, "expires_at")
    same = F.get(F.filter("_wins", lambda w: w["package_id"] == F.col("package_id")), F.lit(0))
    target = F.coalesce(same["subscription_id"] == F.col("id"), F.lit(False))
    ended = target & same["_until"].isNotNull()
    same_request = same.isNotNull() & ~target & P.equals("status", "pending")
    replaced = F.col("_wins").isNotNull() & P.live(now)
    cancelled = same_request | replaced | ended
    noted = F.when(target & same["_note"].isNotNull(), append_note(F.col("notes"), same["_note"])) \
        .otherwise(F.col("notes"))
    notes = (
        F.when(ended, append_note(noted, fill(V.NOTE_NEW_PACKAGE, same["_by"])))
        .when(target, noted)
        .when(same_request, append_note(F.col("notes"), F.lit(V.NOTE_OTHER_ACTIVATED)))
        .when(replaced, append_note(F.col("notes"), fill(
            V.NOTE_NEW_PACKAGE, F.get("_wins", F.lit(0))["package_name"])))
        .otherwise(F.col("notes"))
    )
    return _changed(df, {
        "status": F.when(cancelled, F.lit("cancelled")).when(target, F.lit("active"))
        .otherwise(F.col("status")),
        "payment_id": F.when(target, same["_payment_id"]).otherwise(F.col("payment_id")),
        "started_at": F.when(target, now).otherwise(F.col("started_at")),
        "expires_at": F.when(ended | replaced, now).when(target, same["expires_at"])
        .otherwise(F.col("expires_at")),
        "notes": notes,
    }, target | cancelled, subscriptions.columns, as_of)


def _activated_payments(payments: DataFrame, applied: DataFrame, as_of: datetime) -> DataFrame:
    given = applied.filter(F.col("_given").isNotNull()).select(
        F.col("_given").alias("id")).distinct().withColumn("_hit", F.lit(True))
    now = moment(as_of, payments, "completed_at")
    kept = payments.join(given, "id", "left").select(*[
        F.when(F.col("_hit"), {"status": F.lit("completed"), "completed_at": now}[c])
        .otherwise(F.col(c)).alias(c) if c in ("status", "completed_at") else F.col(c)
        for c in payments.columns])
    made = rows_like(payments, applied.filter(F.col("_given").isNull()), {
        "id": F.col("_payment_id"), "user_id": F.col("user_id"), "package_id": F.col("package_id"),
        "status": F.lit("completed"), "amount": F.col("amount"), "completed_at": now})
    return kept.unionByName(made)


def _activated_providers(providers: DataFrame, wins: DataFrame, as_of: datetime,
                         cut: Cut) -> DataFrame:
    """Switch off the oldest active places beyond the quota.

    The oldest n of an owner's active places are all but the newest `_keep`, and
    `_keep` never exceeds the package's limit. So the newest few are picked per
    owner instead of ranking all places of an owner who may have millions; the last
    of them is the boundary that every place of the owner is compared with.
    """
    over = wins.filter("_turn = 1 AND _some_off AND user_id IS NOT NULL").select("user_id", "_keep")
    active = providers.filter(P.equals("status", "active")).select("id", "user_id", "created_at")
    # oldest first is created_at ascending, NULL last, then id: kept places are the other end
    newest_first = [F.desc_nulls_first("created_at"), F.col("id").desc()]
    kept = first_per_key(active.join(over, "user_id"), "user_id", "_keep", newest_first, "id")
    place = F.struct(F.col("created_at").isNull(), F.col("created_at"), F.col("id"))
    last = cut(over.join(kept.groupBy("user_id").agg(F.min(place).alias("_last")), "user_id", "left"))
    off = P.equals("status", "active") & F.col("_keep").isNotNull() & (
        F.col("_last").isNull() | (place < F.col("_last")))
    df = providers.join(last, "user_id", "left").withColumn("_off", off)
    return _changed(df, {"status": F.when(F.col("_off"), F.lit("pending")).otherwise(
        F.col("status"))}, F.col("_off"), providers.columns, as_of)


def activate_payments(payments: DataFrame, profiles: DataFrame, requests: DataFrame,
                      as_of: datetime, cut: Cut = as_is) -> Change:
    """Payments-era activation: a pending payment becomes completed.

    `requests`: request_id, actor_id, payment_id.
    """
    return _settle_payments(payments, profiles, requests, as_of, "completed", V.NOT_PENDING,
                            V.ACTIVATED_PAYMENT, cut)


def cancel_payments(payments: DataFrame, profiles: DataFrame, requests: DataFrame,
                    as_of: datetime, cut: Cut = as_is) -> Change:
    """Payments-era cancellation: only a pending payment can be cancelled."""
    return _settle_payments(payments, profiles, requests, as_of, "cancelled",
                            V.CANNOT_CANCEL_PAYMENT, V.CANCELLED, cut)


def _settle_payments(payments: DataFrame, profiles: DataFrame, requests: DataFrame,
                     as_of: datetime, status: str, refusal: str, message: str, cut: Cut) -> Change:
    acted = with_actor(requests, profiles, P.is_admin())
    asked = acted.filter(F.col("_allowed") & F.col("payment_id").isNotNull()).select(
        "request_id", "payment_id")
    targets = payments.select(F.col("id").alias("payment_id"), "user_id", "package_id", "status",
                              F.lit(True).alias("_known"))
    # a missing status is neither pending nor refused: the guard only stops known others
    open_ = F.col("_known").isNotNull() & F.coalesce(F.col("status") == "pending", F.lit(True))
    turns = _by_turn(_look_up(asked, targets, "payment_id"), "payment_id", open_, status, cut)
    error = F.when(F.col("_known").isNull(), F.lit(V.SUBSCRIPTION_MISSING)).when(
        F.col("_now") != "pending", F.concat(F.lit(refusal), F.col("_now")))
    judged = cut(turns.select(
        "request_id", "payment_id", "user_id", "package_id", error.alias("error"),
        F.lit(message).alias("message")))
    hit = judged.filter(F.col("error").isNull()).select(
        F.col("payment_id").alias("id"), F.lit(True).alias("_hit"))
    changes = {"status": F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))}
    if status == "completed":
        now = moment(as_of, payments, "completed_at")
        changes["completed_at"] = F.when(F.col("_hit"), now).otherwise(F.col("completed_at"))
    state = State(payments=lambda: payments.join(hit, "id", "left").select(
        *[changes.get(c, F.col(c)).alias(c) for c in payments.columns]))
    denials = [(~F.col("_allowed"), V.FORBIDDEN),
               (F.col("payment_id").isNull(), V.SUBSCRIPTION_MISSING)]
    return Change(state, _verdicts(acted, denials, judged,
                                   ["message", "payment_id", "user_id", "package_id"]))


# --- create -------------------------------------------------------------------------

def create(subscriptions: DataFrame, packages: DataFrame, providers: DataFrame,
           profiles: DataFrame, requests: DataFrame, as_of: datetime,
           settings: DataFrame | None = None, cut: Cut = as_is, unique: bool = False) -> Change:
    """Users ask for packages: a pending subscription at the package's price.

    `requests`: request_id, actor_id, package_id. The user's other pending requests
    are cancelled, those of earlier calls of the batch too, and a missing profile is made. The
    result warns of a live subscription and of active places beyond the new package's limit.
    `unique`: a user has one row per package and status, and a call that would make a second one
    is refused.
    """
    judged = cut(_judge_creation(subscriptions, packages, providers, requests, as_of, cut, unique))
    applied = judged.filter(F.col("error").isNull())

    state = State(
        subscriptions=lambda: _created_subscriptions(subscriptions, applied, as_of, cut),
        user_profiles=lambda: append_profiles(
            profiles, applied.select(F.col("user_id").alias("id")), as_of),
    )
    columns = ["message", "subscription_id", "user_id", "package_id", "package_name", "amount",
               "has_active_subscription", "current_package_name", "places_warning"]
    if settings is not None:
        info = latest_settings(settings).select(F.struct(*SETTINGS)).scalar()
        judged = judged.withColumn("payment_info", info)
        columns.append("payment_info")
    denials = [(F.col("actor_id").isNull(), V.SIGN_IN_FIRST)]
    return Change(state, _verdicts(requests, denials, judged, columns))


def _created_subscriptions(subscriptions: DataFrame, applied: DataFrame, as_of: datetime,
                           cut: Cut) -> DataFrame:
    """All pending rows of a user with a success go; of the new rows the last stays pending."""
    last = cut(applied.groupBy("user_id").agg(F.max("request_id").alias("_last")))
    df = subscriptions.join(last, "user_id", "left")
    dropped = P.equals("status", "pending") & F.col("_last").isNotNull()
    kept = _changed(df, {
        "status": F.when(dropped, F.lit("cancelled")).otherwise(F.col("status")),
        "notes": F.when(dropped, append_note(F.col("notes"), F.lit(V.NOTE_REPLACED_REQUEST)))
        .otherwise(F.col("notes")),
    }, dropped, subscriptions.columns, as_of)
    now = moment(as_of, subscriptions, "created_at")
    stays = F.col("request_id") == F.col("_last")
    made = rows_like(subscriptions, applied.join(last, "user_id"), {
        "id": F.col("subscription_id"), "user_id": F.col("user_id"),
        "package_id": F.col("package_id"),
        "status": F.when(stays, F.lit("pending")).otherwise(F.lit("cancelled")),
        "notes": F.when(~stays, F.lit(V.NOTE_REPLACED_REQUEST)), "amount": F.col("amount"),
        "auto_renew": F.lit(False), "created_at": now, "updated_at": now})
    return kept.unionByName(made)


def _creations(rows: DataFrame, cut: Cut) -> DataFrame:
    """request_id of the requests that succeed, of those for open packages.

    Before a user's first success the packages pending in the table are refused; it is the first
    request for another one. After it only the package of the last success is pending, which
    is that of the request before: one that was refused asked for the same package. So a
    request is compared with the user's previous one, found in blocks of requests, the
    first of a block with the last of the user's block before it.
    """
    valid = rows.select("request_id", "user_id", "package_id", "_pending").withColumn(
        "_block", F.floor(F.col("request_id") / TURN_BLOCK))
    turns = Window.partitionBy("user_id", "_block").orderBy("request_id")
    ends = valid.groupBy("user_id", "_block").agg(
        F.max_by("package_id", "request_id").alias("_end"))
    carried = cut(ends.select("user_id", "_block", F.lag("_end").over(
        Window.partitionBy("user_id").orderBy("_block")).alias("_carried")))
    first = cut(valid.filter("_pending IS NULL").groupBy("user_id").agg(
        F.min("request_id").alias("_first")))
    before = valid.withColumn("_before", F.lag("package_id").over(turns)).join(
        first, "user_id").join(carried, ["user_id", "_block"])
    other = F.col("package_id") != F.coalesce("_before", "_carried")
    return before.filter((F.col("request_id") == F.col("_first")) | (
        (F.col("request_id") > F.col("_first")) & other)).select(
        "request_id", F.lit(True).alias("_done"))


def _unique_creations(rows: DataFrame, done: DataFrame, subscriptions: DataFrame,
                      as_of: datetime, cut: Cut) -> DataFrame:
    """request_id of the requests of `done` that succeed where a user may have one row per package
    and status, and `_since`, the request from which nothing of the user's succeeds any more.

    A success cancels the user's pending rows, so these must have no cancelled row beside them;
    if one has before the batch, nothing succeeds. A new row is in that place if its package had a
    pending or cancelled row before or an earlier success in the batch: it stays, and no later
    call succeeds. So a user's successes end with the first for a package that is taken.
    """
    held = _occupied(subscriptions.filter(F.col("user_id").isNotNull()), as_of).select(
        F.col("_who"), "package_id", "_pending", "_cancelled")
    asked = rows.select("request_id", "user_id", "package_id").withColumn(
        "_who", _who(F.col("user_id"), F.lit(""))).join(done, "request_id")
    held = cut(held.join(asked.select("_who").distinct(), "_who", "left_semi"))
    stuck = held.filter("_pending > 1 OR (_pending > 0 AND _cancelled > 0)").select("_who").distinct()
    firsts = asked.groupBy("_who", "package_id").agg(F.min("request_id").alias("_own"))
    used = held.filter("_pending > 0 OR _cancelled > 0").select(
        "_who", "package_id", F.lit(True).alias("_used"))
    known = cut(firsts.join(used, ["_who", "package_id"], "left"))
    again = F.when(F.col("_used") | (F.col("request_id") > F.col("_own")), F.col("request_id"))
    ends = cut(asked.join(known, ["_who", "package_id"]).groupBy("_who").agg(
        F.min(again).alias("_last")).join(stuck.withColumn("_stuck", F.lit(True)), "_who", "left"))
    return asked.join(ends, "_who").filter(
        F.col("_stuck").isNull() & (F.col("_last").isNull() | (F.col("request_id") <= F.col("_last")))
    ).select("request_id", F.lit(True).alias("_done"))


def _now_pending(rows: DataFrame, done: DataFrame, cut: Cut) -> DataFrame:
    """Requests with `_has`, whether the package asked for is the user's pending one when they are
    made: that of the last success before them, or one of the table before any success."""
    served = cut(rows.select("request_id", "user_id", "package_id").join(done, "request_id").select(
        "user_id", F.struct("request_id", "package_id").alias("_win")).groupBy("user_id").agg(
        F.sort_array(F.collect_list("_win")).alias("_wins")))
    earlier = F.filter("_wins", lambda w: w["request_id"] < F.col("request_id"))
    last = F.element_at(earlier, -1)["package_id"]
    has = F.when(F.coalesce(F.size(earlier), F.lit(0)) > 0, last == F.col("package_id")).otherwise(
        F.col("_pending").isNotNull())
    return rows.join(served, "user_id", "left").withColumn("_has", has).drop("_wins")


def _judge_creation(subscriptions: DataFrame, packages: DataFrame, providers: DataFrame,
                    requests: DataFrame, as_of: datetime, cut: Cut, unique: bool) -> DataFrame:
    terms = packages.select(
        F.col("id").alias("package_id"), F.col("name").alias("package_name"),
        F.col("price").alias("amount"), P.package_open().alias("_open"),
        F.coalesce("max_places", F.lit(V.FREE_PLACES)).alias("_max"))
    signed = requests.filter(F.col("actor_id").isNotNull()).select(
        "request_id", F.col("actor_id").alias("user_id"), "package_id")
    pending = cut(subscriptions.filter(P.equals("status", "pending")).select(
        "user_id", "package_id").distinct().withColumn("_pending", F.lit(True)))
    names = packages.select(F.col("id").alias("package_id"), F.col("name").alias("_name"))
    latest = F.struct(F.col("started_at").isNull(), F.col("started_at"), -F.col("id"))
    current = live_subscriptions(subscriptions, as_of).select(
        "id", "user_id", "package_id", "started_at").join(names, "package_id", "left").groupBy(
        "user_id").agg(F.lit(True).alias("_live"),
                       F.max_by("_name", F.when(F.col("_name").isNotNull(), latest))
                       .alias("current_package_name"))
    places = places_per_user(providers).select("user_id", "active_places")
    users = cut(current.join(places, "user_id", "full"))
    asked = cut(signed.join(terms, "package_id", "left").join(
        pending, ["user_id", "package_id"], "left"))
    done = _creations(asked.filter("package_name IS NOT NULL AND _open"), cut)
    refused = F.lit(V.ALREADY_PENDING)
    if unique:
        done = cut(_unique_creations(asked, cut(done), subscriptions, as_of, cut))
        asked = _now_pending(asked, done, cut)
        refused = F.when(F.col("_has"), refused).otherwise(F.lit(V.DUPLICATE_STATUS))
    rows = asked.join(users, "user_id", "left").join(done, "request_id", "left")

    error = (
        F.when(F.col("package_name").isNull(), F.lit(V.PACKAGE_MISSING))
        .when(~F.col("_open"), F.lit(V.PACKAGE_INACTIVE))
        .when(F.col("_done").isNull(), refused)
    )
    used = F.coalesce("active_places", F.lit(0))
    excess = F.greatest(used - F.col("_max"), F.lit(0))
    is_live = P.truthy("_live")
    message = (
        F.when(excess > 0, fill(V.CREATED_OVER_QUOTA, used, F.col("package_name"), F.col("_max"),
                                excess))
        .when(is_live, fill(V.CREATED_HAS_ACTIVE, F.coalesce("current_package_name",
                                                             F.lit(V.ACTIVE_PACKAGE))))
        .otherwise(F.lit(V.CREATED))
    )
    over = excess > 0
    warning = F.struct(
        over.alias("has_warning"), F.when(over, used).alias("current_places"),
        F.when(over, F.col("_max")).alias("max_places_allowed"),
        F.when(over, excess).alias("excess_places"),
        F.when(over, fill(V.EXCESS_WARNING, excess)).alias("message"))
    return rows.select(
        "request_id", "user_id", "package_id", "package_name", "amount", error.alias("error"),
        new_ids(subscriptions, requests).alias("subscription_id"), message.alias("message"),
        is_live.alias("has_active_subscription"), "current_package_name",
        warning.alias("places_warning"))


def create_payments(payments: DataFrame, packages: DataFrame, profiles: DataFrame,
                    requests: DataFrame, as_of: datetime, paid: bool = False) -> Change:
    """Payments-era request for a package: a pending payment, or a completed one at
    once when `paid`. Nothing is cancelled, so every request of a batch is applied."""
    terms = packages.select(
        F.col("id").alias("package_id"), F.col("name").alias("package_name"),
        F.col("price").alias("amount"), P.package_open().alias("_open"))
    signed = F.col("actor_id").isNotNull()
    error = F.when(F.col("package_name").isNull(), F.lit(V.PACKAGE_MISSING)).when(
        ~F.col("_open"), F.lit(V.PACKAGE_INACTIVE))
    judged = requests.select("request_id", "actor_id", "package_id").filter(signed).join(
        terms, "package_id", "left").select(
        "request_id", F.col("actor_id").alias("user_id"), "package_id", "package_name", "amount",
        error.alias("error"), new_ids(payments, requests).alias("payment_id"))
    applied = judged.filter(F.col("error").isNull())
    values = {"id": F.col("payment_id"), "user_id": F.col("user_id"),
              "package_id": F.col("package_id"), "amount": F.col("amount"),
              "status": F.lit("completed" if paid else "pending")}
    column = "completed_at" if paid else "created_at"
    values[column] = moment(as_of, payments, column)
    state = State(
        payments=lambda: payments.unionByName(rows_like(payments, applied, values)),
        user_profiles=lambda: append_profiles(
            profiles, applied.select(F.col("user_id").alias("id")), as_of),
    )
    columns = ["payment_id", "user_id", "package_id", "package_name", "amount"]
    return Change(state, _verdicts(requests, [(~signed, V.SIGN_IN_FIRST)], judged, columns))


# --- cancel, expire, link -------------------------------------------------------------

def cancel(subscriptions: DataFrame, payments: DataFrame, profiles: DataFrame,
           requests: DataFrame, as_of: datetime, cut: Cut = as_is, unique: bool = False) -> Change:
    """Admins cancel pending or active subscriptions and the payment tied to them.

    `requests`: request_id, actor_id, subscription_id, reason. The expiry stays. `unique`: a
    user has one row per package and status, and a call that would make a second one is refused.
    """
    acted = with_actor(requests, profiles, P.is_admin())
    asked = acted.filter(F.col("_allowed") & F.col("subscription_id").isNotNull()).select(
        "request_id", "subscription_id", "reason")
    targets = subscriptions.select(F.col("id").alias("subscription_id"), "status", "payment_id",
                                   "package_id", _who(F.col("user_id"), F.col("id")).alias("_who"))
    found = _look_up(asked, targets, "subscription_id")
    refused = F.when(F.col("status").isNull(), F.lit(V.SUBSCRIPTION_MISSING))
    if unique:
        turns = _unique_cancels(cut(found), subscriptions, as_of, cut)
    else:
        turns = _by_turn(found, "subscription_id", F.col("status").isin("pending", "active"),
                         "cancelled", cut)
    error = refused.when(
        ~F.col("_now").isin("pending", "active"), F.concat(F.lit(V.CANNOT_CANCEL), F.col("_now")))
    if unique:
        error = error.when(~F.col("_served"), F.lit(V.DUPLICATE_STATUS))
    judged = cut(turns.select(
        "request_id", "subscription_id", "payment_id", "reason", error.alias("error"),
        F.lit(V.CANCELLED).alias("message")))
    applied = judged.filter(F.col("error").isNull())
    state = State(
        subscriptions=lambda: _cancelled_subscriptions(subscriptions, applied, as_of),
        payments=lambda: _cancelled_payments(payments, applied),
    )
    denials = [(~F.col("_allowed"), V.FORBIDDEN),
               (F.col("subscription_id").isNull(), V.SUBSCRIPTION_MISSING)]
    return Change(state, _verdicts(acted, denials, judged, ["message", "subscription_id", "reason"]))


def _unique_cancels(found: DataFrame, subscriptions: DataFrame, as_of: datetime,
                    cut: Cut) -> DataFrame:
    """Requests with `_served`, whether they succeed where a user may have one row per package and
    status, and `_now`, the status they find. Only the first request for an open row of a user
    and package can take the place among the cancelled rows, if it is free."""
    key = ["_who", "package_id"]
    taken = _occupied(subscriptions, as_of).filter("_cancelled > 0").select(*key)
    first = cut(found.filter(F.col("status").isin("pending", "active")).groupBy(*key).agg(
        F.min_by(F.struct("request_id", "subscription_id"), "request_id").alias("_win")).join(
        taken, key, "left_anti"))
    own = F.col("_win.subscription_id") == F.col("subscription_id")
    gone = own & (F.col("_win.request_id") < F.col("request_id"))
    return found.join(first, key, "left").withColumns({
        "_served": F.coalesce(F.col("_win.request_id") == F.col("request_id"), F.lit(False)),
        "_now": F.when(gone, F.lit("cancelled")).otherwise(F.col("status"))})


def _cancelled_subscriptions(subscriptions: DataFrame, applied: DataFrame,
                             as_of: datetime) -> DataFrame:
    why = F.coalesce(F.concat(F.lit(V.NOTE_CANCEL_REASON), F.col("reason")),
                     F.lit(V.NOTE_CANCELLED_BY_ADMIN))
    gone = applied.select(F.col("subscription_id").alias("id"), why.alias("_why"))
    hit = F.col("_why").isNotNull()
    return _changed(subscriptions.join(gone, "id", "left"), {
        "status": F.when(hit, F.lit("cancelled")).otherwise(F.col("status")),
        "notes": F.when(hit, append_note(F.col("notes"), F.col("_why"))).otherwise(F.col("notes")),
    }, hit, subscriptions.columns, as_of)


def _cancelled_payments(payments: DataFrame, applied: DataFrame) -> DataFrame:
    tied = applied.filter(F.col("payment_id").isNotNull()).select(
        F.col("payment_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    status = F.when(F.col("_hit"), F.lit("cancelled")).otherwise(F.col("status"))
    return payments.join(tied, "id", "left").withColumn("status", status).select(*payments.columns)


def expire(subscriptions: DataFrame, as_of: datetime) -> DataFrame:
    """Mark active subscriptions past their expiry as expired: a map over rows, no shuffle."""
    gone = P.expired(moment(as_of, subscriptions, "expires_at"))
    return _changed(subscriptions, {"status": F.when(gone, F.lit("expired")).otherwise(
        F.col("status"))}, gone, subscriptions.columns, as_of)


def expire_unique(subscriptions: DataFrame, as_of: datetime, cut: Cut = as_is) -> Change:
    """The sweep as one call where a user may have one row per package and status.

    It is one statement over all rows: if any of them would be the second expired row of its
    user and package, the call is refused and no row changes. The result is a row with ok,
    error, the number of rows expired, and how many users' packages stand in the way.
    """
    gone = P.expired(moment(as_of, subscriptions, "expires_at"))
    groups = subscriptions.groupBy(
        _who(F.col("user_id"), F.col("id")).alias("_who"), "package_id").agg(
        F.count_if(gone).alias("_gone"), F.count_if(P.equals("status", "expired")).alias("_held"))
    clash = (F.col("_gone") > 0) & (F.col("_gone") + F.col("_held") > 1)
    found = cut(groups.agg(F.coalesce(F.sum("_gone"), F.lit(0)).alias("_rows"),
                           F.count_if(clash).alias("blocking")))
    ok = F.col("blocking") == 0
    results = found.select(
        ok.alias("ok"), F.when(~ok, F.lit(V.DUPLICATE_STATUS)).alias("error"),
        F.when(ok, F.col("_rows")).otherwise(F.lit(0)).alias("expired"), "blocking")
    free = found.select(ok).scalar()
    return Change(State(subscriptions=lambda: _changed(
        subscriptions, {"status": F.when(gone & free, F.lit("expired")).otherwise(F.col("status"))},
        gone & free, subscriptions.columns, as_of)), results)


def expired_count(subscriptions: DataFrame, as_of: datetime) -> DataFrame:
    """How many rows `expire` changes."""
    gone = P.expired(moment(as_of, subscriptions, "expires_at"))
    return subscriptions.agg(F.count_if(gone).alias("expired"))


def link_payments(subscriptions: DataFrame, payments: DataFrame, requests: DataFrame,
                  as_of: datetime, cut: Cut = as_is) -> Change:
    """Tie completed payments to subscriptions of the same user.

    `requests`: request_id, subscription_id, payment_id. The guards only stop known
    values: a payment without a user or without a status passes. A link changes nothing
    that another is judged by; the last one of a subscription stays.
    """
    asked = requests.filter(F.col("subscription_id").isNotNull()).select(
        "request_id", "subscription_id", "payment_id")
    targets = subscriptions.select(F.col("id").alias("subscription_id"), "user_id",
                                   F.lit(True).alias("_known"))
    paid = payments.select(F.col("id").alias("payment_id"), F.col("user_id").alias("_payer"),
                           F.col("status").alias("_status"), F.lit(True).alias("_paid"))
    found = _look_up(_look_up(asked, targets, "subscription_id"), paid, "payment_id")
    error = (
        F.when(F.col("_known").isNull(), F.lit(V.SUBSCRIPTION_MISSING))
        .when(F.col("_paid").isNull(), F.lit(V.PAYMENT_MISSING))
        .when(F.col("_status") != "completed",
              F.concat(F.lit(V.PAYMENT_NOT_COMPLETED), F.col("_status")))
        .when(F.col("user_id") != F.col("_payer"), F.lit(V.USER_MISMATCH))
    )
    judged = cut(found.select(
        "request_id", "subscription_id", "payment_id", error.alias("error"),
        F.lit(V.LINKED).alias("message")))
    linked = cut(judged.filter(F.col("error").isNull()).groupBy(
        F.col("subscription_id").alias("id")).agg(
        F.max_by("payment_id", "request_id").alias("_payment")))
    hit = F.col("_payment").isNotNull()
    state = State(subscriptions=lambda: _changed(subscriptions.join(linked, "id", "left"), {
        "payment_id": F.when(hit, F.col("_payment")).otherwise(F.col("payment_id"))},
        hit, subscriptions.columns, as_of))
    denials = [(F.col("subscription_id").isNull(), V.SUBSCRIPTION_MISSING)]
    return Change(state, _verdicts(requests, denials, judged,
                                   ["message", "subscription_id", "payment_id"]))
