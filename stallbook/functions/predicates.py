"""Row predicates as Column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V


def live(as_of: Column, status: str = "status", expires: str = "expires_at") -> Column:
    """Subscription is active and not past its expiry; an open end never expires (strict)."""
    return (F.col(status) == "active") & (F.col(expires).isNull() | (F.col(expires) > as_of))


def expired(as_of: Column, status: str = "status", expires: str = "expires_at") -> Column:
    """Active but past expiry. At `expires_at = as_of` a row is neither live nor expired."""
    return (F.col(status) == "active") & F.col(expires).isNotNull() & (F.col(expires) < as_of)


def still_paid(as_of: Column, expires: str = "expires_at") -> Column:
    """Payments-era liveness: the last instant still counts (inclusive)."""
    return as_of <= F.col(expires)


def package_enabled(column: str = "is_active") -> Column:
    """Payments-era reading of a package flag: NULL counts as enabled."""
    return F.coalesce(F.col(column), F.lit(True))


def package_open(column: str = "is_active") -> Column:
    """Subscriptions-era reading of a package flag: NULL counts as closed."""
    return F.coalesce(F.col(column), F.lit(False))


def visible(status: str = "status") -> Column:
    """Provider shown in listings; a NULL status is pending."""
    return F.coalesce(F.col(status), F.lit("pending")) == "active"


def visible_or_unset(status: str = "status") -> Column:
    """First-generation listing rule: a NULL status was shown."""
    return (F.col(status) == "active") | F.col(status).isNull()


def awaiting(status: str = "status") -> Column:
    return F.coalesce(F.col(status), F.lit("pending")) == "pending"


def equals(column: str, value) -> Column:
    return F.col(column) == F.lit(value)


def equals_if_given(column: str | Column, value) -> Column:
    """`p IS NULL OR col = p` for a parameter known when the plan is built."""
    if value is None:
        return F.lit(True)
    return (F.col(column) if isinstance(column, str) else column) == F.lit(value)


def name_like(text: str | None, column: str = "name") -> Column:
    """Case-blind search; `%` and `_` in the text stay wildcards, blank text matches all."""
    wanted = (text or "").strip()
    return F.col(column).ilike(f"%{wanted}%") if wanted else F.lit(True)


def name_contains(text: str | None, column: str = "full_name",
                  collation: str | None = None) -> Column:
    """Case-blind plain substring, NULL names count as empty, blank text matches all.

    With a collation its own rules say which letters are the same: `UNICODE_CI` is case-blind,
    `UNICODE_CI_AI` blind to accents too.
    """
    wanted = (text or "").strip().lower()
    if not wanted:
        return F.lit(True)
    if collation is not None:
        name = F.coalesce(F.col(column), F.lit(""))
        return F.contains(F.collate(name, collation), F.collate(F.lit(wanted), collation))
    return F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(wanted))


def truthy(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(False))


def is_admin(role: str = "role") -> Column:
    return F.col(role).isin(*V.ADMIN_ROLES)


def edits_roles(role: str = "role") -> Column:
    return F.col(role) == V.ROLE_EDITOR
