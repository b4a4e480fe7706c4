"""Scalar column functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as V
from .clock import whole_days

# --- fixed values: address patterns --------------------------------------------
_HAS_SCHEME = r"(?i)^https?://"
_HOST_AND_PATH = r"^([\w-]+\.)+[\w-]+/"
_SOCIAL_PAGE = r"(?i)^facebook\.com/"
_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def trim_all(text: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def normalize_url(url: Column) -> Column:
    bare = trim_all(url)
    needs_scheme = ~bare.rlike(_HAS_SCHEME) & (bare.rlike(_HOST_AND_PATH) | bare.rlike(_SOCIAL_PAGE))
    return F.when(needs_scheme, F.concat(F.lit("https://"), bare)).otherwise(bare)


def place_page(provider_id: Column) -> Column:
    return F.concat(F.lit("/place/"), provider_id.cast("string"))


def service_page(service_id: Column) -> Column:
    return F.concat(F.lit("/service/"), service_id.cast("string"))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def display_name(given: Column, email: Column) -> Column:
    """Name of a new profile: the given name, else the email, else a default."""
    return F.coalesce(blank_to_null(given), blank_to_null(email), F.lit(V.NEW_USER))


def name_from_email(email: Column) -> Column:
    return F.substring_index(email, "@", 1)


def normalize_role(role: Column) -> Column:
    return F.trim(F.lower(role))


def status_text(status: Column) -> Column:
    """Display text of a status; an unknown one reads as pending."""
    texts = F.create_map(*[F.lit(x) for pair in V.STATUS_TEXTS.items() for x in pair])
    return F.coalesce(texts[status], F.lit(V.STATUS_TEXTS["pending"]))


def number_or(text: Column, type_name: str, default) -> Column:
    """Form number: blank, unreadable and zero all give the default."""
    number = text.try_cast(type_name)
    return F.coalesce(F.nullif(number, F.lit(0).cast(type_name)), F.lit(default).cast(type_name))


def place_fields(physical: Column, address: Column, map_url: Column) -> dict[str, Column]:
    """Address, map and type of a new place: an online one has no map and a fixed address."""
    online = F.lit(V.ONLINE_PLACE)
    return {
        "address": F.when(physical, blank_to_null(address)).otherwise(online),
        "map_url": F.when(physical, blank_to_null(map_url)),
        "type": F.when(physical, F.lit(V.PHYSICAL_PLACE)).otherwise(online),
    }


def append_note(notes: Column, text: Column) -> Column:
    """Add a line to the notes; a NULL text makes the whole note NULL."""
    return F.concat(F.coalesce(F.concat(notes, F.lit("\n")), F.lit("")), text)


def fill(template: str, *values: Column) -> Column:
    """A fixed text with its `%s` places filled; NULL when a value is NULL."""
    parts = template.split("%s")
    pieces: list[Column] = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        pieces += [value.cast("string"), F.lit(part)]
    return F.concat(*pieces)


def recency(created_at: Column, as_of: Column) -> Column:
    """Ranking bonus of a place: one point per day it is younger than the window.

    NULL creation gives 0; a future one gives more than the window.
    """
    bonus = F.greatest(F.lit(0).cast("bigint"), F.lit(V.RECENCY_DAYS) - whole_days(as_of, created_at))
    return F.when(created_at.isNull(), F.lit(0).cast("bigint")).otherwise(bonus)
