"""Declared schemas of the marketplace tables.

Reads never infer a schema: `sources.tables.read_table` applies these. Money is
`decimal(18,2)`, coordinates `decimal(9,6)`, ids `bigint`, user ids `string`.
Operators do not depend on the user id type, so frames keyed by a numeric user
id work as well.
"""

from pyspark.sql.types import StructType

_DDL = {
    "packages": """
        id bigint not null, name string not null, price decimal(18,2) not null,
        duration_days int not null, ads_limit int, image_limit int, video_limit int,
        is_active boolean, description string, max_places int, priority_weight int,
        created_at timestamp""",
    "user_profiles": """
        id string not null, full_name string not null, role string,
        phone_number string, email string, created_at timestamp""",
    "payments": """
        id bigint not null, user_id string, package_id bigint, status string,
        amount decimal(18,2) not null, place_id bigint, discount_code string,
        paymob_transaction_id string, payment_receipt_url string,
        created_at timestamp, completed_at timestamp""",
    "subscriptions": """
        id bigint not null, user_id string not null, package_id bigint not null,
        status string not null, started_at timestamp, expires_at timestamp,
        payment_id bigint, amount decimal(18,2) not null, auto_renew boolean,
        notes string, created_at timestamp not null, updated_at timestamp not null""",
    "providers": """
        id bigint not null, name string not null, category string, city string,
        area string, address string, phone string, website string, whatsapp string,
        map_url string, description string, image_url string, lat decimal(9,6),
        lng decimal(9,6), type string, delivery boolean, online_service boolean,
        show_on_map boolean, user_id string, activity_id bigint, package_id bigint,
        status string, subscription_start timestamp, subscription_end timestamp,
        created_at timestamp, updated_at timestamp""",
    "services": """
        id bigint not null, provider_id bigint not null, name string not null,
        description string, price decimal(18,2), image_url string, delivery boolean,
        online boolean, created_at timestamp""",
    "visits": """
        id bigint not null, page string, ip_address string, device string,
        source string, country string, created_at timestamp""",
    "ads": """
        id bigint not null, provider_id bigint, service_id bigint, title string not null,
        description string, status string, start_date timestamp, end_date timestamp,
        created_at timestamp""",
    "ads_images": """
        id bigint not null, ad_id bigint, image_url string not null, created_at timestamp""",
    "favorites": """
        id bigint not null, user_id string, provider_id bigint, ad_id bigint,
        created_at timestamp""",
    "activities": """
        id bigint not null, name string not null, description string,
        created_at timestamp""",
    "offers": """
        id bigint not null, price decimal(18,2) not null, currency string,
        provider_id bigint not null, service_id bigint, product_id bigint,
        active boolean, start_date timestamp, end_date timestamp, created_at timestamp""",
    "reviews": """
        id bigint not null, provider_id bigint, service_id bigint,
        user_id string not null, rating int not null, comment string, status string,
        created_at timestamp""",
    "payment_settings": """
        id bigint not null, bank_name string, bank_account string, account_name string,
        mobile_wallet string, instructions string, updated_at timestamp""",
}

TABLES = tuple(_DDL)


def schema(name: str) -> StructType:
    """Declared schema of a table; needs a running session."""
    return StructType.fromDDL(_DDL[name])
