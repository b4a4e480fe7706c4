"""The marketplace's tables seen in a star-schema test set.

Each adapter is a projection of one whole table: no row is left out. Timestamps
stay `timestamp_ntz` and user ids are numbers; operators take both.
"""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

AS_OF = datetime(2001, 8, 2)
AS_OF_VISITS = datetime(2024, 1, 15, 12)

_NOW = f"TIMESTAMP_NTZ '{AS_OF}'"


def _days(n: str) -> str:
    return f"make_interval(0, 0, 0, cast({n} as int))"


_SUBSCRIPTION_STATUS = ("case o_orderstatus when 'F' then 'active' when 'O' then 'pending' "
                        "else 'cancelled' end")

_ADAPTERS: dict[str, tuple[str, dict[str, str]]] = {
    "packages": ("nation", {
        "id": "cast(n_nationkey as bigint)",
        "name": "n_name",
        "price": "cast(100 + 50 * n_regionkey as decimal(18,2))",
        "duration_days": "90 * (1 + n_nationkey % 4)",
        "is_active": "case when n_nationkey % 8 = 7 then null when n_nationkey % 8 = 3 then false else true end",
        "description": "case when n_nationkey % 2 = 0 then n_name end",
        "max_places": "case when n_nationkey % 10 = 9 then null else 1 + n_nationkey % 5 end",
        "priority_weight": "case when n_nationkey % 9 = 8 then null else n_regionkey end",
        "created_at": f"{_NOW} - {_days('n_nationkey % 6')}",
    }),
    "user_profiles": ("customer", {
        "id": "c_custkey",
        "full_name": "c_name",
        "role": "case c_mktsegment when 'AUTOMOBILE' then 'admin' when 'MACHINERY' then 'owner' "
                "when 'BUILDING' then null when 'FURNITURE' then '' else 'user' end",
        "email": "lower(c_name) || '@example.com'",
    }),
    "payments": ("orders", {
        "id": "o_orderkey",
        "user_id": "o_custkey",
        "package_id": "o_orderkey % 25",
        "status": "case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' "
                  "else 'cancelled' end",
        "amount": "cast(o_totalprice as decimal(18,2))",
        "payment_receipt_url": "case when o_orderkey % 3 = 0 then 'receipt/' || cast(o_orderkey as string) end",
        "created_at": "o_orderdate",
        "completed_at": f"case when o_orderstatus = 'F' then o_orderdate + {_days('1')} end",
    }),
    "subscriptions": ("orders", {
        "id": "o_orderkey",
        "user_id": "o_custkey",
        "package_id": "o_orderkey % 25",
        "status": _SUBSCRIPTION_STATUS,
        "started_at": "case when o_orderstatus = 'F' then o_orderdate end",
        "expires_at": "case when o_orderstatus = 'F' and o_orderkey % 10 <> 0 "
                      f"then o_orderdate + {_days('90 * (1 + (o_orderkey % 25) % 4)')} end",
        "payment_id": "case when o_orderstatus = 'F' then o_orderkey end",
        "amount": "cast(o_totalprice as decimal(18,2))",
        "auto_renew": "o_orderkey % 3 = 0",
        "notes": "case when o_orderkey % 2 = 0 then o_orderpriority end",
        "created_at": "o_orderdate",
        "updated_at": "o_orderdate",
    }),
    "providers": ("part", {
        "id": "p_partkey",
        "name": "p_name",
        "category": "p_type",
        "city": "p_brand",
        "address": "p_brand || ' ' || cast(p_size as string)",
        "phone": "cast(null as string)",
        "website": "'www.' || cast(p_partkey as string) || '.example.com/'",
        "image_url": "'img/' || cast(p_partkey as string)",
        "description": "case when p_size % 2 = 0 then p_type end",
        "user_id": "case when p_partkey % 7 = 0 then null else p_partkey - p_partkey % 4 end",
        "status": "case p_size % 5 when 0 then null when 1 then 'pending' when 4 then 'suspended' "
                  "else 'active' end",
        "created_at": f"case when p_size = 48 then null else {_NOW} - {_days('p_size * 2 - 8')} end",
        "updated_at": "cast(null as timestamp_ntz)",
    }),
    "services": ("lineitem", {
        "id": "l_orderkey * 10 + l_linenumber",
        "provider_id": "l_partkey",
        "name": "'service ' || cast(l_linenumber as string)",
        "description": "l_returnflag",
        "price": "case when l_suppkey % 9 = 0 then null else cast(l_extendedprice as decimal(18,2)) end",
        "image_url": "cast(null as string)",
        "delivery": "case l_returnflag when 'R' then true when 'A' then false end",
        "online": "l_linestatus = 'O'",
        "created_at": "l_shipdate",
    }),
    "ads": ("orders", {
        "id": "o_orderkey",
        "provider_id": "o_orderkey % 200",
        "service_id": "cast(null as bigint)",
        "title": "'ad ' || cast(o_orderkey as string)",
        "description": "o_orderpriority",
        "status": "case o_orderstatus when 'F' then 'active' when 'O' then 'pending' end",
        "start_date": "o_orderdate",
        "end_date": f"o_orderdate + {_days('30')}",
        "created_at": "o_orderdate",
    }),
    "ads_images": ("lineitem", {
        "id": "l_orderkey * 10 + l_linenumber",
        "ad_id": "l_orderkey",
        "image_url": "'img/' || cast(l_partkey as string)",
    }),
    "favorites": ("events", {
        "id": "event_id",
        "user_id": "user_id",
        "provider_id": "event_id % 200",
    }),
    "visits": ("events", {
        "id": "event_id",
        "page": "case when event_type in ('view', 'click') then '/place/' else '/service/' end "
                "|| cast(user_id as string)",
        "device": "event_type",
        "created_at": "ts",
    }),
    "activities": ("supplier", {
        "id": "s_suppkey",
        "name": "s_name",
        "description": "cast(s_nationkey as string)",
        "created_at": f"{_NOW} - {_days('s_nationkey')}",
    }),
    "offers": ("part", {
        "id": "p_partkey",
        "price": "cast(p_retailprice as decimal(18,2))",
        "provider_id": "p_partkey",
        "active": "p_size > 10",
    }),
    "reviews": ("lineitem", {
        "id": "l_orderkey * 10 + l_linenumber",
        "provider_id": "l_partkey",
        "service_id": "l_orderkey * 10 + l_linenumber",
        "user_id": "l_suppkey",
        "rating": "1 + l_linenumber % 5",
        "comment": "l_returnflag || l_linestatus",
        "created_at": "l_shipdate",
    }),
    "payment_settings": ("region", {
        "id": "cast(r_regionkey as bigint)",
        "bank_name": "r_name",
        "bank_account": "cast(1000 + r_regionkey as string)",
        "account_name": "lower(r_name)",
        "mobile_wallet": "cast(null as string)",
        "instructions": "'pay at ' || r_name",
        "updated_at": f"{_NOW} - {_days('r_regionkey')}",
    }),
}


_FILES = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
            " p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,"
              " o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
                " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
                " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double,"
              " props string",
    "pages": "page_id bigint, url string, html string",
}


class Market:
    """The adapted tables of one folder, as attributes: `Market(spark, dir).providers`."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._files: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in _ADAPTERS:
            raise AttributeError(name)
        source, columns = _ADAPTERS[name]
        return self.raw(source).selectExpr(*[f"{expr} as {column}" for column, expr in columns.items()])

    def raw(self, name: str) -> DataFrame:
        if name not in self._files:
            self._files[name] = self.spark.read.schema(_FILES[name]).parquet(
                f"{self.sf_dir}/{name}.parquet")
        return self._files[name]

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in _ADAPTERS}
