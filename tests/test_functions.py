from datetime import datetime, timedelta

from market_rows import NOW, dicts
from pyspark.sql import functions as F

from stallbook.functions import fixed_values as V
from stallbook.functions import predicates as P
from stallbook.functions import scalars as S
from stallbook.functions.clock import moment, plus_days, whole_days
from stallbook.functions.ordering import newest, top


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_url_forms(spark):
    cases = {
        "http://a.b/c": "http://a.b/c",
        "HTTPS://a.b": "HTTPS://a.b",
        "facebook.com/x": "https://facebook.com/x",
        "Facebook.com/x": "https://Facebook.com/x",
        "a.b/c": "https://a.b/c",
        "my-shop.co.uk/": "https://my-shop.co.uk/",
        "a.b": "a.b",
        "word": "word",
        "  a.b/c \t\n": "https://a.b/c",
        " word　": "word",
        "   ": "",
        "": "",
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "url string")
    got = {r.url: r.x for r in df.select("url", S.normalize_url(F.col("url")).alias("x")).collect()}
    assert got == cases


def test_expiry_edges(spark, tables):
    rows = [{"id": i, "status": s, "expires_at": e} for i, (s, e) in enumerate([
        ("active", NOW - timedelta(seconds=1)), ("active", NOW), ("active", NOW + timedelta(seconds=1)),
        ("active", None), ("pending", None), ("expired", NOW + timedelta(days=1))])]
    df = tables("subscriptions", rows)
    at = moment(NOW, df, "expires_at")
    got = dicts(df.select("id", P.live(at).alias("live"), P.expired(at).alias("expired"),
                          P.still_paid(at).alias("paid")).orderBy("id"))
    assert [r["live"] for r in got] == [False, False, True, True, False, False]
    assert [r["expired"] for r in got] == [True, False, False, False, False, False]
    assert [r["paid"] for r in got] == [False, True, True, None, None, True]


def test_provider_visibility_differs_between_generations(spark):
    df = spark.createDataFrame([("active",), ("pending",), (None,)], "status string")
    got = dicts(df.select("status", P.visible().alias("now"), P.visible_or_unset().alias("then")))
    assert [(r["now"], r["then"]) for r in got] == [(True, True), (False, False), (False, True)]


def test_days_are_whole_and_truncated_toward_zero(spark):
    def days(a, b):
        return one(spark, whole_days(F.lit(a), F.lit(b)))

    base = datetime(2024, 1, 1, 12)
    assert days(base + timedelta(days=9, hours=-1), base) == 8
    assert days(base - timedelta(days=2, hours=23), base) == -2
    assert one(spark, plus_days(F.lit(base), F.lit(31))) == datetime(2024, 2, 1, 12)
    assert one(spark, plus_days(F.lit(base), F.lit(None).cast("int"))) is None


def test_recency(spark, tables):
    made = {1: NOW, 2: NOW - timedelta(days=29, hours=23), 3: NOW - timedelta(days=45), 4: None,
            5: NOW + timedelta(days=2)}
    df = tables("providers", [{"id": k, "created_at": v} for k, v in made.items()])
    bonus = S.recency(F.col("created_at"), moment(NOW, df, "created_at"))
    got = {r.id: r.b for r in df.select("id", bonus.alias("b")).collect()}
    assert got == {1: 30, 2: 1, 3: 0, 4: 0, 5: 32}


def test_notes(spark):
    assert one(spark, S.append_note(F.lit(None).cast("string"), F.lit("a"))) == "a"
    assert one(spark, S.append_note(F.lit("x"), F.lit("a"))) == "x\na"
    assert one(spark, S.append_note(F.lit("x"), F.lit(None).cast("string"))) is None


def test_names_and_roles(spark):
    assert one(spark, S.display_name(F.lit(""), F.lit("a@b.c"))) == "a@b.c"
    assert one(spark, S.display_name(F.lit("A"), F.lit("a@b.c"))) == "A"
    assert one(spark, S.display_name(F.lit(""), F.lit(""))) == V.NEW_USER
    assert one(spark, S.name_from_email(F.lit("ann@b.c"))) == "ann"
    assert one(spark, S.normalize_role(F.lit(" Admin "))) == "admin"


def test_status_text_falls_back_to_pending(spark):
    assert one(spark, S.status_text(F.lit("expired"))) == V.STATUS_TEXTS["expired"]
    assert one(spark, S.status_text(F.lit("odd"))) == V.STATUS_TEXTS["pending"]
    assert one(spark, S.status_text(F.lit(None).cast("string"))) == V.STATUS_TEXTS["pending"]


def test_form_numbers(spark):
    for text, want in (("7", 7), ("0", 30), ("", 30), ("x", 30), (None, 30)):
        assert one(spark, S.number_or(F.lit(text).cast("string"), "int", 30)) == want


def test_searches(spark):
    df = spark.createDataFrame([("Blue Cafe",), ("cafe_red",), ("Tea",), (None,)], "name string")
    assert df.filter(P.name_like(" CAFE ")).count() == 2
    assert df.filter(P.name_like("e_r")).count() == 1
    assert df.filter(P.name_like("  ")).count() == 4
    assert df.filter(P.name_contains("AF", "name")).count() == 2
    assert df.filter(P.name_contains("%", "name")).count() == 0
    assert df.filter(P.name_contains(None, "name")).count() == 4


def test_optional_filter(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "status string")
    assert df.filter(P.equals_if_given("status", None)).count() == 3
    assert df.filter(P.equals_if_given("status", "a")).count() == 1


def test_newest_puts_missing_first(spark, tables):
    df = tables("ads", [{"id": 1, "created_at": NOW}, {"id": 2}, {"id": 3, "created_at": NOW}])
    got = [r.id for r in top(df, newest("created_at"), ["id", "created_at"], 3).collect()]
    assert got == [2, 1, 3]
    assert [r.id for r in top(df, newest("created_at"), ["id"], 1, 1).collect()] == [1]
