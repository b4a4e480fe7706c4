"""Searches through the trigram table against a scan of the names."""

import random

import pytest
from pyspark.sql import functions as F

from stallbook.functions import predicates as P
from stallbook.sources import trigrams as G

ODD = ["İstanbul Café", "ΟΔΟΣ ΑΒΓ", "οδος αβγ", "Straße 12", "100% cotton", "a_b_c shop", "back\\slash",
       "مطعم البيت", "مقهى البيت القديم", "𝔘nicode 𝔘ni", "ab", "", "   ", "aaa", "aaaa", None, "Café bar"]


@pytest.fixture(scope="module")
def names(spark, tmp_path_factory):
    rnd = random.Random(1)
    words = ["blue", "bolt", "grand", "Shop", "house", "CAFE", "garden", "of", "x"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 4)))) for i in range(400)]
    rows += [(1000 + i, "The Corner Shop") for i in range(200)]
    rows += [(2000 + i, n) for i, n in enumerate(ODD)]
    path = str(tmp_path_factory.mktemp("names"))
    df = spark.createDataFrame(rows, "id bigint, name string")
    G.add(df, path, files=4)
    return df, path


LIKE = ["bolt garden", "GRAND%house", "b_ue b%t", "100\\%", "a\\_b\\_c", "a_b_c", "back\\\\slash", "οδοσ αβ", "ΟΔΟΣ",
        "istanbul", "İSTAN", "STRASSE", "straße", "البيت", "مقهى%قديم", "𝔘nicode", "café", "aaaa", "ab", "%", "",
        None, "zzz", "corner", "of of of", "cotton\\", "e_b_l"]


@pytest.mark.parametrize("text", LIKE)
def test_like_is_the_scan(names, text):
    df, path = names
    want = sorted(r["id"] for r in df.filter(P.name_like(text)).collect())
    assert sorted(r["id"] for r in G.like(df, path, text).collect()) == want


@pytest.mark.parametrize("text", ["bolt g", "100%", "a_b", "back\\s", "البيت", "CAFÉ", "x", " ", None, "Corner Shop"])
def test_containing_is_the_scan(names, text):
    df, path = names
    want = sorted(r["id"] for r in df.filter(P.name_contains(text, "name")).collect())
    assert sorted(r["id"] for r in G.containing(df, path, text, name="name").collect()) == want


def test_runs_of_a_pattern():
    assert G.letters("%ab_c\\%d%\\\\e\\") == ["ab", "c%d", "\\e"]
    assert G.letters("%%__") == [] and G._cut(["ab", "abcd"]) == ["abc", "bcd"]


def test_rare_letters_use_the_table_and_frequent_ones_scan(names):
    df, path = names
    spark = df.sparkSession
    assert G._ids(spark, path, "bigint", G._cut(["corner"])) is None
    assert G._ids(spark, path, "bigint", G._cut(["ab"])) is None
    found = G._ids(spark, path, "bigint", G._cut(["cotton"]))
    assert "PushedFilters: [In(gram" in found._jdf.queryExecution().toString()
    assert [r["id"] for r in found.collect()] == [2004]


def test_added_and_renamed_rows_are_found(spark, tmp_path):
    path = str(tmp_path / "n")
    old = spark.createDataFrame([(i, f"place {i:04}") for i in range(50)], "id bigint, name string")
    G.add(old, path, files=2)
    renamed = spark.createDataFrame([(7, "zebra bar"), (90, "zebra inn")], "id bigint, name string")
    G.add(renamed, path, files=2)
    G.add(renamed, path, files=2)  # a repeated call does no harm
    now = old.filter("id <> 7").unionByName(renamed)
    for text, want in (("zebra", [7, 90]), ("0007", []), ("0012", [12])):
        assert sorted(r["id"] for r in G.like(now, path, text).collect()) == want
    assert G.like(now.withColumn("gram", F.lit(1)), path, "zebra").columns == ["id", "name", "gram"]
    G.add(old.limit(0), str(tmp_path / "none"), files=2)
    assert G.like(old.limit(0), str(tmp_path / "none"), "zebra").collect() == []
