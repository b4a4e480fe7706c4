import math

from pyspark.sql import functions as F

from stallbook.llm import url_filters as u


def test_hosts_paths_rules_and_odd_urls(spark):
    urls = {1: "HTTPS://A.Example.ORG/es/x?q#f", 2: "http://org", 3: "no scheme/x", 4: None,
            5: "x://b.com/de/1://y", 6: "x://example.org/en/12#a", 7: "x://notexample.org/es/",
            8: "x://ÄB.com?u", 9: "://com/fr/", 10: "x://" + "a" * 5000 + ".net/" + "p" * 20000}
    pages = spark.createDataFrame([(i, x, "mine", "too") for i, x in urls.items()] + [
        (1, urls[1], "mine", "too")], "page_id long, url string, host string, rate string")
    none = spark.createDataFrame([], "outcome_key long, bad boolean")
    got = u.filter_urls(pages.drop("host", "rate"), none, ["org/", "com/fr/"],
                        ["example.org/es/", "example.org/en/1", "com/de/"])
    rows = {r.page_id: (r.host, r.path[:9], r.rule, r.verdict) for r in got.collect()}
    assert got.count() == 11
    assert rows[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert rows[2] == ("org", "", None, "allow")
    assert rows[3] == rows[4] == ("", "", None, "allow")
    assert rows[5] == ("b.com", "/de/1://y", "com/de/", "block")
    assert rows[6] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert rows[7] == ("notexample.org", "/es/", "org/", "allow")
    assert rows[8] == ("Äb.com", "", None, "allow")
    assert rows[9] == ("com", "/fr/", "com/fr/", "allow")
    assert rows[10][0].endswith("a.net") and rows[10][3] == "allow"
    clash = u.filter_urls(pages, none)
    assert clash.where("host = 'mine' AND rate = 'too'").count() == 11
    assert u.filter_urls(pages.limit(0), none).collect() == []


def test_suffixes_and_domains(spark):
    hosts = ["a.b.co.uk", "co.uk", "b.co.uk", "x.y.org", "org", ""]
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    suffix = u.suffix_of(F.col("host"), ["co.uk"])
    got = df.select("host", suffix.alias("s"), u.domain_of(F.col("host"), suffix).alias("d")).collect()
    assert {r.host: (r.s, r.d) for r in got} == {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"),
        "b.co.uk": ("co.uk", "b.co.uk"), "x.y.org": ("org", "y.org"), "org": ("org", "org"),
        "": ("", "")}


def brute(hosts, z):
    """Posterior rate and bound of every host, in plain Python."""
    def total(key):
        out = {}
        for h in hosts:
            n, bad = out.get(key(h), (0, 0))
            out[key(h)] = (n + h["n"], bad + h["bad"])
        return out

    def rho(children):
        top = sum((s - n * m) ** 2 - n * m * (1 - m) for n, s, m in children)
        room = sum(n * (n - 1) * m * (1 - m) for n, s, m in children)
        return min(max(top / room, 1e-4), 0.5) if room else 1e-4

    domains, suffixes = total(lambda h: (h["suffix"], h["domain"])), total(lambda h: h["suffix"])
    n, bad = total(lambda h: 0)[0]
    mean = bad / n
    raw = lambda x: x[1] / x[0] if x[0] else mean
    w_s = 1 / rho([(*x, mean) for x in suffixes.values()]) - 1
    w_d = 1 / rho([(*x, raw(suffixes[k[0]])) for k, x in domains.items()]) - 1
    w_h = 1 / rho([(h["n"], h["bad"], raw(domains[h["suffix"], h["domain"]])) for h in hosts]) - 1
    out = {}
    for h in hosts:
        sn, sb = suffixes[h["suffix"]]
        dn, db = domains[h["suffix"], h["domain"]]
        prior = ((mean * w_s + sb) / (w_s + sn) * w_d + db) / (w_d + dn)
        a, b = prior * w_h + h["bad"], (1 - prior) * w_h + h["n"] - h["bad"]
        rate = a / (a + b)
        out[h["host"]] = rate, rate - z * math.sqrt(rate * (1 - rate) / (a + b + 1))
    return out


def test_reputations_shrink_like_the_formula_and_block_what_is_surely_bad(spark, tmp_path):
    hosts = []
    for i in range(30):
        suffix = ("com", "net", "org")[i % 3]
        n = (i * 13) % 40
        hosts.append({"host": f"h{i}.d{i % 7}.{suffix}", "domain": f"d{i % 7}.{suffix}",
                      "suffix": suffix, "n": n, "bad": float(n if i == 11 else n * (i % 5) // 9)})
    path = str(tmp_path / "hosts")
    spark.createDataFrame(hosts).write.parquet(path)
    got = u.reputations(spark.read.parquet(path), max_bad=0.5).collect()
    want = brute(hosts, 1.645)
    assert len(got) == 30
    for r in got:
        assert math.isclose(r.rate, want[r.host][0], rel_tol=1e-9)
        assert math.isclose(r.bound, want[r.host][1], rel_tol=1e-9)
        assert r.verdict == ("block" if want[r.host][1] > 0.5 else "allow")
    assert [r.host for r in got if r.verdict == "block"] == ["h11.d4.org"]


def test_outcomes_that_count(spark):
    pages = spark.createDataFrame(
        [(i, f"x://{'bad' if i < 60 else 'good'}.a.com/{i}", "p") for i in range(120)]
        + [(500, "x://bad.a.com/none", "p"), (None, None, None)], "page_id long, url string, key string")
    outcomes = spark.createDataFrame(
        [(i, i < 60) for i in range(120)] + [(None, True), (7777, True), (3, None)],
        "outcome_key long, bad boolean")
    got = u.filter_urls(pages, outcomes, key=F.col("page_id"), max_bad=0.5)
    by = {r.page_id: r for r in got.collect()}
    assert by[500].verdict == "block" and by[500].labelled == 60
    assert by[100].verdict == "allow" and by[None].verdict == "allow" and by[None].labelled == 0
    assert by[1].key == "p"
