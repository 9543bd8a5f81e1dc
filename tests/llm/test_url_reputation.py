from pyspark.sql import functions as F

from dyadscope.llm import queries, url_reputation


def _parts(spark, urls):
    host, path = url_reputation.host_and_path(F.col("url"))
    df = spark.createDataFrame([(u,) for u in urls], "url string").select(host.alias("h"), path.alias("p"))
    domain, suffix = url_reputation.domain_and_suffix(F.col("h"))
    return [tuple(r) for r in df.select("h", "p", domain, suffix).collect()]


def test_parts_of_urls(spark):
    urls = ["http://A.B.Example.CO.UK:80/x/Y?q#f", "https://h?x=://y/z", "no scheme/path", None, "x://", "ftp://10.0.0.1/a", "//h/p", "a://b://c/d", "s://ÉX.com#f/g"]
    assert _parts(spark, urls) == [
        ("a.b.example.co.uk:80", "/x/Y", "example.co.uk", "co.uk"), ("h", "", "h", "h"), ("", "", "", ""), ("", "", "", ""), ("", "", "", ""),
        ("10.0.0.1", "/a", "10.0.0.1", ""), ("", "", "", ""), ("b:", "//c/d", "b", "b"), ("Éx.com", "", "Éx.com", "com"),
    ]


def test_longest_rule_wins(spark):
    rows = [("a.org", "/es/"), ("example.org", "/es/x"), ("www.example.org", "/en/12"), ("badexample.org", "/en/12"), ("org", "/"), ("a.org", ""), ("x.com", "/de/1"), ("x.com", "/en/")]
    rule, verdict = url_reputation.first_rule(F.col("h"), F.col("p"), queries.URL_RULES)
    got = [tuple(r) for r in spark.createDataFrame(rows, "h string, p string").select(rule, verdict).collect()]
    assert got == [
        ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("org/", "allow"), ("org/", "allow"), (None, None), ("com/de/", "block"), (None, None),
    ]


def test_hosts_shrink_to_their_domain_and_bad_ones_are_blocked(spark):
    pages, outcomes, n = [], [], 0
    hosts = [("b.fine.com", 0, 1), ("c.fine.com", 0, 0), ("y.foul.net", 0, 0), ("z.mild.net", 30, 5)]
    hosts += [(f"a{i}.fine.com", 19, 1) for i in range(10)] + [(f"x{i}.foul.net", 1, 19) for i in range(10)]
    for host, good, bad in hosts:
        for k in range(good + bad + 1):
            pages.append((n, f"http://{host}/p{k}"))
            if k < good + bad:
                outcomes.append((n, int(k < good)))
            n += 1
    judged = url_reputation.judge(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(outcomes, "page_id bigint, good int"))
    by_host = {r["host"]: r["verdict"] for r in judged.collect()}
    bad = {h for h, v in by_host.items() if v == "block"}
    assert bad == {"y.foul.net", *(f"x{i}.foul.net" for i in range(10))}


def test_odd_rows(spark):
    pages = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "http://a.com/", 3), (3, "http://a.com/", 4), (3, "http://a.com/", 4)], "page_id bigint, url string, host int")
    outcomes = spark.createDataFrame([(3, 1, "x"), (3, 1, "x"), (2, None, "y"), (None, 0, "z")], "page_id bigint, good int, host string")
    rows = url_reputation.judge(pages, outcomes).collect()
    assert len(rows) == 5 and {r["verdict"] for r in rows} == {"allow"}
    none = spark.createDataFrame([], "page_id bigint, good int")
    assert url_reputation.judge(pages, none).count() == 5 and url_reputation.judge(pages.limit(0), none).count() == 0


def test_a_page_names_the_document_at_the_end_of_its_path(spark):
    from dyadscope.llm.queries import named_document

    urls = {
        "http://1.2.3.4/fr/77": 77, "https://9news.com/en/5": 5, "http://a.org/2024/07/123.html?x=/9": 123, "http://a.org/en/7#top/8": 7, "http://a.org/12/about": None,
        "http://a.org/1234567890123456789": None, "http://a.org": None, "no url/5": None, "http://a.org/x5": None, "http://a.org/5x": None, None: None, "": None,
    }
    rows = spark.createDataFrame([(u,) for u in urls], "url string").select("url", named_document(F.col("url")).alias("d")).collect()
    assert {r["url"]: r["d"] for r in rows} == urls
