from graftwork.llm import urls
from graftwork.llm.queries import BLOCKED_HOSTS, URL_RULES


def test_rules_and_lists(spark):
    cases = {
        "http://a.org/": ("a.org", "/", "org/", "allow"),
        "http://a.org": ("a.org", "", None, "allow"),
        "https://EXAMPLE.org/es/1?x": ("example.org", "/es/1", "example.org/es/", "block"),
        "https://m.example.org/en/17#t": ("m.example.org", "/en/17", "example.org/en/1", "block"),
        "https://badexample.org/es/": ("badexample.org", "/es/", "org/", "allow"),
        "x://y.com/fr/://z": ("y.com", "/fr/://z", "com/fr/", "allow"),
        "http://y.com/de": ("y.com", "/de", None, "allow"),
        "http://www.spam-farm.example.net/x": ("www.spam-farm.example.net", "/x", None, "block"),
        "http://spam-farm.example.org/x": ("spam-farm.example.org", "/x", "org/", "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        "http://": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(i, u, "rule") for i, u in enumerate(cases)] + [(None, "http://y.com/de/", "r"), (0, "http://a.org/", "r")]
    got = urls.filter_urls(spark, spark.createDataFrame(rows, "page_id bigint, url string, rule string"), URL_RULES, BLOCKED_HOSTS).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for i, want in enumerate(cases.values()):
        assert (by[i].host, by[i].path, by[i].rule, by[i].verdict) == want, want
    assert by[None].rule == "com/de/"


def test_collisions_are_confirmed():
    import io

    import numpy as np

    same = lambda b: 7
    files = urls.DigestArray.build([("a", 1), ("b", 2)], same)
    array = urls.DigestArray(*(np.load(io.BytesIO(x)) for x in files.values()), digest=same)
    assert array.find([b"b", b"c", b"a"]).tolist() == [2, -1, 1]


def test_no_rules_and_empty_table(spark):
    df = spark.createDataFrame([(1, "http://a.b/")], "page_id bigint, url string")
    assert urls.filter_urls(spark, df, []).first().verdict == "allow"
    assert urls.filter_urls(spark, df.limit(0), URL_RULES).count() == 0
