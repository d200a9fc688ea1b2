"""op3: parsing, rules and odd tables."""

from __future__ import annotations

from tracemill.llm.host_reputation import judged
from tracemill.llm.queries import RULES

URLS = [
    (1, None, ("", "", None, "allow")),
    (2, "no scheme at all", ("", "", None, "allow")),
    (3, "http://A.Example.ORG/es/x?y#z", ("a.example.org", "/es/x", "example.org/es/", "block")),
    (4, "https://example.org/en/12", ("example.org", "/en/12", "example.org/en/1", "block")),
    (5, "https://notexample.org/es/", ("notexample.org", "/es/", "org/", "allow")),
    (6, "x://b.com/de/?q=/fr/", ("b.com", "/de/", "com/de/", "block")),
    (7, "x://com/fr/a", ("com", "/fr/a", "com/fr/", "allow")),
    (8, "http://host.net?x", ("host.net", "", None, "allow")),
    (8, "http://host.net?x", ("host.net", "", None, "allow")),
    (None, "http://\u00c4.com", ("\u00c4.com", "", None, "allow")),
    (9, "http://org", ("org", "", None, "allow")),
    (10, "http://h.net/" + "p" * 10000, ("h.net", "/" + "p" * 10000, None, "allow")),
]
PAGE = "page_id long, url string, host int, domain string, n int, bad string, verdict int"


def frames(spark, urls, outcomes):
    pages = spark.createDataFrame([(i, u, 1, "d", 2, "b", 3) for i, u in urls], PAGE).repartition(2)
    return pages, spark.createDataFrame(outcomes, "page_id long, bad boolean")


def test_parsing_and_rules(spark):
    found = judged(*frames(spark, [r[:2] for r in URLS], [(1, False), (None, True), (3, None), (99, True)]), RULES).collect()
    got = sorted(((r.page_id, (r.host, r.path, r.rule, r.verdict)) for r in found), key=repr)
    assert got == sorted(((i, want) for i, _, want in URLS), key=repr)


def test_bad_hosts_are_blocked_and_good_ones_are_not(spark):
    urls = [(i, f"http://bad.net/{i}") for i in range(60)] + [(100 + i, f"http://good.info/{i}") for i in range(60)] + [(300, "http://new.biz/")]
    outcomes = [(i, True) for i in range(50)] * 2 + [(100 + i, False) for i in range(50)]
    verdict = {r.host: r.verdict for r in judged(*frames(spark, urls, outcomes), RULES).collect()}
    assert verdict == {"bad.net": "block", "good.info": "allow", "new.biz": "allow"}


def test_empty_tables(spark):
    assert judged(*frames(spark, [], []), RULES).count() == 0
    assert [r.verdict for r in judged(*frames(spark, [(1, "http://a.b/")], []), RULES).collect()] == ["allow"]
