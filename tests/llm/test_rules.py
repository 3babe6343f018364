"""URL rules and licences."""

import random
import time
from collections import Counter

import edge
import pytest

from loadcast.llm import licences, urls
from loadcast.llm.queries import URL_RULES

PAGES = [(1, "http://Www.Example.ORG/en/123?x=/fr/"), (2, "https://a.b.com/fr/x#y"), (3, None), (4, "no scheme"), (5, ""),
         (6, "http://example.org/es/"), (7, "http://example.org"), (8, "http://org/x"), (9, "ftp://x.com/de/://y"),
         (10, "http://notexample.org/es/"), (11, "http://x.com:80/fr/"), (12, "http://?x"), (12, "http://?x"), (None, "http://b.com/de/"),
         (13, "a://b://c/d"), (14, "http://a..org/x"), (15, "http://x.com/de\n/fr/"), (16, "http://.org/es/"), (17, "http://com/de/")]


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def brute(url, rules):
    host, path = split(url)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


def table(spark, rows):
    return spark.createDataFrame([(i, u, "clash", "clash", "clash") for i, u in rows],
                                 "page_id bigint, url string, host string, rule string, short string")


@pytest.mark.parametrize("broadcast_rules", [0, 1000])
def test_urls_match_brute_force(spark, broadcast_rules):
    rng = random.Random(4)
    rules = list(URL_RULES) + [("x.com", "", "allow"), ("example.org", "/en/1", "allow"), ("b.com", "/de/", "allow")]
    rows = PAGES + [(100 + i, f"http://{rng.choice(['a.', 'www.', ''])}{rng.choice(['example.org', 'x.com', 'b.net'])}"
                     f"{rng.choice(['/', '/en/1', '/en/2', '/fr/', '/es/', ''])}{rng.randrange(30)}") for i in range(300)]
    given = spark.createDataFrame(rules + [(None, "/", "block"), ("y", "/", None)], "host string, path string, verdict string")
    found = urls.judge(table(spark, rows), given, broadcast_rules=broadcast_rules).collect()
    assert Counter(map(tuple, found)) == Counter((i, *brute(u, rules)) for i, u in rows)


def test_very_long_hosts(spark):
    rows = [(1, "http://" + "a." * 300_000 + "example.org/es/x"), (2, "http://" + "b" * 500_000 + ".com/de/" + "c" * 500_000),
            (3, "x" * 1_000_000), (4, "http://" + "." * 500_000)]
    given = spark.createDataFrame([*URL_RULES, (".org", "/", "block"), ("a.b.c.com", "/", "block")],
                                  "host string, path string, verdict string")
    start = time.perf_counter()
    found = urls.judge(table(spark, rows), given).collect()
    assert time.perf_counter() - start < 30
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found} == {i: brute(u, URL_RULES) for i, u in rows}


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in urls.judge(table(spark, PAGES), rules).collect()} == {"allow"}
    assert urls.judge(table(spark, []), rules).count() == 0


def test_licences(spark):
    mit = licences.KNOWN[0][1]
    variant = "Copyright (c) 2020 Some Body\n" + mit.upper().replace("LICENSE", "LICENCE").replace(",", " ;").replace("\n", "\n\n")
    rows = [edge.row(1, mit), edge.row(2, variant), edge.row(3, mit + " and more"), edge.row(4, None), edge.row(5, ""),
            edge.row(6, "text\nReleased under the MIT Licence!\nmore\n licensed under cc by-nc 4.0"),
            edge.row(7, "Released under the MIT License."), edge.row(7, "Released under the MIT License."),
            edge.row(None, "Licensed under the Apache Licence, version 2.0"), edge.row(8, "(c) 2020 me\n"),
            edge.row(9, "é Released under the MIT License.")]
    found = licences.scan(edge.frame(spark, rows)).collect()
    got = Counter((r.doc_id, r.licence, r.notices) for r in found)
    assert got == Counter({(1, "MIT", None): 1, (2, "MIT", None): 1, (3, None, None): 1, (4, None, None): 1,
                           (5, None, None): 1, (6, None, "CC-BY-NC-4.0,MIT"): 1, (7, "MIT", "MIT"): 2,
                           (None, "Apache-2.0", "Apache-2.0"): 1, (8, None, None): 1, (9, None, None): 1})
    assert licences.scan(edge.frame(spark, [])).count() == 0
