import random
import re

import duckdb
import pytest

from pipelark.llm import queries, url_filter
from pipelark.llm.url_filter import Automaton, Rule


def regex(pattern):
    parts = re.findall(r"\*+|[^*]", pattern)
    return re.compile("".join("(?s:.*)" if len(p) > 1 else "[^/]*" if p == "*" else "[^/]" if p == "?" else re.escape(p) for p in parts))


def test_automaton_against_regular_expressions():
    rng = random.Random(1)
    for _ in range(60):
        patterns = ["".join(rng.choice(["a", "b", "/", "?", "*", "**", "é" if rng.random() < 0.1 else "c"]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 40))]
        patterns = [re.sub(r"\*{3,}", "**", p) for p in patterns]
        texts = ["".join(rng.choice("abc/" if rng.random() < 0.8 else "é日\U0001f600") for _ in range(rng.randint(0, 30))) for _ in range(40)] + [""]
        found = Automaton(patterns).match([t.encode() for t in texts])
        for i, text in enumerate(texts):
            assert [bool(regex(p).fullmatch(text)) for p in patterns] == found[i].tolist()


def test_rows_wider_than_a_word():
    patterns = [f"host{i}.example/**path{i}**" for i in range(50)]
    made = Automaton(patterns)
    assert made.words > 10
    found = made.match([b"host7.example/x/path7/y", b"host7.example/x/path8", b"host49.example/path49"])
    assert [row.nonzero()[0].tolist() for row in found] == [[7], [], [49]]


def test_nothing_to_match():
    assert Automaton([]).match([b"abc", b""]).shape == (2, 0)
    assert Automaton(["*"]).match([]).shape == (0, 1)


URLS = [
    (None, "", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("://", "", "", None, "allow"),
    ("http://Example.COM/en/x", "example.com", "/en/x", "example.com/en/", "block"),
    ("http://www.example.com/en/x?q=/es/", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://badexample.com/en/", "badexample.com", "/en/", "com/", "allow"),
    ("http://example.com/EN/", "example.com", "/EN/", "com/", "allow"),
    ("http://example.com", "example.com", "", None, "allow"),
    ("http://example.com?x=1", "example.com", "", None, "allow"),
    ("ftp://x.net/es/1#f", "x.net", "/es/1", "net/es/", "block"),
    ("http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    ("http://x.org/a.com/en/", "x.org", "/a.com/en/", None, "allow"),
    ("http://xnet/fr/", "xnet", "/fr/", None, "allow"),
    ("http://spam-farm.example.org/en/1", "spam-farm.example.org", "/en/1", None, "block"),
    ("http://x.org/spam", "x.org", "/spam", None, "allow"),
    ("http://ÉX.org/Ü", "Éx.org", "/Ü", None, "allow"),
    ("x://http://a.net/es/", "http:", "//a.net/es/", None, "allow"),
    ("http://x.com:80/", "x.com:80", "/", None, "allow"),
    ("http://x.com/a\nb", "x.com", "/a\nb", "com/", "allow"),
]


def test_contract(spark):
    frame = spark.createDataFrame([(i, u[0], "old") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    found = url_filter.filter_urls(frame, queries.URL_RULES, queries.URL_BLOCKED).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in found] == [u[1:] for u in URLS]


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", [(i, u[0]) for i, u in enumerate(URLS)])
    rows = con.execute(f"select host, path, rule, verdict from ({queries.OP3_SQL}) order by page_id").fetchall()
    assert rows == [u[1:] for u in URLS]


def test_odd_rows(nasty, empty, others):
    found = url_filter.filter_urls(nasty, queries.URL_RULES, queries.URL_BLOCKED, url="text")
    others(found, ("host", "path", "rule", "verdict"))
    assert {r.verdict for r in found.collect()} == {"allow"}
    assert url_filter.filter_urls(empty, queries.URL_RULES, [], url="text").collect() == []


@pytest.mark.parametrize("n", [0, 300])
def test_many_rules(spark, n):
    rules = [Rule(f"h{i}.org", "/", "block") for i in range(n)]
    frame = spark.createDataFrame([("http://h299.org/x",), ("http://h300.org/x",)], "url string")
    assert [r.verdict for r in url_filter.filter_urls(frame, rules, []).collect()] == (["block", "allow"] if n else ["allow", "allow"])
