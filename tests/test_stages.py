"""Stages, expressions and nulls on small tables."""

from datetime import datetime, timedelta

import pytest

from pipelark import engine
from pipelark.errors import CatalogError, QueryTypeError
from pipelark.sources.catalog import Catalog, Entry

NOW = datetime(2024, 6, 1, 12)


@pytest.fixture(scope="module")
def catalog(spark):
    t = datetime(2024, 6, 1)
    logs = spark.createDataFrame(
        [
            (t, "eastus", 200, 1.5, True, timedelta(minutes=15), "u1"),
            (t + timedelta(hours=1), "westus", 500, None, False, timedelta(hours=1), "u2"),
            (t + timedelta(hours=2), None, 404, 3.0, None, None, None),
            (t + timedelta(hours=3), "eastus", None, -2.0, True, timedelta(seconds=-5), "u1"),
        ],
        "timestamp timestamp_ntz, region string, code int, dur double, ok boolean, ttl interval day to second, user string",
    )
    users = spark.createDataFrame([("u1", "free", 200), ("u2", "pro", 7), (None, "none", 0)], "user string, tier string, code int")
    many = spark.createDataFrame([("u1", "a"), ("u1", "b")], "user string, tag string")
    return Catalog([Entry(n, "dataframe", frame=f) for n, f in (("logs", logs), ("users", users), ("many", many))])


@pytest.fixture
def run(spark, catalog):
    def go(text):
        return [tuple(r) for r in engine.execute(spark, text, catalog, NOW).collect()]

    return go


@pytest.fixture
def columns(spark, catalog):
    return lambda text: [(c.name, c.origin, c.type) for c in engine.prepare(spark, text, catalog, NOW).columns]


@pytest.mark.parametrize(
    ("condition", "codes"),
    [
        ("code == 200", {200}),
        ("code != 200", {500, 404}),
        ("not (code == 200)", {500, 404, None}),
        ("not (code != 200)", {200, None}),
        ("not not (code == 200)", {200}),
        ("code in (200, 404)", {200, 404}),
        ("code !in (200, 404)", {500}),
        ("not (code in (200, 404))", {500, None}),
        ("not (code !in (200, 404))", {200, 404, None}),
        ("code between (200 .. 404)", {200, 404}),
        ("not (code between (200 .. 404))", {500, None}),
        ("code between (404 .. 200)", set()),
        ("isnull(code)", {None}),
        ("not isnotnull(code)", {None}),
        ("isempty(region)", {404}),
        ("isempty(code)", {None}),
        ('region contains "east"', {200, None}),
        ('region contains "EAST"', set()),
        ('region =~ "EASTUS"', {200, None}),
        ('region startswith "west" or region endswith "stus" and code == 200', {500, 200}),
        ("ok == true", {200, None}),
        ("not (ok == true)", {500, 404}),
        ("dur > 1 and dur < 2.0", {200}),
        ("not (dur > 1 and dur < 2.0)", {500, 404, None}),
        ("not (dur > 1 or code == 500)", {None}),
        ("dur * 2 == code - 197", {200}),
        ("timestamp > ago(11h)", {404, None}),
        ("timestamp - datetime(2024-06-01) > timestamp - datetime(2024-06-01)", set()),
        ("1 == 1", {200, 500, 404, None}),
    ],
)
def test_where(run, condition, codes):
    assert {c for (c,) in run(f"logs (*) | where {condition} | project code")} == codes


def test_project_arithmetic(run, columns):
    text = "logs (*) | project a = code / 3, b = code * 2 - 1, c = code / 2.0, d = -dur, e = timestamp - timestamp, f = timestamp + ttl, g = ttl * 2, h = ttl / 2, i = ttl - ttl, j = -ttl"
    assert [c[2] for c in columns(text)] == ["long", "long", "real", "real", "timespan", "datetime", "timespan", "timespan", "timespan", "timespan"]
    row = run(text)[0]
    t, m = datetime(2024, 6, 1), timedelta(minutes=1)
    assert row == (66, 399, 100.0, -1.5, timedelta(0), t + 15 * m, 30 * m, 7.5 * m, timedelta(0), -15 * m)
    assert run("logs (*) | where code == 404 | project f = timestamp + ttl, c = dur + code") == [(None, 407.0)]
    assert run("logs (*) | where code == 200 | project q = (0 - 7 * code) / (2 * code)") == [(-3,)]


def test_division_by_zero_is_an_error(run):
    for what in ("code / 0", "dur / 0", "dur / 0.0", "ttl / 0"):
        with pytest.raises(Exception, match="BY_ZERO"):
            run(f"logs (*) | project x = {what}")


def test_origins(columns):
    assert columns("logs (*) | project code, c = code, d = code + 1") == [("code", "logs", "int"), ("c", "logs", "int"), ("d", None, "long")]
    assert columns("logs (*) | project c = code | where logs.c == 1 | project logs.c") == [("c", "logs", "int")]
    assert columns("logs (*) | summarize sum(code), n = count() by region") == [("sum_code", None, "long"), ("n", None, "long"), ("region", "logs", "string")]


def test_aggregates(run, columns):
    text = "logs (*) | summarize count(), sum(code), sum(dur), avg(code), min(dur), max(timestamp), min(ttl), dcount(region), dcount(ok)"
    assert [c[0] for c in columns(text)] == ["count_", "sum_code", "sum_dur", "avg_code", "min_dur", "max_timestamp", "min_ttl", "dcount_region", "dcount_ok"]
    assert run(text) == [(4, 1104, 2.5, 368.0, -2.0, datetime(2024, 6, 1, 3), timedelta(seconds=-5), 2, 2)]
    assert run("logs (*) | where isnull(code) | summarize sum(code), avg(code), max(code), dcount(code)") == [(0, None, None, 0)]
    assert sorted(run("logs (*) | summarize n = count() by region"), key=str) == [(1, "westus"), (1, None), (2, "eastus")]
    assert run("logs (*) | where code == 1 | summarize n = count()") == []
    assert run("logs (*) | where code == 1 | summarize n = count() by region") == []
    assert run("logs (*) | summarize a = count(), a = sum(code) by ok | where not isnull(ok) | summarize n = count()") == [(2,)]


def test_count(run, columns):
    assert run("logs (*) | count") == [(4,)]
    assert run("logs (*) | where code == 1 | count") == [(0,)]
    assert columns("logs (*) | count") == [("count", None, "long")]
    assert run("logs (*) | count | where count_ > 3 | project n = count_ * 2") == [(8,)]


def test_sort_and_take(run):
    assert [r[0] for r in run("logs (*) | sort by code | project code")] == [200, 404, 500, None]
    assert [r[0] for r in run("logs (*) | sort by code desc | project code")] == [500, 404, 200, None]
    assert run("logs (*) | sort by region desc, code desc | take 2 | project region, code") == [("westus", 500), ("eastus", 200)]
    assert len(run("logs (*) | take 3")) == 3
    assert len(run("logs (*) | take 2147483647")) == 4


def test_join(run, columns):
    assert [c[:2] for c in columns("logs (*) | project user, code | join (users (*)) on user")] == [("user", "logs"), ("code", "logs"), ("user", "users"), ("tier", "users"), ("code", "users")]
    # Null keys equal each other.
    joined = run("logs (*) | project user, code | join (users (*)) on user | project logs.user, logs.code, tier")
    assert sorted(joined, key=str) == sorted([("u1", 200, "free"), ("u2", 500, "pro"), (None, 404, "none"), ("u1", None, "free")], key=str)
    assert run("logs (*) | join (users (*)) on user, code | project user, tier, users.user, users.code") == [("u1", "free", "u1", 200)]
    assert run("logs (*) | join (users (*) | project tier, id = user) on $left.user == $right.id | where tier == \"pro\" | project user, id") == [("u2", "u2")]
    assert sorted(run('logs (*) | where code == 200 | join (many (*)) on user | project tag')) == [("a",), ("b",)]
    assert run("logs (*) | where code == 1 | join (many (*)) on user | count") == [(0,)]
    assert run("logs (*) | project x = code + 0 | join (users (*)) on $left.x == $right.code | project tier") == [("free",)]


def test_self_join(run):
    assert sorted(run("users (*) | project user, a = tier | join (users (*) | project user, b = tier) on user | project user, a, b"), key=str) == sorted([("u1", "free", "free"), ("u2", "pro", "pro"), (None, "none", "none")], key=str)


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("logs (*) | where nope == 1", "not found"),
        ("logs (*) | where Code == 1", "not found"),
        ("logs (*) | where users.code == 1", "not found"),
        ("logs (*) | project code | where region == \"x\"", "not found"),
        ("logs (*) | where code == \"x\"", "mismatch"),
        ("logs (*) | where code contains \"x\"", "mismatch"),
        ("logs (*) | where code contains 1", "not applicable"),
        ("logs (*) | where ok < true", "not applicable"),
        ("logs (*) | where region in (1)", "mismatch"),
        ("logs (*) | where timestamp between (1 .. 2)", "mismatch"),
        ("logs (*) | where timestamp =~ timestamp", "not applicable"),
        ("logs (*) | project x = 1", "must be computed"),
        ("logs (*) | project x = region + 1", "no type rule"),
        ("logs (*) | project x = timestamp + timestamp", "no type rule"),
        ("logs (*) | project x = 2 * ttl", "no type rule"),
        ("logs (*) | project x = ttl + timestamp", "no type rule"),
        ("logs (*) | project x = -region", "no negative"),
        ("logs (*) | summarize sum(region)", "not applicable"),
        ("logs (*) | summarize avg(timestamp)", "not applicable"),
        ("logs (*) | summarize min(region)", "not applicable"),
        ("logs (*) | join (users (*)) on region", "not found"),
        ("logs (*) | join (users (*)) on $left.code == $right.tier", "cannot compare"),
        ("logs (*) | join (users (*)) on user | project code", "ambiguous"),
        ("logs (*) | sort by nope", "not found"),
        ("users (last 1d)", "no time column"),
    ],
)
def test_faults(spark, catalog, text, message):
    with pytest.raises(QueryTypeError, match=message):
        engine.execute(spark, text, catalog, NOW)


def test_unknown_table(spark, catalog):
    for text in ("nope (*)", "logs (*) | join (nope (*)) on user"):
        with pytest.raises(CatalogError, match="nope"):
            engine.execute(spark, text, catalog)


def test_windows(run):
    assert run("logs (last 10h) | count") == [(2,)]
    assert run("logs (datetime(2024-06-01 01:00) .. datetime(2024-06-01 02:00)) | count") == [(2,)]
    assert run("logs (datetime(2024-06-02) .. datetime(2024-06-01)) | count") == [(0,)]
    # One clock for the whole query, sub-queries included.
    assert run("logs (last 10h) | project user, a = timestamp | join (logs (last 10h) | project user, b = timestamp) on user | where a == b | count") == [(2,)]


def test_empty_results_have_columns(spark, catalog):
    frame = engine.execute(spark, "logs (*) | where code == 1 | project region, n = code + 1", catalog)
    assert frame.columns == ["region", "n"] and frame.collect() == []


def test_types_from_spark(spark):
    frame = spark.sql("select cast(1 as tinyint) a, 2.5bd b, date'2024-01-01' c, array(1, 2) d, named_struct('x', 1) e, binary('q') f, timestamp'2024-01-01 00:00:00Z' g, float(0.5) h")
    catalog = Catalog([Entry("t", "dataframe", frame=frame)])
    result = engine.prepare(spark, "t (*)", catalog)
    assert [c.type for c in result.columns] == ["int", "real", "datetime", "dynamic", "dynamic", "dynamic", "datetime", "real"]
    assert tuple(result.frame.first()) == (1, 2.5, datetime(2024, 1, 1), "[1,2]", '{"x":1}', "q", datetime(2024, 1, 1), 0.5)


def test_plans(spark, tmp_path):
    """Filters and columns reach the scan, also negated ones; equal nulls don't cost the hash join; top k is one operator."""
    path = str(tmp_path / "t.parquet")
    spark.range(100).selectExpr("id", "id % 7 as k", "cast(id as string) as s", "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, id) as timestamp").write.parquet(path)
    catalog = Catalog([Entry("t", "parquet", path=path)])
    plan = lambda text: engine.explain(spark, text, catalog, NOW)
    found = plan("t (datetime(2024-01-01) .. datetime(2024-01-02)) | where not (k > 3 and id == 2) | project id")
    assert "GreaterThanOrEqual(timestamp" in found and "Or(" in found and "s:string" not in found
    joined = plan("t (*) | project k, id | join (t (*) | project k, s) on k")
    assert "NestedLoop" not in joined and "Cartesian" not in joined
    assert "TakeOrderedAndProject" in plan("t (*) | sort by k desc, id | take 5")


@pytest.fixture
def in_order(spark):
    """A query over 400 numbered rows of several partitions, whose order counts."""
    rows = spark.createDataFrame([(i, i * 7 % 5, "xyz"[i * i % 3]) for i in range(400)], "n int, k int, s string").repartitionByRange(6, "n").sortWithinPartitions("n")
    pairs = spark.createDataFrame([(k, p) for k in range(5) for p in (2, 1)], "k int, p int").coalesce(1)
    tables = Catalog([Entry("rows", "dataframe", frame=rows), Entry("pairs", "dataframe", frame=pairs)])
    return lambda text: [tuple(r) for r in engine.execute(spark, text, tables, NOW, ordered=True).collect()]


def test_take_gives_the_first_rows(in_order):
    rows = [(i, i * 7 % 5, "xyz"[i * i % 3]) for i in range(400)]
    assert in_order("rows (*)") == rows
    assert in_order("rows (*) | take 150") == rows[:150]
    assert in_order("rows (*) | where k == 3 | take 7 | project n") == [r[:1] for r in rows if r[1] == 3][:7]
    assert in_order("rows (*) | take 150 | where k == 3 | count") == [(30,)]


def test_sort_is_stable(in_order):
    rows = [(i, i * 7 % 5, "xyz"[i * i % 3]) for i in range(400)]
    assert in_order("rows (*) | sort by k") == sorted(rows, key=lambda r: r[1])
    assert in_order("rows (*) | sort by s desc | project n") == [r[:1] for r in sorted(rows, key=lambda r: -ord(r[2]))]
    assert in_order("rows (*) | sort by n desc | sort by k | take 90") == sorted(rows[::-1], key=lambda r: r[1])[:90]


def test_groups_come_as_they_are_first_seen(in_order):
    assert in_order("rows (*) | summarize count() by k") == [(80, i * 7 % 5) for i in range(5)]
    assert in_order("rows (*) | sort by n desc | summarize low = min(n) by s, k | take 1") == [(9, "x", 3)]
    assert in_order("rows (*) | summarize n = count()") == [(400,)] and in_order("rows (*) | where n < 0 | summarize n = count()") == []


def test_joins_keep_the_order_of_the_left_then_the_right(in_order):
    found = in_order("rows (*) | join (pairs (*)) on k | project n, p | take 31")
    assert found == [(i // 2, 2 - i % 2) for i in range(31)]


def test_take_of_more_rows_than_spark_can(run):
    with pytest.raises(QueryTypeError, match="at most"):
        run("logs (*) | take 2147483648")


def test_comparisons_beside_nan_are_pushed_down(spark, tmp_path):
    spark.createDataFrame([(1.0, 2.0), (float("nan"), 1.0)], "a double, b double").write.parquet(str(tmp_path / "t"))
    tables = Catalog([Entry("t", "parquet", path=str(tmp_path / "t"), time_column=None)])
    plan = engine.explain(spark, "t (*) | where a > 0.5 and a < 9.0", tables)
    assert "GreaterThan(a,0.5)" in plan and "LessThan(a,9.0)" in plan
    assert [tuple(r) for r in engine.execute(spark, "t (*) | where a > 0.5", tables).collect()] == [(1.0, 2.0)]
