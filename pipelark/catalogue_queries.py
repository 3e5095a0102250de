"""Registered queries of the pipeline language, each with SQL that has the same result.

There is one for every stage, predicate, expression, aggregate and source.  Sums
and averages of floating-point numbers depend on the order of addition, so that
they are rounded on both sides.
"""

from __future__ import annotations

import atexit
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import partial
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import engine
from .sources import files
from .sources.catalog import Catalog, Entry, parquet_tables
from .sources.csv_sink import store

#: Tables with the time column that windows are about.
TABLES = {
    "region": None,
    "nation": None,
    "customer": None,
    "supplier": None,
    "part": None,
    "orders": "o_orderdate",
    "lineitem": "l_shipdate",
    "events": "ts",
    "documents": None,
    "embeddings": None,
    "pages": None,
    "benchmark": None,
    "labels": None,
    "conversations": None,
}

#: The clock of queries that look back.
NOW = datetime(2024, 1, 20, 12)


@dataclass(frozen=True)
class Case:
    query: str
    sql: str
    rounded: tuple[str, ...] = ()
    ordered: bool = False


def tables(sf_dir: str) -> Catalog:
    return parquet_tables(sf_dir, TABLES, {"events": ("props",)})


FLAGSHIP = (
    "orders (*) | where o_totalprice > 1000.0 | join (customer (*) | project c_custkey, c_mktsegment) on $left.o_custkey == $right.c_custkey"
    " | summarize n = count(), total = sum(o_totalprice) by c_mktsegment | sort by n desc"
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine.execute(spark, FLAGSHIP, tables(sf_dir), NOW)


# Nulls and NaN: the tables have none, so that some queries get rows of their own.

_PEOPLE = [(1, "ann", "de", 3.5), (2, "bob", None, None), (3, None, "fr", -1.0), (4, "", "de", 0.0), (None, "eve", None, 7.25)]
_PLACES = [("de", "Germany"), ("fr", "France"), (None, "nowhere")]
_PEOPLE_SQL = "(VALUES (1, 'ann', 'de', 3.5::DOUBLE), (2, 'bob', NULL, NULL), (3, NULL, 'fr', -1.0), (4, '', 'de', 0.0), (NULL, 'eve', NULL, 7.25)) AS people(id, name, land, score)"
_PLACES_SQL = "(VALUES ('de', 'Germany'), ('fr', 'France'), (NULL, 'nowhere')) AS places(land, title)"
_NAN = float("nan")
_MEASURES = [(1, 1.5, 2.0, True), (2, _NAN, 2.0, False), (3, None, _NAN, True), (4, _NAN, _NAN, None), (5, 0.5, None, True), (6, -3.0, -3.0, False), (7, _NAN, None, True)]
_MEASURES_SQL = (
    "(VALUES (1, 1.5::DOUBLE, 2.0::DOUBLE, true), (2, 'nan'::DOUBLE, 2.0, false), (3, NULL, 'nan'::DOUBLE, true), (4, 'nan'::DOUBLE, 'nan'::DOUBLE, NULL), (5, 0.5, NULL, true), (6, -3.0, -3.0, false),"
    " (7, 'nan'::DOUBLE, NULL, true)) AS measures(id, v, w, fine)"
)


def _ieee(test: str) -> str:
    """A comparison in SQL that is false where an operand is NaN (DuckDB orders NaN as the largest number)."""
    return f"coalesce({test} AND NOT isnan(v) AND NOT isnan(w), false)"



CASES: dict[str, Case] = {
    "full_pipeline": Case(
        FLAGSHIP,
        "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment",
        ("total",),
    ),
    # Sources and windows
    "scan_full": Case("nation (*)", "SELECT * FROM nation"),
    "window_absolute": Case(
        "events (datetime(2024-01-05) .. datetime(2024-01-10 06:30:00.5)) | project event_id, ts",
        "SELECT event_id, ts FROM events WHERE ts BETWEEN '2024-01-05' AND '2024-01-10 06:30:00.5'",
    ),
    "window_empty": Case("events (datetime(2020-01-01) .. datetime(2020-02-01)) | project event_id", "SELECT event_id FROM events WHERE false"),
    "window_reversed": Case("events (datetime(2024-01-10) .. datetime(2024-01-05)) | count", 'SELECT CAST(0 AS BIGINT) AS "count"'),
    "window_last": Case(
        "events (last 2d12h) | project event_id, ts",
        "SELECT event_id, ts FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-18 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'",
    ),
    # Predicates
    "where_eq": Case('events (*) | where event_type == "click" | project event_id', "SELECT event_id FROM events WHERE event_type = 'click'"),
    "where_ne": Case('events (*) | where event_type != "click" | project event_id', "SELECT event_id FROM events WHERE event_type <> 'click'"),
    "where_lt": Case("events (*) | where value < 20 | project event_id, value", "SELECT event_id, value FROM events WHERE value < 20"),
    "where_le": Case("part (*) | where p_size <= 7 | project p_partkey, p_size", "SELECT p_partkey, p_size FROM part WHERE p_size <= 7"),
    "where_gt": Case("events (*) | where value > 200.5 | project event_id, value", "SELECT event_id, value FROM events WHERE value > 200.5"),
    "where_ge": Case("events (*) | where ts >= datetime(2024-01-25 12:00) | project event_id, ts", "SELECT event_id, ts FROM events WHERE ts >= '2024-01-25 12:00:00'"),
    "where_column_column": Case("lineitem (*) | where l_discount > l_tax | project l_orderkey, l_discount, l_tax", "SELECT l_orderkey, l_discount, l_tax FROM lineitem WHERE l_discount > l_tax"),
    "where_literal_first": Case("events (*) | where 300 < value | project event_id", "SELECT event_id FROM events WHERE value > 300"),
    "where_string_order": Case('customer (*) | where c_mktsegment < "FURNITURE" | project c_custkey', "SELECT c_custkey FROM customer WHERE c_mktsegment < 'FURNITURE'"),
    "where_tilde_eq": Case('customer (*) | where c_mktsegment =~ "building" | project c_custkey', "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'"),
    "where_contains": Case('part (*) | where p_name contains "ring" | project p_partkey, p_name', "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')"),
    "where_startswith": Case('part (*) | where p_name startswith "red" | project p_partkey, p_name', "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'red')"),
    "where_endswith": Case('part (*) | where p_name endswith "widget" | project p_partkey, p_name', "SELECT p_partkey, p_name FROM part WHERE ends_with(p_name, 'widget')"),
    "where_in": Case('events (*) | where event_type in ("click", "view") | project event_id', "SELECT event_id FROM events WHERE event_type IN ('click', 'view')"),
    "where_not_in": Case("customer (*) | where c_nationkey !in (1, 2, 3) | project c_custkey, c_nationkey", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3)"),
    "where_between": Case("events (*) | where value between (10 .. 12.5) | project event_id, value", "SELECT event_id, value FROM events WHERE value BETWEEN 10 AND 12.5"),
    "where_between_datetime": Case(
        "orders (*) | where o_orderdate between (datetime(1996-01-01) .. datetime(1996-12-31)) | project o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN '1996-01-01' AND '1996-12-31'"
    ),
    "where_and_or_precedence": Case(
        'events (*) | where event_type == "click" and value > 50 or event_type == "error" | project event_id', "SELECT event_id FROM events WHERE (event_type = 'click' AND value > 50) OR event_type = 'error'"
    ),
    "where_parentheses": Case(
        'events (*) | where event_type == "click" and (value > 50 or value < 5) | project event_id', "SELECT event_id FROM events WHERE event_type = 'click' AND (value > 50 OR value < 5)"
    ),
    "where_not": Case(
        'events (*) | where not (event_type == "click" or value > 20) | project event_id, value', "SELECT event_id, value FROM events WHERE coalesce(NOT (event_type = 'click' OR value > 20), true)"
    ),
    "where_ago": Case("events (*) | where ts > ago(36h) and ts < ago(1d6h30m) | project event_id", "SELECT event_id FROM events WHERE ts > '2024-01-19 00:00:00' AND ts < '2024-01-19 05:30:00'"),
    "where_ago_window": Case(
        "events (*) | where ts >= ago(1w) and ts <= ago(0s) | summarize n = count() by event_type",
        "SELECT count(*) AS n, event_type FROM events WHERE ts BETWEEN '2024-01-13 12:00:00' AND '2024-01-20 12:00:00' GROUP BY event_type",
    ),
    "where_arithmetic": Case(
        "lineitem (*) | where l_extendedprice * (1 - l_discount) > 90000 | project l_orderkey, l_linenumber", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_extendedprice * (1 - l_discount) > 90000"
    ),
    # Projections and arithmetic
    "project_select": Case("customer (*) | project c_name, c_custkey", "SELECT c_name, c_custkey FROM customer"),
    "project_rename": Case("customer (*) | project id = c_custkey, segment = c_mktsegment", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer"),
    "project_qualified": Case("customer (*) | project customer.c_custkey, name = customer.c_name", "SELECT c_custkey, c_name AS name FROM customer"),
    "project_arith_int": Case(
        "part (*) | project p_partkey, a = p_size + 3, b = p_size - p_partkey, c = 2 * p_size", "SELECT p_partkey, p_size::BIGINT + 3 AS a, p_size::BIGINT - p_partkey AS b, 2 * p_size::BIGINT AS c FROM part"
    ),
    "project_int_div": Case("part (*) | project p_partkey, q = (3 - p_size) / 4", "SELECT p_partkey, (3 - p_size::BIGINT) // 4 AS q FROM part"),
    "project_arith_float": Case(
        "lineitem (*) | project l_orderkey, revenue = l_extendedprice * (1 - l_discount), half = l_quantity / 2",
        "SELECT l_orderkey, round(l_extendedprice * (1 - l_discount), 4) AS revenue, l_quantity / 2 AS half FROM lineitem",
        ("revenue",),
    ),
    "project_unary_minus": Case("customer (*) | project c_custkey, debt = -c_acctbal, n = -c_nationkey", "SELECT c_custkey, -c_acctbal AS debt, -(c_nationkey::BIGINT) AS n FROM customer"),
    "project_precedence": Case("part (*) | project p_partkey, v = p_size + 2 * 3 - -1", "SELECT p_partkey, p_size::BIGINT + 7 AS v FROM part"),
    "datetime_diff_filter": Case(
        "events (*) | project event_id, ts, since = ts - datetime(2024-01-10) | project event_id, back = ts - since | where back == datetime(2024-01-10)",
        "SELECT event_id, TIMESTAMP '2024-01-10' AS back FROM events",
    ),
    "timespan_arithmetic": Case(
        "events (*) | project event_id, later = ts + (ts - datetime(2024-01-10)) * 2 | where later > datetime(2024-02-01)",
        "SELECT event_id, ts + (ts - TIMESTAMP '2024-01-10') * 2 AS later FROM events WHERE ts + (ts - TIMESTAMP '2024-01-10') * 2 > TIMESTAMP '2024-02-01'",
    ),
    # Aggregates
    "summarize_count": Case("events (*) | summarize count() by event_type", "SELECT count(*) AS count_, event_type FROM events GROUP BY event_type"),
    "summarize_sum": Case("events (*) | summarize sum(value) by event_type", "SELECT round(sum(value), 2) AS sum_value, event_type FROM events GROUP BY event_type", ("sum_value",)),
    "summarize_sum_int": Case("part (*) | summarize total = sum(p_size) by p_brand", "SELECT CAST(sum(p_size) AS BIGINT) AS total, p_brand FROM part GROUP BY p_brand"),
    "summarize_avg": Case("events (*) | summarize avg(value) by event_type", "SELECT round(avg(value), 4) AS avg_value, event_type FROM events GROUP BY event_type", ("avg_value",)),
    "summarize_min": Case("events (*) | summarize min(value), min(ts) by event_type", "SELECT min(value) AS min_value, min(ts) AS min_ts, event_type FROM events GROUP BY event_type"),
    "summarize_max": Case("events (*) | summarize max(value), max(ts) by event_type", "SELECT max(value) AS max_value, max(ts) AS max_ts, event_type FROM events GROUP BY event_type"),
    "summarize_dcount": Case("events (*) | summarize dcount(user_id) by event_type", "SELECT count(DISTINCT user_id) AS dcount_user_id, event_type FROM events GROUP BY event_type"),
    "summarize_several_dcounts": Case(
        "orders (*) | summarize a = dcount(o_custkey), b = dcount(o_orderdate), n = count() by o_orderstatus",
        "SELECT count(DISTINCT o_custkey) AS a, count(DISTINCT o_orderdate) AS b, count(*) AS n, o_orderstatus FROM orders GROUP BY o_orderstatus",
    ),
    "summarize_multi_by": Case(
        "lineitem (*) | summarize n = count(), qty = sum(l_quantity) by l_returnflag, l_linestatus",
        "SELECT count(*) AS n, sum(l_quantity) AS qty, l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus",
    ),
    "summarize_global": Case(
        "events (*) | summarize n = count(), low = min(value), high = max(value), users = dcount(user_id)", "SELECT count(*) AS n, min(value) AS low, max(value) AS high, count(DISTINCT user_id) AS users FROM events"
    ),
    "summarize_global_empty": Case("events (*) | where value < 0 | summarize n = count()", "SELECT count(*) AS n FROM events WHERE value < 0 HAVING count(*) > 0"),
    "having_style": Case(
        "orders (*) | summarize n = count() by o_custkey | where n >= 15", "SELECT count(*) AS n, o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 15"
    ),
    "summarize_high_cardinality": Case("orders (*) | summarize n = count() by o_custkey", "SELECT count(*) AS n, o_custkey FROM orders GROUP BY o_custkey"),
    # Joins
    "join_same_name": Case(
        "orders (*) | project o_orderkey, key = o_custkey | join (customer (*) | project key = c_custkey, c_name) on key | project o_orderkey, key, c_name",
        "SELECT o_orderkey, o_custkey AS key, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    ),
    "join_explicit": Case(
        "supplier (*) | join (nation (*)) on $left.s_nationkey == $right.n_nationkey | project s_suppkey, n_name, nation.n_regionkey",
        "SELECT s_suppkey, n_name, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "join_mixed_types": Case(
        "events (*) | project event_id, user_id | join (nation (*)) on $left.user_id == $right.n_nationkey | project event_id, n_name",
        "SELECT event_id, n_name FROM events JOIN nation ON user_id = n_nationkey",
    ),
    "join_multi_key": Case(
        "customer (*) | project nation = c_nationkey, id = c_custkey, c_name | join (supplier (*) | project nation = s_nationkey, id = s_suppkey, s_name) on nation, id | project id, nation, c_name, s_name",
        "SELECT c_custkey AS id, c_nationkey AS nation, c_name, s_name FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_custkey = s_suppkey",
    ),
    "join_nested": Case(
        "customer (*) | join (nation (*) | join (region (*)) on $left.n_regionkey == $right.r_regionkey) on $left.c_nationkey == $right.n_nationkey | summarize n = count() by r_name",
        "SELECT count(*) AS n, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    ),
    "join_subquery_pipeline": Case(
        "customer (*) | join (orders (datetime(1996-01-01) .. datetime(1997-01-01)) | where o_totalprice > 100000 | summarize n = count() by o_custkey) on $left.c_custkey == $right.o_custkey | project c_name, n",
        "SELECT c_name, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 AND o_orderdate BETWEEN '1996-01-01' AND '1997-01-01' GROUP BY o_custkey) ON c_custkey = o_custkey",
    ),
    "join_self": Case(
        "nation (*) | project a = n_name, n_regionkey | join (nation (*) | project b = n_name, n_regionkey) on n_regionkey | project a, b, n_regionkey",
        "SELECT l.n_name AS a, r.n_name AS b, l.n_regionkey FROM nation l JOIN nation r ON l.n_regionkey = r.n_regionkey",
    ),
    "join_count": Case("orders (*) | join (customer (*)) on $left.o_custkey == $right.c_custkey | count", 'SELECT count(*) AS "count" FROM orders JOIN customer ON o_custkey = c_custkey'),
    # Sort, take, count
    "sort_full": Case("events (*) | project event_id, value | sort by value, event_id", "SELECT event_id, value FROM events ORDER BY value, event_id"),
    "sort_take_topk": Case("orders (*) | project o_orderkey, o_totalprice | sort by o_totalprice desc, o_orderkey | take 25", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "sort_multi": Case(
        "customer (*) | sort by c_mktsegment asc, c_acctbal desc, c_custkey | project c_custkey, c_mktsegment | take 40",
        "SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey LIMIT 40",
    ),
    "take": Case("customer (*) | project c_custkey | take 700 | count", 'SELECT least(count(*), 700) AS "count" FROM customer'),
    "take_first_rows": Case("orders (*) | where o_totalprice > 100000 | project o_orderkey, o_custkey | take 40", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 100000 ORDER BY o_orderkey LIMIT 40", ordered=True),
    "sort_keeps_order": Case("events (*) | sort by event_type desc | take 60 | project event_id, event_type", "SELECT event_id, event_type FROM events ORDER BY event_type DESC, event_id LIMIT 60", ordered=True),
    "groups_as_first_seen": Case(
        "orders (*) | summarize n = count(), most = max(o_totalprice) by o_custkey | take 30", "SELECT count(*) AS n, max(o_totalprice) AS most, o_custkey FROM orders GROUP BY o_custkey ORDER BY min(o_orderkey) LIMIT 30", ordered=True
    ),
    "groups_after_sort": Case(
        "events (*) | sort by value desc | summarize n = count() by user_id | take 12",
        "SELECT count(*) AS n, user_id FROM (SELECT *, row_number() OVER (ORDER BY value DESC, event_id) AS place FROM events) GROUP BY user_id ORDER BY min(place) LIMIT 12",
        ordered=True,
    ),
    "join_keeps_order": Case(
        "nation (*) | project n_nationkey, n_regionkey | join (customer (*) | project c_custkey, c_nationkey) on $left.n_nationkey == $right.c_nationkey | take 70 | project n_nationkey, c_custkey",
        "SELECT n_nationkey, c_custkey FROM nation JOIN customer ON n_nationkey = c_nationkey ORDER BY n_nationkey, c_custkey LIMIT 70",
        ordered=True,
    ),
    "count": Case('events (*) | where event_type == "error" | count', "SELECT count(*) AS \"count\" FROM events WHERE event_type = 'error'"),
    "count_empty": Case("events (*) | where value < 0 | count", 'SELECT count(*) AS "count" FROM events WHERE value < 0'),
    "count_alias": Case("events (*) | count | where count_ > 5 | project n = count_", "SELECT count(*) AS n FROM events HAVING count(*) > 5"),
    # Opaque columns
    "dynamic_eq": Case('events (*) | where props == "{\\"k\\": 69}" | project event_id', "SELECT event_id FROM events WHERE props = '{\"k\": 69}'"),
    "dynamic_group_by": Case("events (*) | summarize n = count() by props", "SELECT count(*) AS n, props FROM events GROUP BY props"),
    "dynamic_not_null": Case("events (*) | where not isempty(props) | count", 'SELECT count(*) AS "count" FROM events WHERE props IS NOT NULL'),
}


def _run(case: Case, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(engine.execute(spark, case.query, tables(sf_dir), NOW, case.ordered), case)


def _rounded(frame: DataFrame, case: Case) -> DataFrame:
    return frame.withColumns({c: F.round(c, 4 if c in ("revenue", "avg_value") else 2) for c in case.rounded}) if case.rounded else frame


NULL_CASES: dict[str, Case] = {
    "where_isnull": Case("people (*) | where isnull(score) | project id, name", f"SELECT id, name FROM {_PEOPLE_SQL} WHERE score IS NULL"),
    "where_isnotnull": Case("people (*) | where isnotnull(land) | project id, land", f"SELECT id, land FROM {_PEOPLE_SQL} WHERE land IS NOT NULL"),
    "where_isempty": Case("people (*) | where not isempty(name) | project id, name", f"SELECT id, name FROM {_PEOPLE_SQL} WHERE NOT (name IS NULL OR name = '')"),
    "null_compare": Case("people (*) | where score != 3.5 | project id, score", f"SELECT id, score FROM {_PEOPLE_SQL} WHERE score <> 3.5"),
    "null_not_compare": Case("people (*) | where not (score > 0) | project id, score", f"SELECT id, score FROM {_PEOPLE_SQL} WHERE coalesce(NOT (score > 0), true)"),
    "null_not_nested": Case(
        'people (*) | where not (score > 0 and not (land == "de")) | project id, name', f"SELECT id, name FROM {_PEOPLE_SQL} WHERE NOT (coalesce(score > 0, false) AND NOT coalesce(land = 'de', false))"
    ),
    "null_not_in": Case('people (*) | where land !in ("de") | project id, name', f"SELECT id, name FROM {_PEOPLE_SQL} WHERE land NOT IN ('de')"),
    "null_isempty": Case("people (*) | where isempty(name) | project id", f"SELECT id FROM {_PEOPLE_SQL} WHERE name IS NULL OR name = ''"),
    "null_isnull": Case("people (*) | where isnull(land) or isnull(id) | project id, name", f"SELECT id, name FROM {_PEOPLE_SQL} WHERE land IS NULL OR id IS NULL"),
    "null_group": Case(
        "people (*) | summarize n = count(), s = sum(score), a = avg(score), d = dcount(name) by land",
        f"SELECT count(*) AS n, coalesce(sum(score), 0) AS s, avg(score) AS a, count(DISTINCT name) AS d, land FROM {_PEOPLE_SQL} GROUP BY land",
    ),
    "null_all_null_sum": Case(
        'people (*) | where name == "bob" | summarize s = sum(score), a = avg(score), m = max(score)', f"SELECT coalesce(sum(score), 0) AS s, avg(score) AS a, max(score) AS m FROM {_PEOPLE_SQL} WHERE name = 'bob'"
    ),
    "null_join": Case(
        "people (*) | join (places (*)) on land | project name, land, title",
        f"SELECT name, people.land, title FROM {_PEOPLE_SQL} JOIN {_PLACES_SQL} ON people.land IS NOT DISTINCT FROM places.land",
    ),
    "null_sort_last": Case("people (*) | sort by score desc | take 4 | project id, score", f"SELECT id, score FROM {_PEOPLE_SQL} ORDER BY score DESC NULLS LAST LIMIT 4"),
    "where_true": Case("measures (*) | where fine == true | project id", f"SELECT id FROM {_MEASURES_SQL} WHERE fine"),
    "where_not_false": Case("measures (*) | where not (fine == false) | project id, fine", f"SELECT id, fine FROM {_MEASURES_SQL} WHERE fine IS DISTINCT FROM false"),
    "nan_compare": Case("measures (*) | where v > 1.0 | project id", f"SELECT id FROM {_MEASURES_SQL} WHERE v > 1 AND NOT isnan(v)"),
    "nan_not_compare": Case("measures (*) | where not (v > 1.0) | project id", f"SELECT id FROM {_MEASURES_SQL} WHERE NOT coalesce(v > 1 AND NOT isnan(v), false)"),
    "nan_equal": Case("measures (*) | where v == v | project id", f"SELECT id FROM {_MEASURES_SQL} WHERE v IS NOT NULL AND NOT isnan(v)"),
    "nan_unequal": Case("measures (*) | where v != w | project id", f"SELECT id FROM {_MEASURES_SQL} WHERE v IS NOT NULL AND w IS NOT NULL AND (isnan(v) OR isnan(w) OR v <> w)"),
    "nan_not_unequal": Case("measures (*) | where not (v != w) | project id", f"SELECT id FROM {_MEASURES_SQL} WHERE v IS NULL OR w IS NULL OR {_ieee('v = w')}"),
    "nan_columns": Case("measures (*) | where v <= w or w < v | project id", f"SELECT id FROM {_MEASURES_SQL} WHERE {_ieee('v <= w')} OR {_ieee('w < v')}"),
    "nan_columns_more": Case("measures (*) | where not (v >= w) and not (w > v) | project id", f"SELECT id FROM {_MEASURES_SQL} WHERE NOT {_ieee('v >= w')} AND NOT {_ieee('w > v')}"),
    "nan_in_between": Case("measures (*) | where v !in (1.5) and not (v between (0.0 .. 9.0)) | project id", f"SELECT id FROM {_MEASURES_SQL} WHERE v <> 1.5 AND (isnan(v) OR v NOT BETWEEN 0 AND 9)"),
    "nan_min_max": Case(
        "measures (*) | summarize low = min(v), high = max(v), n = count() by fine",
        f"SELECT coalesce(min(v) FILTER (NOT isnan(v)), min(v)) AS low, coalesce(max(v) FILTER (NOT isnan(v)), max(v)) AS high, count(*) AS n, fine FROM {_MEASURES_SQL} GROUP BY fine",
    ),
    "null_arithmetic": Case("people (*) | project name, twice = score * 2, one = id + 1", f"SELECT name, score * 2 AS twice, id::BIGINT + 1 AS one FROM {_PEOPLE_SQL}"),
}


def _run_nulls(case: Case, spark: SparkSession, sf_dir: str) -> DataFrame:
    people = spark.createDataFrame(_PEOPLE, "id int, name string, land string, score double")
    places = spark.createDataFrame(_PLACES, "land string, title string")
    measures = spark.createDataFrame(_MEASURES, "id int, v double, w double, fine boolean")
    frames = {"people": people, "places": places, "measures": measures}
    return engine.execute(spark, case.query, Catalog([Entry(name, "dataframe", frame=frame) for name, frame in frames.items()]), NOW)


# CSV folders: the whole table of events is written as one and read back.

_CSV = "(SELECT event_id::INTEGER AS event_id, date_trunc('milliseconds', ts) AS ts, user_id::INTEGER AS user_id, event_type, value, props FROM events) AS e"

CSV_CASES: dict[str, Case] = {
    "csv_scan_full": Case("events (*)", f"SELECT * FROM {_CSV}"),
    "csv_window_absolute": Case(
        "events (datetime(2024-01-05 12:00) .. datetime(2024-01-07 06:00)) | project event_id, ts", f"SELECT event_id, ts FROM {_CSV} WHERE ts BETWEEN '2024-01-05 12:00:00' AND '2024-01-07 06:00:00'"
    ),
    "csv_window_last": Case("events (last 36h) | summarize n = count() by event_type", f"SELECT count(*) AS n, event_type FROM {_CSV} WHERE ts BETWEEN '2024-01-19 00:00:00' AND '2024-01-20 12:00:00' GROUP BY event_type"),
    "csv_where_project": Case('events (*) | where event_type == "error" and value > 20 | project event_id, value', f"SELECT event_id, value FROM {_CSV} WHERE event_type = 'error' AND value > 20"),
    "csv_dynamic_group_by": Case("events (*) | summarize n = count() by props", f"SELECT count(*) AS n, props FROM {_CSV} GROUP BY props"),
}


def _folder(spark: SparkSession, table: str) -> str:
    """A new folder that all machines see; it goes when Python ends, as results may be asked for until then."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    top = f"{found}/csv-{uuid4()}"
    atexit.register(files.remove, spark, top)
    return f"{top}/{table}"


def _run_csv(case: Case, spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "events")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ids = {c: F.col(c).cast("int") for c in ("event_id", "user_id")}
    # As JSON text the last column is quoted; it is registered as opaque by its schema file.
    store(events.withColumns(ids), folder, "events", "ts")
    return engine.execute(spark, case.query, Catalog([Entry("events", "file", dir=folder)]), NOW)


# Cells of every type, line ends in quotes, both kinds of line ends, an empty file, and cells that aren't of their type.

_SESSIONS = {
    "sessions.json": """{"name": "sessions", "orderedColumns": [{"name": "timestamp", "type": "datetime"}, {"name": "id", "type": "int"}, {"name": "note", "type": "string"},
        {"name": "fine", "type": "bool"}, {"name": "took", "type": "timespan"}, {"name": "rest", "type": "timespan"}, {"name": "score", "type": "real"}, {"name": "props", "type": "dynamic"}]}""",
    "2024-03-01_00-00-00.000_sessions.csv": (
        '2024-03-01 00:00:00.000,1,"one\ntwo, three",true,1h30m,15m,0.5,"{""a"": 1}"\n'
        '2024-03-01 06:00:00.250,2,"say ""so""",F,-15m,1.5s,inf,\r\n'
        "2024-03-01 07:00:00.000,3,,1,0,250ms,NaN,[]\n"
    ),
    "2024-03-02_00-00-00.000_sessions.csv": "",
    "2024-03-03_00-00-00.000_sessions.csv": (
        "2024-03-03 00:00:00.000,4,last,no,soon,1h,x,{}\r\n2024-03-03 00:00:01.000,5.5,\"a\r\nb\",False,2h45m30.5s,,1e3\n2024-03-03 00:00:02.000,6,z,T,100us,-1h,-2,{}\n"
    ),
}
_SESSIONS_SQL = (
    "(VALUES (TIMESTAMP '2024-03-01 00:00:00', 1, 'one' || chr(10) || 'two, three', true, INTERVAL 5400 SECONDS, INTERVAL 900 SECONDS, 0.5::DOUBLE, '{\"a\": 1}'),"
    " ('2024-03-01 06:00:00.25', 2, 'say \"so\"', false, INTERVAL (-900) SECONDS, INTERVAL 1500 MILLISECONDS, 'inf', NULL), ('2024-03-01 07:00:00', 3, NULL, true, INTERVAL 0 SECONDS, INTERVAL 250 MILLISECONDS, 'nan', '[]'),"
    " ('2024-03-03 00:00:00', 4, 'last', NULL, NULL, INTERVAL 3600 SECONDS, NULL, '{}'), ('2024-03-03 00:00:01', NULL, 'a' || chr(13) || chr(10) || 'b', false, INTERVAL 9930500 MILLISECONDS, NULL, 1000, NULL),"
    " ('2024-03-03 00:00:02', 6, 'z', true, INTERVAL 100 MICROSECONDS, INTERVAL (-3600) SECONDS, -2, '{}')) AS sessions(ts, id, note, fine, took, rest, score, props)"
)

CELL_CASES: dict[str, Case] = {
    "csv_quoted_line_ends": Case("sessions (*) | project ts = timestamp, note", f"SELECT ts, note FROM {_SESSIONS_SQL}"),
    "csv_bool_cells": Case("sessions (*) | project id, fine, note", f"SELECT id, fine, note FROM {_SESSIONS_SQL}"),
    "csv_where_bool": Case("sessions (*) | where fine == false or isnull(fine) | project ts = timestamp, fine", f"SELECT ts, fine FROM {_SESSIONS_SQL} WHERE fine IS DISTINCT FROM true"),
    "csv_number_cells": Case("sessions (*) | where not (score == 0.5) and score != 7 | project id, inverse = 1 / (score + 2.5)", f"SELECT id, 1 / (score + 2.5) AS inverse FROM {_SESSIONS_SQL} WHERE score <> 0.5"),
    "csv_timespan_cells": Case("sessions (*) | project id, until = timestamp + took", f"SELECT id, ts + took AS until FROM {_SESSIONS_SQL}"),
    "csv_timespan_and_timespan": Case(
        "sessions (*) | project id, longer = timestamp + (took + rest), shorter = timestamp - (took - rest)", f"SELECT id, ts + took + rest AS longer, ts - took + rest AS shorter FROM {_SESSIONS_SQL}"
    ),
    "csv_timespan_and_number": Case("sessions (*) | project id, half = timestamp + took / 2, less = timestamp - rest * 3", f"SELECT id, ts + took / 2 AS half, ts - rest * 3 AS less FROM {_SESSIONS_SQL}"),
    "csv_where_timespan": Case("sessions (*) | where took > rest | project id, ts = timestamp", f"SELECT id, ts FROM {_SESSIONS_SQL} WHERE took > rest"),
    "csv_dynamic_cells": Case("sessions (*) | summarize n = count() by props", f"SELECT count(*) AS n, props FROM {_SESSIONS_SQL} GROUP BY props"),
    "csv_empty_file": Case("sessions (datetime(2024-03-02) .. datetime(2024-03-02 23:00)) | summarize n = count()", "SELECT 1::BIGINT AS n WHERE false"),
    "csv_empty_window": Case("sessions (datetime(2023-01-01) .. datetime(2023-02-01)) | project id, note", f"SELECT id, note FROM {_SESSIONS_SQL} WHERE false"),
    "csv_first_rows": Case("sessions (*) | take 4 | project ts = timestamp, id", f"SELECT ts, id FROM {_SESSIONS_SQL} ORDER BY ts LIMIT 4", ordered=True),
}


def _run_cells(case: Case, spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark, "sessions")
    for name, text in _SESSIONS.items():
        files.write(spark, f"{folder}/{name}", text)
    return engine.execute(spark, case.query, Catalog([Entry("sessions", "file", dir=folder)]), NOW, case.ordered)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    runs = {name: partial(_run, case) for name, case in CASES.items()}
    runs |= {name: partial(_run_nulls, case) for name, case in NULL_CASES.items()}
    runs |= {name: partial(_run_cells, case) for name, case in CELL_CASES.items()}
    return runs | {name: partial(_run_csv, case) for name, case in CSV_CASES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: case.sql for name, case in (CASES | NULL_CASES | CELL_CASES | CSV_CASES).items()}
