from datetime import datetime, timedelta

import pytest

from pipelark import engine
from pipelark.sources import sample
from pipelark.sources.catalog import Catalog, Entry


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sample"))
    sample.write(spark, folder)
    catalog = Catalog([Entry(t, "file", dir=f"{folder}/{t}") for t in ("requests", "users")])
    return lambda text: [tuple(r) for r in engine.execute(spark, text, catalog, datetime(2026, 5, 8)).collect()]


def test_volume(run):
    assert run("requests (*) | count") == [(7000,)]
    assert run("users (*) | count") == [(50,)]
    for day in (1, 3, 7):
        assert run(f"requests (datetime(2026-05-0{day}) .. datetime(2026-05-0{day} 23:59:59.999)) | count") == [(1000,)]
    assert run("requests (last 24h) | count") == [(1000,)]


def test_rows(run):
    found = run("requests (*) | sort by timestamp, requestId | project timestamp, requestId, statusCode, durationMs, ttl")
    assert [r[1] for r in found] == [f"req-{i:07d}" for i in range(1, 7001)]
    assert {r[2] for r in found} == set(sample.STATUS)
    assert all(r[3] > 0 for r in found)
    assert {r[4] for r in found} == {None, *(timedelta(minutes=m) for m in sample.MINUTES)}
    regions = dict((b, a) for a, b in run("requests (*) | summarize n = count() by region"))
    assert set(regions) == {None, *sample.REGIONS} and regions["eastus"] > regions["westus"] > regions["northeurope"] > regions["southeastasia"]


def test_join_drops_requests_without_a_user(run):
    (without,), *_ = run("requests (*) | where isnull(userId) | count")
    assert 200 < without < 500
    assert run("requests (*) | join (users (*) | project userId, tier) on userId | count") == [(7000 - without,)]
    by_tier = run("requests (*) | join (users (*) | project userId, tier) on userId | summarize n = count() by tier")
    assert sum(n for n, _ in by_tier) == 7000 - without


def test_same_seed_same_tables(spark):
    a, b, c = (sorted(map(repr, sample.requests(spark, 2, 50, seed).collect())) for seed in (1, 1, 2))
    assert a == b != c
