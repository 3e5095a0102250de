import json
from datetime import datetime

import pytest

from pipelark.errors import QueryTypeError
from pipelark.sources.catalog import Catalog, Entry
from pipelark.streaming.follow import follow


def write(folder, day, rows):
    lines = "".join(f"2024-01-0{day} 00:00:0{i}.000,{k},{v}\n" for i, (k, v) in enumerate(rows))
    (folder / f"2024-01-0{day}_00-00-00.000_t.csv").write_text(lines)


def test_follow(spark, tmp_path):
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "t.json").write_text(json.dumps({"orderedColumns": [{"name": n, "type": t} for n, t in (("timestamp", "datetime"), ("k", "string"), ("v", "int"))]}))
    names = spark.createDataFrame([("a", "Ann"), ("b", "Bob")], "k string, name string")
    catalog = Catalog([Entry("t", "file", dir=str(folder)), Entry("names", "dataframe", frame=names)])
    write(folder, 1, [("a", 1), ("b", 2), ("a", "x")])
    rows = follow(spark, "t (*) | where v > 0 | join (names (*)) on k | project name, v", catalog)
    sums = follow(spark, "t (datetime(2024-01-01 00:00:01) .. datetime(2025-01-01)) | summarize n = count(), s = sum(v) by k", catalog)
    assert rows.isStreaming and sums.isStreaming
    first = rows.writeStream.format("memory").queryName("followed").option("checkpointLocation", str(tmp_path / "c1")).start()
    second = sums.writeStream.format("memory").queryName("summed").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    try:
        for q in (first, second):
            q.processAllAvailable()
        assert sorted(tuple(r) for r in spark.table("followed").collect()) == [("Ann", 1), ("Bob", 2)]
        write(folder, 2, [("a", 5)])
        for q in (first, second):
            q.processAllAvailable()
        assert sorted(tuple(r) for r in spark.table("followed").collect()) == [("Ann", 1), ("Ann", 5), ("Bob", 2)]
        assert sorted(tuple(r) for r in spark.table("summed").collect()) == [(1, 2, "b"), (2, 5, "a")]
    finally:
        first.stop()
        second.stop()


def test_refused(spark, tmp_path):
    catalog = Catalog([Entry("t", "file", dir=str(tmp_path)), Entry("d", "dataframe", frame=spark.range(1))])
    for text in ("t (*) | sort by k", "t (*) | take 5", "d (*)"):
        with pytest.raises(QueryTypeError):
            follow(spark, text, catalog, datetime(2024, 1, 1))
