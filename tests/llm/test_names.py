"""Columns with dots, spaces and quotes in their names: every operator takes and returns them."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pipelark.llm import decontamination, line_dedup, quality_classifier, quality_rules, sentencepiece_codec, sharding, simhash, substring_dedup, token_counts, url_filter

ID, TEXT, EXTRA = "doc.id", "the.text", ["a.b", "A b-c", "x.y.z"]


@pytest.fixture(scope="module")
def docs(spark, prose):
    rows = [(i, t, 1.5, "x", i) for i, t in enumerate([prose(1, 80), prose(2, 90), None, "", prose(1, 80), "https://example.com/en/a.b"])]
    return spark.createDataFrame(rows, "id long, t string, a double, b string, c int").toDF(ID, TEXT, *EXTRA).repartition(2)


OPERATORS = {
    "quality report": lambda d, b: quality_rules.quality_report(d, TEXT),
    "quality filter": lambda d, b: quality_rules.quality_filter(d, TEXT),
    "classifier": lambda d, b: quality_classifier.quality_scores(d, TEXT, sample=4),
    "encode": lambda d, b: sentencepiece_codec.encode(d, public_tokenizers.path("piece_bpe_32k.model"), TEXT, ids="the.ids", decoded="back.again"),
    "decode": lambda d, b: sentencepiece_codec.decode(d.withColumn("the.ids", F.array(F.lit(5))), public_tokenizers.path("piece_bpe_32k.model"), "the.ids", "back.again"),
    "urls": lambda d, b: url_filter.filter_urls(d, [url_filter.Rule("com", "/", "allow")], ["*x*"], TEXT),
    "near duplicates": lambda d, b: d.join(simhash.near_duplicates(d, ID, TEXT), d[f"`{ID}`"] == F.col("doc_id")),
    "near dedup": lambda d, b: simhash.near_dedup(d, ID, TEXT),
    "leaks": lambda d, b: decontamination.leaks(d, b, TEXT, "item.id", "item.text", out="the.leaks"),
    "lines": lambda d, b: line_dedup.line_dedup(d, ID, TEXT),
    "shards": lambda d, b: sharding.shard(d, 3),
    "spans": lambda d, b: substring_dedup.substring_dedup(d, ID, TEXT),
    "token budget": lambda d, b: token_counts.token_budget(d, public_tokenizers.path("byte_bpe_50k.json"), 100, TEXT),
    "prefix counts": lambda d, b: token_counts.prefix_counts(d, public_tokenizers.path("byte_bpe_50k.json"), TEXT, "the.counts"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_names_with_dots(docs, prose, name):
    benchmark = docs.sparkSession.createDataFrame([(1, prose(1, 80))], "i long, t string").toDF("item.id", "item.text")
    found = OPERATORS[name](docs, benchmark)
    assert set(EXTRA) <= set(found.columns) and ID in found.columns
    rows = found.collect()
    assert rows and all(r["a.b"] == 1.5 and r["A b-c"] == "x" and r["x.y.z"] == r[ID] for r in rows)
    if name not in ("quality filter", "near dedup"):
        assert sorted(r[ID] for r in rows) == [0, 1, 2, 3, 4, 5]
