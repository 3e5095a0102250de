"""Line and substring deduplication against plain loops, and the helper for frequent keys."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from pipelark.llm import first_seen, line_dedup, queries, substring_dedup

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def line_key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def order(i):
    return (i is None, i or 0)


def without_lines(rows):
    """(id, remaining text, lines, dropped lines) of every row."""
    first = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = line_key(line)
            if len(key) >= 10 and (key not in first or order(i) < order(first[key])):
                first[key] = i
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stays = [x for x in lines if len(line_key(x)) < 10 or first[line_key(x)] == i]
        out.append((i, "\n".join(stays), len(lines), len(lines) - len(stays)))
    return out


def results(frame):
    return sorted(((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in frame.collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(4)
    lines = ["Common line of text", "  COMMON line of text\t", "ÉCOLE des langues", "école des langues", "short", "", "  ", "a line\r", "exactly 10", "exactly 9", "tab\tinside of it"]
    rows = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.7 else f"line {rng.randrange(300)} of its own" for _ in range(rng.randint(1, 150)))) for i in range(60)]
    return rows + [(60, None), (61, ""), (62, "\n"), (None, "Common line of text\nanother for null only"), (63, "\nCommon line of text\n\n"), (5, rows[5][1]), (7, "Common line of text")]


@pytest.mark.parametrize("threshold", [2, 10**9])
def test_lines(spark, documents, monkeypatch, threshold):
    """With all frequent keys and with none."""
    monkeypatch.setattr(first_seen, "FREQUENT_ROWS", threshold)
    found = line_dedup.line_dedup(table(spark, documents))
    assert results(found) == sorted(without_lines(documents), key=repr)


def test_line_sql(spark):
    rows = [(0, "A line that repeats\nonce"), (1, "a LINE that repeats  \n\nonce"), (2, None), (3, ""), (4, "x\ty is a line \x0b"), (5, "\x0cx\ty is a line")]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    expected = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in without_lines(rows))
    assert sorted(con.execute(f"select doc_id, n_lines, n_dropped, kept_sha256 from ({queries.OP6_SQL})").fetchall()) == expected
    assert results(line_dedup.line_dedup(table(spark, rows))) == sorted(without_lines(rows), key=repr)


def test_bitmaps_are_sparse(spark):
    """A long document of which two lines go has two words, whatever its length."""
    long = "\n".join(f"line number {i} of the long one" for i in range(10_000))
    rows = [(0, "line number 70 of the long one\nline number 9999 of the long one"), (1, long)]
    maps = line_dedup.keep_bitmaps(table(spark, rows)).collect()
    assert [(m.doc, [(k.word, ~k.bits) for k in m.keep]) for m in maps] == [(1, [(1, 1 << 6), (156, 1 << 15)])]
    assert results(line_dedup.line_dedup(table(spark, rows))) == sorted(without_lines(rows), key=repr)


def test_lines_of_odd_rows(nasty, empty, others):
    found = line_dedup.line_dedup(nasty)
    others(found, ("n_lines", "n_dropped"), ("text",))
    assert results(found) == sorted(without_lines([(r.doc_id, r.text) for r in nasty.collect()]), key=repr)
    assert found.filter("doc_id = 1").first().text is None
    assert line_dedup.line_dedup(empty).collect() == []


def test_line_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    found = queries.op6_line_dedup(spark, d).collect()
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in found) == sorted((i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, k in without_lines(rows))


def test_lines_use_no_python(spark, documents):
    plan = line_dedup.line_dedup(table(spark, documents))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapInArrow", plan)


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("threshold", [1, 50, 10**9])
def test_later(spark, monkeypatch, whole, threshold):
    monkeypatch.setattr(first_seen, "FREQUENT_ROWS", threshold)
    rng = random.Random(3)
    rows = [(k, k * 3, rng.choice([None, *range(40)]), at) for at in range(1500) for k in [rng.choice([1, 1, 1, 2, *range(3, 200)])]]
    frame = spark.createDataFrame(rows, "h1 long, h2 long, doc int, at int")
    first = {}
    for h1, _, doc, at in rows:
        first[h1] = min(first.get(h1, ((True, 99), 10**9)), (order(doc), at))
    expected = [r for r in rows if (order(r[2]) != first[r[0]][0] if whole else (order(r[2]), r[3]) != first[r[0]])]
    assert sorted(map(repr, (tuple(r) for r in first_seen.later(frame, whole).collect()))) == sorted(map(repr, expected))


def test_look_ups_of_a_hot_key_give_each_row_back_once(spark, monkeypatch):
    """A key in a third of all rows: no join makes more rows than come in, and the result is that of a plain loop."""
    monkeypatch.setattr(first_seen, "FREQUENT_ROWS", 100)
    n = 6000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.xxhash64(F.col("id") % 1500)).alias("h1"), F.lit(1).alias("h2"), F.expr("cast(id div 2 as int)").alias("doc"), F.expr("cast(id % 2 as int)").alias("at")).repartition(4)
    found = first_seen.later(rows, False)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") + plan.count("Join LeftAnti") == plan.count("Join ") and plan.count("Join LeftOuter") >= 2
    seen, expected = set(), []
    for r in sorted(rows.collect(), key=lambda r: (r.doc, r.at)):
        if r.h1 in seen:
            expected.append(tuple(r))
        seen.add(r.h1)
    assert sorted(map(tuple, found.collect())) == sorted(expected)


def test_frequent_keys_are_bounded(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.xxhash64("id")).alias("h1"))
    assert [r.h1 for r in first_seen.frequent(rows).collect()] == [7]
    assert first_seen.frequent(rows.filter("false")).collect() == []


# Spans


def without_spans(rows):
    """Every row's text without sentences in repeated runs, its sentences and the removed ones."""
    runs = {}
    for i, text in sorted({(i, t or "") for i, t in rows}, key=lambda r: order(r[0])):
        found = substring_dedup.sentences(text)
        for at in range(len(found)):
            end, words = at, 0
            while end < len(found) and (words < 20 or end - at < 2):
                words += found[end][3]
                end += 1
            if words >= 20 and end - at >= 2:
                runs.setdefault(tuple(s[2] for s in found[at:end]), []).append((order(i), at, end, i, text))
    gone = {}
    for places in runs.values():
        first = min(p[:2] for p in places)
        for _, at, end, i, text in (p for p in places if p[:2] != first):
            gone.setdefault((i, text), set()).update(range(at, end))
    out = []
    for i, text in rows:
        found = substring_dedup.sentences(text or "")
        removed = gone.get((i, text or ""), set())
        starts = [s[0] for s in found] + [len(text or "")]
        rest = (text or "")[: starts[0]] + "".join((text or "")[starts[k] : starts[k + 1]] for k in range(len(found)) if k not in removed)
        out.append((i, rest, len(found), len(removed)))
    return sorted(out, key=repr)


def spans_of(frame):
    return sorted(((r.doc_id, r.text or "", r.n_sentences, r.n_removed) for r in frame.collect()), key=repr)


def test_sentences():
    text = "One. Two! Three?\n\n Four is 3.5 long.  Five"
    found = substring_dedup.sentences(text)
    assert [text[a:b] for a, b, _, _ in found] == ["One.", "Two!", "Three?", "Four is 3.5 long.", "Five"]
    assert [s[2] for s in found][3] == "four is 3.5 long."
    long = "begin " + "word " * 20 + "pause, " + "word " * 10 + "again; end"
    assert [s[3] for s in substring_dedup.sentences(long)] == [22, 11, 1]
    found = substring_dedup.sentences("  word " * 30)
    assert [s[3] for s in found] == [24, 6] and found[0][2] == " ".join(["word"] * 24)
    assert substring_dedup.sentences("") == substring_dedup.sentences(" \n ") == []


def test_sentences_without_spaces():
    """Each character of such a script is a word; its signs end sentences."""
    text = "今天天气很好，我们去公园。Then home. そうですか？はい"
    found = substring_dedup.sentences(text)
    assert [(text[a:b], n) for a, b, _, n in found] == [("今天天气很好，", 7), ("我们去公园。", 6), ("Then home.", 2), ("そうですか？", 6), ("はい", 2)]
    rng = random.Random(2)
    passage = "".join(chr(0x4E00 + rng.randrange(900)) + ("。" if k % 15 == 14 else "") for k in range(90))
    assert common_runs(passage, "另外" + passage)


def test_rows_that_repeat_id_and_text(spark, prose):
    rows = table(spark, [(1, prose(1, 90))] + [(2, prose(1, 90))] * 40)
    found = substring_dedup.repeated_spans(rows).filter("size(spans) > 0").collect()
    assert [r.doc for r in found] == [2] and len(found[0].spans) == len(substring_dedup.spans(prose(1, 90))[0])


def test_cuts_do_not_depend_on_what_stands_before(prose):
    long = "some words that go on, and on and on without an end until here, then on again and again; and more of it comes, ever more of them, until at last it ends."
    one = [s[2] for s in substring_dedup.sentences("Another begins with a lot of words that are not shared at all " + long)]
    two = [s[2] for s in substring_dedup.sentences(long)]
    assert one[1:] == two[1:]


def common_runs(one, two):
    return set(zip(*[x.tolist() for x in substring_dedup.spans(one)[:2]])) & set(zip(*[x.tolist() for x in substring_dedup.spans(two)[:2]]))


def unpunctuated(prose, seed, words):
    return " ".join(re.sub("[^a-z ]", " ", prose(seed, words + 20).lower()).split()[:words])


def test_unpunctuated_passages_at_different_offsets(prose):
    """Of 100 shared words a run is found whatever stands before them, and the words between the edges go."""
    for n in range(200):
        passage = unpunctuated(prose, 3000 + n, 100)
        one, two = (f"{unpunctuated(prose, n * 2 + k, (n * 7 + k * 5) % 53)} {passage} {unpunctuated(prose, 900 + n * 2 + k, 30)}".strip() for k in range(2))
        assert common_runs(one, two)


@pytest.mark.parametrize("lengths", [(20, 1, 3, 8, 24), (17, 18, 19, 20), tuple(range(1, 25)), tuple(range(15, 40)), (1000,)])
def test_passages_of_55_words_hold_a_run(lengths):
    """Whatever the lengths of their clauses, where in a clause they begin and end, and what stands around them."""
    for n in range(300):
        rng, words = random.Random(n), []
        while len(words) < 80:
            words += [f"w{rng.randrange(400)}" for _ in range(rng.choice(lengths))]
            words[-1] += rng.choice(",.;:")
        at = rng.randrange(25)
        around = [[" ".join(f"{c}{rng.randrange(400)}" for _ in range(rng.randrange(30))) for c in "ab"] for _ in range(2)]
        one, two = (" ".join([before, *words[at : at + 55], after]) for before, after in around)
        assert common_runs(one, two)


def test_periodic_passages_at_different_offsets():
    """A short phrase again and again has equal cuts, too."""
    for period in range(1, 12):
        words = [f"w{i}" for i in range(period)] * 120
        for offset in range(1, 12):
            assert common_runs(" ".join(words[:100]), " ".join([*["before"] * offset, *words[offset : offset + 100]]))


@pytest.mark.parametrize("threshold", [2, 10**9])
def test_spans(spark, prose, monkeypatch, threshold):
    monkeypatch.setattr(first_seen, "FREQUENT_ROWS", threshold)
    passage, other = prose(100, 70), prose(101, 60)
    rows = [(i, f"{prose(i, 60)} {passage if i % 3 == 0 else ''} {prose(i + 500, 40)} {other if i % 7 == 0 else ''}") for i in range(25)]
    rows += [(30, passage), (31, f"{passage}\n{passage}"), (32, passage.upper()), (None, passage), (33, None), (34, ""), (2, rows[2][1]), (35, prose(1, 60))]
    found = spans_of(substring_dedup.substring_dedup(table(spark, rows)))
    assert found == without_spans(rows)
    texts = {r[0]: r[1] for r in found}
    assert passage[:80] in texts[0] and texts[30] == texts[32] == "" and sum(passage[10:200] in (t or "") for t in texts.values()) == 1


def test_passages_in_other_sentences(spark, prose):
    """A passage set in the middle of sentences goes but for its edges."""
    passage = prose(200, 80)
    rows = [(i, f"{prose(i, 50)[:-1]} {passage} {prose(i + 50, 50)}") for i in range(2)]
    text = {r.doc_id: r.text for r in substring_dedup.substring_dedup(table(spark, rows)).collect()}
    inner = substring_dedup.sentences(passage)
    assert passage in text[0]
    assert not any(passage[a:b] in text[1] for a, b, _, n in inner[1:] if n > 3)
    assert text[1].endswith(prose(51, 50))


def test_spans_of_odd_rows(nasty, empty, others):
    found = substring_dedup.substring_dedup(nasty)
    others(found, ("n_sentences", "n_removed"), ("text",))
    assert spans_of(found) == without_spans([(r.doc_id, r.text) for r in nasty.collect()])
    assert found.filter("doc_id = 1").first().text is None
    assert substring_dedup.substring_dedup(empty).collect() == []


def test_span_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    assert spans_of(queries.op8_substring_dedup(spark, d)) == without_spans(rows)
