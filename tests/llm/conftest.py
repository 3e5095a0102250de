import random

import pytest

WORDS = "the of and to in is that with as for it was on are be by this had not but from or have an they which one you were all her she there would their we him been has when who will no more if out so up said what its about than into them can only other time new some could these two may first then do any like my now over such our man me even most made after also did many off before must well back through years where much your way down should because long each just state those people too mr how little good world make very year still see own work men day get here old life both between being under three never know same last another while us might great go come since against right came take used himself few house use place during high without again home around small however found mrs part school thought went say general once upon every left war".split()


@pytest.fixture(scope="session")
def prose():
    """Sentences of random words: prose(seed, words)."""

    def make(seed, words, line=60):
        rng, out, held = random.Random(seed), [], 0
        while held < words:
            n = min(words - held, rng.randint(5, 14))
            sentence = " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "er", "ing"]) for _ in range(n))
            out.append(sentence.capitalize() + ".")
            held += n
            if rng.random() < 0.2:
                out.append("\n")
        return " ".join(out).replace(" \n ", "\n").strip()

    return make


#: Names that operators give to their results or use on the way.
CLASHES = (
    "ids decoded n_tokens fit_chars host path rule verdict shard slot kept quality base_failed n_words n_lines n_dropped n_sentences n_removed "
    "leaks score weak_label votes fp component doc version at key h1 h2 word bits keep spans span_doc line_marks line_doc row_hash target draw place part rank sends "
    "source_text canonical row_number node root least"
).split()


@pytest.fixture(scope="session")
def nasty(spark, prose):
    """Nulls, empty and very long texts, repeated rows, ties and clashing column names."""
    again = prose(5, 120)
    texts = [
        (1, None),
        (2, ""),
        (3, "a"),
        (4, " \t\n\r\n "),
        (5, again),
        (5, again),
        (6, again),
        (None, again),
        (None, prose(6, 80)),
        (7, prose(7, 20000)),
        (8, "x" * 50_000),
        (9, "é日本\u0000\U0001f600 " * 300),
        (10, "\n".join(["the same line again"] * 400)),
        (5, prose(8, 90)),
        (11, None),
        (12, "<|endoftext|><s></s> ▁ <0x0A>"),
    ]
    rows = [(i, t, *[f"{c}{n}" if n % 3 else None for c in CLASHES]) for n, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHES)).repartition(3)


@pytest.fixture(scope="session")
def empty(nasty):
    return nasty.filter("false")


@pytest.fixture
def others(nasty):
    """Check that all rows are there and that columns which aren't results are as they were."""

    def check(found, replaced, dropped=()):
        kept = [c for c in nasty.columns if c not in replaced and c not in dropped]
        assert set(kept) <= set(found.columns)
        a = sorted(map(repr, (tuple(r) for r in nasty.select(*kept).collect())))
        b = sorted(map(repr, (tuple(r) for r in found.select(*kept).collect())))
        assert a == b

    return check
