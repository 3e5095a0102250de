"""Line deduplication with keep bitmaps, in DataFrame operations only.

Lines are compared by a hash of their key (white space at the ends stripped, A-Z
small).  Only hashes, documents and positions move; what comes back for each
document is a bitmap of the lines that stay, as 64-bit words of which those
without a dropped line are left out.  Applied to a document the bitmap gives the
text that remains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import first_seen
from .batches import free
from .session import settled

#: Keys with fewer code points are never dropped.
LEAST_LENGTH = 10

BLANKS = " \t\n\x0b\x0c\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    """The lines of a text; null and empty texts have one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """A line with white space stripped at both ends and A-Z made small, and nothing else."""
    bare = F.btrim(line, F.lit(BLANKS))
    # lower() knows more letters than A-Z, so it is used where there are no others.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, CAPITALS, SMALL))


def version(text: Column) -> Column:
    """Tells apart rows that have the same document id but other texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_bitmaps(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """One row (``doc``, ``version``, ``keep``) for each document that loses lines.

    A key found in two documents or more loses all its lines but those in the
    document of the smallest id (null ids come last and count as one document).
    ``keep`` lists (word, bits): bit i of word w is line 64 w + i, 1 if it stays;
    words without a dropped line aren't listed.
    """
    lines = df.select(df[f"`{doc_id}`"].alias("doc"), version(df[f"`{text}`"]).alias("version"), F.posexplode(lines_of(df[f"`{text}`"])).alias("at", "line"))
    keyed = lines.select("doc", "version", "at", line_key(F.col("line")).alias("key")).filter(F.length("key") >= least_length)
    rows = settled(keyed.select(*first_seen.key(F.col("key")), "doc", "version", "at"))
    dropped = first_seen.later(rows, whole_document=True)
    word, bit = F.expr("at div 64"), F.expr("shiftleft(1L, at % 64)")
    words = dropped.groupBy("doc", "version", word.cast("int").alias("word")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    return words.groupBy("doc", "version").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep"))


def _marks(keep: Column) -> Column:
    """A bitmap as text: for each word 64 signs, the bit of the last line first; 1 stays, 0 goes."""

    def spelled(entry: Column, k: Column) -> Column:
        before = F.coalesce(F.get(keep, k - 1)["word"], F.lit(-1))
        return F.concat(F.repeat(F.lit("1"), (entry["word"] - before - 1) * 64), F.lpad(F.bin(entry["bits"]), 64, "0"))

    return F.coalesce(F.array_join(F.transform(keep, spelled), ""), F.lit(""))


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with ``text`` reduced to the lines that stay, and ``n_lines`` and ``n_dropped`` (long) as last columns.

    Texts of documents without a bitmap are left as they are, null ones included.
    """
    kept = [c for c in df.columns if c.lower() not in ("n_lines", "n_dropped")]
    v, w, m = (free(kept, x) for x in ("line_version", "line_doc", "line_marks"))
    left = df.select(*[df[f"`{c}`"] for c in kept], version(df[f"`{text}`"]).alias(v))
    right = bitmaps.select(F.col("doc").alias(w), F.col("version").alias(f"{v}_2"), _marks(F.col("keep")).cast("binary").alias(m))
    both = left.join(right, left[f"`{doc_id}`"].eqNullSafe(right[w]) & (left[v] == right[f"{v}_2"]), "left")
    lines = lines_of(F.col(f"`{text}`"))

    def stays(line: Column, i: Column) -> Column:
        sign = F.substring(F.col(m), (F.floor(i / 64).cast("int") + 1) * 64 - i % 64, F.lit(1))
        return sign != F.lit(b"0")

    some = F.col(m).isNotNull()
    remaining = F.when(some, F.array_join(F.filter(lines, stays), "\n")).otherwise(F.col(f"`{text}`"))
    gone = F.when(some, F.size(F.filter(lines, lambda x, i: ~stays(x, i)))).otherwise(0).cast("long")
    columns = [remaining.alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in kept]
    return both.select(*columns, F.size(lines).cast("long").alias("n_lines"), gone.alias("n_dropped"))


def line_dedup(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH) -> DataFrame:
    """``df`` without its repeated lines, with ``n_lines`` (before) and ``n_dropped``.

    See :func:`keep_bitmaps` for the lines that go.  No row goes: a document of
    which every line is dropped has an empty text.  Rows that repeat an id and
    text fare alike.  Lines of very long texts count like others.  Columns named like results are replaced, others pass
    through; an empty table gives an empty result.
    """
    return apply_bitmaps(df, keep_bitmaps(df, doc_id, text, least_length), doc_id, text)
