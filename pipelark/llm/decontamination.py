"""Benchmark decontamination by greedy string tiling.

A document and a test item that share a run of words are tiled: the longest
matching run of words not yet in a tile is marked in both, again and again,
until no run of ``MATCH`` words is left; an item of fewer words is a run as a whole.
Runs are found with running (Karp-Rabin) hashes.  The share of the item that tiles cover tells how much of it
the document holds, in whatever order its parts stand there.

Items are taken in blocks of bounded size, each of which is sent to all workers
and held against all documents; so documents aren't shuffled, and a benchmark of
any size is compared whole (after some blocks rows are written out, so that
memory doesn't grow with their number).  A seed that a document shares with very many items
costs it one look at each of them, and only items that seeds can cover far
enough are tiled, with no more memory than the words of both.
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import extended, free
from .session import ready, settled

#: Words of a seed and of the shortest tile (all of a shorter item), and the share of an item that makes a leak.
MATCH, COVERAGE = 5, 0.5

#: Characters of the items of a block, and blocks that a task has in memory.
BLOCK_CHARS, BLOCKS_AT_ONCE = 20_000_000, 4

_words = re.compile(r"\w+").findall

#: The odd base of running hashes (modulo 2^64), and the number that it gives 1 with.
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def words(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in small letters."""
    return _words((text or "").lower())


def _powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers, from 1 on."""
    return _power_table(base, 1 << max(10, n.bit_length()))[:n]


@lru_cache(maxsize=8)
def _power_table(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


class Running:
    """Hashes of all windows of a row of numbers, whatever their size."""

    def __init__(self, numbers: np.ndarray):
        # Numbers are spread first: sums of powers of small ones would often be equal.
        x = numbers.astype(np.uint64) + np.uint64(_BASE)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * _powers(_BASE, len(x)), dtype=np.uint64)])
        self.back = _powers(_BACK, len(x))

    def windows(self, size: int) -> np.ndarray:
        """The hash of each window of ``size`` numbers, by its first place."""
        n = max(0, len(self.sums) - size)
        return (self.sums[size:] - self.sums[:n]) * self.back[:n]


def tiles(item: np.ndarray, document: np.ndarray, least: int = MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the document, words), the longest first.

    Of equally long ones the first in the item, then in the document is taken.
    Lengths are tried by bisection, since a run holds all shorter ones.
    """
    rows, hashes = (item, document), (Running(item), Running(document))
    taken, found = [np.zeros(len(r), bool) for r in rows], []

    def common(size: int) -> tuple[int, int] | None:
        """The first equal runs of ``size`` words outside of tiles."""
        places, seen = [], []
        for t, h in zip(taken, hashes):
            before = np.concatenate([[0], np.cumsum(t)])
            places.append(np.flatnonzero(before[size:] == before[: max(0, len(before) - size)]))
            seen.append(h.windows(size)[places[-1]])
        for i, h in zip(*(x[np.isin(seen[0], seen[1])] for x in (places[0], seen[0]))):
            for j in places[1][seen[1] == h]:
                if (item[i : i + size] == document[j : j + size]).all():
                    return int(i), int(j)
        return None

    most = min(len(item), len(document))
    while most >= least and (best := common(least)):
        size = least
        while size < most:
            middle = (size + most + 1) // 2
            if longer := common(middle):
                best, size = longer, middle
            else:
                most = middle - 1
        for t, at in zip(taken, best):
            t[at : at + size] = True
        found.append((*best, size))
        most = size
    return found


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers from each start to each end, one range behind the other."""
    sizes = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


class ItemBlock:
    """A block of test items, ready to be held against documents."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.keys = [key for key, _ in items]
        self.numbers: dict[str, int] = {}
        rows = [[self.numbers.setdefault(w, len(self.numbers) + 1) for w in words(text)] for _, text in items]
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.flat = np.fromiter((n for r in rows for n in r), np.int64, int(self.sizes.sum()))
        running, item_of = Running(self.flat), np.repeat(np.arange(len(rows)), self.sizes)
        #: By the words of a seed: its size, the places (in ``flat``) of seeds, their items and the numbers of their
        #: hashes; the sorted hashes, and the places by them (``first`` tells where those of a hash begin).
        self.seeds = []
        for size in range(MATCH, 0, -1):
            hashes = running.windows(size)
            at = np.arange(len(hashes))
            fits = np.minimum(self.sizes, MATCH)[item_of[at]] == size
            at = at[fits & (at + size <= self.ends[item_of[at]])]
            if len(at):
                known, number = np.unique(hashes[at], return_inverse=True)
                order = np.argsort(number, kind="stable")
                first = np.searchsorted(number[order], np.arange(len(known) + 1))
                self.seeds.append((size, at, item_of[at], number, known, at[order], first))

    def leaks(self, text: str | None, coverage: float) -> list[dict]:
        """The items of which the text holds ``coverage`` or more, with their tiles; the best first, then in the order of the block."""
        if not self.seeds:
            return []
        found = words(text)
        row = np.fromiter(map(self.numbers.get, found, repeat(0)), np.int64, len(found))
        # Most words of most documents are in no item: look only at windows without such a word.
        outside = np.concatenate([[0], np.cumsum(row == 0)])
        running, found = None, []
        for size, places, items, number, hashes, by_hash, first in self.seeds:
            inside = np.flatnonzero(outside[size:] == outside[: max(0, len(outside) - size)])
            if not len(inside):
                continue
            running = running or Running(row)
            seen = running.windows(size)[inside]
            at = np.searchsorted(hashes, seen).clip(max=len(hashes) - 1)
            hit = hashes[at] == seen
            if not hit.any():
                continue
            at, inside = at[hit], inside[hit]
            some = np.unique(at)
            reached = np.sort(by_hash[_ranges(first[some], first[some + 1])])
            owner = items[np.searchsorted(places, reached)]
            new = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            step = np.minimum(np.diff(reached, append=reached[-1] + size), size)
            step[np.concatenate([new[1:] - 1, [len(step) - 1]])] = size
            reach = np.add.reduceat(step, new)
            # No tiling can cover more than all seeds do.
            for k in owner[new][reach >= coverage * self.sizes[owner[new]]].tolist():
                end = int(self.ends[k])
                own = slice(*np.searchsorted(places, [end - self.sizes[k], end]))
                found += self._tiled(k, row, inside[np.isin(at, number[own])], size, coverage)
        return [x for _, x in sorted(found, key=lambda x: (-x[1]["coverage"], x[0]))]

    def _tiled(self, k: int, row: np.ndarray, places: np.ndarray, size: int, coverage: float) -> list[tuple[int, dict]]:
        """Item ``k`` and how it is tiled, if it is a leak; its seeds are at ``places`` of the document."""
        end = int(self.ends[k])
        item = self.flat[end - int(self.sizes[k]) : end]
        # Only what seeds cover counts; a word that no item has stands for what is left out.
        held = np.unique(places[:, None] + np.arange(size))
        gaps = np.flatnonzero(np.diff(held) > 1) + 1
        near, where = np.insert(row[held], gaps, 0), np.insert(held, gaps, -1)
        cover = tiles(item, near, size)
        share = sum(t[2] for t in cover) / len(item)
        if share < coverage:
            return []
        return [(k, {"item_id": self.keys[k], "coverage": share, "tiles": [{"item_word": i, "doc_word": int(where[j]), "n_words": n} for i, j, n in cover]})]


@lru_cache(maxsize=4)
def _block(name: str, items) -> ItemBlock:
    """The block of a broadcast, built once in a worker."""
    return ItemBlock(items.value)


class _Sent:
    """A broadcast that is known by a name."""

    def __init__(self, items):
        self.name, self.items = str(uuid.uuid4()), items

    def __eq__(self, other) -> bool:
        return isinstance(other, _Sent) and self.name == other.name

    def __hash__(self) -> int:
        return hash(self.name)

    @property
    def value(self):
        return self.items.value


def _blocks(benchmark: DataFrame, item_id: str, text: str, most: int) -> list[_Sent]:
    """Broadcast blocks of items, each of about ``most`` characters; the driver has one of them in memory at a time."""
    spark = ready(benchmark.sparkSession)
    items = benchmark.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text")).filter(F.length("text") > 0)
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // most)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n)))
    blocks = []
    for i in range(n):
        rows = [tuple(r) for r in (items.filter(part == i) if n > 1 else items).collect()]
        rows.sort(key=lambda r: (r[0] is None, () if r[0] is None else (r[0],), r[1]))
        blocks.append(_Sent(spark.sparkContext.broadcast(rows)))
    return blocks


def leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE, out: str = "leaks", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``df`` with an array of the items that each text holds: ``item_id``, ``coverage`` and ``tiles``.

    The items of most coverage come first, then those of smaller ids, whatever
    ``block_chars`` is.  Very long texts are held against items whole.  Null and empty texts and items match nothing.  Items of fewer than ``MATCH``
    words are held by texts that have all their words in a row.  Repeated items
    are listed as often as they are repeated.
    Rows of ``df`` stay as they are, repeated ones too; a column named like the result is
    replaced; an empty table on either side gives no leaks.
    """
    key = benchmark.schema[item_id].dataType
    tile = T.StructType([T.StructField(n, T.IntegerType()) for n in ("item_word", "doc_word", "n_words")])
    leak = T.StructType([T.StructField("item_id", key), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.ArrayType(tile))])
    kind = pa.list_(pa.struct([("item_id", _arrow(key)), ("coverage", pa.float64()), ("tiles", pa.list_(pa.struct([(n, pa.int32()) for n in tile.names])))]))
    rows = df.drop(*[c for c in df.columns if c.lower() == out.lower()])
    names, parts = rows.columns, []
    for n, block in enumerate(_blocks(benchmark, item_id, item_text, block_chars)):
        if n and n % BLOCKS_AT_ONCE == 0:
            rows = settled(rows)
        parts.append(free([*names, *parts, out], "leaks_in_block"))

        def make(block=block):
            tests = _block(block.name, block)
            return lambda texts: [pa.array([tests.leaks(t.as_py(), coverage) for t in texts], kind)]

        rows = extended(rows, text, [T.StructField(parts[-1], T.ArrayType(leak))], make)
    none = F.array().cast(T.ArrayType(leak))
    joined = F.concat(none, *parts)
    return rows.select(*[F.col(f"`{c}`") for c in names], (F.array_sort(joined, _order) if len(parts) > 1 else joined).alias(out))


def _order(a: Column, b: Column) -> Column:
    """Whether leak ``a`` comes before ``b`` (-1), behind it (1), or neither (0): by coverage, then by id, null ids last."""
    x, y = a["item_id"], b["item_id"]
    before = (a["coverage"] > b["coverage"]) | (a["coverage"] == b["coverage"]) & ((x < y) | x.isNotNull() & y.isNull())
    behind = (a["coverage"] < b["coverage"]) | (a["coverage"] == b["coverage"]) & ((x > y) | x.isNull() & y.isNotNull())
    return F.when(before, -1).when(behind, 1).otherwise(0)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def decontaminate(df: DataFrame, benchmark: DataFrame, text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``df`` whose text holds no test item; see :func:`leaks`."""
    out = free(df.columns, "leaks")
    return leaks(df, benchmark, text, coverage=coverage, out=out).filter(F.size(out) == 0).drop(out)
