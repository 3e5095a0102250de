"""Prefix tables of byte-pair (merge-type) vocabularies.

A merge vocabulary splits a text by joining, again and again, the neighbouring
pair with the best priority, the leftmost of equals first.  Two facts make a
linear table possible:

* a row of tokens is the split of its text exactly when every neighbouring pair
  of it is the split of that pair's own text, and
* hence every prefix has one last token only.

So the table is filled from left to right: an Aho-Corasick automaton reports the
tokens that end at a position, and the one which is compatible with the last
token of the prefix before it is stored.  The ids are then read off backwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import ahocorasick

#: Entries of the memo of pair tests; it is emptied when full, so memory is bounded.
PAIRS_KEPT = 400_000

#: Stands for the start of a text and for a character outside the vocabulary.
OPEN = -1

#: Runs of text remembered in each of two generations, and the longest of them.
RUNS_KEPT, RUN_LENGTH = 250_000, 40

Join = Callable[[int, int], "tuple[float, int] | None"]


class Memo(dict):
    """Results for short runs of text; when a generation is full, the one before it is forgotten."""

    def __init__(self, compute: Callable):
        super().__init__()
        self.compute = compute
        self.older: dict = {}

    def __missing__(self, run):
        found = self.older.get(run)
        if found is None:
            found = self.compute(run)
            if len(run) > RUN_LENGTH:
                return found
        if len(self) >= RUNS_KEPT:
            self.older = dict(self)
            self.clear()
        self[run] = found
        return found


class MergeVocabulary:
    """Tokens with their texts, and the priority with which two of them join.

    ``pieces`` maps an id to its text.  ``join(a, b)`` gives (priority, id) of
    the token that ``a`` and ``b`` form, or None; lower priorities join first.
    """

    def __init__(self, pieces: dict[int, str], join: Join):
        self.pieces = pieces
        self.join = join
        self.ids = {}
        for token, piece in pieces.items():
            self.ids.setdefault(piece, token)
        self.parents: dict[int, tuple[int, int, float]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, token in self.ids.items():
            if self._grow(token, piece):
                self.automaton.add_word(piece, (token, len(piece)))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.sizes = {token: len(piece) for token, piece in pieces.items()}
        self._pairs: dict[int, bool] = {}

    def _grow(self, token: int, piece: str) -> bool:
        """Join a piece's own characters; remember the last join. False if it isn't reached."""
        if len(piece) == 1:
            return True
        if any(c not in self.ids for c in piece):
            return False
        row = [self.ids[c] for c in piece]
        last = None
        while len(row) > 1:
            found = [(m[0], i, m[1]) for i in range(len(row) - 1) if (m := self.join(row[i], row[i + 1]))]
            if not found:
                return False
            priority, i, made = min(found)
            last = (row[i], row[i + 1], priority)
            row[i : i + 2] = [made]
        if row[0] != token:
            return False
        self.parents[token] = last
        return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether the text of ``a`` followed by that of ``b`` splits into just these two."""
        key = a << 24 | b
        known = self._pairs.get(key)
        return self._test(key, a, b) if known is None else known

    def _test(self, key: int, a: int, b: int) -> bool:
        if len(self._pairs) >= PAIRS_KEPT:
            self._pairs.clear()
        known = self._pairs[key] = self._meet(a, b)
        return known

    def _meet(self, a: int, b: int) -> bool:
        """Replay the joins beside the border; false once a join across it would come first."""
        left, right = [], []  # the symbols that touch the border, with the priority of the join that made each
        node = a
        while node in self.parents:
            _, inner, priority = self.parents[node]
            left.append((node, priority))
            node = inner
        left.append((node, None))
        node = b
        while node in self.parents:
            inner, _, priority = self.parents[node]
            right.append((node, priority))
            node = inner
        right.append((node, None))
        i, j = len(left) - 1, len(right) - 1
        while True:
            across = self.join(left[i][0], right[j][0])
            next_left = left[i - 1][1] if i else None
            next_right = right[j - 1][1] if j else None
            if across is not None:
                # Of equal priorities the leftmost join is made first.
                before_left = next_left is None or across[0] < next_left
                before_right = next_right is None or across[0] <= next_right
                if before_left and before_right:
                    return False
            if next_left is None and next_right is None:
                return True
            if next_right is None or (next_left is not None and next_left <= next_right):
                i -= 1
            else:
                j -= 1

    def last_tokens(self, text: str) -> list[int | None]:
        """For each prefix length its last token; None after a character outside the vocabulary."""
        last: list[int | None] = [None] * (len(text) + 1)
        last[0] = OPEN
        if not len(self.automaton):
            return last
        known, test = self._pairs.get, self._test
        for end, (token, size) in self.automaton.iter(text):
            if last[end + 1] is None:
                before = last[end + 1 - size]
                if before is None or before < 0:
                    last[end + 1] = token
                elif (meets := known(key := before << 24 | token)) or (meets is None and test(key, before, token)):
                    last[end + 1] = token
        return last

    def split(self, text: str, outside: Callable[[str], Sequence[int]]) -> list[int]:
        """The ids of a text, recovered backwards; ``outside`` spells a character without a token."""
        last = self.last_tokens(text)
        ids: list[int] = []
        at = len(text)
        while at:
            token = last[at]
            if token is None:
                ids.extend(reversed(outside(text[at - 1])))
                at -= 1
            else:
                ids.append(token)
                at -= self.sizes[token]
        ids.reverse()
        return ids

    def counts(self, text: str, outside: Callable[[str], int] = lambda c: 1) -> list[int]:
        """How many tokens each prefix of a text has, the empty prefix included."""
        sizes = self.sizes
        counts = [0]
        for at, token in enumerate(self.last_tokens(text)[1:], 1):
            counts.append(counts[-1] + outside(text[at - 1]) if token is None else counts[at - sizes[token]] + 1)
        return counts
