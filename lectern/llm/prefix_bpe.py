"""Byte pair encoding by dynamic programming over prefixes.

A sequence of tokens is the encoding of its text if, and only if, every two neighbours are a
valid pair: encoding the two tokens' joined text gives them back. So every prefix has exactly
one last token that fits the prefix before it. One table of these last tokens answers, without
encoding anything again, the tokens and the token count of every prefix; appending extends the
table; after an edit only the entries behind it are recomputed.

Works on ``bytes`` (atoms are bytes) and on ``str`` (atoms are characters). A token's rank is
its merge priority: the lowest rank merges first, the leftmost on ties, and a token's parts
have lower ranks than the token itself.
"""

from __future__ import annotations

from itertools import pairwise

NEVER = 1 << 60
SHIFT = 21  # bits of an atom, and of a token's number


class Vocabulary:
    """Tokens, found backwards from their last atom, and the check of pairs that the table needs."""

    def __init__(self, ranks: dict):
        self.ranks = ranks
        self.tokens = list(ranks)
        self.sizes = [len(t) for t in self.tokens]
        self._children: dict[int, int] = {}
        self._ends: list[int] = [-1]
        self._edges: dict[int, tuple | None] = {}
        self._known: dict[int, bool] = {}
        for number, token in enumerate(self.tokens):
            node = 0
            for atom in reversed(self.atoms(token)):
                key = node << SHIFT | atom
                if (node := self._children.get(key, 0)) == 0:
                    node = self._children[key] = len(self._ends)
                    self._ends.append(-1)
            self._ends[node] = number

    @staticmethod
    def atoms(text) -> list[int]:
        return list(text) if isinstance(text, bytes) else list(map(ord, text))

    def _merge(self, text) -> tuple[list, list, list]:
        """Plain merging of a token's text: its parts, and what its first and its last atom grew into."""
        ranks, parts = self.ranks, [text[i : i + 1] for i in range(len(text))]
        first, last = [parts[0]], [parts[-1]]
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if best == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if at == 0:
                first.append(parts[0])
            if at == len(parts) - 1:
                last.append(parts[-1])
        return parts, first, last

    def _edge(self, number: int) -> tuple | None:
        """What the token's first and last atoms grow into, with the ranks at which they grow on; None if merging never gives it."""
        if number not in self._edges:
            parts, *both = self._merge(self.tokens[number])
            lives = tuple([(p, self.ranks[q]) for p, q in pairwise(grown)] + [(grown[-1], NEVER)] for grown in both)
            self._edges[number] = lives if len(parts) == 1 else None
        return self._edges[number]

    def _valid(self, a: int, b: int) -> bool:
        """True if no merge crosses the border between two tokens."""
        left, right, ranks = self._edge(a), self._edge(b), self.ranks
        good = left is not None and right is not None
        if good:
            for x, x_grows in left[1]:
                for y, y_grows in right[0]:
                    rank = ranks.get(x + y, NEVER)
                    if rank < x_grows and rank <= y_grows and rank != NEVER:
                        good = False
        if len(self._known) >= 1_000_000:
            self._known.clear()
        self._known[a << SHIFT | b] = good
        return good

    def extend(self, atoms: list[int], last: list[int], count: list[int]) -> None:
        """Fill in the table for the prefixes from ``len(last)`` on.

        ``last[i]`` is the number of the prefix's last token, or, below 0, an atom that the
        vocabulary lacks; such an atom never merges and counts as its UTF-8 bytes.
        """
        child, ends, known, sizes = self._children.get, self._ends, self._known, self.sizes
        for end in range(len(last), len(atoms) + 1):
            node, at, found = 0, end, None
            while at:
                at -= 1
                node = child(node << SHIFT | atoms[at])
                if node is None:
                    break
                token = ends[node]
                if token >= 0:
                    before = last[at]
                    if before is None or before < 0:
                        good = self._edge(token) is not None
                    else:
                        good = known.get(before << SHIFT | token)
                        if good is None:
                            good = self._valid(before, token)
                    if good:
                        found = token
                        break
            if found is None:
                last.append(~atoms[end - 1])
                count.append(count[end - 1] + len(chr(atoms[end - 1]).encode()))
            else:
                last.append(found)
                count.append(count[end - sizes[found]] + 1)

    def encode(self, text) -> list[int]:
        """The numbers of the text's tokens."""
        last: list = [None]
        self.extend(self.atoms(text), last, [0])
        return self.walk(last, len(text))

    def walk(self, last: list[int], at: int) -> list[int]:
        found, sizes = [], self.sizes
        while at:
            token = last[at]
            found.append(token)
            at -= sizes[token] if token >= 0 else 1
        return found[::-1]

    def count(self, text) -> int:
        last, count = [None], [0]
        self.extend(self.atoms(text), last, count)
        return count[-1]


class PrefixTable:
    """For every prefix of a text its last token and its token count; index 0 is the empty prefix."""

    __slots__ = ("vocabulary", "atoms", "last", "count")

    def __init__(self, vocabulary: Vocabulary, text=b""):
        self.vocabulary, self.atoms, self.last, self.count = vocabulary, [], [None], [0]
        self.append(text)

    def append(self, more) -> PrefixTable:
        self.atoms += self.vocabulary.atoms(more)
        self.vocabulary.extend(self.atoms, self.last, self.count)
        return self

    def replace(self, start: int, stop: int, new) -> PrefixTable:
        """Edit the atoms ``start`` to ``stop``; the entries up to ``start`` stay as they are."""
        del self.last[start + 1 :], self.count[start + 1 :]
        self.atoms[start:stop] = self.vocabulary.atoms(new)
        self.vocabulary.extend(self.atoms, self.last, self.count)
        return self

    def tokens(self, end: int | None = None) -> list[int]:
        """The numbers of the tokens of the prefix of length ``end``, by default of the whole text."""
        return self.vocabulary.walk(self.last, len(self.atoms) if end is None else end)
