"""Words in text without spaces: the most likely cut by a dictionary, in search mode.

A run of letters of such a script is a graph whose edges are the dictionary's words; the path with the
highest product of word frequencies is taken. Neighbouring characters that the dictionary lacks are cut by a hidden Markov model of
where words begin and end, whose numbers come from the dictionary's own words. In search mode the shorter words inside a
long word come before it, so a query for either finds both. Other letters and digits are words by runs, as in ``text.tokens``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Scripts that are written without spaces.
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
#: Cuts of runs that a worker remembers, of runs up to so many characters.
REMEMBERED, SHORT = 100_000, 64


class Cutter:
    """``counts``: words and how often they occur. ``scripts``: the characters whose runs are cut. ``guess``: whether unknown ones are cut by the model."""

    def __init__(self, counts: dict[str, int], scripts: str = UNSPACED, guess: bool = True):
        self.total = max(1, sum(counts.values()))
        self.weights = {w: math.log(n / self.total) for w, n in counts.items() if n > 0}
        self.longest, self.unknown, self.guess = max(map(len, counts), default=1), math.log(0.5 / self.total), guess
        self.runs = regex.compile(rf"(?V1)([{scripts}]+)|[[\p{{L}}\p{{N}}]--[{scripts}]]+")
        self.remembered: dict[str, list[str]] = {}
        self._fit(counts)

    def _fit(self, counts: dict[str, int]) -> None:
        """Starts, steps and characters of the states B, M, E and S from the words, each as often as it occurs."""
        single = sum(n for w, n in counts.items() if len(w) == 1) + 1
        two = sum(n for w, n in counts.items() if len(w) == 2) + 1
        more = sum(n for w, n in counts.items() if len(w) > 2) + 1
        middles = sum(n * (len(w) - 2) for w, n in counts.items() if len(w) > 2) + 2
        log = lambda a, b: math.log(a / b)
        begin, alone = log(two + more, single + two + more), log(single, single + two + more)
        after = {"B": begin, "S": alone}
        self.first = after
        self.steps = {
            "B": {"E": log(two, two + more), "M": log(more, two + more)}, "M": {"E": log(more, middles), "M": log(middles - more, middles)}, "E": after, "S": after,
        }
        seen = {state: Counter() for state in "BMES"}
        for word, n in counts.items():
            states = "S" if len(word) == 1 else "B" + "M" * (len(word) - 2) + "E"
            for state, char in zip(states, word):
                seen[state][char] += n
        kinds = len({c for w in counts for c in w}) + 1
        sizes = {state: sum(found.values()) + kinds for state, found in seen.items()}
        self.seen, self.sizes = seen, sizes

    def emits(self, state: str, char: str) -> float:
        return math.log((self.seen[state][char] + 1) / self.sizes[state])

    def best_path(self, run: str) -> list[str]:
        """The words of the most likely path; of equally likely ones that with the longer last word."""
        scores, lengths = [0.0], [0]
        for stop in range(1, len(run) + 1):
            best, length = -math.inf, 1
            for n in range(1, min(self.longest, stop) + 1):
                weight = self.weights.get(run[stop - n : stop], self.unknown if n == 1 else None)
                if weight is not None and scores[stop - n] + weight >= best:
                    best, length = scores[stop - n] + weight, n
            scores.append(best)
            lengths.append(length)
        words, stop = [], len(run)
        while stop:
            words.append(run[stop - lengths[stop] : stop])
            stop -= lengths[stop]
        return words[::-1]

    def guessed(self, run: str) -> list[str]:
        """The words of a run of unknown characters, by the most likely states."""
        scores, back = {s: self.first.get(s, -math.inf) + self.emits(s, run[0]) for s in "BMES"}, []
        for char in run[1:]:
            came = {s: max((scores[p] + self.steps[p].get(s, -math.inf), p) for p in "BMES") for s in "BMES"}
            back.append({s: p for s, (_, p) in came.items()})
            scores = {s: value + self.emits(s, char) for s, (value, _) in came.items()}
        state = max("ES", key=lambda s: scores[s])
        states = [state]
        for step in reversed(back):
            states.append(step[states[-1]])
        words, start = [], 0
        for at, state in enumerate(reversed(states), 1):
            if state in "ES":
                words.append(run[start:at])
                start = at
        return words

    def cut(self, run: str) -> list[str]:
        """The words of a run of an unspaced script."""
        path = self.best_path(run)
        if not self.guess:
            return path
        words, strange = [], ""
        for word in [*path, None]:
            if word is not None and len(word) == 1 and word not in self.weights:
                strange += word
                continue
            if strange:
                words += self.guessed(strange) if len(strange) > 1 else [strange]
                strange = ""
            if word is not None:
                words.append(word)
        return words

    def for_search(self, run: str) -> list[str]:
        """The words, each after the known words of two and three characters inside it."""
        if run in self.remembered:
            return self.remembered[run]
        found = []
        for word in self.cut(run):
            for n in (2, 3):
                if len(word) > n:
                    found += [part for at in range(len(word) - n + 1) if (part := word[at : at + n]) in self.weights]
            found.append(word)
        if len(run) <= SHORT:
            if len(self.remembered) >= REMEMBERED:
                self.remembered.clear()
            self.remembered[run] = found
        return found

    def tokens(self, text: str) -> list[str]:
        found = []
        for match in self.runs.finditer(text.lower()):
            found += self.for_search(match.group()) if match.group(1) else [match.group()]
        return found


def tokenizer(spark: SparkSession, cutter: Cutter) -> Callable[[Column], Column]:
    """A function of a text column for ``tokenize=`` of the keyword index and its searches; a null text has no tokens."""
    shared = spark.sparkContext.broadcast(cutter)  # a dictionary of bounded size

    @F.arrow_udf("array<string>")
    def tokens(texts: pa.Array) -> pa.Array:
        own = shared.value
        return pa.array([own.tokens(t) if t is not None else [] for t in texts.to_pylist()], type=pa.list_(pa.string()))

    return tokens
