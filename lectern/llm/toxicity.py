"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two words counts their common subsequences of three characters, each weighted by
how far it spreads, so gaps and inserted characters weaken an insult but do not hide it. A subsequence
spreads over at most ``SPREAD`` characters; wider ones, which would weigh ``DECAY`` for each, do not count. So a
letter put into every gap of a word leaves a sixth of its kernel, two a fortieth, and three nothing; three
letters in one gap leave a quarter. A word
carries a mark before its first character, which lets a stem count more at a word's start.

Training is on labelled texts, whose labels say only that something in them is toxic. So each
toxic text is stood for by its most telling words, and each other text by the word most like
those; the machine is fitted on the kernel's Nyström features of these words, chooses the words
anew, and is fitted again. The machine's sum over landmarks collapses into one weight per
subsequence, so scoring a word needs no kernel with any landmark. A text's score is the
calibrated margin of its two most toxic words; its words include runs of single letters put together.

The fit, on the driver, works on at most ``FREQUENT`` + ``OTHERS`` + ``HARDEST`` clean words besides the toxic texts' words, on ``LANDMARKS`` landmarks, counts a clean word for at most ``MOST`` texts, and reads at most ``SAMPLE_TOXIC`` toxic and ``SAMPLE_CLEAN`` other labelled documents, those
whose hashes are lowest, never one whose crc32(doc_id as text) mod 5 is 0; scoring reads every
whole text.

Defined results: a null or empty text has the score of a text without toxic words; a null doc_id
counts as held out of learning and has held_out by crc32 of the empty text; repeated rows stay;
labels with null toxic, or of unknown documents, are not learnt from; a document with several
labels is toxic if one says so; without toxic or without clean labels every score is 0; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import Memo, filter_rows, lowest, map_rows, one_per_worker, table

SAMPLE_TOXIC, SAMPLE_CLEAN = 1000, 2000
#: Characters of a subsequence, characters over which it may spread, weight of each character that it spreads over.
LENGTH, SPREAD, DECAY = 3, 5, 0.6
LANDMARKS, ROUNDS = 160, 4
#: Words of the clean texts that the machine is fitted against: the most frequent, others by hash, and in each
#: round those most like the toxic texts' words; texts up to which a clean word counts once for each.
FREQUENT, OTHERS, HARDEST, MOST = 2000, 4000, 1500, 50
#: Margins count from and up to these.
FLOOR, CEILING = -0.5, 1.0
#: Characters of the overlapping parts that a longer word is looked at in, when fitting as when scoring.
PART = 24
MARK = "^"
EDGE = re.compile(r"[\W_]+")


def normal(word: str) -> str:
    """Lower case, without the signs at its ends and inside it."""
    word = word.lower()
    return word if word.isalpha() else EDGE.sub("", word)


def words_of(text: str | None) -> dict[str, int]:
    """How often each word of a text occurs, its runs of single letters put together besides."""
    found = text.split() if text else []
    words = Counter(found)
    run: list[str] = []
    if any(len(w) == 1 for w in words):
        for w in [*found, ""]:
            if len(w) == 1 and w.isalpha():
                run.append(w)
            else:
                if len(run) > 2:
                    words["".join(run)] += 1
                run = []
    return words


def parts(word: str) -> list[str]:
    """A normal word's overlapping parts of at most ``PART`` characters; a short word is its only one."""
    if len(word) <= PART:
        return [word]
    return [word[at : at + PART] for at in range(0, len(word) - PART // 2, PART // 2)]


_PICKS = list(combinations(range(1, SPREAD), LENGTH - 1))
_WEIGHT = [DECAY ** (n + 1) for n in range(SPREAD)]
#: By the number of characters, the length of a word's vector, as if its subsequences were all different.
_NORM = [math.sqrt(sum(_WEIGHT[p[-1]] ** 2 for start in range(n) for p in _PICKS if start + p[-1] < n)) or 1.0 for n in range(PART + 2)]


def subsequences(word: str) -> dict[str, float]:
    """The kernel's features of a normal word of at most ``PART`` characters: weight by subsequence."""
    word, found = MARK + word, {}
    for start in range(len(word) - LENGTH + 1):
        for a, b in _PICKS:
            if start + b < len(word):
                key = word[start] + word[start + a] + word[start + b]
                found[key] = found.get(key, 0.0) + _WEIGHT[b] / _NORM[len(word)]
    return found


def kernel(a: str, b: str) -> float:
    """The subsequence kernel of two normal words, normalized by their numbers of characters."""
    x, y = subsequences(a), subsequences(b)
    return sum(v * y[k] for k, v in x.items() if k in y)


class Machine:
    """The fitted machine: a weight per subsequence, the offset, and the calibration of the two top margins."""

    def __init__(self, weights: dict[str, float], offset: float, curve: tuple[float, float, float]):
        self.weights, self.offset, self.curve = weights, offset, curve
        self.tree: dict = {}
        for (x, y, z), value in weights.items():
            self.tree.setdefault(x, {}).setdefault(y, {})[z] = value

    def margin(self, word: str) -> float:
        """Of a normal word; of a long one, that of the most toxic of its overlapping parts."""
        if len(word) < LENGTH:
            return -1.0
        return max(map(self._part, parts(word)))

    def _part(self, word: str) -> float:
        word, tree, total = MARK + word, self.tree, 0.0
        size = len(word)
        for start in range(size - LENGTH + 1):
            seconds = tree.get(word[start])
            if seconds is None:
                continue
            stop = min(size, start + SPREAD)
            for a in range(start + 1, stop - 1):
                thirds = seconds.get(word[a])
                if thirds is not None:
                    for b in range(a + 1, stop):
                        value = thirds.get(word[b])
                        if value is not None:
                            total += value * _WEIGHT[b - start]
        return total / _NORM[size] + self.offset

    def score(self, text: str | None, margins) -> float:
        x, y = top_two(words_of(text), margins)
        return self.curve_at(x, y)

    def curve_at(self, x: float, y: float) -> float:
        a, b, c = self.curve
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a * x + b * y + c))))


def top_two(words: dict[str, int], margins) -> tuple[float, float]:
    """The two highest margins of a text's words; a word that occurs again counts again."""
    first = second = FLOOR
    for margin, n in zip(map(margins.__getitem__, words), words.values()):
        if margin > second:
            if margin > first:
                first, second = margin, margin if n > 1 else first
            else:
                second = margin
    return min(first, CEILING), min(second, CEILING)


def _telling(texts: list[list[str]], toxic: np.ndarray) -> list[str]:
    """The words of the toxic texts whose best five letters occur in toxic texts above all."""
    bad: Counter = Counter()
    for words, label in zip(texts, toxic):
        if label:
            bad.update({g for w in words for g in _grams(w)})
    good = dict.fromkeys(bad, 0)  # no others are asked for
    for words, label in zip(texts, toxic):
        if not label:
            for g in {g for w in words for g in _grams(w)}:
                if g in good:
                    good[g] += 1
    n0, n1 = max(1, int((toxic == 0).sum())), max(1, int((toxic == 1).sum()))
    worth = {}
    for g, c in bad.items():
        odds = math.log((c + 0.5) / n1) - math.log((good[g] + 0.5) / n0)
        if odds > 0:  # rare ones are likely by chance: odds count by the texts that show them
            worth[g] = odds * math.log1p(c)
    known = Memo(lambda w: max((worth.get(g, 0.0) for g in _grams(w)), default=0.0), 2_000_000)
    return [w for words, label in zip(texts, toxic) if label for w in _highest(words, known)]


def _highest(words: list[str], values) -> list[str]:
    """The words of at least half the highest value, if that is above 0."""
    top = max(map(values.__getitem__, words), default=0.0)
    return [w for w in words if values[w] >= 0.5 * top] if top > 0 else []


def _grams(word: str) -> set[str]:
    word = MARK + word
    return {word[i : i + 5] for i in range(max(1, len(word) - 4))}


def _features(words: list[str], columns: dict[str, int]):
    """Dense rows over the landmarks' subsequences, and nothing else: kernels with landmarks need no more."""
    x = np.zeros((len(words), len(columns)))
    for i, w in enumerate(words):
        for k, v in subsequences(w).items():
            if k in columns:
                x[i, columns[k]] = v
    return x


def _embedded(words: list[str], columns: dict[str, int], marks, nystrom, rows: int = 512):
    """The Nyström features of words, ``rows`` at a time: their dense rows need never be there together."""
    return np.vstack([_features(words[at : at + rows], columns) @ marks.T @ nystrom for at in range(0, len(words), rows)])


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 50.0) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the rows inside the margin."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, ridge = np.zeros(x1.shape[1]), np.r_[np.ones(x.shape[1]), 1e-3]
    for _ in range(50):
        inside = y * (x1 @ w) < 1
        a, c = x1[inside], cost * weight[inside]
        new = np.linalg.solve(np.diag(ridge) + (a * c[:, None]).T @ a, (a * c[:, None]).T @ y[inside])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def fit(rows: list[tuple[str | dict[str, int] | None, int]]) -> Machine:
    """Fit on (text or its words with their counts, toxic) rows."""
    rows = [(words if isinstance(words, dict) else words_of(words), label) for words, label in rows]
    toxic = np.array([int(t) for _, t in rows], dtype=np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return Machine({}, -1.0, (0.0, 0.0, -50.0))
    texts, same = [], {}  # each word once in memory, however many texts have it
    for counts, _ in rows:
        whole = [w for w in map(normal, counts) if len(w) >= LENGTH]
        texts.append(list(dict.fromkeys(same.setdefault(part, part) for w in whole for part in parts(w))))
    del same
    bad = [words for words, label in zip(texts, toxic) if label]
    good = [words for words, label in zip(texts, toxic) if not label]
    chosen = _telling(texts, toxic)
    common = Counter(w for words in good for w in words)
    background = [w for w, _ in sorted(common.items(), key=lambda c: (-c[1], c[0]))[:FREQUENT]]
    rare = sorted(common, key=lambda w: (zlib.crc32(w.encode()), w))[:OTHERS]
    harder: list[str] = []
    machine = Machine({}, -1.0, (0.0, 0.0, -50.0))
    for _ in range(ROUNDS):
        if not (counts := Counter(chosen)):
            break
        positives, negatives = sorted(counts), sorted({*background, *rare, *harder})
        ranked = [w for w, _ in sorted(counts.items(), key=lambda c: (-c[1], c[0]))]
        landmarks = sorted({*ranked[: LANDMARKS // 2], *(harder or background)[: LANDMARKS // 2]})
        columns = {k: i for i, k in enumerate(sorted({k for w in landmarks for k in subsequences(w)}))}
        marks = _features(landmarks, columns)
        values, vectors = np.linalg.eigh(marks @ marks.T)
        keep = values > 1e-6 * values.max()
        nystrom = vectors[:, keep] / np.sqrt(values[keep])  # kernel values with the landmarks -> features
        x = _embedded(positives + negatives, columns, marks, nystrom)
        y = np.r_[np.ones(len(positives)), -np.ones(len(negatives))]
        # A word weighs as the texts that it stands for, or, if clean texts have it, as these.
        mass = np.r_[[counts[w] for w in positives], [min(common[w], MOST) for w in negatives]].astype(float)
        mass[len(positives) :] *= 2 * mass[: len(positives)].sum() / max(1.0, mass[len(positives) :].sum())
        mass /= mass[: len(positives)].mean()
        w, offset = _svm(x, y, mass)
        flat = marks.T @ (nystrom @ w)  # the sum over landmarks, as one weight per subsequence
        machine = Machine({k: float(flat[i]) for k, i in columns.items() if flat[i]}, offset, (0.0, 0.0, 0.0))
        margins = Memo(machine.margin, 2_000_000)
        chosen = [w for words in bad for w in _highest(words, margins)]
        top = {max(sorted(words), key=margins.__getitem__) for words in good if words}
        harder = sorted(top, key=lambda w: (-margins[w], w))[:HARDEST]
    if not machine.weights:
        return machine
    # As scoring sees them: whole words, each with the margin of its most toxic part.
    known = Memo(lambda word: machine.margin(normal(word)), 400_000)
    tops = np.array([top_two(counts, known) for counts, _ in rows])
    return Machine(machine.weights, offset, _curve(tops, toxic))


def _curve(tops: np.ndarray, toxic: np.ndarray, ridge: float = 0.1) -> tuple[float, float, float]:
    """Logistic curve over the two top margins, fitted by Newton steps."""
    x, w = np.hstack([tops, np.ones((len(tops), 1))]), np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.diag([1, 1, 0.01]), x.T @ (toxic - p) - ridge * w * [1, 1, 0.01])
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1]), float(w[2])


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame, n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN) -> list[tuple[dict[str, int], int]]:
    """The bounded sample of labelled documents that the machine is fitted on: their words, counted where the texts are.

    Of several rows with one doc_id, the one whose text has the lowest hash stands for all.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(~held_out(F.col("doc_id")))
    ids = lowest(known.where("toxic = 1"), n_toxic, "doc_id").union(lowest(known.where("toxic <> 1"), n_clean, "doc_id"))
    chosen = F.broadcast(ids.select("doc_id", "toxic"))  # at most n_toxic + n_clean rows
    one = docs.select("doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "toxic"), F.xxhash64("text")).alias("row"))

    def make():
        def rows(batch):
            for doc_id, text, toxic in batch:
                counts = words_of(text)
                yield doc_id, " ".join(counts), " ".join(map(str, counts.values())), toxic

        return rows

    # One string per text until its words are made one for all texts: a list of them each takes ten times the driver's memory.
    found = map_rows(one.select("doc_id", "row.text", "row.toxic"), "doc_id long, words string, counts string, toxic long", make).collect()
    found.sort(key=lambda r: r["doc_id"], reverse=True)
    same: dict[str, str] = {}
    rows = []
    while found:
        r = found.pop()
        rows.append(({same.setdefault(w, w): int(n) for w, n in zip(r["words"].split(), r["counts"].split())}, int(r["toxic"] == 1)))
    return rows


def scorer(docs: DataFrame, labels: DataFrame):
    """What makes, in a task, the function that scores a text with the machine fitted on the labelled ``docs``."""
    machine = fit(sample(docs, labels))
    # Its size is bounded by the landmarks' subsequences.
    shared = docs.sparkSession.sparkContext.broadcast((machine.weights, machine.offset, machine.curve))

    name = ("toxicity", uuid.uuid4().hex)

    def build():
        own = Machine(*shared.value)
        known = Memo(own.margin, 300_000)
        return own, Memo(lambda word: known[normal(word)], 400_000)

    def make():
        own, margins = one_per_worker(name, build)
        return lambda text: own.score(text, margins)

    return make


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    make_score = scorer(docs, labels)

    def make():
        score = make_score()
        return lambda batch: ((doc_id, s := score(text), int(s >= 0.5)) for doc_id, text in batch)

    found = map_rows(docs.select("doc_id", "text"), "doc_id long, score double, predicted int", make)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score below 0.5."""
    make_score = scorer(docs, labels)

    def make():
        score = make_score()
        return lambda text: score(text) < 0.5

    return filter_rows(docs, "text", make)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
