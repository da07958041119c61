"""Token counts from prefix dynamic programming.

The piece vocabulary's tokens never hold a space mark behind another character, so a text falls
into words, each a run of marks and what follows it, whose tokens do not depend on the others.
A word's prefix table holds the exact token count of each of its prefixes; with the counts of
the words before it, the count of every prefix of the text is known. Truncation to a budget and
budget questions read the table and never encode anything again.

Defined results: a null text is the empty text, with 0 tokens; null and repeated doc_ids stay as
rows of their own; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from itertools import accumulate

import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import Memo, map_rows, one_per_worker, table
from lectern.llm.prefix_bpe import PrefixTable, Vocabulary

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
MARK = "▁"
RUNS = re.compile(r" +[^ ]*")


class PieceCounts:
    def __init__(self, path: str | None = None):
        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        # Scores fall by one from piece to piece, so their negatives are the merge ranks.
        ranks = {
            model.id_to_piece(i): int(-model.get_score(i))
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))
        }
        if any(re.search(rf"[^{MARK}]{MARK}", piece) for piece in ranks):
            raise ValueError("a piece crosses the start of a word")
        # Tables work on texts with spaces; the mark itself counts as one.
        self.vocabulary = Vocabulary({piece.replace(MARK, " "): rank for piece, rank in ranks.items()})
        self.words = Memo(self.vocabulary.count, 1_000_000)

    def split(self, text: str) -> list[str]:
        """The words with their leading spaces; the first space is the one that the library adds."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if "  " not in text and text[-1] != " " and text[0] != " ":
            return [" " + w for w in text.split(" ")]
        return RUNS.findall(" " + text)

    def count(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.split(text)))

    def prefix_counts(self, text: str) -> list[int]:
        """The token count of ``text[:i]`` for every i; the library's count of each prefix."""
        found, before = [0], 0
        for at, word in enumerate(self.split(text)):
            counts = PrefixTable(self.vocabulary, word).count
            found += [before + c for c in counts[2 if at == 0 else 1 :]]
            before += counts[-1]
        return found

    def fit(self, text: str, limit: int) -> int:
        """Length of the longest prefix that has at most ``limit`` tokens."""
        words = self.split(text)
        totals = list(accumulate(map(self.words.__getitem__, words), initial=0))
        if totals[-1] <= limit:
            return len(text)
        # The count of a prefix may fall as a word grows, so later words count while their start fits.
        at, end = max(k for k, total in enumerate(totals[:-1]) if total <= limit), 0
        start = sum(map(len, words[:at])) - 1
        counts = PrefixTable(self.vocabulary, words[at]).count
        end = max(k for k, c in enumerate(counts) if totals[at] + c <= limit)
        return max(0, start + end)


def piece_counts(path: str | None = None) -> PieceCounts:
    return one_per_worker(("piece_counts", path), lambda: PieceCounts(path))


def count_tokens(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and fit_chars: code points of the longest prefix within the limit."""

    def make():
        counter = piece_counts(path)

        def rows(batch):
            for doc_id, text in batch:
                text = text or ""
                n = counter.count(text)
                yield doc_id, len(text.encode()), n, n > limit, counter.fit(text, limit) if n > limit else len(text)

        return rows

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long", make)


def prefix_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, counts: the token count of every prefix, by its number of code points.

    ``counts[i]`` answers "how many tokens has the prefix of i"; the largest i with
    ``counts[i] <= budget`` is the exact cut for a budget.
    """

    def make():
        counter = piece_counts(path)
        return lambda batch: ((doc_id, counter.prefix_counts(text or "")) for doc_id, text in batch)

    return map_rows(docs.select("doc_id", "text"), "doc_id long, counts array<int>", make)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
