"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A text falls into pieces by the tokenizer's pattern; each piece's prefix table (``prefix_bpe``)
gives its ids. ``EncodedText`` keeps the pieces of one text for exact appends and edits;
``encode_documents`` encodes a table in one pass without a shuffle.

Defined results: a null text is the empty text, which has no ids; null and repeated doc_ids stay
as rows of their own; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from bisect import bisect_right

import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import Memo, map_rows, one_per_worker, table
from lectern.llm.prefix_bpe import Vocabulary

RANKS = "byte_bpe_50k.tiktoken"
#: Unicode white space, as the pattern's \s means it.
SPACE = r"\t-\r \x85\xa0  -     　"
#: A single space between two other characters is a border that no piece and no look-ahead crosses.
BORDER = re.compile(rf"(?<=[^{SPACE}]) (?=[^{SPACE}])")

NOT_PLAIN = re.compile(rf" [{SPACE}]|[{SPACE}] |^ | $")


def _pattern() -> regex.Pattern:
    """The public pattern with \\s and \\S spelt out: the regex libraries differ on \\x1c-\\x1f."""
    return regex.compile(public_tokenizers.PATTERN.replace(r"^\s", f"^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))


class ByteBPE:
    def __init__(self, path: str | None = None):
        with open(path or public_tokenizers.path(RANKS), "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.vocabulary = Vocabulary(self.ranks)
        self.rank_of = list(self.ranks.values())
        self.pattern = _pattern()
        self.known = Memo(self._piece, 500_000)
        self.words = Memo(self._word, 500_000)

    def _piece(self, piece: str) -> bytes:
        ids = self.piece(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        return [self.rank_of[t] for t in self.vocabulary.encode(piece)]

    def pieces(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def _word(self, word: str) -> bytes:
        return b"".join([self.known[p] for p in self.pattern.findall(" " + word)])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        parts = BORDER.split(text) if NOT_PLAIN.search(text) else text.split(" ")
        first = b"".join([self.known[p] for p in self.pattern.findall(parts[0])])
        return first + b"".join(map(self.words.__getitem__, parts[1:]))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def byte_bpe(path: str | None = None) -> ByteBPE:
    return one_per_worker(("byte_bpe", path), lambda: ByteBPE(path))


class EncodedText:
    """One text's pieces and ids, for appends and edits that encode only what they touch."""

    #: Only pieces that reach into so many characters before an edit depend on it: a contraction looks at three.
    REACH = 4

    def __init__(self, bpe: ByteBPE, text: str = ""):
        self.bpe, self.text, self.starts, self.piece_ids, self.encoded = bpe, "", [], [], 0
        self.replace(0, 0, text)

    def ids(self) -> list[int]:
        return [i for ids in self.piece_ids for i in ids]

    def append(self, more: str) -> EncodedText:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> EncodedText:
        """Replace ``text[start:stop]``; ``encoded`` counts the pieces that were encoded for it."""
        first = max(0, bisect_right(self.starts, max(0, start - self.REACH)) - 1)
        shift = len(new) - (stop - start)
        text = self.text[:start] + new + self.text[stop:]
        at = self.starts[first] if self.starts else 0
        old = {s + shift: k for k, s in enumerate(self.starts) if s >= stop}
        starts, ids, self.encoded = self.starts[:first], self.piece_ids[:first], 0
        for match in self.bpe.pattern.finditer(text, at):
            if match.start() >= start + len(new) and match.start() in old:  # from here on all is as before
                k = old[match.start()]
                starts += [s + shift for s in self.starts[k:]]
                ids += self.piece_ids[k:]
                break
            starts.append(match.start())
            ids.append(self.bpe.piece(match[0].encode()))
            self.encoded += 1
        self.text, self.starts, self.piece_ids = text, starts, ids
        return self


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit) of every whole text."""

    def make():
        bpe = byte_bpe(path)

        def rows(batch):
            for doc_id, text in batch:
                ids = bpe.encode(text or "")
                yield doc_id, len(ids) // 4, ids

        return rows

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids binary", make)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode every text, decode its ids, and return digests of both."""

    def make():
        bpe = byte_bpe(path)

        def rows(batch):
            for doc_id, text in batch:
                packed = bpe.encode(text or "")
                n = len(packed) // 4
                decoded = bpe.decode(memoryview(packed).cast("I") if n else ())
                yield doc_id, n, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded).hexdigest()

        return rows

    return map_rows(docs.select("doc_id", "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
