"""Token-ID files with a shared zstandard dictionary.

Every document's ids are serialized as little-endian unsigned 32-bit integers and compressed on
their own, with a dictionary trained on serialized id arrays of a bounded sample (``SAMPLE_DOCUMENTS``). A file holds
segments; a segment has the compressed documents one after the other, the offset index of its
documents, and the dictionary's hash. One short document is read by its segment and its offset,
without its neighbours. Spark writes the segments as rows of a Parquet table, in ascending
doc_id order, so a lost executor's segments are written again and none is left half-written;
the dictionary is a table of one row beside them.

A sample too small to train on is the dictionary itself, as raw content.

Defined results: a null text is the empty text and has the end id only; null doc_ids come first;
rows that share a doc_id are ordered by a hash of their text, then by the text; so any number of
rows with one doc_id is dealt to many tasks; other columns are ignored; an empty table
gives files without documents.
"""

from __future__ import annotations

import hashlib
import re
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm.common import Memo, lowest, map_rows, new_path, one_per_worker, ship, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Documents whose ids train the dictionary, ids of each that are used, and the dictionary's bytes.
SAMPLE_DOCUMENTS, SAMPLE_IDS, DICTIONARY_BYTES = 1000, 4096, 65536
SEGMENT_BYTES = 4 << 20
#: Bytes of text that one task sorts and encodes, about.
PARTITION_BYTES = 32 << 20
LEVEL = 3

#: White space by Unicode, at which the tokenizer's normalizer and splitter always part a text;
#: Python's \s has \x1c-\x1f besides.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
#: The tokenizer's own splitting pattern, and the character that stands for each byte.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Signs in ASCII: a run of them behind letters is one piece.
SIGNS = string.punctuation
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_HIDDEN = [b for b in range(256) if b not in _SHOWN]
BYTE_CHARS = [chr(b) if b in _SHOWN else chr(256 + _HIDDEN.index(b)) for b in range(256)]
SEGMENTS = "partition int, segment int, dictionary string, first_doc long, last_doc long, documents binary, payload binary"
#: Of the offset index, a document's entry.
ENTRY = np.dtype([("doc_id", "<i8"), ("has_id", "?"), ("offset", "<u8"), ("size", "<u4"), ("ids", "<u4")])


class WordIds:
    """The library's ids of a text, put together from the library's ids of its words.

    No token and no special string crosses white space, so a text's ids are its words' ids one after
    the other. Of words in Latin letters the splitter's pieces are known beforehand, and each piece's
    ids come from the library's model; all other words go through the whole library.
    """

    def __init__(self, path: str | None = None):
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path(TOKENIZER))
        self.model = self.tokenizer.model
        self.pieces = Memo(self._piece, 100_000)
        self.words = Memo(self._word, 800_000)

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() and piece.isprintable()):  # such characters stand for themselves
            piece = "".join([BYTE_CHARS[b] for b in piece.encode()])
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        # Below U+0250 nothing composes, and lowering does not look at the neighbours.
        if max(word) < "\u0250" and "<|" not in word:
            low = word.lower()
            letters = low.rstrip(SIGNS)
            if letters.isalpha():  # most words are a piece of letters, and perhaps one of signs
                if letters == word:
                    return self._piece(word)
                return self.words[letters] + self.pieces[low[len(letters) :]] if len(letters) < len(low) else self.words[letters]
            return b"".join([self.pieces[p] for p in PIECES.findall(low)])
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        words = text.split() if ODD_SPACE.search(text) is None else filter(None, SPACE.split(text))
        return b"".join(map(self.words.__getitem__, words))


def word_ids(path: str | None = None) -> WordIds:
    return one_per_worker(("word_ids", path), lambda: WordIds(path))


def train(docs: DataFrame, path: str | None = None) -> bytes:
    """The dictionary, from the documents whose ids' hashes are lowest; raw ids if they are too few to train on, empty without any."""
    sample = lowest(docs.select("doc_id", "text"), SAMPLE_DOCUMENTS, "doc_id", "text")

    def make():
        ids = word_ids(path)
        return lambda batch: ((ids.encode(text or "")[: 4 * SAMPLE_IDS],) for _, text in batch)

    samples = [bytes(r[0]) for r in map_rows(sample, "ids binary", make).collect()]
    if sum(map(len, samples)) < 20 * DICTIONARY_BYTES // 8 or len(samples) < 50:
        return b"".join(samples)[:DICTIONARY_BYTES]
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(raw) if raw else None


def write(docs: DataFrame, folder: str, partitions: int = 1, path: str | None = None) -> None:
    """Encode ``docs`` and write the segments and the dictionary under ``folder``, in at least ``partitions`` files."""
    spark = docs.sparkSession
    ship(spark)
    raw = train(docs, path)
    name = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(name, raw)], "hash string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    shared = spark.sparkContext.broadcast(raw)  # at most DICTIONARY_BYTES

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = word_ids(path), np.array([END_ID], dtype="<u4").tobytes()
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(shared.value), write_content_size=True).compress
        partition, number, entries, frames, size = TaskContext.get().partitionId(), 0, [], [], 0

        def row():
            documents = np.array(entries, dtype=ENTRY)
            known = documents["doc_id"][documents["has_id"]]
            bounds = [int(known[0]), int(known[-1])] if len(known) else [None, None]
            return pa.RecordBatch.from_pylist(
                [dict(zip(target.names, (partition, number, name, *bounds, documents.tobytes(), b"".join(frames))))], schema=target
            )

        for batch in batches:
            texts = batch.column(1)
            for at, doc_id in enumerate(batch.column(0).to_pylist()):
                packed = ids.encode(texts[at].as_py() or "") + end
                frame = compress(packed)
                entries.append((doc_id or 0, doc_id is not None, size, len(frame), len(packed) // 4))
                frames.append(frame)
                size += len(frame)
                if size >= SEGMENT_BYTES:
                    yield row()
                    number, entries, frames, size = number + 1, [], [], 0
        if entries:
            yield row()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(SEGMENTS))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(partitions, -(-size // PARTITION_BYTES))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("nth"))
    first = F.col("doc_id").asc_nulls_first()
    # By the hash, rows of one doc_id are split between tasks, and by their places, rows that are equal in all.
    ordered = rows.repartitionByRange(partitions, first, "hash", "nth").sortWithinPartitions(first, "hash", "text").select("doc_id", "text")
    ordered.mapInArrow(segments, SEGMENTS).write.option("compression", "none").parquet(f"{folder}/segments")


def _entries(documents: bytes) -> np.ndarray:
    return np.frombuffer(documents, dtype=ENTRY)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """partition, segment, nth, doc_id, n_tokens, ids (binary) of every document of the files."""
    ship(spark)
    raw = bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])
    name, shared = hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)

    def make():
        decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value)).decompress

        def rows(batch):
            for partition, segment, dictionary, documents, payload in batch:
                if dictionary != name:
                    raise ValueError("a segment was written with another dictionary")
                view = memoryview(payload)
                for nth, (doc_id, known, offset, size, n) in enumerate(_entries(documents).tolist()):
                    yield partition, segment, nth, doc_id if known else None, n, decompress(view[offset : offset + size])

        return rows

    found = spark.read.parquet(f"{folder}/segments").select("partition", "segment", "dictionary", "documents", "payload")
    return map_rows(found, "partition int, segment int, nth int, doc_id long, n_tokens long, ids binary", make)


def read_one(spark: SparkSession, folder: str, doc_id: int) -> list[np.ndarray]:
    """The ids of one document (of each row that has the doc_id): its segment's frame alone is decompressed."""
    raw = bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])
    decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(raw)).decompress
    near = spark.read.parquet(f"{folder}/segments").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    found = []
    for row in near.orderBy("partition", "segment").select("documents", "payload").collect():
        for e in (e for e in _entries(row["documents"]) if e["has_id"] and e["doc_id"] == doc_id):
            found.append(np.frombuffer(decompress(memoryview(row["payload"])[e["offset"] : e["offset"] + e["size"]]), dtype="<u4"))
    return found


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    ``start`` adds the sums of the partitions, of the segments of a partition before it, both
    windows over one row per partition or segment, and the counts within the segment.
    """
    ship(spark)
    raw = bytes(spark.read.parquet(f"{folder}/dictionary").first()["dictionary"])
    name, shared = hashlib.sha256(raw).hexdigest(), spark.sparkContext.broadcast(raw)

    def make_sums():
        return lambda batch: ((p, s, int(_entries(d)["ids"].sum(dtype=np.int64))) for p, s, d in batch)

    def make():
        decompress = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value)).decompress

        def rows(batch):
            for partition, segment, dictionary, documents, payload in batch:
                if dictionary != name:
                    raise ValueError("a segment was written with another dictionary")
                view, inside = memoryview(payload), 0
                for doc_id, known, offset, size, n in _entries(documents).tolist():
                    ids = decompress(view[offset : offset + size])
                    if len(ids) != 4 * n:
                        raise ValueError("a document's length differs from its index")
                    yield partition, segment, doc_id if known else None, inside, n, zlib.crc32(ids)
                    inside += n

        return rows

    segments = spark.read.parquet(f"{folder}/segments")
    sums = map_rows(segments.select("partition", "segment", "documents"), "partition int, segment int, n long", make_sums)
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("partition").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.groupBy("partition").agg(F.sum("n").alias("n")).select("partition", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    starts = sums.withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0))).join(parts, "partition")
    starts = starts.select("partition", "segment", (F.col("earlier") + F.col("inside")).alias("first"))
    found = map_rows(
        segments.select("partition", "segment", "dictionary", "documents", "payload"),
        "partition int, segment int, doc_id long, inside long, n_tokens long, ids_crc32 long",
        make,
    )
    return found.join(starts, ["partition", "segment"]).select(
        "doc_id", (F.col("first") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), folder, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return digests(spark, folder)
