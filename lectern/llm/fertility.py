"""Quality rules from tokenizer fertility.

Two public vocabularies, one of pieces with byte fallback and a byte-level one for many languages,
measure each text's words: characters per token, the share of tokens that are bytes of a character
not in the vocabulary, and the entropy of the text's tokens. Junk is cut into unusually short or
long tokens, falls back to bytes, or repeats few tokens. The bands in which a
text must lie are those of its language, or of its script where no language is given, and of its
length: the quartiles over all documents of the group whose numbers of words have as many binary
digits, widened by multiples of their distance. So the spread that a length has by chance is
measured, and long texts have narrow bands. Base rules on length and repetition come first.

Defined results: a null text has no words and fails the base rules; a null doc_id stays a row; a
null language is replaced by the script of the first letter; a length with fewer than ``MIN_GROUP``
documents that pass the base rules takes the bands of its whole group, a group with fewer the wider
bands of all documents; repeated rows stay; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import unicodedata
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from lectern.llm.common import Memo, map_rows, one_per_worker, ship, stored, table

MODEL, RANKS = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Measures by the piece vocabulary, and the same by the byte-level one.
MEASURES, BYTE_LEVEL = ("chars_per_token", "fallback_share", "entropy"), "byte_level_"
#: Distances of the quartiles by which the bands go beyond them, below and above (None: no limit).
WIDTHS = {vocabulary + m: w for vocabulary in ("", BYTE_LEVEL) for m, w in zip(MEASURES, ((2.25, 2.25), (None, 4.0), (1.75, None)))}
#: The least that a band goes beyond the quartiles; for texts longer than ``STEADY_WORDS`` it falls with the root.
LEAST = {vocabulary + m: w for vocabulary in ("", BYTE_LEVEL) for m, w in zip(MEASURES, (0.1, 0.1, 0.4))}
#: Shorter texts vary more by chance: where their length has no bands, those of the group widen with the root of this over their words.
STEADY_WORDS = 300
#: Documents of a group that has bands of its own, and how much wider the bands of all documents are for the others.
MIN_GROUP, WIDER = 10, 3.0

FEATURES = (
    "doc_id long, grp string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, " + ", ".join(f"{m} double" for m in WIDTHS)
)


def repeat_words(ids: np.ndarray) -> int:
    """Words that lie in a window of three which occurs twice or more; ``ids`` numbers the words from 0."""
    if len(ids) < 3:
        return 0
    kinds = int(ids.max()) + 1
    pairs = ids[:-2] * kinds + ids[1:-1]
    if kinds >= 1 << 20:  # three numbers would not fit into 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        kinds = max(kinds, 1)
    _, which, n = np.unique(pairs * kinds + ids[2:], return_inverse=True, return_counts=True)
    again = n[which] > 1
    inside = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        inside[shift : shift + len(again)] |= again
    return int(inside.sum())


def duplicate_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            if line in seen:
                n += 1
            seen.add(line)
    return n


class Fertility:
    def __init__(self, path: str | None = None, ranks_path: str | None = None):
        model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(MODEL))
        with open(ranks_path or public_tokenizers.path(RANKS), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.n_pieces = n = model.get_piece_size()  # both vocabularies' ids stand in one row of numbers
        self.is_byte = np.zeros(n + max(ranks.values()) + 1, dtype=bool)
        self.is_byte[:n] = [model.is_byte(i) for i in range(n)]
        # Of a byte-level vocabulary, these are the tokens that are one byte of a longer character.
        self.is_byte[[n + rank for token, rank in ranks.items() if len(token) == 1 and token > b"\x7f"]] = True

        def tokens(word: bytes) -> bytes:
            text = word.decode()  # as it stands behind a space
            ids = model.encode(text)
            ids += [n + rank for rank in encode(" " + text)]
            return array("I", ids).tobytes()

        self.tokens = Memo(tokens, 300_000)

    def measure(self, text: str) -> tuple:
        """The numbers of ``FEATURES`` from n_words on."""
        words = text.encode().split()  # bytes: splits at exactly the contract's white space
        n = len(words)
        word_chars = len(text) - sum(map(text.count, SPACES))
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
        repeats = repeat_words(ids)
        base = (n, word_chars, sum(map(text.count, SYMBOLS)), duplicate_lines(text), repeats)
        failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
        if not n:
            return *base, failed, *[0.0] * len(WIDTHS)
        tokens = [self.tokens[w] for w in number]
        times = np.repeat(np.bincount(ids), np.fromiter(map(len, tokens), np.int64, len(tokens)) // 4)
        counts = np.bincount(np.frombuffer(b"".join(tokens), dtype="I"), weights=times)
        kinds = np.nonzero(counts)[0]
        at = np.searchsorted(kinds, self.n_pieces)
        return *base, failed, *self.shape(counts, kinds[:at], word_chars), *self.shape(counts, kinds[at:], word_chars)

    def shape(self, counts: np.ndarray, kinds: np.ndarray, word_chars: int) -> tuple[float, float, float]:
        """The ``MEASURES`` of a text by the vocabulary whose tokens ``kinds`` are."""
        counts = counts[kinds]
        share = counts / (total := max(1.0, counts.sum()))  # some signs are no tokens at all
        return round(word_chars / total, 3), round(float(share[self.is_byte[kinds]].sum()), 3), round(float(-(share * np.log2(share)).sum()), 3)


def fertility(path: str | None = None, ranks_path: str | None = None) -> Fertility:
    return one_per_worker(("fertility", path, ranks_path), lambda: Fertility(path, ranks_path))


def script(text: str) -> str:
    letter = next((c for c in text if c.isalpha()), "")
    return unicodedata.name(letter, "unknown").split()[0].lower() if letter else "none"


def measurer(path: str | None = None, ranks_path: str | None = None):
    """A generator of the features of (doc_id, text, lang) rows."""
    measure = fertility(path, ranks_path).measure

    def rows(batch):
        for doc_id, text, lang in batch:
            text = text or ""
            yield doc_id, lang if lang is not None else f"script:{script(text)}", *measure(text)

    return rows


def features(docs: DataFrame, path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    return map_rows(docs.select("doc_id", "text", "lang"), FEATURES, lambda: measurer(path, ranks_path))


def size_class():
    """Documents whose numbers of words have as many binary digits are of a class."""
    return F.length(F.bin("n_words"))


def bands(measured: DataFrame) -> DataFrame:
    """Quartiles of each measure per group and length class, per group, and (both null) of all documents.

    The measures have three decimals, so exact quartiles need a bounded number of counts.
    """
    quartiles = [F.struct(F.percentile(m, 0.25).alias("low"), F.percentile(m, 0.75).alias("high")).alias(m) for m in WIDTHS]
    passed = measured.where("not base_failed").withColumn("size", size_class())
    enough = (F.col("n") >= MIN_GROUP) & F.col("grp").isNotNull()
    columns = ["grp", "size", *WIDTHS, "scale"]
    sized = passed.groupBy("grp", "size").agg(*quartiles, F.count("*").alias("n")).where(enough).withColumn("scale", F.lit(1.0))
    found = passed.groupBy("grp").agg(*quartiles, F.count("*").alias("n")).where(enough).withColumn("scale", F.lit(1.0)).withColumn("size", F.lit(None).cast("int"))
    whole = passed.agg(*quartiles).withColumn("grp", F.lit(None).cast("string")).withColumn("size", F.lit(None).cast("int")).withColumn("scale", F.lit(WIDER))
    return sized.select(columns).unionByName(found.select(columns)).unionByName(whole)


def within(name: str, band, scale, least):
    """True if a measure lies in its band."""
    below, above = WIDTHS[name]
    low, high = band[name]["low"], band[name]["high"]
    reach = lambda width: scale * F.greatest((high - low) * width, least * LEAST[name])
    inside = F.lit(True)
    if below is not None:
        inside &= F.col(name) >= low - reach(below)
    if above is not None:
        inside &= F.col(name) <= high + reach(above)
    return inside


def judged(measured: DataFrame) -> DataFrame:
    """``measured`` with ``kept``: base rules passed and all measures within the bands."""
    limits = stored(bands(measured), "bands")
    sized = limits.where("size is not null").select("grp", "size", F.struct(*WIDTHS, "scale").alias("sized"))
    own = limits.where("grp is not null and size is null").select("grp", F.struct(*WIDTHS, "scale").alias("own"))
    rows = measured.withColumn("size", size_class()).join(sized, ["grp", "size"], "left").join(own, "grp", "left")
    found = limits.where("grp is null").first()  # the bands of all documents: one row of a few numbers
    quartile = lambda m, end: F.lit(found[m][end]).cast("double").alias(end)
    whole = F.struct(*[F.struct(quartile(m, "low"), quartile(m, "high")).alias(m) for m in WIDTHS], F.lit(found["scale"]).alias("scale"))
    band, inside = F.coalesce("sized", "own", whole), ~F.col("base_failed")
    steady = F.sqrt(STEADY_WORDS / F.greatest("n_words", F.lit(1)))
    scale = band["scale"] * F.when(F.col("sized").isNotNull(), 1.0).otherwise(F.greatest(F.lit(1.0), steady))
    for name in WIDTHS:
        inside &= within(name, band, scale, F.least(F.lit(1.0), steady))
    return rows.select(*measured.columns, F.coalesce(inside, F.lit(False)).alias("kept"))


def judge(docs: DataFrame, path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """The features of every document, and ``kept``."""
    return judged(stored(features(docs, path, ranks_path), "features")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", *WIDTHS,
    )


def keep(docs: DataFrame, path: str | None = None, ranks_path: str | None = None) -> DataFrame:
    """The rows of ``docs`` that pass, each judged by its own text whatever its doc_id."""
    ship(docs.sparkSession)
    kinds = _parse_datatype_string(FEATURES)
    target = to_arrow_schema(kinds)

    def run(batches):
        measure = measurer(path, ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = [part.column(part.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text", "lang")]
                values = [pa.array(v, type=f.type) for v, f in zip(zip(*measure(zip(*columns))), target)]
                row = pa.StructArray.from_arrays(part.columns, fields=list(part.schema))
                yield pa.RecordBatch.from_arrays([row, *values], names=["row", *target.names])

    schema = StructType([StructField("row", docs.schema), *kinds.fields])
    # Rows are written once with their features: nothing meets again by doc_id, and no text is shuffled.
    measured = stored(docs.mapInArrow(run, schema), "measured-rows")
    return judged(measured).where("kept").select("row.*")


def op1_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
