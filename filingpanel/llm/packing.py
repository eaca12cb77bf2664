"""Token sequences of fixed capacity, filled by sum-of-squares packing."""

from __future__ import annotations

import hashlib
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import as_bytes, id_text, shipped, slices, staged

CAPACITY, END_ID, GROUP_PIECES, MAX_CACHED = 4096, 1, 4096, 1_000_000
END_MARKS = b".,;:!?#$%&*+-=()[]{}/\"^_~"  # no apostrophe (contractions), nothing of the special tokens' <|>
EASY_CASE = re.compile("[\x00-\u012f\u0131-\u0148]*").fullmatch  # letters whose case does not depend on context
# Byte-level vocabularies write the bytes that Latin-1 does not print as the characters from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARACTERS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_TOKENIZERS: dict[str, "WordCache"] = {}


class WordCache(dict):
    """White-space separated word (bytes) -> its ids as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins across it, so the ids of a text are the ids of its words in
    order. A word is encoded when it is first met by a worker; the cache starts anew when it is full. Most words
    are one run of lower-case letters, perhaps with end punctuation, for which the vocabulary's merges are called
    directly; all others go through the whole tokenizer.
    """

    def __init__(self, vocabulary: bytes):
        super().__init__()
        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.merges = self.tokenizer.model.tokenize

    def __missing__(self, word: bytes) -> bytes:
        ids = self._ids(word)
        if len(self) >= MAX_CACHED:
            self.clear()
        self[word] = ids
        return ids

    def _ids(self, word: bytes) -> bytes:
        core = word.rstrip(END_MARKS)
        text = core.decode()
        if core != word and text[-1:].isalpha():  # letter runs and other runs are split anyway
            return self[core] + self[word[len(core):]]
        text = text if core == word else word.decode()
        low = text.lower() if EASY_CASE(text) else text  # the tokenizer lower-cases all text
        if low != text:
            return self[low.encode()]
        if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
            ids = [t.id for t in self.merges(word.decode("latin-1").translate(BYTE_CHARACTERS))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


def _cache(vocabulary: Broadcast) -> WordCache:
    data = vocabulary.value
    key = hashlib.sha256(data).hexdigest()
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = WordCache(data)
    return _TOKENIZERS[key]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of the documents: ``doc_id, piece, start, length, ids_crc32, ids`` (ids as packed 32-bit integers).

    Each document is its ids plus ``end_id``, cut after every ``capacity`` ids. Null and empty texts give one piece
    with the end id alone. Repeated rows give pieces of their own. Nothing is shuffled.
    """
    words_of = shipped(docs.sparkSession, vocabulary)
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(words_of)
        for batch in slices(batches, "text", 4 << 20):
            words = [t.split() for t in as_bytes(batch.column("text"))]
            owner, piece, length, crc, ids = [], [], [], [], []
            for i, w in enumerate(words):
                data = b"".join(map(cache.__getitem__, w)) + tail
                for n, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at:at + 4 * capacity]
                    owner.append(i), piece.append(n), length.append(len(part) // 4)
                    crc.append(zlib.crc32(part)), ids.append(part)
            piece = pa.array(piece, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int32())), piece,
                 pc.multiply(piece.cast(pa.int64()), capacity), pa.array(length, pa.int64()),
                 pa.array(crc, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    df = id_text(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ids binary")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset for each length, in the given order.

    Among the open bins that can take the piece, it goes where the sum over all gaps of (open bins with that
    gap)^2 becomes smallest; equal sums prefer the smaller gap. A bin is opened only when none can take it.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    bins, offsets, opened = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        gaps = np.flatnonzero(count[s:]) + s
        if gaps.size:
            after = np.where(gaps > s, 2 * count[gaps - s] + 1, 0)
            gap = int(gaps[np.argmin(after - 2 * count[gaps] + 1)])
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b = capacity, opened
            opened += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``doc_id, piece, start, length, ids_crc32``.

    The pieces are dealt by a hash into groups of about ``group_pieces``, however many there are, so each group is
    bounded and has the mixture of lengths of the whole; a group is packed by itself, longest pieces first. The place of a
    row in ``pieces``, a stored table, is part of the hash, so equal rows spread over the groups, too.
    """
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    small = pieces.select(*columns)
    groups = max(1, -(-small.count() // group_pieces))
    small = small.withColumn("_group", F.pmod(F.xxhash64(*columns, F.monotonically_increasing_id()), F.lit(groups)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        bins, offsets = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(pdf["_group"].to_numpy(np.int64) << 40) + bins, offset=offsets).drop(columns="_group")

    kind = small.schema["doc_id"].dataType.simpleString()
    return small.groupBy("_group").applyInPandas(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Tokenise, cut and pack. An empty table gives an empty result; null ids pass through."""
    pieces = token_pieces(docs, vocabulary, capacity, id_col=id_col, text_col=text_col).drop("ids")
    return pack(staged(pieces, "token-pieces"), capacity)
