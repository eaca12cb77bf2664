"""Byte-level BPE encoding and decoding with recursive DuckDB queries inside the tasks."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import id_text, shipped, slices

MAX_CACHED = 1_000_000  # words or pieces kept per worker
SHORT_PIECE = 64  # bytes; longer pieces take the query whose state is one row per position
SLICE_BYTES, MEMORY = 3 << 20, "400MB"
_CODECS: dict[str, "Codec"] = {}

# White space that the fast path understands: single spaces inside a line, single line breaks between lines.
OTHER_SPACE = re.compile(r"[^\S \n]")
DOUBLE_SPACES = ("  ", " \n", "\n ", "\n\n")

# One contraction per piece and step: the leftmost pair of minimum rank. Token positions are unnested and join the
# merge table; a piece without a pair that can merge leaves the recursion.
SHORT_SQL = """
WITH RECURSIVE bpe AS (
  SELECT piece, list(token ORDER BY pos) AS tokens, 0 AS step FROM start GROUP BY piece
  UNION ALL
  (WITH positions AS (SELECT piece, unnest(tokens[:-2]) AS token, unnest(tokens[2:]) AS next_token,
                             unnest(range(1, len(tokens))) AS i FROM bpe),
        best AS (SELECT piece, min(m.rank * 4294967296::BIGINT + i) AS found
                 FROM positions JOIN merges m ON m.pair = token::BIGINT * 16777216 + next_token GROUP BY piece)
   SELECT piece, tokens[:(found & 4294967295) - 1] || [(found >> 32)::INTEGER] || tokens[(found & 4294967295) + 2:], step + 1
   FROM bpe JOIN best USING (piece))
)
SELECT piece, arg_max(tokens, step) AS tokens FROM bpe GROUP BY piece ORDER BY piece
"""

# The same for long pieces. Only the present row of a position is kept (null: contracted away). All occurrences of the
# minimum rank that do not overlap are contracted at once if no pair with the new token has a lower rank ("safe"), which
# is what one leftmost contraction after the other gives; otherwise the leftmost alone.
LONG_SQL = """
WITH RECURSIVE bpe(piece, pos, token) USING KEY (piece, pos) AS (
  SELECT piece, pos, token FROM start
  UNION
  (WITH pairs AS (SELECT piece, pos, token, lead(token) OVER w AS next_token, lead(pos) OVER w AS next_pos
                  FROM recurring.bpe WHERE token IS NOT NULL WINDOW w AS (PARTITION BY piece ORDER BY pos)),
        ranked AS (SELECT piece, pos, next_pos, m.rank, m.safe FROM pairs p
                   JOIN merges m ON m.pair = p.token::BIGINT * 16777216 + p.next_token),
        least AS (SELECT *, min(rank) OVER (PARTITION BY piece) AS lowest FROM ranked),
        hits AS (SELECT *, row_number() OVER w AS number, lag(next_pos) OVER w AS before FROM least WHERE rank = lowest
                 WINDOW w AS (PARTITION BY piece ORDER BY pos)),
        runs AS (SELECT *, count(*) FILTER (before IS DISTINCT FROM pos) OVER (PARTITION BY piece ORDER BY pos) AS run FROM hits),
        odd AS (SELECT *, row_number() OVER (PARTITION BY piece, run ORDER BY pos) AS k FROM runs),
        chosen AS (SELECT * FROM odd WHERE k % 2 = 1 AND (safe OR number = 1))
   SELECT piece, pos, rank FROM chosen UNION ALL SELECT piece, next_pos, NULL FROM chosen)
)
SELECT piece, list(token ORDER BY pos) AS tokens FROM bpe WHERE token IS NOT NULL GROUP BY piece ORDER BY piece
"""

DECODE_SQL = "SELECT doc, string_agg(bytes, '' ORDER BY pos) AS bytes FROM ids JOIN vocabulary USING (token) GROUP BY doc ORDER BY doc"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and rank of each line of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class Codec:
    """Encoder and decoder of one vocabulary; one per Python worker.

    Words (runs between single spaces) and pattern pieces that were met before are looked up; both caches start anew
    when they are full, so memory is bounded whatever the text.
    """

    def __init__(self, vocabulary: bytes, pattern: str):
        self.ranks = read_ranks(vocabulary)
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.pieces: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}  # words without, and with, a space before them
        self.spaced: dict[str, bytes] = {}
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        self._load()

    def _load(self) -> None:
        left, right, rank = [], [], []
        for token, r in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        left, right, rank = (np.array(x, np.int64) for x in (left, right, rank))
        unsafe = np.unique(np.concatenate([left[rank < left], right[rank < right]]))
        merges = pa.table({"pair": left << 24 | right, "rank": rank.astype(np.int32), "safe": ~np.isin(rank, unsafe)})
        vocabulary = pa.table({"token": pa.array(list(self.ranks.values()), pa.int32()),
                               "bytes": [t.decode("latin-1") for t in self.ranks]})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("loaded", table)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM loaded")
            self.db.unregister("loaded")

    def _merge(self, pieces: list[bytes], sql: str) -> Iterator[bytes]:
        """Ids of the pieces, packed, in their order."""
        for at in range(0, len(pieces), 1 << 15):
            part = pieces[at:at + (1 << 15)]
            data = np.frombuffer(b"".join(part), np.uint8)
            size = np.fromiter(map(len, part), np.int64, len(part))
            pos = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
            start = pa.table({"piece": np.repeat(np.arange(len(part), dtype=np.int32), size), "pos": pos.astype(np.int32),
                              "token": self.byte_ids[data]})
            self.db.register("start", start)
            tokens = self.db.sql(sql).to_arrow_table().column("tokens").combine_chunks()
            self.db.unregister("start")
            flat = tokens.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes()
            ends = (np.asarray(tokens.offsets) * 4).tolist()
            first = ends[0]
            yield from (flat[a - first:b - first] for a, b in zip(ends, ends[1:]))

    def _learn_pieces(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.pieces]
        if len(self.pieces) + len(new) > MAX_CACHED:
            self.pieces.clear()
            new = list(pieces)
        short, long = [], []
        for p in new:
            data = p.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                self.pieces[p] = np.array([whole], "<u4").tobytes()
            else:
                (short if len(data) <= SHORT_PIECE else long).append((p, data))
        for group, sql in ((short, SHORT_SQL), (long, LONG_SQL)):
            if group:
                self.pieces.update(zip((p for p, _ in group), self._merge([d for _, d in group], sql)))

    def _split(self, text: str) -> tuple[list[str], list[str]] | None:
        """Words at the start of a line, and words after a space; None if the white space is unusual."""
        if not text or text[0] in " \n" or text[-1] in " \n" or any(s in text for s in DOUBLE_SPACES) or OTHER_SPACE.search(text):
            return None
        return [line.split(" ") for line in text.split("\n")]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, each match of the pattern for itself."""
        if len(self.plain) + len(self.spaced) > MAX_CACHED:
            self.plain.clear(), self.spaced.clear()
        split = [self._split(t) for t in texts]
        plain, spaced = {"\n"}, set()
        for lines in split:
            for words in lines or ():
                plain.add(words[0])
                spaced.update(words[1:])
        find = self.pattern.findall
        plain_new = {w: find(w) for w in plain if w not in self.plain}
        spaced_new = {w: find(" " + w) for w in spaced if w not in self.spaced}
        other = [find(t) if lines is None else None for t, lines in zip(texts, split)]
        self._learn_pieces({p for found in (plain_new.values(), spaced_new.values(), filter(None, other)) for ps in found for p in ps})
        ids = self.pieces.__getitem__
        for cache, new in ((self.plain, plain_new), (self.spaced, spaced_new)):
            for w, ps in new.items():
                cache[w] = b"".join(map(ids, ps))
        out, at_start, after_space, end_of_line = [], self.plain, self.spaced.__getitem__, self.plain["\n"]
        for lines, ps in zip(split, other):
            if lines is None:
                out.append(b"".join(map(ids, ps)))
            else:
                out.append(end_of_line.join([at_start[w[0]] + b"".join(map(after_space, w[1:])) for w in lines]))
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each packed id list: positions join the vocabulary, an ordered aggregate puts them together."""
        size = np.array([len(i) // 4 for i in ids], np.int64)
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
        if len(flat) and (flat.min() < 0 or flat.max() > max(self.ranks.values())):
            raise ValueError("an id is not in the vocabulary")
        self.db.register("ids", pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), size),
                                          "pos": np.arange(len(flat), dtype=np.int32), "token": flat}))
        found = self.db.sql(DECODE_SQL).to_arrow_table()
        self.db.unregister("ids")
        out = [b""] * len(ids)
        for doc, text in zip(found.column("doc").to_pylist(), found.column("bytes").to_pylist()):
            out[doc] = text.encode("latin-1")
        return out


def _codec(vocabulary: Broadcast, pattern: str) -> Codec:
    data = vocabulary.value
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(data, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (packed little-endian unsigned 32-bit integers) per row, without special tokens.

    ``vocabulary``: path of a rank file on the driver; it reaches the tasks as a broadcast of checked size. Null text
    is empty and has no ids; null ids pass through; repeated rows are encoded each; nothing is shuffled.
    """
    sent = shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent, pattern)
        for batch in slices(batches, "text", SLICE_BYTES):
            ids = codec.encode(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    df = id_text(docs, id_col, text_col)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``doc_id, bytes`` from the rows of ``encode``; null ids are empty."""
    sent = shipped(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent, pattern)
        for batch in slices(batches, "ids", SLICE_BYTES):
            data = codec.decode([i or b"" for i in batch.column("ids").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "bytes"])

    df = encoded.select("doc_id", "ids")
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: ``encode`` and ``decode`` in one task, so that the ids,
    larger than the text, need not travel; rows as in ``encode``."""
    sent = shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent, pattern)
        for batch in slices(batches, "text", SLICE_BYTES):
            ids = codec.encode(batch.column("text").to_pylist())
            decoded = codec.decode(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()),
                 pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array([hashlib.sha256(d).hexdigest() for d in decoded])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    df = id_text(docs, id_col, text_col)
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
