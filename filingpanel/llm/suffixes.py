"""Repeated byte strings across a corpus, removed exactly, by a distributed merge sort of suffixes.

Every string of ``length`` bytes has one anchor: the place of the smallest hash among its ``gram``-byte substrings, so
equal strings have their anchor at the same offset. Only suffixes that start at anchors are looked at, and only those
whose gram occurs elsewhere: consecutive strings with one anchor share one *context* (the bytes they span).

1. Grams are counted. Where all contexts of a repeated gram are equal, all their strings repeat.
2. Other contexts are sorted: tasks make front-coded sorted runs of anchor suffixes, runs of a bucket are merged with
   a loser tree that knows the common prefixes, and the common prefixes to the right together with those to the left
   (bytes before the anchor, backwards) tell which offsets repeat.
3. The repeated strings are united per text and cut out.

Passages too short for ``length`` bytes are not removed; ``shared_prints`` tells by winnowing which texts have one.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, drop_staged, id_text, slices, staged

LENGTH, GRAM = 400, 100
PASSAGE_WORDS, PRINT_WORDS = 50, 30
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SLICE_BYTES = 2 << 20
BLOCK = 1 << 18  # string starts that are worked on together
RUN_BYTES, BUCKET_CONTEXTS, HOT_CONTEXTS, MATRIX = 4 << 20, 6_000, 20_000, 1 << 18
MULTIPLIER = 0x9E3779B97F4A7C15
_M64 = 1 << 64


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random odd number per byte value, and the powers of the multiplier and of its inverse modulo 2^64."""
    n = 2 * BLOCK + 4096
    values = np.random.default_rng(2024).integers(0, _M64, 256, np.uint64) | np.uint64(1)
    return values, _powers(MULTIPLIER, n), _powers(pow(MULTIPLIER, -1, _M64), n)


def _powers(base: int, n: int) -> np.ndarray:
    out, done = np.ones(n, np.uint64), 1
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * np.uint64(pow(base, done, _M64))
        done += more
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def anchor_runs(data: np.ndarray, sizes: list[int], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For texts laid end to end: anchor, first start, last start (places in ``data``) and gram hash of each run of
    consecutive starts with one anchor. No string crosses the end of its text."""
    ends = np.cumsum(sizes)
    starts = [np.arange(e - s, e - length + 1) for s, e in zip(sizes, ends.tolist()) if s >= length]
    if not starts:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    values, power, inverse = _tables()
    n, width = len(data), length - gram + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * power[:n], out=sums[1:])
    count = n - gram + 1
    grams = _mix((sums[gram:] - sums[:-gram]) * inverse[:count])
    key = grams >> np.uint64(24) << np.uint64(24) | np.arange(count, dtype=np.uint64)  # equal hashes: the leftmost
    blocks = np.append(key, np.full(-count % width, _M64 - 1, np.uint64)).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()[:count]
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:count]
    least = np.minimum(after[:count - width + 1], before[width - 1:])
    start = np.concatenate(starts)
    anchor = (least[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    return anchor[new], first, last, grams[anchor[new]]


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int]], bytes, list[int]]]:
    """Groups of texts or of overlapping parts of long texts: (text number, place of the part), bytes, sizes."""
    owners, parts, total = [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), BLOCK):
            part = t[at:at + BLOCK + length - 1]
            if total + len(part) > 2 * BLOCK and parts:
                yield owners, b"".join(parts), list(map(len, parts))
                owners, parts, total = [], [], 0
            owners.append((i, at)), parts.append(part)
            total += len(part)
    if parts:
        yield owners, b"".join(parts), list(map(len, parts))


def pack_code(anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return anchor << 20 | (anchor - first) << 10 | (last - first)


def unpack_code(code):
    """anchor, first start, last start"""
    anchor, back, more = code >> 20, code >> 10 & 1023, code & 1023
    return anchor, anchor - back, anchor - back + more


def _context_hash(data: bytes, code: int) -> int:
    """Of the spanned bytes and where the anchor and the last start lie in them."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=struct.pack("<I", code & 0xFFFFF)).digest(), "little", signed=True)


def anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """``doc_id, text_key, code, gram, context`` per anchor. A task gives a text twice at most, which is enough to
    know that all of it repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in slices(batches, "text", SLICE_BYTES):
            texts, keys, rows = [], [], []
            for i, t in enumerate(as_bytes(batch.column("text"))):
                k = hashlib.md5(t).digest()
                seen[k] += 1
                if len(t) >= length and seen[k] <= 2:
                    texts.append(t), keys.append(k), rows.append(i)
            for owners, data, sizes in _pieces(texts, length):
                anchor, first, last, grams = anchor_runs(np.frombuffer(data, np.uint8), sizes, length, gram)
                edges = np.cumsum(sizes)
                part = np.searchsorted(edges, first, side="right")
                offset = edges - sizes
                code = pack_code(anchor, first, last)
                context = [_context_hash(data[a:b + length], c) for a, b, c in zip(first.tolist(), last.tolist(), code.tolist())]
                owner, place = np.array([o for o, _ in owners]), np.array([p for _, p in owners])
                code += (place - offset)[part] << 20
                text = owner[part]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(np.array(rows)[text], pa.int64())) if len(text) else batch.column("doc_id").slice(0, 0),
                     pa.array([keys[i] for i in text.tolist()], pa.binary()), pa.array(code, pa.int64()),
                     pa.array(grams.view(np.int64)), pa.array(context, pa.int64())],
                    ["doc_id", "text_key", "code", "gram", "context"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_key binary, code long, gram long, context long")


def common_prefix(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix of two strings that agree up to ``at``; known bytes are not looked at again."""
    end, step = min(len(a), len(b)), 16
    while at < end:
        to = min(at + step, end)
        if a[at:to] == b[at:to]:
            at, step = to, 2 * step
        elif to - at == 1:
            return at
        else:
            step = (to - at) // 2
            end = to
    return end if at > end else at


def front_coded(entries: list[tuple[bytes, bytes]]) -> bytes:
    """A sorted run: of each string only what follows the common prefix with the one before."""
    out, before = [], b""
    for string, load in entries:
        same = common_prefix(before, string)
        out += [struct.pack("<III", same, len(string) - same, len(load)), string[same:], load]
        before = string
    return b"".join(out)


def read_run(data: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    """(string, common prefix with the one before, load)"""
    at, before = 0, b""
    while at < len(data):
        same, rest, more = struct.unpack_from("<III", data, at)
        at += 12
        before = before[:same] + data[at:at + rest]
        at += rest
        yield before, same, data[at:at + more]
        at += more


def merged(runs: list[Iterator[tuple[bytes, int, bytes]]]) -> Iterator[tuple[bytes, int, bytes]]:
    """The runs in one order, each string with the length of its common prefix with the one before.

    A loser tree: every player knows its common prefix with the last winner. The longer prefix wins without a look at
    the bytes; only equal prefixes are compared, from there on.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list = [next(r, None) for r in runs] + [None] * (size - len(runs))
    known = [0] * size  # common prefix of each head with the last string that was put out

    def contest(a: int, b: int) -> tuple[int, int]:
        """winner, loser"""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = heads[a][0], heads[b][0]
        same = common_prefix(x, y, known[a])
        if same == len(x) or same < len(y) and x[same] < y[same]:
            known[b] = same
            return a, b
        known[a] = same
        return b, a

    losers = [0] * size
    winners = [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = contest(winners[2 * node], winners[2 * node + 1])
    best = winners[1] if size > 1 else 0
    while heads[best] is not None:
        string, _, load = heads[best]
        yield string, known[best], load
        heads[best] = next(runs[best], None)
        known[best] = heads[best][1] if heads[best] else 0
        node = (best + size) // 2
        while node:
            best, losers[node] = contest(best, losers[node])
            node //= 2


def repeated_offsets(rights: list[bytes], lefts: list[bytes], right_common: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For contexts of one gram in the order of their right sides: the intervals of offsets (anchor minus start) at which
    the string of a context equals that of another one.

    Two strings at offset o are equal if the right sides share ``length - o`` bytes and the left sides o bytes. Classes of
    equal right (left) sides at a depth are runs in the right (left) order between common prefixes below that depth.
    """
    n = len(rights)
    low = np.array([length - len(r) for r in rights])
    high = np.array([len(x) for x in lefts])
    back = [x[::-1] for x in lefts]
    if n == 2:
        a, b = max(length - right_common[1], *low.tolist()), min(common_prefix(back[0], back[1]), *high.tolist())
        return [[(a, b)] if a <= b else []] * 2
    order = sorted(range(n), key=back.__getitem__)
    left_common = np.array([0] + [common_prefix(back[i], back[j]) for i, j in zip(order, order[1:])])
    right_common = np.array(right_common)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    found: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    width = max(1, MATRIX // n)
    for at in range(int(low.min()), int(high.max()) + 1, width):
        offsets = np.arange(at, min(at + width, int(high.max()) + 1))
        right = np.cumsum(right_common[:, None] < length - offsets, axis=0)
        left = np.cumsum(left_common[:, None] < offsets, axis=0)[rank]
        key = np.where((offsets >= low[:, None]) & (offsets <= high[:, None]), right * (n + 1) + left, -1 - np.arange(n)[:, None])
        by = np.argsort(key, axis=0, kind="stable")
        in_order = np.take_along_axis(key, by, axis=0)
        same = in_order[1:] == in_order[:-1]
        flag = np.zeros((n + 1, len(offsets)), bool)
        flag[1:n] |= same
        flag[:n - 1] |= same
        repeats = np.zeros((n, len(offsets)), bool)
        np.put_along_axis(repeats, by, flag[:n], axis=0)
        edge = np.diff(np.pad(repeats, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        for i in np.flatnonzero(repeats.any(axis=1)).tolist():
            for a, b in zip(np.flatnonzero(edge[i] == 1).tolist(), np.flatnonzero(edge[i] == -1).tolist()):
                if found[i] and found[i][-1][1] == at + a - 1:
                    found[i][-1] = (found[i][-1][0], at + b - 1)
                else:
                    found[i].append((at + a, at + b - 1))
    return found


def _extract(owned: DataFrame, length: int, buckets: int) -> DataFrame:
    """Front-coded sorted runs of context suffixes per bucket, and window hashes of the contexts of hot grams.

    Rows of ``owned``: text, contexts (code, gram, context, hot). Out: ``bucket, run`` or ``gram, context, o, w1, w2``.
    """
    schema = "bucket int, run binary, gram long, context long, o int, w1 long, w2 long"

    def runs(entries: list) -> pa.RecordBatch:
        by: dict[int, list] = {}
        for right, left, gram, context in entries:
            by.setdefault(gram % buckets, []).append((right, struct.pack("<qq", gram, context) + left))
        rows = [{"bucket": b, "run": front_coded(sorted(e))} for b, e in by.items()]
        entries.clear()
        return pa.RecordBatch.from_pylist(rows, schema=_schema(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, size = [], 0
        for batch in slices(batches, "text", SLICE_BYTES):
            for text, contexts in zip(as_bytes(batch.column("text")), batch.column("contexts").to_pylist()):
                for c in contexts:
                    anchor, first, last = unpack_code(c["code"])
                    if c["hot"]:
                        yield _windows(text, anchor, first, last, c["gram"], c["context"], length, schema)
                    else:
                        entries.append((text[anchor:last + length], text[first:anchor], c["gram"], c["context"]))
                        size += last + length - first
                if size >= RUN_BYTES:
                    yield runs(entries)
                    size = 0
        if entries:
            yield runs(entries)

    return owned.mapInArrow(run, schema)


def _windows(text: bytes, anchor: int, first: int, last: int, gram: int, context: int, length: int, schema: str) -> pa.RecordBatch:
    rows = []
    for start in range(first, last + 1):
        w1, w2 = struct.unpack("<qq", hashlib.blake2b(text[start:start + length], digest_size=16).digest())
        rows.append({"gram": gram, "context": context, "o": anchor - start, "w1": w1, "w2": w2})
    return pa.RecordBatch.from_pylist(rows, schema=_schema(schema))


def _schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in text.split(", "))])


def _resolve_bucket(length: int, gram: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        group: dict[int, tuple] = {}

        def close():
            if len(group) > 1:
                rights, lefts, commons, grams = map(list, zip(*group.values()))
                for (context, g), spans in zip(zip(group, grams), repeated_offsets(rights, lefts, commons, length)):
                    out.extend((g, context, a, b) for a, b in spans)
            group.clear()

        common = 0
        for string, same, load in merged([read_run(r) for r in pdf["run"]]):
            g, context = struct.unpack_from("<qq", load)
            common = min(common, same) if group else same
            if same < gram:
                close()
            if context not in group:  # an equal context came from a repeated row
                group[context] = (string, load[16:], common, g)
                common = length
        close()
        return pd.DataFrame(out, columns=["gram", "context", "o_from", "o_to"])

    return run


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS) -> DataFrame:
    """``text_key`` (MD5 of the text) and ``spans``: intervals (start, end) of bytes covered by a string of ``length``
    bytes that also starts elsewhere. Texts without such a string have no row.

    Columns of ``docs``: doc_id, text (not null). A gram with more than ``hot_contexts`` different contexts is not merged
    in one bucket: the strings of its contexts are counted by a 128-bit hash with partial sums instead.
    """
    found = staged(anchors(docs, length, gram), "anchors")
    grams = staged(
        found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
        .where("n > 1").select("gram", (F.col("a") != F.col("b")).alias("mixed")), "grams")
    again = staged(found.join(grams, "gram"), "repeated-anchors")
    drop_staged(found)
    contexts = staged(
        again.where("mixed").groupBy("gram", "context")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text_key", "doc_id", "code")).alias("at")), "contexts")
    hot = staged(contexts.groupBy("gram").count().where(F.col("count") > hot_contexts).select("gram", F.lit(True).alias("hot")), "hot-grams")
    owners = (
        contexts.join(hot, "gram", "left").groupBy("at.text_key", "at.doc_id")
        .agg(F.collect_list(F.struct(F.col("at.code").alias("code"), "gram", "context", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("contexts"))
        .withColumnsRenamed({"text_key": "_key", "doc_id": "_id"}))
    texts = docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("text_key"))
    owned = texts.join(owners, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("text", "contexts")
    buckets = max(1, -(-contexts.count() // BUCKET_CONTEXTS))
    parts = staged(_extract(owned, length, buckets), "suffix-runs")
    resolved = parts.where("run is not null").select("bucket", "run").groupBy("bucket").applyInPandas(
        _resolve_bucket(length, gram), "gram long, context long, o_from int, o_to int")
    windows = parts.where("run is null").select("gram", "context", "o", "w1", "w2").distinct()
    twice = windows.groupBy("gram", "o", "w1", "w2").count().where("count > 1").drop("count")
    by_hash = windows.join(twice, ["gram", "o", "w1", "w2"]).select("gram", "context", F.col("o").alias("o_from"), F.col("o").alias("o_to"))
    anchor, back, more = F.shiftright("code", 20), F.shiftright("code", 10).bitwiseAND(F.lit(1023)), F.col("code").bitwiseAND(F.lit(1023))
    copied = contexts.where("n > 1").select("gram", "context", F.lit(None).cast("int").alias("o_from"), F.lit(None).cast("int").alias("o_to"))
    offsets = staged(resolved.union(by_hash).union(copied), "offsets")
    mixed = again.where("mixed").join(offsets, ["gram", "context"]).select(
        "text_key", (anchor - F.coalesce("o_to", back)).alias("start"),
        (anchor - F.coalesce(F.col("o_from"), back - more) + length).alias("end"))
    whole = again.where("not mixed").select("text_key", (anchor - back).alias("start"), (anchor - back + more + length).alias("end"))
    return staged(
        mixed.union(whole).groupBy("text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "repeated-spans")


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _word_hashes(text: bytes) -> np.ndarray:
    words, out = (m[0] for m in WORD.finditer(text)), [np.empty(0, np.uint64)]
    while part := list(islice(words, BLOCK)):
        out.append(pd.util.hash_array(np.array(part, object), categorize=False))
    return np.concatenate(out)


def word_prints(texts: list[bytes], passage: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash, each once, of the ``words``-word strings with the smallest hash in some ``passage`` words
    of a text. White space between the words does not count."""
    hashes = [_word_hashes(t) for t in texts]
    owner, word = np.repeat(np.arange(len(texts)), [len(h) for h in hashes]), np.concatenate(hashes)
    if len(word) < passage:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    count = len(word) - words + 1
    grams = np.zeros(count, np.uint64)
    for i in range(words):
        grams = grams * np.uint64(MULTIPLIER) + word[i:i + count]
    least = np.lib.stride_tricks.sliding_window_view(_mix(grams), passage - words + 1).min(axis=1)
    inside = owner[:len(least)] == owner[passage - 1:]
    owner, least = owner[:len(least)][inside], least[inside]
    new = np.append(True, (owner[1:] != owner[:-1]) | (least[1:] != least[:-1]))[:len(owner)]
    once = pd.DataFrame({"owner": owner[new], "print": least[new].view(np.int64)}).drop_duplicates()
    return once["owner"].to_numpy(), once["print"].to_numpy()


def shared_prints(docs: DataFrame, passage: int = PASSAGE_WORDS, words: int = PRINT_WORDS) -> DataFrame:
    """``text_key`` (MD5 of the text) and ``n_shared``: its prints that another row has too. Texts without have no row.

    Two rows with the same ``passage`` consecutive words choose the same print in them, so both have a row here; a text
    that has no ``words`` consecutive words in common with another row has none. Columns of ``docs``: text (not null).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in slices(batches, "text", SLICE_BYTES):
            texts, keys = [], []
            for t in as_bytes(batch.column("text")):
                k = hashlib.md5(t).digest()
                seen[k] += 1
                if seen[k] <= 2:  # twice is enough to know that all of it is shared
                    texts.append(t), keys.append(k)
            if texts:
                owner, prints = word_prints(texts, passage, words)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()).take(pa.array(owner)), pa.array(prints, pa.int64())], ["text_key", "print"])

    found = staged(docs.select("text").mapInArrow(run, "text_key binary, print long"), "prints")
    again = found.groupBy("print").count().where("count > 1").select("print")
    shared = staged(found.join(again, "print").groupBy("text_key").agg(F.count_distinct("print").alias("n_shared")), "shared-prints")
    drop_staged(found)
    return shared


def cut_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes), ``n_shared`` (see
    ``shared_prints``; nothing is removed for it).

    Null text is empty; texts shorter than ``length`` have nothing to remove; repeated rows and equal texts repeat each
    other; null ids pass through. An empty table gives an empty result.
    """
    base = id_text(docs, id_col, text_col)
    spans = repeats(base, length, gram, hot_contexts).join(shared_prints(base), "text_key", "full").withColumnRenamed("text_key", "_key")
    keyed = base.withColumn("text_key", F.unhex(F.md5("text")))
    joined = keyed.join(spans, F.col("text_key") == F.col("_key"), "left").select(
        "doc_id", "text", "spans", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            sizes, removed, counts, kept = [], [], [], []
            for text, found in zip(as_bytes(batch.column("text")), batch.column("spans").to_pylist()):
                cut = united([(s["start"], s["end"]) for s in found or ()])
                edges = [0, *(x for s in cut for x in s), len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2])))
                sizes.append(len(text)), removed.append(len(text) - len(kept[-1])), counts.append(len(cut))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, counts)), pa.array(kept, pa.binary()),
                 batch.column("n_shared")],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_shared"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, n_shared long")
