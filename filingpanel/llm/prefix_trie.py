"""Trie of the turn sequences of conversations: what prefixes share, and what storing them once would save."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import global_index
from .common import as_bytes, slices, staged
from .parentheses import Parentheses

FAMILY, MAX_HEAD = 20, 3  # conversations of one base, and the most turns taken from it
SHARD_ROWS = 8192  # rebuilt turns of one shard, about
SEGMENT = 4096  # turns of one conversation that a shard holds; the next ones are in the next segment
IDS_PER_CHUNK = 8192  # ids that are joined to one text
KEY = ["depth", "k0", "k1"]  # depth and 128-bit key of the turns up to it
NO_ENDS = hashlib.sha256(b"").hexdigest()
LOCAL = ("shard int, segment int, open long, close long, parent int, depth long, k0 long, k1 long, p0 long, p1 long, words long, "
         "members long, least long, ends array<long>, onward array<long>")


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, g0, g1, words``: 128 bits of the SHA-256 of role and text, and the words of the text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts, roles = as_bytes(batch.column("text")), as_bytes(batch.column("role"))
            digests = b"".join(hashlib.sha256(b"%d:%b%b" % (len(r), r, t)).digest()[:16] for r, t in zip(roles, texts))
            g = (np.frombuffer(digests, ">u8").astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64).reshape(-1, 2)  # in the order of the bytes
            words = np.fromiter((len(t.split()) for t in texts), np.int64, len(texts))  # on bytes: ASCII white space
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(g[:, 0].copy()), pa.array(g[:, 1].copy()), pa.array(words)],
                ["conv_id", "turn", "g0", "g1", "words"])

    df = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return df.mapInArrow(run, f"conv_id long, turn {df.schema['turn'].dataType.simpleString()}, g0 long, g1 long, words long")


def _mixed(g0: np.ndarray, g1: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of a turn at its depth; their sums over the turns up to a depth are the key of the prefix."""
    def scramble(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    a, b, d = g0.view(np.uint64), g1.view(np.uint64), depth.astype(np.uint64)
    a = scramble(a + scramble(d * np.uint64(0x9E3779B97F4A7C15)))
    b = scramble(b + a)
    return scramble(a + b), b


def rebuilt(conversations: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, int, int]:
    """``conv_id, base, depth, segment, m0, m1, words, last`` per turn of the rebuilt conversations, with one row of depth 0
    for each conversation, the number of rows and the length of the longest conversation.

    Places of the turns come from a global sort in slices, so a conversation of any length is spread over tasks.
    """
    rows = global_index(turns(conversations), ["conv_id", "turn", "g0", "g1"], "at")
    own = rows.groupBy("conv_id").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    heads = (
        rows.where(F.col("conv_id") % FAMILY == 0).join(own.where(F.col("conv_id") % FAMILY == 0), "conv_id")
        .where(F.col("at") - F.col("first_at") < MAX_HEAD)
        .groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("at", "g0", "g1", "words"))).alias("head")))
    taken = (F.crc32(F.col("conv_id").cast("string")) % (MAX_HEAD + 1)).cast("int")
    info = staged(
        own.select("*", base.alias("base"), taken.alias("h")).join(heads, "base", "left")
        .withColumn("head", F.slice(F.coalesce("head", F.array()), F.lit(1), F.col("h")))
        .withColumn("length", F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "conversations")
    total, longest = info.agg(F.coalesce(F.sum(F.col("length") + 1), F.lit(0)), F.coalesce(F.max("length"), F.lit(0))).first()

    turn = ["conv_id", "base", "depth", "g0", "g1", "words", (F.col("depth") == F.col("length")).alias("last")]
    tops = info.withColumns({"depth": F.lit(0).cast("long"), "g0": F.lit(0).cast("long"), "g1": F.lit(0).cast("long"), "words": F.lit(0).cast("long")})
    first = info.select("conv_id", "base", "length", F.posexplode("head").alias("i", "t")).select(
        "conv_id", "base", "length", (F.col("i") + 1).cast("long").alias("depth"), "t.g0", "t.g1", "t.words")
    rest = (
        rows.join(info.select("conv_id", "base", "first_at", "h", F.size("head").alias("k"), "length"), "conv_id")
        .where(F.col("at") - F.col("first_at") >= F.col("h"))
        .withColumn("depth", F.col("at") - F.col("first_at") - F.col("h") + F.col("k") + 1))
    every = tops.select(*turn).unionByName(first.select(*turn)).unionByName(rest.select(*turn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g0, g1, depth = (np.asarray(batch.column(c)) for c in ("g0", "g1", "depth"))
            m = [np.where(depth > 0, x, np.uint64(0)).view(np.int64) for x in _mixed(g0, g1, depth)]
            piece = (np.maximum(depth, 1) - 1) // segment
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("base"), batch.column("depth"), pa.array(piece.astype(np.int32)),
                 *map(pa.array, m), batch.column("words"), batch.column("last")],
                ["conv_id", "base", "depth", "segment", "m0", "m1", "words", "last"])

    mixed = every.mapInArrow(run, "conv_id long, base long, depth long, segment int, m0 long, m1 long, words long, last boolean")
    return staged(mixed, "rebuilt"), total, longest


def _carried(rows: DataFrame) -> DataFrame:
    """``conv_id, segment, c0, c1``: sums of the hashes of all earlier segments; sums are taken modulo 2^64 as decimals."""
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    modulus = F.lit(str(1 << 64)).cast("decimal(20,0)")

    def whole(c: Column) -> Column:
        return F.pmod(c.cast("decimal(38,0)"), modulus).cast("decimal(20,0)")

    def signed(c: Column) -> Column:
        return F.when(c >= F.lit(str(1 << 63)).cast("decimal(20,0)"), c - modulus).otherwise(c).cast("long")

    per = rows.groupBy("conv_id", "segment").agg(*[whole(F.sum(whole(F.col(m)))).alias(m) for m in ("m0", "m1")])
    return per.select("conv_id", "segment", *[
        signed(whole(F.coalesce(F.sum(m).over(before), F.lit(0)))).alias(c) for m, c in (("m0", "c0"), ("m1", "c1"))])


def _numbered(*columns: np.ndarray) -> np.ndarray:
    """A number for each distinct row."""
    order = np.lexsort(columns[::-1])
    new = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    out = np.empty(len(order), np.int64)
    out[order] = np.append(0, np.cumsum(new))
    return out


def local_trie(rows: pa.Table, last_depth: int) -> pa.Table:
    """The trie of the prefixes in one shard, as rows of ``LOCAL`` in preorder.

    Conversations are sorted by their sequences of node numbers. What a conversation adds to the nodes before it is the
    end of its path, so the first places of the nodes, in that order, are the preorder of the trie.
    """
    conv, depth = rows["conv_id"].to_numpy(), rows["depth"].to_numpy()
    order = np.lexsort((depth, conv))
    conv, depth = conv[order], depth[order]
    words, last = rows["words"].to_numpy()[order], rows["last"].to_numpy()[order]
    starts = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
    sizes = np.diff(np.append(starts, len(conv)))
    keys, before = [], []
    for m, c in (("m0", "c0"), ("m1", "c1")):
        m, c = (rows[x].to_numpy()[order].view(np.uint64) for x in (m, c))
        total = np.cumsum(m)
        key = total - np.repeat(total[starts] - m[starts] - c[starts], sizes)
        keys.append(key), before.append(key - m)
    node = _numbered(depth, *keys)
    paths, ends = node.astype(">u4").tobytes(), 4 * (starts + sizes)
    rank = sorted(range(len(starts)), key=lambda i: paths[4 * starts[i]:ends[i]])
    walk = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in rank])

    first = np.sort(np.unique(node[walk], return_index=True)[1])  # in the order of the walk: the preorder
    at = walk[first]
    number = np.empty(len(at), np.int64)
    number[node[at]] = np.arange(len(at))
    node = number[node]  # nodes are numbered in preorder from here
    trie = Parentheses(depth[at])
    parent = np.where(np.isin(at, starts), -1, node[at - 1])
    least = np.full(len(at), np.iinfo(np.int64).max)
    np.minimum.at(least, node, conv)

    def lists(chosen: np.ndarray) -> pa.Array:
        """Conversations of the chosen rows by node."""
        to = np.lexsort((conv[chosen], node[chosen]))
        offsets = np.append(0, np.cumsum(np.bincount(node[chosen], minlength=len(at)))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(conv[chosen][to]))

    shard, segment = (np.full(len(at), rows[c][0].as_py(), np.int32) for c in ("shard", "segment"))
    columns = [shard, segment, trie.opens, trie.findclose(), parent.astype(np.int32), depth[at],
               *[k[at].view(np.int64) for k in keys], *[b[at].view(np.int64) for b in before], words[at], np.bincount(node), least]
    onward = lists(np.flatnonzero((depth == last_depth) & ~last))
    return pa.table([*map(pa.array, columns), lists(np.flatnonzero(last)), onward], names=[f.strip().split()[0] for f in LOCAL.split(",")])


def subtree_sums(rows: pa.Table) -> pa.Table:
    """Leaf pairs and savings below each node of one shard, by differences of running totals between its parentheses."""
    rows = rows.sort_by("open")
    start, close = rows["open"].to_numpy(), rows["close"].to_numpy()
    number = np.arange(len(start))
    behind = number + (close - start + 1) // 2  # the subtree takes as many nodes as pairs
    sums = []
    for c in ("leaf", "saved"):
        total = np.append(0, np.cumsum(rows[c].to_numpy()))
        sums.append(total[behind] - total[number])
    parent, least = rows["parent"].to_numpy(), rows["conv_id"].to_numpy()
    known = (parent >= 0) & rows["own"].to_numpy()
    above = pa.array(np.where(known, least[parent], 0), mask=~known)
    return pa.table([*[rows[c] for c in KEY], *map(pa.array, sums), above], names=[*KEY, "n_leaves", "saved_tokens", "parent_conv_id"])


def _hashed_ends(ends: DataFrame) -> DataFrame:
    """SHA-256 per node of its ids in numeric order, comma-joined.

    Ids are sorted over all tasks and joined to texts of many ids there; the hash of a node, which has to see them one
    after the other, then runs over those texts only.
    """
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # [key, first id, texts]

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*[pa.array([r[0][i] for r in rows], pa.int64()) for i in range(3)], pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([",".join(r[2]) for r in rows], pa.string())], [*KEY, "start", "ids"])

        for batch in batches:
            for *key, c in zip(*[batch.column(x).to_pylist() for x in (*KEY, "c")]):
                if held and held[-1][0] == key and len(held[-1][2]) < IDS_PER_CHUNK:
                    held[-1][2].append(str(c))
                else:
                    held.append([key, c, [str(c)]])
            if len(held) > 1:
                yield out(held[:-1])
                del held[:-1]
        if held:
            yield out(held)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*[pa.array([r[0][i] for r in rows], pa.int64()) for i in range(3)], pa.array([r[1] for r in rows], pa.string())], [*KEY, "ends_sha256"])

        for batch in batches:
            done = []
            for *key, ids in zip(*[batch.column(x).to_pylist() for x in (*KEY, "ids")]):
                if key != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield out(done)
        if now is not None:
            yield out([(now, state.hexdigest())])

    keys = ", ".join(f"{k} long" for k in KEY)
    texts = ends.repartitionByRange(*KEY, "c").sortWithinPartitions(*KEY, "c").mapInArrow(joined, f"{keys}, start long, ids string")
    return texts.repartition(*KEY).sortWithinPartitions(*KEY, "start").mapInArrow(hashed, f"{keys}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS, segment: int = SEGMENT) -> DataFrame:
    """One row per distinct prefix of the rebuilt conversations: ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.

    Turns come by number (null first), equal numbers by the SHA-256 of role and text. Conversation ``c`` starts with the
    first crc32(c) % 4 turns of conversation ``c - c % 20``. Null roles and texts count as empty, which differs from no turn;
    rows without ``conv_id`` belong to no conversation and count nowhere; repeated rows are turns of their own; extra columns
    are not read. An empty table has no conversation and gives no rows.

    Conversations are dealt to shards by their base, long ones in segments of ``segment`` turns. Each shard
    encodes its trie as balanced parentheses. The spines that shards share, such as a first turn that a third of the
    conversations have, are counted per shard and then merged by key. A node is counted below its ancestors only in the shard
    of its smallest member. Prefix keys are 128-bit sums; that equal keys have equal parents is checked.
    """
    rows, total, longest = rebuilt(conversations, segment)
    shards = max(1, math.ceil(total / shard_rows))
    shard = lambda base: F.pmod(F.xxhash64(base), F.lit(shards)).cast("int")
    rows = rows.withColumn("shard", shard(F.col("base"))).drop("base")
    if longest > segment:
        rows = rows.join(_carried(rows), ["conv_id", "segment"])
    else:
        rows = rows.withColumns({c: F.lit(0).cast("long") for c in ("c0", "c1")})

    def built(group: pa.Table) -> pa.Table:
        return local_trie(group, (group["segment"][0].as_py() + 1) * segment)

    local = staged(rows.groupBy("shard", "segment").applyInArrow(built, LOCAL), "local-tries")
    same = [F.when(F.min(c) == F.max(c), F.min(c)).alias(c) for c in ("p0", "p1", "words")]
    merged = local.groupBy(*KEY).agg(F.sum("members").alias("n_convs"), F.min("least").alias("conv_id"), *same).withColumn(
        "p0", F.coalesce("p0", F.raise_error(F.lit("two prefixes share a 128-bit key")).cast("long")))
    children = merged.where("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p0").alias("k0"), F.col("p1").alias("k1")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = staged(merged.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-nodes")

    weight = nodes.select(*KEY, "conv_id", (F.col("n_children") == 0).cast("long").alias("leaf"),
                          ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    own = F.col("shard") == shard(F.col("conv_id") - F.col("conv_id") % FAMILY)
    weighed = local.select("shard", "segment", "open", "close", "parent", *KEY, "onward").join(weight, KEY).withColumn("own", own).withColumns(
        {c: F.when(F.col("own"), F.col(c)).otherwise(0) for c in ("leaf", "saved")})
    if longest > segment:
        weighed = weighed.join(_tails(local, weight, segment), ["shard", "segment", "open"], "left").withColumns(
            {c: F.col(c) + F.coalesce(f"tail_{c}", F.lit(0)) for c in ("leaf", "saved")}).drop("tail_leaf", "tail_saved")
    sums = weighed.drop("onward").groupBy("shard", "segment").applyInArrow(
        subtree_sums, "depth long, k0 long, k1 long, n_leaves long, saved_tokens long, parent_conv_id long")
    below = sums.groupBy(*KEY).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"),
                                   F.max("parent_conv_id").alias("parent_conv_id"))
    ends = _hashed_ends(local.where(F.size("ends") > 0).select(*KEY, F.explode("ends").alias("c")))
    out = nodes.join(below, KEY).join(ends, KEY, "left")
    if longest > segment:  # parents of the first nodes of a segment are in another one
        above = nodes.where(F.col("depth") % segment == 0).select(
            (F.col("depth") + 1).alias("depth"), F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("above"))
        out = out.join(above, ["depth", "p0", "p1"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def _tails(local: DataFrame, weight: DataFrame, segment: int) -> DataFrame:
    """``shard, segment, open, tail_leaf, tail_saved``: what the conversations that go on behind the last node of a segment
    own in later segments, so that it counts below that node."""
    later = Window.partitionBy("conv_id").orderBy(F.desc("segment")).rangeBetween(Window.unboundedPreceding, -1)
    nowhere = [F.lit(None).cast("int").alias("shard"), F.lit(None).cast("long").alias("open")]
    owned = weight.where(F.col("depth") > segment).groupBy(
        "conv_id", F.floor((F.col("depth") - 1) / segment).cast("int").alias("segment")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    onward = local.where(F.size("onward") > 0).select(
        F.explode("onward").alias("conv_id"), "segment", F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"), "shard", "open")
    return (
        owned.select("*", *nowhere).unionByName(onward)
        .withColumns({f"tail_{c}": F.sum(c).over(later) for c in ("leaf", "saved")}).where("shard IS NOT NULL")
        .groupBy("shard", "segment", "open").agg(*[F.sum(f"tail_{c}").alias(f"tail_{c}") for c in ("leaf", "saved")]))
