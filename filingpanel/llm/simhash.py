"""Near duplicates by 64-bit SimHash fingerprints, searched with BK-trees."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, drop_staged, id_text, slices, staged, text_of
from .components import components

SHINGLE, RADIUS, SEED, BITS = 4, 4, 42, 64
# Groups at a Jaccard similarity: shingles of five words, shards by minima, candidates by fingerprints of 256 bits.
WIDE_SHINGLE, WIDE_WORDS, SIMILARITY, MINIMA = 5, 4, 0.8, 6
TREE_SIZE = 2048  # members of one tree
QUERY_ROWS = 1024  # queries that walk a tree together
COUNT_ROWS = 1 << 15
SHORT = 80  # queries of fewer shingles are compared with a whole tree: few hashes make their fingerprints too coarse
TREE_SHINGLES, QUERY_SHINGLES = 1 << 22, 1 << 20  # of the members of one tree, of the queries that walk it together
LINK_PARTS = 1024  # arrays of links sent on together


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; fewer words are one shingle, no words none."""
    words = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    parts = map(joined.__getitem__, map(slice, starts, ends[-n:].tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n)


def _mixed(hashes: np.ndarray, number: int) -> np.ndarray:
    """Another hash function of the shingles, from their first one."""
    x = hashes + np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _majority(hashes: np.ndarray) -> np.ndarray:
    """64 bits, each 1 if it is set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), COUNT_ROWS):
        part = hashes[at:at + COUNT_ROWS]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingle hashes."""
    return int(_majority(shingle_hashes(text, width))[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, words: int = 1, minima: int = 0, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, fp, minima`` per row: a fingerprint of ``words`` signed longs, and the smallest of the shingles under
    that many more hash functions. Null text counts as empty (all zero)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps, least = np.zeros((batch.num_rows, words), np.uint64), np.zeros((batch.num_rows, minima), np.uint64)
            for i, t in enumerate(as_bytes(batch.column("text"))):
                hashes = shingle_hashes(t, width)
                for j in range(words):
                    fps[i, j] = _majority(_mixed(hashes, j) if j else hashes)[0]
                for j in range(minima if len(hashes) else 0):
                    least[i, j] = _mixed(hashes, words + j).min()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _lists(fps), _lists(least)], ["doc_id", "fp", "minima"])

    df = id_text(docs, id_col, text_col)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, fp array<long>, minima array<long>")


def shingle_sets(docs: DataFrame, width: int, words: int, minima: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, k1, k2, n, fp, minima`` per row: the MD5 of the text, and of the set of its shingles, without
    repeats, the 128-bit hash, the size, the fingerprint, and the smallest shingles under ``minima`` hash functions.
    Null text has the empty set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            n = np.zeros(batch.num_rows, np.int64)
            key, fps, least = (np.zeros((batch.num_rows, k), np.uint64) for k in (2, words, minima))
            for i, t in enumerate(as_bytes(batch.column("text"))):
                hashes = np.unique(shingle_hashes(t, width))
                key[i], n[i] = _set_key(hashes), len(hashes)
                for j in range(words):
                    fps[i, j] = _majority(_mixed(hashes, j) if j else hashes)[0]
                for j in range(minima if len(hashes) else 0):
                    least[i, j] = _mixed(hashes, words + j).min()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("digest"), *_longs(key), pa.array(n), _lists(fps), _lists(least)],
                ["doc_id", "digest", "k1", "k2", "n", "fp", "minima"])

    df = id_text(docs, id_col, text_col).withColumn("digest", F.unhex(F.md5("text")))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, digest binary, k1 long, k2 long, n long, fp array<long>, minima array<long>")


def _members_of_sets(docs: DataFrame, width: int) -> DataFrame:
    """``id, k1, k2, shingles`` per row of ``id, text``: the sorted hashes of its set of shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            sets = [np.unique(shingle_hashes(t, width)) for t in as_bytes(batch.column("text"))]
            key = np.array([_set_key(s) for s in sets], np.uint64).reshape(-1, 2)
            offsets = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
            flat = pa.array(np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), *_longs(key), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["id", "k1", "k2", "shingles"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, k1 long, k2 long, shingles array<long>")


def _set_key(hashes: np.ndarray) -> tuple[int, int]:
    whole = xxhash.xxh128_intdigest(hashes.tobytes(), SEED)
    return whole >> 64, whole & (1 << 64) - 1


def _longs(rows: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.ascontiguousarray(c).view(np.int64)) for c in rows.T]


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.view(np.int64).ravel()))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


class BKTree:
    """Children hang on the integer Hamming distance to their parent.

    Built in bulk: the first fingerprint of a set is its root, the rest is dealt to the children by distance; this is
    the tree that inserting one by one gives. A query at distance d from a node follows the edges from d - radius to
    d + radius only, as the triangle inequality rules out the others. Queries walk the tree in blocks. Fingerprints
    are rows of 64-bit words.
    """

    def __init__(self, members: np.ndarray):
        self.members = members
        self.children: list[list[tuple[int, int]]] = [[] for _ in members]
        stack = [np.arange(len(members))] if len(members) else []
        while stack:
            own = stack.pop()
            root, rest = own[0], own[1:]
            if rest.size:
                d = distance(members[rest], members[root])
                order = np.argsort(d, kind="stable")
                edges, first = np.unique(d[order], return_index=True)
                for edge, child in zip(edges.tolist(), np.split(rest[order], first[1:])):
                    self.children[root].append((edge, int(child[0])))
                    stack.append(child)

    def within(self, queries: np.ndarray, radius: int | np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(node, positions of the queries within ``radius`` of it), node by node. ``radius``: of all queries or of each."""
        stack = [(0, np.arange(len(queries)))] if len(self.members) and len(queries) else []
        while stack:
            node, at = stack.pop()
            d = distance(queries[at], self.members[node])
            limit = radius[at] if isinstance(radius, np.ndarray) else radius
            hit = at[d <= limit]
            if hit.size:
                yield node, hit
            for edge, child in self.children[node]:
                near = at[np.abs(d - edge) <= limit]
                if near.size:
                    stack.append((child, near))


def tree_links(members: np.ndarray, names: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]],
               radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what lies within ``radius``: one per query with a hit, one per member of a larger component.

    Not all pairs are listed: components of the members are kept as labels and merged node by node. ``blocks``:
    fingerprints of the queries and their names.
    """
    tree, label = BKTree(members), np.arange(len(members))
    left, right = [], []
    for queries, own in blocks:
        first = np.full(len(queries), -1)
        for node, hit in tree.within(queries, radius):
            known = first[hit]
            first[hit[known < 0]] = node
            joined = np.unique(np.append(label[known[known >= 0]], label[node]))
            if joined.size > 1:
                label[np.isin(label, joined)] = joined[0]
        hit = first >= 0
        left.append(own[hit]), right.append(names[first[hit]])
    left.append(names), right.append(names[label])
    return left, right


def _blocks(bits: int, count: int) -> list[tuple[int, int]]:
    """(shift, width) of ``count`` blocks that cover the bits."""
    edges = [bits * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def shard_keys(fp: Column, radius: int, agree: int = 2) -> Column:
    """Keys of which two fingerprints within ``radius`` share at least one.

    The bits are cut into ``radius + agree`` blocks; ``radius`` differing bits leave ``agree`` blocks equal, so each
    choice of ``agree`` blocks with its values is a key.
    """
    blocks = _blocks(BITS, radius + agree)
    keys = []
    for number, chosen in enumerate(combinations(blocks, agree)):
        mask = sum(((1 << width) - 1) << shift for shift, width in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(number).alias("band"), fp.bitwiseAND(F.lit(signed)).alias("value")))
    return F.array(*keys)


def links(classes: DataFrame, keys: Column, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Edges ``a, b`` between nodes of ``classes`` (``node`` long, ``fp``) whose components are those of all pairs of
    fingerprints within ``radius`` that share one of ``keys`` (structs of band and value).

    Fingerprints meet in the shard of a key; each shard is a BK-tree of at most about ``tree_size`` members that its own
    fingerprints search. A larger shard is split into several trees by a hash, and its fingerprints visit each of
    them in blocks, so no task holds more than one tree and one block.
    """
    keyed = classes.select("node", "fp", F.explode(F.array_distinct(keys)).alias("k")).select("node", "fp", "k.*")
    large = staged(
        keyed.groupBy("band", "value").count().where(F.col("count") > tree_size)
        .select("band", "value", F.ceil(F.col("count") / tree_size).cast("int").alias("trees")), "large-shards")
    own = F.pmod(F.xxhash64("node"), F.col("trees")).cast("int")
    dealt = (
        keyed.join(large, ["band", "value"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
        .withColumn("own", own)
        .select("node", "fp", "band", "value", "own", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"))
        .select("band", "value", "tree", (F.col("own") != F.col("tree")).alias("guest"), "node", "fp")
        .repartition("band", "value", "tree").sortWithinPartitions("band", "value", "tree", "guest", "node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: list[np.ndarray] | None = None
        for batch in batches:
            rows = [np.asarray(batch.column(c)) for c in ("band", "value", "tree", "guest", "node")]
            rows.append(batch.column("fp").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1))
            if carry is not None:
                rows = [np.concatenate(p) for p in zip(carry, rows)]
            change = _changes(rows)
            cut = int(change[-1]) if len(change) else 0
            if cut:
                yield from _solve([r[:cut] for r in rows], radius)
            carry = [r[cut:] for r in rows]
        if carry is not None and len(carry[0]):
            yield from _solve(carry, radius)

    return dealt.mapInArrow(run, "a long, b long")


def _changes(rows: list[np.ndarray]) -> np.ndarray:
    """Where another shard tree begins."""
    return np.flatnonzero(np.any([r[1:] != r[:-1] for r in rows[:3]], axis=0)) + 1


def _solve(rows: list[np.ndarray], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of whole shard trees; rows are sorted by shard, members before guests."""
    guest, node, fp = rows[3].astype(bool), rows[4], rows[5]
    change = _changes(rows)
    starts, ends = np.append(0, change), np.append(change, len(fp))
    sizes = ends - starts
    two = starts[sizes == 2]  # a root and one child: linked if the edge is within the radius
    two = two[distance(fp[two], fp[two + 1]) <= radius]
    left, right = [node[two]], [node[two + 1]]
    for start, end in zip(starts[sizes > 2].tolist(), ends[sizes > 2].tolist()):
        split = end - int(guest[start:end].sum())
        blocks = ((fp[at:min(at + QUERY_ROWS, end)], node[at:min(at + QUERY_ROWS, end)]) for at in range(start, end, QUERY_ROWS))
        more = tree_links(fp[start:split], node[start:split], blocks, radius)
        left += more[0]
        right += more[1]
    a, b = np.concatenate(left), np.concatenate(right)
    keep = a != b
    yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


class SetTree:
    """A shard tree whose links are confirmed by the Jaccard similarity of the shingle sets.

    ``sets``: fingerprints, names, sizes and the concatenated sorted shingles of the members. Links are stars as in
    ``tree_links``: what is known to be in one component is not compared again.
    """

    def __init__(self, sets: list[np.ndarray], similarity: float, radius: int):
        fp, self.names, self.sizes, flat = sets
        self.similarity, self.radius = similarity, radius
        self.tree, self.label = BKTree(fp), np.arange(len(fp))
        self.vocabulary, own = np.unique(flat, return_inverse=True)
        self.own = np.split(own, np.cumsum(self.sizes)[:-1])
        self.mark = np.zeros(len(self.vocabulary) + 1, bool)  # the last is for shingles that no member has

    def visit(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Links of queries to one member each; members that a query connects get one label."""
        fp, names, sizes, flat = sets
        place = np.searchsorted(self.vocabulary, flat)
        place[self.vocabulary[np.minimum(place, len(self.vocabulary) - 1)] != flat] = len(self.vocabulary)
        starts, first, label = np.cumsum(sizes) - sizes, np.full(len(fp), -1), self.label
        radii = np.where(sizes < SHORT, BITS * fp.shape[1], self.radius)
        for node, hit in self.tree.within(fp, radii):
            known, size = first[hit], self.sizes[node]
            fits = np.minimum(sizes[hit], size) >= self.similarity * np.maximum(sizes[hit], size) - 1e-9
            hit = hit[fits & ((known < 0) | (label[known] != label[node]))]
            if hit.size:
                hit = hit[self._similar(node, place, starts[hit], sizes[hit])]
            if hit.size:
                known = first[hit]
                first[hit[known < 0]] = node
                joined = np.unique(np.append(label[known[known >= 0]], label[node]))
                if joined.size > 1:
                    label[np.isin(label, joined)] = joined[0]
        hit = first >= 0
        return names[hit], self.names[first[hit]]

    def closing(self) -> tuple[np.ndarray, np.ndarray]:
        """Links of the members."""
        return self.names, self.names[self.label]

    def _similar(self, node: int, place: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        own, ends = self.own[node], np.cumsum(sizes)
        self.mark[own] = True
        at = np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])
        common = np.add.reduceat(self.mark[place[at]], ends - sizes, dtype=np.int64)
        self.mark[own] = False
        return common >= self.similarity * (len(own) + sizes - common) - 1e-9


class ProbeTree:
    """A shard tree that only tells which classes have a candidate in it. Sets come as sizes and minima, without shingles.

    A pair counts in the first shard that the two share: what agrees in the minimum of an earlier band has met there.
    """

    def __init__(self, sets: list[np.ndarray], similarity: float, radius: int, band: int):
        fp, self.names, self.sizes, self.minima = sets
        self.similarity, self.radius, self.band = similarity, radius, band
        self.tree, self.met = BKTree(fp), np.zeros(len(fp), bool)

    def visit(self, sets: list[np.ndarray]) -> np.ndarray:
        """Names of the queries with a candidate among the members."""
        fp, names, sizes, minima = sets
        met = np.zeros(len(fp), bool)
        for node, hit in self.tree.within(fp, np.where(sizes < SHORT, BITS * fp.shape[1], self.radius)):
            size = self.sizes[node]
            fits = np.minimum(sizes[hit], size) >= self.similarity * np.maximum(sizes[hit], size) - 1e-9
            hit = hit[fits & (names[hit] != self.names[node])]
            if hit.size and self.band:
                hit = hit[(minima[hit, :self.band] != self.minima[node, :self.band]).all(axis=1)]
            if hit.size:
                met[hit] = self.met[node] = True
        return names[met]


def _cuts(fp: np.ndarray, names: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> Iterator[list[np.ndarray]]:
    """Pieces of at most ``QUERY_ROWS`` sets and about ``QUERY_SHINGLES`` shingles; ``flat`` holds the shingles of all."""
    ends, a = np.cumsum(sizes), 0
    while a < len(fp):
        done = int(ends[a - 1]) if a else 0
        b = max(a + 1, min(a + QUERY_ROWS, int(np.searchsorted(ends, done + QUERY_SHINGLES, "right"))))
        yield [fp[a:b], names[a:b], sizes[a:b], flat[done:int(ends[b - 1])]]
        a = b


TREE = ["band", "value", "tree"]  # a shard of a minimum, and the number of its tree


def _trees(batches: Iterator[pa.RecordBatch], content: str) -> Iterator[tuple[tuple, bool, list[np.ndarray]]]:
    """(tree, if guests, sets) of each run of rows; ``content``: the column of shingles or of other numbers per set."""
    for batch in batches:
        keys = [np.asarray(batch.column(c)) for c in TREE]
        guest, node = np.asarray(batch.column("guest")), np.asarray(batch.column("node"))
        fp = batch.column("fp").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
        column = batch.column(content)
        flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in (*keys, guest)], axis=0)) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            if a < b:
                yield tuple(int(k[a]) for k in keys), bool(guest[a]), [fp[a:b], node[a:b], np.diff(ends[a:b + 1]), flat[ends[a]:ends[b]]]


def candidates(classes: DataFrame, shards: DataFrame, similarity: float, radius: int) -> DataFrame:
    """``band, value, tree, guest, node``: the trees in which a class has a candidate, as a member or as a guest.

    ``classes``: node, fp, n, minima. A shard of several trees has its classes in them by a hash, and each also visits the trees of
    smaller number, piece by piece, so a tree is held but its guests are not.
    """
    own = F.pmod(F.xxhash64("node"), F.col("trees")).cast("int")
    keyed = classes.where("n > 0").select("node", "fp", F.concat(F.array("n"), "minima").alias("known"), F.posexplode("minima").alias("band", "value"))
    dealt = (
        keyed.join(shards, ["band", "value"]).withColumn("own", own)
        .select("node", "fp", "known", "band", "value", "own", F.explode(F.sequence(F.lit(0), F.col("own"))).alias("tree"))
        .select(*TREE, (F.col("own") != F.col("tree")).alias("guest"), "node", "fp", "known")
        .repartition(*TREE).sortWithinPartitions(*TREE, "guest", "node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, members, tree, rows = None, [], None, []

        def out() -> pa.RecordBatch:
            keys = [np.concatenate([np.full(len(names), k[i]) for k, _, names in rows]) for i in range(3)]
            guest = np.concatenate([np.full(len(names), g) for _, g, names in rows])
            names = np.concatenate([names for *_, names in rows])
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(keys[0].astype(np.int32)), pa.array(keys[1]), pa.array(keys[2].astype(np.int32)), pa.array(guest), pa.array(names)],
                [*TREE, "guest", "node"])

        def grown() -> ProbeTree:
            whole = [np.concatenate(p) for p in zip(*members)]
            members.clear()
            new = ProbeTree(whole, similarity, radius, place[0])
            for a in range(0, len(whole[0]) if len(whole[0]) > 1 else 0, QUERY_ROWS):
                new.visit([x[a:a + QUERY_ROWS] for x in whole])
            return new

        def leave() -> None:
            done = grown() if members else tree
            if done is not None and done.met.any():
                rows.append((place, False, done.names[done.met]))

        for key, guest, (fp, names, width, flat) in _trees(batches, "known"):
            if key != place:
                leave()
                place, tree = key, None
                if len(rows) >= LINK_PARTS:
                    yield out()
            known = flat.reshape(len(names), -1)
            sets = [fp, names, known[:, 0], known[:, 1:]]
            if not guest:
                members.append(sets)
                continue
            tree = grown() if members else tree
            for a in range(0, len(names) if tree is not None else 0, QUERY_ROWS):
                met = tree.visit([x[a:a + QUERY_ROWS] for x in sets])
                if met.size:
                    rows.append((key, True, met))
        leave()
        if rows:
            yield out()

    return dealt.mapInArrow(run, "band int, value long, tree int, guest boolean, node long")


def set_links(sets: DataFrame, similarity: float, radius: int) -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs of classes in a tree that lie within ``radius`` (short ones at
    any distance) and have a Jaccard similarity of at least ``similarity``.

    ``sets``: band, value, tree, guest, node, fp, shingles. Members come first; guests go through the tree piece by piece and
    are not held.
    """
    columns = [*TREE, "guest", "node"]
    dealt = sets.select(*columns, "fp", "shingles").repartition(*TREE).sortWithinPartitions(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[np.ndarray, np.ndarray]] = []
        place, members, tree = None, [], None

        def grown() -> SetTree:
            """The tree of the members, which have walked it."""
            whole = [np.concatenate(p) for p in zip(*members)]
            members.clear()
            new = SetTree(whole, similarity, radius)
            if len(whole[0]) > 1:
                links.extend(map(new.visit, _cuts(*whole)))
            return new

        def leave() -> None:
            done = grown() if members else tree
            if done is not None:
                links.append(done.closing())

        for key, guest, (fp, names, sizes, flat) in _trees(batches, "shingles"):
            if key != place:
                leave()
                place, tree = key, None
                if len(links) > LINK_PARTS:
                    yield _edges(links)
                    links.clear()
            part = [fp, names, sizes, flat.view(np.uint64)]
            if not guest:
                members.append(part)
            else:
                tree = grown() if members else tree
                if tree is not None:
                    links.extend(map(tree.visit, _cuts(*part)))
        leave()
        if links:
            yield _edges(links)

    return dealt.mapInArrow(run, "a long, b long")


def _edges(links: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = map(np.concatenate, zip(*links))
    keep = a != b
    return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def _named(rows: DataFrame, classes: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with the ``component_id`` of their class; ``found``: links between the classes."""
    labels = components(found)
    # every class with the root of its component; roots and lonely classes are their own
    rooted = staged(
        classes.select(*key, "node", "first_id").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    smallest = staged(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    named = staged(rooted.join(smallest, "root").select(*key, "component_id"), "named")
    drop_staged(labels, rooted, smallest)
    return rows.join(named, key)


def near_components(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, fp, component_id`` (smallest id that links reach, the own included).

    Fingerprints of 64 bits link within ``radius`` bits; the shards by ``shard_keys`` lose no link. Null and empty texts
    have fingerprint zero and link like any other. Documents of one fingerprint are one class; only classes are
    searched. A null id never names a component (null if it has no other). Repeated rows are returned as often
    as they come. An empty table gives an empty result.
    """
    rows = staged(fingerprints(docs, width, id_col=id_col, text_col=text_col), "fingerprints")
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")).withColumn("node", F.monotonically_increasing_id()), "classes")
    found = links(classes, shard_keys(F.col("fp")[0], radius), radius)
    return _named(rows, classes, found, ["fp"]).select("doc_id", F.col("fp")[0].alias("fp"), "component_id")


def similar_components(docs: DataFrame, width: int = WIDE_SHINGLE, similarity: float = SIMILARITY, words: int = WIDE_WORDS,
                       minima: int = MINIMA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, component_id``: components of documents whose shingle sets have a Jaccard similarity of ``similarity`` or
    more; ``digest``: MD5 of the text, which tells rows of one id apart.

    Every link is confirmed by comparing the sets. Candidates share the smallest shingle under one of ``minima`` hash
    functions (two texts with a similarity of s share one with probability 1 - (1 - s)^minima, over 0.9999 at 0.8) and
    lie within ``search_radius`` of their fingerprints of 64 * ``words`` bits, short texts at any distance. Sets are made
    only for texts that have a candidate, and go only to the trees in which they have one; a pair is a candidate in one
    tree. Texts of one set are one class; those without words are one too. Edge cases as in ``near_components``.
    """
    rows = staged(shingle_sets(docs, width, words, minima, id_col, text_col), "shingle-sets")
    same = [F.first(c).alias(c) for c in ("n", "fp", "minima")]  # equal in all rows of a class
    classes = staged(
        rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"), *same).withColumn("node", F.monotonically_increasing_id()), "classes")
    shards = staged(
        classes.where("n > 0").select("n", F.posexplode("minima").alias("band", "value"))
        .groupBy("band", "value").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n")).where("c > 1")
        .select("band", "value", F.greatest(F.ceil(F.col("c") / TREE_SIZE), F.ceil(F.col("n") / TREE_SHINGLES)).cast("int").alias("trees")), "shards")
    radius = search_radius(similarity, 64 * words)
    hits = staged(candidates(classes, shards, similarity, radius), "candidates")
    drop_staged(shards)
    wanted = staged(hits.join(classes.select("node", F.col("first_id").alias("id"), "k1", "k2", "fp"), "node"), "wanted")
    drop_staged(hits)
    some = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    ids = staged(wanted.select(F.col("id").alias("_wanted")).distinct(), "wanted-ids")  # stored: while small, the text is not shuffled to meet it
    made = _members_of_sets(some.join(ids, F.col("id").eqNullSafe(F.col("_wanted")), "left_semi"), width)
    # the row of the class's first id, or several equal ones, which do no harm
    at = wanted.select("*", *[F.col(c).alias(f"_{c}") for c in ("id", "k1", "k2")]).drop("id", "k1", "k2")
    match = F.col("id").eqNullSafe(F.col("_id")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))
    found = staged(set_links(made.join(at, match), similarity, radius), "links")
    drop_staged(wanted, ids)
    out = _named(rows, classes, found, ["k1", "k2"]).select("doc_id", "digest", "component_id")
    drop_staged(classes, found)
    return out


def search_radius(similarity: float, bits: int) -> int:
    """Differing bits of two equally large sets of that similarity, plus four standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * share + 4 * math.sqrt(bits * share * (1 - share)))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without those that have a component with a smaller id; rows without id stay.

    Rows are told apart by id and text: of two texts under one id, each goes or stays by its own component.
    ``options`` are those of ``similar_components``.
    """
    found = similar_components(docs, id_col=id_col, text_col=text_col, **options)
    leave = staged(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_near_id"), F.col("digest").alias("_near_digest")).distinct(), "near-copies")
    drop_staged(found)
    same = (F.col(f"`{id_col}`") == F.col("_near_id")) & (F.unhex(F.md5(text_of(text_col))) == F.col("_near_digest"))
    return docs.join(leave, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
