import hashlib
import random
import zlib

import numpy as np
import pytest

from filingpanel.llm import prefix_trie
from filingpanel.llm.parentheses import Parentheses

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k0 string"  # the last two clash with names of the operator


def rows(seed=3, convs=90):
    rng = random.Random(seed)
    text = lambda: rng.choice(["", None, "a b", "a  b", "hello there\nyou", "é x", "yes"])
    out = []
    for c in [*range(convs), 1007, 2021, -3, -41, 4000]:
        for turn in range(rng.choice([1, 2, 3, 4, 5, 9, 30])):
            out.append((c, rng.choice([turn, turn, None]), rng.choice(["user", None, "", "bot"]), text(), 1, "x"))
    for c in range(300, 330):  # copies, and copies that go on
        for turn in range(8):
            out.append((c, turn, "user", "same old words", 1, "x"))
        if c % 3 == 0:
            out.append((c, 9, "user", f"more {c % 2}", 1, "x"))
    out += out[:5] + [(None, 1, "user", "nobody's", 1, "x")]
    rng.shuffle(out)
    return out


def brute(table):
    own, built = {}, {}
    for c, turn, role, text, *_ in table:
        if c is not None:
            role, text = role or "", text or ""
            g = hashlib.sha256(b"%d:%b%b" % (len(role.encode()), role.encode(), text.encode())).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, g), role, text))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + mine[h:]
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    children, out = {}, []
    for node in nodes:
        if node:
            children.setdefault(node[:-1], []).append(node)

    below = {}
    for node in sorted(nodes, key=len, reverse=True):
        leaves, saved = 0 if node in children else 1, (len(nodes[node]) - 1) * len(node[-1][1].encode().split()) if node else 0
        for kid in children.get(node, []):
            leaves, saved = leaves + below[kid][0], saved + below[kid][1]
        below[node] = leaves, saved
        ends = ",".join(str(c) for c in sorted(nodes[node]) if len(built[c]) == len(node))
        out.append((min(nodes[node]), len(node), min(nodes[node[:-1]]) if node else None, len(nodes[node]), len(children.get(node, [])),
                    leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: r[:2])


def found(df):
    return sorted(map(tuple, df.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("shard_rows, segment", [(prefix_trie.SHARD_ROWS, prefix_trie.SEGMENT), (60, prefix_trie.SEGMENT), (200, 2), (10, 1)])
def test_against_direct_trie(spark, shard_rows, segment):
    table = rows()
    df = spark.createDataFrame(table, SCHEMA).repartition(5)
    assert found(prefix_trie.prefix_trie(df, shard_rows, segment)) == brute(table)


def test_ids_in_several_texts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_PER_CHUNK", 3)
    table = rows(8)
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(table, SCHEMA).repartition(5), 100)) == brute(table)


def test_small_tables(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    # without its base, a conversation of fewer turns than it takes is rebuilt without any
    lonely = next(c for c in range(1001, 1020) if zlib.crc32(str(c).encode()) % 4 == 3)
    table = [(lonely, 1, "user", "a", 1, "x"), (lonely, 2, "user", "b", 1, "x")]
    got = found(prefix_trie.prefix_trie(spark.createDataFrame(table, SCHEMA)))
    assert got == [(lonely, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lonely).encode()).hexdigest())] == brute(table)


@pytest.mark.parametrize("seed", range(6))
def test_findclose(seed):
    rng = np.random.default_rng(seed)
    depths = [0]
    for _ in range(int(rng.integers(0, 5000))):
        depths.append(depths[-1] + 1 if rng.random() < 0.6 else max(0, depths[-1] - int(rng.geometric(0.4))))
    depths = np.array(depths)
    trie, text = Parentheses(depths), [""] * (2 * len(depths))
    stack, want, place = [], np.empty(len(depths), int), 0
    for i, d in enumerate([*depths, 0]):
        while stack and depths[stack[-1]] >= d:
            want[stack.pop()] = place
            place += 1
        if i < len(depths):
            assert trie.opens[i] == place
            stack.append(i)
            place += 1
    assert (trie.findclose() == want).all() and len(text) == place
    some = rng.integers(0, len(depths), 20)
    assert (trie.findclose(some) == want[some]).all()
    deep = Parentheses(np.arange(5000))
    assert (deep.findclose() == 9999 - np.arange(5000)).all()
