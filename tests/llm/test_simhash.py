import random
import re

import numpy as np
import xxhash

from filingpanel.llm import simhash
from filingpanel.llm.components import components


def brute_fingerprint(text, width=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    grams = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hs = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(ids, fps, radius):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(ids))]


def near_texts(rng, groups=12, copies=12):
    out = []
    for _ in range(groups):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(60, 300))]
        for _ in range(copies):
            own = list(words)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(500)}"
            out.append(" ".join(own))
    return out


def test_fingerprint_is_the_brute_one():
    for text in ["", "  \t ", "One", "a B c", "Ärger mit ÄÖÜ \x0b KK x y z", "a a a a a a a", " x\n" * 70000, "a\x1cb c d e f"]:
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_tree_finds_what_scanning_finds():
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 5, np.uint64)
    members = np.unique(np.concatenate([centre, *[c ^ (np.uint64(1) << rng.integers(0, 64, 40, np.uint64)) for c in centre]]))
    rows = members[:, None]
    found = {(int(members[n]), int(q)) for n, hit in simhash.BKTree(rows).within(rows, 2) for q in members[hit]}
    assert found == {(int(a), int(b)) for a in members for b in members if bin(int(a) ^ int(b)).count("1") <= 2}


def test_keys_meet_within_the_radius(spark):
    rng = random.Random(4)
    rows = []
    for i in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        rows.append((a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))
    df = spark.createDataFrame(rows, "x long, y long")
    from pyspark.sql import functions as F
    assert df.where(~F.arrays_overlap(simhash.shard_keys(F.col("x"), 4), simhash.shard_keys(F.col("y"), 4))).isEmpty()


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 190)] + [(7, i) for i in range(8, 60)] + [(5, 5), (None, 3), (-4, 2), (2, -4)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 191)}, **{i: 7 for i in range(8, 60)}, 2: -4}
    assert components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_components_of_documents(spark):
    rng = random.Random(5)
    texts = near_texts(rng) + ["", None, "\n", "one", "one"]
    ids = rng.sample(range(10000), len(texts))
    ids[3] = None
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in zip(ids, texts)], "doc_id long, text string, fp long, band int")
    df = df.union(df.limit(1))
    ids, texts = ids + ids[:1], texts + texts[:1]
    fps = [brute_fingerprint(t) for t in texts]
    want = sorted(zip(map(str, ids), (f"{f:016x}" for f in fps), map(str, brute_components(ids, fps, 4))))
    got = simhash.near_components(df).select("doc_id", simhash.hex16(simhash.F.col("fp")).alias("f"), "component_id").collect()
    assert sorted((str(r.doc_id), r.f, str(r.component_id)) for r in got) == want


def test_split_shards_give_the_same_components(spark):
    rng = random.Random(6)
    fps = [brute_fingerprint(t) for t in near_texts(rng, 4, 40)]
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    df = spark.createDataFrame([(i, [f]) for i, f in enumerate(signed)], "node long, fp array<long>")
    keys = simhash.shard_keys(simhash.F.col("fp")[0], 4)
    one = {tuple(r) for r in components(simhash.links(df, keys)).collect()}
    assert one and one == {tuple(r) for r in components(simhash.links(df, keys, tree_size=3)).collect()}


def test_similar_texts_meet_and_others_do_not(spark):
    rng = random.Random(8)
    rows, group = [], []
    for g in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for edits in (0, 1, 2, 3):  # three edits: Jaccard 0.86 with the first
            own = list(words)
            for i in rng.sample(range(0, 200, 7), edits):
                own[i] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(own)), group.append(4 * g)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_components(df).collect()}
    assert got == dict(enumerate(group))


def test_near_dedup_keeps_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(5, text, "a"), (3, text, "b"), (9, text + " end", None), (2, "other words here now yes", "c"), (None, text, "d")],
                               "doc_id long, text string, component_id string")
    out = simhash.near_dedup(df)
    assert out.columns == df.columns and sorted(r.doc_id or -1 for r in out.collect()) == [-1, 2, 3]
    assert simhash.near_dedup(df.limit(0)).count() == 0


def test_two_texts_under_one_id(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text), (2, text + " end"), (2, "something else that nobody wrote before"), (2, text + " end"), (3, None), (3, "")]
    out = simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == [(1, text), (2, rows[2][1]), (3, ""), (3, "")]


def shingle_set(text, width=5):
    words = (text or "").lower().split()
    return {" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def jaccard_components(ids, texts, similarity=0.8):
    """By comparing all pairs of shingle sets."""
    sets = [shingle_set(t) for t in texts]
    near = [[a == b or len(a & b) >= similarity * len(a | b) - 1e-9 for b in sets] for a in sets]
    out = []
    for i in range(len(ids)):
        seen, todo = {i}, [i]
        while todo:
            more = {j for j, n in enumerate(near[todo.pop()]) if n} - seen
            seen |= more
            todo += more
        out.append(min((ids[j] for j in seen if ids[j] is not None), default=None))
    return out


def shared_passages(rng, shares, size=300):
    """Pairs of texts of new words that have a passage of the given share of their words in common."""
    out, word = [], lambda: f"w{rng.randrange(10**7)}"
    for share in shares:
        passage = [word() for _ in range(round(size * share))]
        out += [" ".join(passage + [word() for _ in range(size - len(passage))]) for _ in range(2)]
    return out


def test_similarity_is_that_of_the_shingle_sets(spark):
    rng = random.Random(12)
    # an overlap of s shared words gives a Jaccard similarity of about s / (2 - s): 0.60 to 0.85 and short texts
    shares = [2 * j / (1 + j) for j in (0.6, 0.65, 0.7, 0.75, 0.79, 0.81, 0.83, 0.85) for _ in range(12)]
    texts = shared_passages(rng, shares) + shared_passages(rng, [0.85, 0.9, 0.95] * 10, 24)
    passage = [f"hot{i}" for i in range(200)]  # in many texts, at a similarity of 0.66
    texts += [" ".join(passage + [f"own{rng.randrange(10**7)}" for _ in range(50)]) for _ in range(40)]
    texts += ["", None, "\n", "one", "one", "one two", "ab " * 200, "ab " * 90]
    ids = rng.sample(range(10000), len(texts))
    ids[1] = ids[4] = None
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.similar_components(df).collect())
    want = jaccard_components(ids, texts)
    assert got == sorted(zip(map(str, ids), map(str, want)))
    assert 20 < sum(i != c for i, c in zip(ids, want) if i is not None) < 100


def test_texts_of_one_fingerprint_are_compared_by_their_sets(spark):
    # a passage repeated often decides every bit of a fingerprint with repeats: these texts were one class
    rng = random.Random(13)
    tails = [" ".join(f"w{rng.randrange(10**7)}" for _ in range(90)) for _ in range(6)]
    texts = ["ab " * 400 + t + end for t in tails for end in ("", " more")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_components(df).collect()}
    assert got == {i: i // 2 * 2 for i in range(12)}


def test_split_set_shards_give_the_same_components(spark, monkeypatch):
    rng = random.Random(14)
    texts = near_texts(rng, 3, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(jaccard_components(list(range(len(texts))), texts)))
    for name, value in (("TREE_SIZE", 7), ("TREE_SHINGLES", 900)):
        monkeypatch.setattr(simhash, name, value)
        assert {r.doc_id: r.component_id for r in simhash.similar_components(df).collect()} == want
