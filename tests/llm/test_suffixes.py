import random
from collections import Counter

import pytest

from filingpanel.llm import suffixes


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    rows = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if count[d[i:i + length]] > 1:
                gone[i:i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        rows.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return rows


def corpus(rng, n=60):
    letters = "abcdé \n"
    passages = ["".join(rng.choices(letters, k=k)) for k in (18, 19, 20, 21, 24, 33, 60, 150)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts.append("".join(rng.choices(letters, k=rng.randrange(0, 40))))
            p = rng.choice(passages)
            if rng.random() < 0.4:  # an edited copy
                i = rng.randrange(len(p))
                p = p[:i] + rng.choice("xyz") + p[i + 1:]
            parts.append(p)
        out.append("".join(parts))
    return out + out[:4] + ["", None, "short", "a" * 19, "a" * 20, "a" * 90, "ab" * 60, "é" * 30]


def test_loser_tree_merges_with_common_prefixes():
    rng = random.Random(1)
    for runs in (0, 1, 2, 5, 9):
        lists = [sorted(bytes(rng.choices(b"ab", k=rng.randrange(0, 9))) for _ in range(rng.randrange(0, 30))) for _ in range(runs)]
        coded = [suffixes.front_coded([(s, b"x" + s) for s in r]) for r in lists]
        got = list(suffixes.merged([suffixes.read_run(c) for c in coded]))
        want = sorted(s for r in lists for s in r)
        assert [s for s, _, _ in got] == want and all(load == b"x" + s for s, _, load in got)
        assert [c for _, c, _ in got][1:] == [suffixes.common_prefix(a, b) for a, b in zip(want, want[1:])]


def test_common_prefix():
    rng = random.Random(2)
    for _ in range(500):
        same = bytes(rng.choices(b"ab", k=rng.randrange(0, 200)))
        a, b = same + bytes(rng.choices(b"ab", k=rng.randrange(0, 5))), same + bytes(rng.choices(b"ab", k=rng.randrange(0, 5)))
        want = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
        assert suffixes.common_prefix(a, b) == suffixes.common_prefix(a, b, rng.randrange(0, want + 1)) == want


@pytest.mark.parametrize("gram,hot", [(5, 20000), (8, 20000), (20, 20000), (5, 3)])
def test_cut_is_the_brute_one(spark, gram, hot):
    texts = corpus(random.Random(gram + hot))
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.cut_repeats(df, 20, gram, hot).collect()}
    want = brute(texts, 20)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i])


def test_long_texts_are_cut_in_blocks(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(suffixes, "BLOCK", 64)
    texts = [t.encode() for t in ("".join(rng.choices("abc", k=500)), "".join(rng.choices("abc", k=100)))]
    whole = set()
    for owners, data, sizes in suffixes._pieces(texts, 20):
        at = 0
        for (i, place), size in zip(owners, sizes):
            assert texts[i][place:place + size] == data[at:at + size]
            whole |= {(i, place + s) for s in range(size - 19)}
            at += size
    assert whole == {(i, s) for i, t in enumerate(texts) for s in range(len(t) - 19)}


def test_edge_tables(spark):
    df = spark.createDataFrame([(None, "q" * 50), (1, "x"), (1, "x"), (2, "y" * 10)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.n_removed) for r in suffixes.cut_repeats(df, 20, 5).collect()) == [("1", 0), ("1", 0), ("2", 0), ("None", 50)]
    twice = df.where("text like 'q%'").union(df.where("text like 'y%'")).union(df.where("text like 'y%'"))
    assert sorted((str(r.doc_id), r.n_removed) for r in suffixes.cut_repeats(twice, 10, 5).collect()) == [("2", 10), ("2", 10), ("None", 50)]
    assert suffixes.cut_repeats(df.limit(0)).count() == 0


def test_passages_of_over_50_words_are_found_below_400_bytes(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(1, 7))) for _ in range(n))
    passages = [prose(rng.randrange(51, 60)) for _ in range(8)]
    assert max(map(len, passages)) < suffixes.LENGTH
    texts, planted = [prose(rng.randrange(0, 300)) for _ in range(80)], {}
    for i in range(0, 32):
        planted[i] = passages[i % 8]
        texts[i] = f"{texts[i]}\n{planted[i].replace(' ', '  ', i % 3)} {prose(i)}"
    texts += [None, "", prose(30), " ".join(["again"] * 60), prose(200).replace(" ", " \n")]
    texts += [passages[0][:len(passages[0]) // 3] + " " + prose(60)]  # fewer words than a print has
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_removed, r.n_shared) for r in suffixes.cut_repeats(df).collect()}
    assert {i for i, (_, n) in got.items() if n} == set(planted) and len(got) == len(texts)
    assert not any(removed for removed, _ in got.values())
    copies = spark.createDataFrame([(None, texts[40] + prose(50)), (7, "x y")] * 3, "doc_id long, text string").repartition(1)
    assert sorted((r.doc_id or 0, r.n_shared > 0) for r in suffixes.cut_repeats(copies).collect()) == [(0, True)] * 3 + [(7, False)] * 3


def test_prints_are_those_of_each_window():
    rng = random.Random(5)
    texts = [b" ".join(rng.choice([b"a", b"bb", "\u00e9".encode()]) for _ in range(n)) for n in (0, 3, 7, 8, 9, 40, 5, 200)]
    owner, prints = suffixes.word_prints(texts, 8, 3)
    whole = {(o, p) for o, p in zip(owner.tolist(), prints.tolist())}
    assert len(whole) == len(owner)
    for i, t in enumerate(texts):
        words = t.split()
        alone = {p for n in range(len(words) - 7) for p in suffixes.word_prints([b" ".join(words[n:n + 8])], 8, 3)[1].tolist()}
        assert alone == {p for o, p in whole if o == i}
