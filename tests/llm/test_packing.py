import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from filingpanel.llm import packing

PATH = P.path("word_bpe_49k.json")
TEXTS = ["", None, " \n ", "Hello, World!", "it's 'they'll' DON'T.", "éÉ ñandú, ЖУК. ÅÅ İI Kelvin ς Σ ΟΔΟΣ", "a\x1cb\x85c\xa0d,e", "éá. Å,",
         "12,345.67 x2 2x. ... !?", "日本語。テスト,", "<|endoftext|> a<|endoftext|>. b", "##$$%% foo### bar***.", "word " * 9000, "x" * 20000, "\U0001f600!. ok?!", "ªº ǅ ŉ ß"]


def rand_texts(n):
    rng = random.Random(3)
    alphabet = "abcdeABC  \n.,;:!?'s\"019éÉñ日ß\t-|#" + "etaoin"
    return ["".join(rng.choices(alphabet, k=rng.randrange(0, 300))) for _ in range(n)]


def test_ids_are_those_of_the_library():
    whole = Tokenizer.from_file(PATH)
    cache = packing.WordCache(open(PATH, "rb").read())
    for t in [t or "" for t in TEXTS] + rand_texts(400):
        got = np.frombuffer(b"".join(cache[w] for w in t.encode().split()), "<u4").tolist()
        assert got == whole.encode(t, add_special_tokens=False).ids, t[:60]


def test_pieces_and_sequences(spark):
    whole = Tokenizer.from_file(PATH)
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "Hello", None), (3, TEXTS[3], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = packing.packed_documents(df, PATH).collect()
    want = []
    for i, t, _ in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[at:at + 4096], "<u4")
            want.append((str(i), n, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    check_sequences(got)
    assert len({r.sequence_id for r in got}) == -(-sum(w[3] for w in want) // 4096)
    assert packing.packed_documents(df.limit(0), PATH).count() == 0


def check_sequences(rows):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_groups_are_bounded_and_well_filled(spark):
    rng = random.Random(1)
    lengths = [min(4096, int(rng.expovariate(1 / 900)) + 1) for _ in range(6000)]
    df = spark.createDataFrame([(i, 0, 0, n, 7) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(df, group_pieces=1500).collect()
    assert len(got) == 6000 and len({r.sequence_id >> 40 for r in got}) == 4
    check_sequences(got)
    assert len({r.sequence_id for r in got}) <= -(-sum(lengths) // 4096) + 8


def test_equal_rows_spread_over_the_groups(spark):
    rows = spark.range(40000).repartition(6).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        F.lit(1).cast("long").alias("length"), F.lit(9).cast("long").alias("ids_crc32"))
    got = packing.pack(rows, group_pieces=4000).groupBy(F.shiftright("sequence_id", 40).alias("g")).count().collect()
    assert len(got) == 10 and max(r["count"] for r in got) < 5000


def test_the_place_is_where_the_squares_become_smallest():
    rng = random.Random(2)
    lengths = [rng.randrange(1, 13) for _ in range(300)]
    bins, offsets = packing.sum_of_squares(np.array(lengths), 16)
    level = defaultdict(int)
    for s, b, o in zip(lengths, bins.tolist(), offsets.tolist()):
        def squares(place):
            count = defaultdict(int)
            for k, v in {**level, place: level[place] + s if place in level else s}.items():
                count[16 - v] += 16 - v > 0
            return sum(c * c for c in count.values())
        fits = [k for k, v in level.items() if v + s <= 16]
        if fits:
            assert b in fits and squares(b) == min(map(squares, fits))
        else:
            assert b not in level
        assert o == level.get(b, 0)
        level[b] = o + s
