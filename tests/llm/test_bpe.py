import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from filingpanel.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", None, " ", "\n", "a", "Hello world", "  two  spaces ", "a\nb\n\nc\n", "it's 'they'll' we'd", "x\x1cy\x85z\xa0w　v",
         "日本語のテキスト 12345 ½²", "éä \U0001f600\U0001f468‍\U0001f469", "\ttab\r\nend\r\n", "<|endoftext|> is text",
         "word " * 20000, "a" * 5000, "ab" * 3000, "==== ----- ....", "line one\n line two\nline three \nfour", "\x00\x01 \x7f"]


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.read_ranks(open(PATH, "rb").read())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(open(PATH, "rb").read(), P.PATTERN)


def rand_texts(n):
    rng = random.Random(5)
    alphabet = "abcdefghij ABZ  \n\n.,;'\"019é日ß \t" + "etaoin shrdlu"
    return ["".join(rng.choices(alphabet, k=rng.randrange(0, 400))) for _ in range(n)] + ["".join(rng.choices("abcdxyz", k=700)) for _ in range(5)]


def test_ids_are_those_of_the_library(codec, reference):
    texts = [t or "" for t in TEXTS] + rand_texts(300)
    got = [np.frombuffer(i, "<u4").tolist() for i in codec.encode(texts)]
    for t, ids in zip(texts, got):
        assert ids == reference.encode_ordinary(t), t[:50]
    assert codec.decode(codec.encode(texts)) == [t.encode() for t in texts]


def test_both_queries_agree(codec):
    pieces = [p.encode() for p in {"".join(random.Random(i).choices("abcdefgh", k=40)) for i in range(60)} | {"a" * n for n in range(2, 60)}]
    assert list(codec._merge(pieces, bpe.SHORT_SQL)) == list(codec._merge(pieces, bpe.LONG_SQL))


def test_full_caches_start_anew(reference, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_CACHED", 20)
    small = bpe.Codec(open(PATH, "rb").read(), P.PATTERN)
    for t in rand_texts(20):
        assert np.frombuffer(small.encode([t])[0], "<u4").tolist() == reference.encode_ordinary(t)


def test_rows(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a", None), (4, "a", None)],
                               "doc_id long, text string, ids string")
    rows = bpe.round_trip(df, PATH, P.PATTERN).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        t = "a" if r.doc_id is None else TEXTS[r.doc_id] or ""
        ids = np.array(reference.encode_ordinary(t), "<u4")
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    back = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted((r.doc_id or -1, bytes(r.bytes)) for r in back) == sorted(
        [(i or -1, (t or "").encode()) for i, t in enumerate(TEXTS)] + [(-1, b"a"), (4, b"a")])
    assert bpe.round_trip(df.limit(0), PATH, P.PATTERN).count() == 0
