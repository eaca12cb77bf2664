"""The stages against direct computations over small tables."""

import random
import zlib

import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline
from filingpanel.llm import pii
from test_packing import check_sequences
from test_quality import brute as counts
from test_simhash import jaccard_components, shared_passages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(3, 9)))
    texts = []
    for _ in range(25):
        words = [word() for _ in range(rng.randrange(40, 260))]
        texts.append(" ".join(words))
        if rng.random() < 0.5:
            texts.append(" ".join(words))
        if rng.random() < 0.5:
            words[rng.randrange(len(words))] = "edited"
            texts.append(" ".join(words))
        if rng.random() < 0.3:
            texts.append(" ".join(words) + " write to me@example.org or +49 30 1234567")
    texts += shared_passages(rng, [2 * j / (1 + j) for j in (0.6, 0.7, 0.75, 0.79, 0.81, 0.85) for _ in range(3)], 120)
    texts += ["", None, "a b c " * 100, " ".join(word() for _ in range(6000))]
    rng.shuffle(texts)
    return [(i, t, rng.choice(["en", "fr", None]), "s", len(t) if t else 0) for i, t in enumerate(texts)]


def expected(rows):
    good = [r for r in rows if (c := counts(r[1]))[0] >= 50 and 100 * c[4] <= 50 * c[0]]
    first = {}
    for r in good:
        first.setdefault(r[1], r)
    exact = list(first.values())
    ids = [r[0] for r in exact]
    near = [r for r, c in zip(exact, jaccard_components(ids, [r[1] for r in exact])) if r[0] == c]
    clean = []
    for i, t, lang, source, _ in near:
        t = pii.redact(t, pii.find(t))
        clean.append((i, t, lang, source, len(t)))
    return good, exact, near, clean


def test_stages(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, expected(rows)):
        now = stage(spark, now, str(tmp_path))
        assert now.schema.simpleString() == docs.schema.simpleString()
        got = sorted(map(tuple, now.collect()))
        assert got == sorted(want), name
        now = spark.createDataFrame(got, SCHEMA)
    assert len(want) < len(rows) and any("[EMAIL]" in r[1] for r in want)
    tokenizer, pieces = Tokenizer.from_file(P.path("word_bpe_49k.json")), []
    for i, t, *_ in want:
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4")
        pieces += [(i, n, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes())) for n, at in enumerate(range(0, len(ids), 4096))]
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in whole) == sorted(pieces)
    check_sequences(whole)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
