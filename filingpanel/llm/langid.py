"""Language identification: averaged hashed subword embeddings with a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_SHIPPED_BYTES, as_bytes, slices

# Bounds of the fit: at most about SAMPLE_DOCS labelled documents, spread evenly over the languages.
SAMPLE_DOCS, BUCKETS, DIM, EPOCHS, RATE, SEED = 4000, 1 << 15, 16, 6, 0.5, 7
TARGET_ACCURACY = 0.99  # accepted predictions of the calibration part
UNDETERMINED = "und"
SIZES = (2, 3, 4)  # bytes in a subword, with a space for the word's edge
LETTER = regex.compile(r"\p{L}")
# ASCII letters in lower case, other ASCII to spaces, the bytes of other characters unchanged
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Model(NamedTuple):
    langs: list[str]
    table: np.ndarray  # embedding times softmax weights, per bucket
    bias: np.ndarray
    temperature: float
    reject_below: float


def has_letter(text: bytes) -> bool:
    return text.translate(NORMAL).strip(b" ") != b"" and LETTER.search(text.decode()) is not None


def subwords(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every subword and the number of its text. A subword lies within one word and its edges."""
    joined = b"".join(b" " + t.translate(NORMAL) + b" " for t in texts)
    data = np.frombuffer(joined, np.uint8)
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    blank = data == 32
    buckets, owners = [], []
    for n in SIZES:
        count = len(data) - n + 1
        if count <= 0:
            continue
        code, inner = np.full(count, n, np.uint32), np.zeros(count, bool)
        for j in range(n):
            code = code * np.uint32(0x01000193) ^ data[j:j + count]
            if 0 < j < n - 1 or n == 2 and j == 0:
                inner |= blank[j:j + count] if n > 2 else blank[:count] & blank[1:1 + count]
        # two texts meet at two spaces, which no subword holds inside
        keep = ~inner & ~(blank[:count] & blank[n - 1:n - 1 + count])
        code = code[keep]
        code ^= code >> np.uint32(15)
        buckets.append((code * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKETS.bit_length() + 1))
        owners.append(owner[:count][keep])
    if not buckets:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def logits(model: Model, texts: list[bytes]) -> np.ndarray:
    """One row per text: the mean of its subwords' rows in the table, plus the bias."""
    bucket, owner = subwords(texts)
    count = np.bincount(owner, minlength=len(texts))
    out = np.stack([np.bincount(owner, model.table[bucket, k], len(texts)) for k in range(len(model.langs))], axis=1)
    return out / np.maximum(count, 1)[:, None] + model.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Stochastic gradient descent, one document a step; returns the table (embedding times weights) and the bias."""
    rng = np.random.default_rng(SEED)
    embed = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, langs), np.float32), np.zeros(langs, np.float32)
    steps, done = EPOCHS * len(bags), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            at, share = bags[i]
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            mean = share @ embed[at]
            error = softmax(mean @ weights + bias)
            error[labels[i]] -= 1
            back = weights @ error
            weights -= rate * np.outer(mean, error)
            bias -= rate * error
            # the step of a mean moves each of its rows by its share; scaled up so that long texts learn as fast
            embed[at] -= rate * np.outer(share / share.max(), back)
    return embed @ weights, bias


def calibrate(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Temperature with the least log loss, and the lowest score from which the predictions are right often enough."""
    if not len(z):
        return 1.0, 0.0
    loss = lambda t: -np.log(np.maximum(softmax(z / t)[np.arange(len(z)), labels], 1e-12)).mean()
    temperature = min(np.geomspace(0.05, 20, 81), key=loss)
    p = softmax(z / temperature)
    score, right = p.max(axis=1), p.argmax(axis=1) == labels
    order = np.argsort(-score, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= TARGET_ACCURACY
    return float(temperature), float(score[order][np.flatnonzero(good)[-1]]) if good.any() else 1.0


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that training must not see; a null id is neither held out nor learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text",
        lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of the labelled documents that are not held out; a fifth of it calibrates.

    Rows are drawn by a hash of their id, at a rate per language that gives each an equal part of ``sample_docs``.
    Subwords of whole texts are counted in the tasks; only counts reach the driver, where the small model is trained.
    """
    learn = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    sizes = {r["lang"]: r["count"] for r in learn.groupBy(F.col(lang_col).alias("lang")).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    each = max(1, sample_docs // len(langs))
    rates = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, each / sizes[lang]))])
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    chosen = learn.where(draw < F.element_at(rates, F.col(lang_col))).select(
        draw.alias("draw"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            bags = [np.unique(subwords([t])[0], return_counts=True) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("draw"), batch.column("lang"), pa.array([b.astype(np.int32) for b, _ in bags], pa.list_(pa.int32())),
                 pa.array([c.astype(np.int32) for _, c in bags], pa.list_(pa.int32()))], ["draw", "lang", "bucket", "count"])

    drawn = chosen.mapInArrow(count, "draw double, lang string, bucket array<int>, count array<int>").toArrow()
    rows = sorted(
        ((draw, lang, tuple(bucket[:8].tolist()), bucket, count) for draw, lang, bucket, count in zip(
            drawn.column("draw").to_pylist(), drawn.column("lang").to_pylist(), _arrays(drawn.column("bucket")),
            _arrays(drawn.column("count"))) if len(bucket)), key=lambda r: r[:3])
    bags = [(bucket, (count / count.sum()).astype(np.float32)) for _, _, _, bucket, count in rows]
    labels = np.array([langs.index(lang) for _, lang, *_ in rows], np.int64)
    part = np.arange(len(rows)) % 5 == 4
    table, bias = train([b for b, p in zip(bags, part) if not p], labels[~part], len(langs))
    z = np.array([share @ table[at] + bias for (at, share), p in zip(bags, part) if p]).reshape(-1, len(langs))
    return Model(langs, table, bias, *calibrate(z, labels[part]))


def _arrays(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    for chunk in column.chunks:
        yield from (x.values.to_numpy() for x in chunk)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` per row, from the text alone.

    A null text or one without a letter gets ``und`` and score 0; so does every text if nothing was learnt. ``rejected``
    marks scores below the calibrated bound. Repeated rows are predicted each; whole texts count; no shuffle.
    """
    if model.table.nbytes > MAX_SHIPPED_BYTES:
        raise ValueError(f"the model has {model.table.nbytes} bytes; at most {MAX_SHIPPED_BYTES} are sent to the tasks")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.langs, UNDETERMINED], object)
        for batch in slices(batches, "text", 2 << 20):
            texts = as_bytes(batch.column("text"))
            known = np.array([bool(m.langs) and has_letter(t) for t in texts])
            best, score = np.full(len(texts), len(m.langs)), np.zeros(len(texts))
            if known.any():
                p = softmax(logits(m, texts) / m.temperature)
                best[known], score[known] = p.argmax(axis=1)[known], p.max(axis=1)[known]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names[best], pa.string()), pa.array(score), pa.array(score < m.reject_below)],
                ["doc_id", "lang_pred", "score", "rejected"])

    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
