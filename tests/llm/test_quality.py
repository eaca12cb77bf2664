import math
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from filingpanel.llm import quality


def brute(text):
    text = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", text)
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i:i + 3]), []).append(i)
    covered = {j for at in where.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


TEXTS = ["", None, " \n\t\r\x0b\x0c ", "a", "a b", "a b c", "a b c a b c", "x x x x x", "l one\nl one\n\n\nl one \nl two\r\nl two",
         "é # ** $ % &|<> \U0001f600 b\x1cb", "a a a b a a a", "\n\n a b c\n a b c \n", "w " * 30000, "|" * 5000,
         " ".join(f"w{i % 7}" for i in range(60))]


def test_counts_are_the_brute_ones(spark):
    rows = [(i, t, "en", "extra") for i, t in enumerate(TEXTS)] + [(0, "", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string")
    got = {(r.doc_id, r.stratum): (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
           for r in quality.features(df).collect()}
    assert got == {**{(i, "en"): brute(t) for i, t in enumerate(TEXTS)}, (0, "(none)"): brute("")}


@pytest.mark.parametrize("n,alpha", [(1, 0.3), (40, 0.1), (500, 0.02), (3000, 0.005)])
def test_tail_is_the_exact_one(spark, n, alpha):
    ks = sorted({min(n, k) for k in (0, 1, 2, 3, 5, 9, n)})
    a = Fraction(alpha)
    want = [float(sum(math.comb(n, j) * a**j * (1 - a)**(n - j) for j in range(k + 1))) if k < n * alpha else 1.0 for k in ks]
    got = spark.createDataFrame([(k, n) for k in ks], "k long, n long").select(
        quality.binomial_tail(F.col("k"), F.col("n"), alpha).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx(want, rel=1e-9)


def labelled(rng, lang, n, bad):
    """Good documents of varied words; bad ones with symbols in every word."""
    rows = []
    for i in range(n):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}" for _ in range(60)]
        if i < bad:
            words = [x + "###" for x in words]
        rows.append((" ".join(words), lang, int(i >= bad)))
    return rows


def test_cutoffs_catch_bad_and_spare_good(spark):
    rng = random.Random(1)
    rows = labelled(rng, "en", 1500, 200) + labelled(rng, "fr", 60, 20) + labelled(rng, None, 80, 10)
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang, _) in enumerate(rows)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q, None) for i, (_, _, q) in enumerate(rows)] + [(3, None, 1), (9999, 1, 0)],
                                   "doc_id long, quality int, text string")
    out = {r.doc_id: r.kept for r in quality.quality_verdicts(docs, labels).collect()}
    refused = {i for i, k in out.items() if not k}
    assert refused == {i for i, (_, lang, q) in enumerate(rows) if q == 0 and lang == "en"}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(out) - refused
    # too few labels: nothing can be certified, so only the base rule refuses
    few = quality.quality_verdicts(docs, labels.where("doc_id < 250"))
    assert few.where("not kept").count() == 0
    assert quality.quality_verdicts(docs, labels.limit(0)).where("not kept").count() == 0
    assert quality.quality_verdicts(docs.limit(0), labels).count() == 0


def test_strata_without_a_certificate_refuse_nothing(spark):
    """Languages with few or no labels keep all that pass the base rules, however many others are certified."""
    rng = random.Random(3)
    rows = labelled(rng, "en", 1500, 200) + labelled(rng, "de", 1500, 150) + labelled(rng, "fi", 300, 100) + labelled(rng, "xx", 90, 60)
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang, _) in enumerate(rows)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q) for i, (_, lang, q) in enumerate(rows) if lang != "xx"], "doc_id long, quality int")
    refused = {r.doc_id for r in quality.quality_verdicts(docs, labels).where("not kept").collect()}
    assert refused == {i for i, (_, lang, q) in enumerate(rows) if q == 0 and lang in ("en", "de")}
    feats = quality.features(docs)
    assert {r.stratum for r in quality.thresholds(feats, labels).collect()} == {"en", "de"}


@pytest.mark.parametrize("k", [4_900_000, 4_990_000, 4_999_000])
def test_tail_of_very_many_labels(spark, k):
    """n of a billion: the tail against the normal one with its first correction."""
    n, alpha = 10**9, 0.005
    sd = math.sqrt(n * alpha * (1 - alpha))
    z = (k + 0.5 - n * alpha) / sd
    skew = (1 - 2 * alpha) / sd
    want = 0.5 * math.erfc(-z / math.sqrt(2)) - skew / 6 * (z * z - 1) * math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), alpha).alias("p")).first().p
    assert got == pytest.approx(want, rel=2e-4) or max(got, want) < 1e-200


def test_a_rule_is_refused_when_it_would_cost_good_documents(spark):
    rng = random.Random(2)
    rows = labelled(rng, "en", 1500, 200)
    flip = [(t, lang, 1 if i < 100 else q) for i, (t, lang, q) in enumerate(rows)]  # half of the symbol texts are good
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang, _) in enumerate(flip)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q) for i, (_, _, q) in enumerate(flip)], "doc_id long, quality int")
    assert quality.quality_verdicts(docs, labels).where("not kept").count() == 0
