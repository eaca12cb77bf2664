import random
import re
from fractions import Fraction
from itertools import permutations

from filingpanel.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, mask string, n string"  # the last two clash with names of the operator
LABELS = "doc_id long, quality int, toxic int"


def rows():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 8)))
    texts = ["", None, "é" * 50, "A" * 10 + "b" * 90, "Ab\tcd\x0bef", "x " * 100, "# " + "y " * 120, "Über" * 30]
    for _ in range(60):
        t = " ".join(word() for _ in range(rng.choice([5, 99, 100, 150, 400])))
        if rng.random() < 0.3:
            t = t.upper()
        if rng.random() < 0.3:
            t += rng.choice(["#", "a&b", "|", "€"])
        if rng.random() < 0.3:
            t = " ".join([t] * 3)
        texts += [t] * rng.choice([1, 1, 2, 5])
    rng.shuffle(texts)
    out = [(i * 3 % 211, t, rng.choice(["en", "fr", None, ""]), "m", "n") for i, t in enumerate(texts)]
    copy = next(r for r in out if r[1])
    return out + [copy, copy, (None, copy[1], "en", "m", "n"), (None, "only here " * 60, "de", "m", "n"), (500, copy[1], "de", "m", "n")]


def marks():
    return [(i, i % 2, i % 3 == 0) for i in range(0, 150)] + [(4, 0, 0), (4, 1, 1), (None, 1, 1), (7, None, None)]


def fails(docs):
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, t, part, *_ in docs:
        t = t or ""
        words = [w for w in re.split("[\x20\x09-\x0D]+", t) if w]
        f = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words),
             "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), "D": any(c in "#$%&*|" for c in t),
             "E": i is not None and i > least[t]}
        yield i, part or "", "".join(k for k, v in f.items() if v)


def brute(docs, labels):
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x}
    judged, out = list(fails(docs)), {}
    for part in {p for _, p, _ in judged}:
        own, total = [(i, f) for i, p, f in judged if p == part], dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                removed, left = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                total[f] += len(removed)
                out[part, order, step] = [len(left), len(removed), sum(f in x[1] for x in own) - len(removed), sum(x[1] == f for x in own),
                                          sum(i in good for i, _ in removed), sum(i in toxic for i, _ in removed), f]
        for k, v in out.items():
            if k[0] == part:
                v[-1] = total[v[-1]]
    return out


def as_dict(df):
    return {tuple(r)[:3]: list(r)[3:] for r in df.collect()}


def test_all_orders(spark):
    docs, labels = rows(), [(i, q, int(x) if x is not None else None) for i, q, x in marks()]
    got = as_dict(filter_audit.filter_audit(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame(labels, LABELS)))
    assert got == brute(docs, labels)
    assert len(got) == 4 * 120 * 5


def test_empty_tables(spark):
    docs, labels = rows(), []
    none = spark.createDataFrame([], LABELS)
    assert as_dict(filter_audit.filter_audit(spark.createDataFrame(docs, SCHEMA), none)) == brute(docs, labels)
    empty = filter_audit.filter_audit(spark.createDataFrame([], SCHEMA), none)
    assert empty.count() == 0 and len(empty.columns) == 10


def test_least_squares_gives_shapley_values():
    rng = random.Random(1)
    for players in range(1, 6):
        values = [rng.randrange(1000) for _ in range(1 << players)]
        orders = list(permutations(range(players)))
        want = [Fraction(0)] * players
        for order in orders:
            before = 0
            for p in order:
                want[p] += Fraction(values[before | 1 << p] - values[before], len(orders))
                before |= 1 << p
        assert filter_audit.shapley_values(values, players) == want


def test_text_stays_out_of_the_shuffle(spark):
    plan = filter_audit.counts(spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame([], LABELS))._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "text#" in line]
