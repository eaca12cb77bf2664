import hashlib
import random
import re

import pytest

from filingpanel.llm import pii, queries

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def luhn(d):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0


def brute(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(EMAIL, text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(CARD, text):
        d = re.sub("[^0-9]", "", m.group())
        out += [("card", m.start(), m.end())] if 12 <= len(d) <= 19 and luhn(d) else []
    out += [("phone", m.start(), m.end()) for m in re.finditer(PHONE, text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], ["email", "ip", "card", "phone"].index(s[0])))


TEXTS = ["", "a@b.c", "@@a@b", "x.y+z@dom-a.co.uk, a@b@c.d e@f.g.", "1.2.3.4.5.6.7.8 300.1.1.1 1.2.3.256", "4111 1111 1111 1111 and 4111-1111-1111-1112",
         "é\U0001f600 +49 (30) 123-456 78 +1", "4111  1111111111111111", "ip 0010.0.0.1 +1 (555) 010-9999.", "a@b..c a@-.- %@x.y", "+" * 50 + "1" * 30,
         "call +441234567890 4111111111111111 5500005555555559 123456789012"]


def rand_texts(n):
    rng = random.Random(4)
    return ["".join(rng.choices("ab@@..-+ 0123456789()é", k=rng.randrange(0, 120))) for _ in range(n)]


@pytest.mark.parametrize("texts", [TEXTS, rand_texts(2000)])
def test_base_spans_are_those_of_the_patterns(texts):
    for t in texts:
        assert [s[:3] for s in pii.find(t) if s[0] in pii.BASE_KINDS] == brute(t), t


def test_long_runs_stay_linear():
    for t in ("1" * 200000, "a" * 200000, "a@" * 50000, "+1" + " " * 100000, "1." * 60000, "A" * 100000):
        pii.find(t)


def test_check_digits_and_context():
    assert [s[0] for s in pii.find("my iban is DE89 3704 0044 0532 0130 00 ok")] == ["iban"]
    assert pii.find("DE88370400440532013000") == []
    assert [s[0] for s in pii.find("social security 123-45-6789")] == ["ssn"] and pii.find("part 123-45-6789") == []
    plain, near = pii.find("zz 10.0.0.1")[0], pii.find("server 10.0.0.1")[0]
    assert plain[:1] == near[:1] and near[3] > plain[3]


def test_redaction():
    t = "mail a@b.co or +49 30 1234567 now"
    assert pii.redact(t, pii.find(t)) == "mail [EMAIL] or [PHONE] now"
    assert pii.redact("abcdef", [("x", 1, 4, 1.0), ("y", 2, 5, 1.0)]) == "a[X]f"


def test_rows(spark, tmp_path):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a@b.c", None), (1, "a@b.c", None), (99, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op5_pii(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = brute("a@b.c" if r.doc_id is None else (TEXTS[r.doc_id] if r.doc_id < 99 else ""))
        kinds = [s[0] for s in spans]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(kinds.count, ("email", "ip", "card", "phone")))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    clean = pii.redact_pii(df.withColumn("n_chars", pii.F.lit(7).cast("long")), length_col="n_chars")
    assert clean.columns == [*df.columns, "n_chars"]
    assert {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}[99] == (None, None)
    assert all(len(r.text) == r.n_chars for r in clean.where("text is not null").collect())
    assert pii.pii_spans(df.limit(0)).count() == 0


@pytest.mark.parametrize("behind", [" EUR 500", " BIC COBADEFF", " I said", " 500", " USD", " BIC COBADEFFXXX", " A B C D E F", "", ".", " GB"])
@pytest.mark.parametrize("iban", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S",
                                  "GB82 WEST 1234 5698 7654 32"])
def test_iban_before_words_and_numbers(iban, behind):
    assert [s[:3] for s in pii.find("x " + iban + behind) if s[0] == "iban"] == [("iban", 2, 2 + len(iban))]


def test_iban_behind_what_looks_like_its_start():
    t = "REF AB12 DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32"
    assert [t[s[1]:s[2]] for s in pii.find(t) if s[0] == "iban"] == ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]
    assert [s for s in pii.find("DE88 3704 0044 0532 0130 00 EUR 500 BIC") if s[0] == "iban"] == []
    pii.find("AB12 " * 40000)
