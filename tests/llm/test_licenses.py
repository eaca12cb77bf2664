import re
import string

from filingpanel.llm import licenses


def brute(text, templates=licenses.TEMPLATES):
    low = (text or "").translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    base, labels, score = [], set(), 0.0
    for t in templates:
        key, words = t.key.split(), t.text.split()
        shift = next(s for s in range(len(words)) if words[s:s + len(key)] == key)
        for at in range(len(w) - len(key) + 1):
            if w[at:at + len(key)] == key:
                labels.add(t.label)
                score = max(score, sum(0 <= at - shift + k < len(w) and w[at - shift + k] == x for k, x in enumerate(words)) / len(words))
                if t.base:
                    base.append((at, t.label))
    return (len(w), len(base), min(base)[0] if base else None, max(base)[0] if base else None,
            ",".join(sorted({b[1] for b in base})), ",".join(sorted(labels)), score)


TEXTS = ["", None, "...", "Under the MIT License", "x under the\nMIT-License. under the mit license", "CC BY-NC 4.0 cc by nc cc by",
         "underthe mit license", "under the Kmit license", "under the mitİ license worK", "Apache License, Version 2.0.",
         "This work is licensed under the GNU General Public License, version 3.", "mit mit license the mit license under",
         "Licensed under the Apache License, Version 2.0 (the License); you may not use", "a " * 50000 + "cc by nc" + " b" * 20,
         "é CC`BY{NC} ü", "license\x00apache license version 2"]


def test_scan_is_the_brute_one(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None)], "doc_id long, text string, places string")
    rows = licenses.license_labels(licenses.license_places(df)).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        assert tuple(r)[1:] == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]
    assert licenses.license_labels(licenses.license_places(df.limit(0))).count() == 0


def test_anchors_are_the_rarest_words(spark):
    df = spark.createDataFrame([(i, "the mit under") for i in range(5)] + [(9, "license the")], "doc_id long, text string")
    t = licenses.Template("mit", True, "under the mit license", "under the mit license")
    assert licenses.anchors(df, [t])[0][0] == 3
