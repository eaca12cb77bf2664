"""Personal data: patterns propose spans, check digits confirm them, words nearby move the score.

Fixed values (kinds in output order, base scores, context words, patterns) stand together below.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices

# Fixed values. Base kinds are always reported; the others only from THRESHOLD on.
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
BASE_KINDS = KINDS[:4]
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
CONTEXT = {
    "email": ["email", "e-mail", "mail", "contact", "write"],
    "ip": ["ip", "address", "host", "server", "login"],
    "card": ["card", "visa", "credit", "debit", "payment"],
    "phone": ["phone", "call", "tel", "mobile", "fax"],
    "iban": ["iban", "bank", "account", "transfer"],
    "ssn": ["ssn", "social", "security"],
}
CONTEXT_BONUS, CONTEXT_CHARS, THRESHOLD = 0.3, 48, 0.5
LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}(?![A-Za-z0-9])")
# Characters of an IBAN by country.
IBAN_LENGTH = {country: int(n) for n, countries in {
    "15": "NO", "16": "BE", "18": "DK FI FO GL NL SD", "19": "MK SI", "20": "AT BA EE KZ LT LU MN XK", "21": "CH CR HR LI LV",
    "22": "BG BH DE GB GE IE ME RS VA", "23": "AE GI IL IQ OM SO TL", "24": "AD CZ ES MD PK RO SA SE SK TN VG",
    "25": "LY PT ST", "26": "IS TR", "27": "BI DJ FR GR IT MC MR SM", "28": "AL AZ BY CY DO GT HN HU LB NI PL SV",
    "29": "BR EG PS QA UA", "30": "JO KW MU YE", "31": "MT SC", "32": "LC", "33": "RU"}.items() for country in countries.split()}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
WORDS = {kind: re.compile(r"(?<![a-z])(?:" + "|".join(map(re.escape, words)) + r")(?![a-z])")
         for kind, words in CONTEXT.items()}
DIGITS = re.compile("[0-9]")

SPANS = "array<struct<kind: string, start: int, end: int, score: double>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                 ("score", pa.float64())]))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each ``@`` outwards in linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        head = text[done:at]
        start = done + len(head.rstrip(LOCAL_PART))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Numbers whose check digits hold, each at most once.

    Upper-case words and numbers behind an IBAN look like further groups, so every group boundary of a match is tried:
    that of the country's length first, then from the longest down. Without any, the search goes on right behind the start,
    as what looks like a group can be the start of an IBAN.
    """
    m = IBAN.search(text)
    while m:
        start, size = m.start(), IBAN_LENGTH.get(m.group()[:2])
        ends = [m.end(), *(i for i in range(m.end() - 1, start, -1) if text[i] == " ")]
        compact = [(end, text[start:end].replace(" ", "")) for end in ends]
        compact.sort(key=lambda c: len(c[1]) != size)
        end = next((end for end, c in compact if 15 <= len(c) <= 34 and mod97(c)), None)
        if end:
            yield start, end
        m = IBAN.search(text, end or start + 1)


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    for start, end in emails(text):
        yield "email", start, end
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = "".join(DIGITS.findall(m.group()))
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    for m in PHONE.finditer(text):
        if 9 <= len(DIGITS.findall(m.group())) <= 15:
            yield "phone", m.start(), m.end()
    for start, end in ibans(text):
        yield "iban", start, end
    for m in SSN.finditer(text):
        yield "ssn", m.start(), m.end()


def find(text: str) -> list[tuple[str, int, int, float]]:
    """Spans (kind, start, end, score) of a text in code points, by start, then kind as listed."""
    found = []
    for kind, start, end in _proposals(text):
        near = text[max(0, start - CONTEXT_CHARS):start] + " " + text[end:end + CONTEXT_CHARS]
        score = min(1.0, SCORE[kind] + CONTEXT_BONUS * bool(WORDS[kind].search(near.lower())))
        if kind in BASE_KINDS or score >= THRESHOLD:
            found.append((kind, start, end, round(score, 3)))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return found


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Replace each span by its kind in brackets; overlapping spans become one, named after the first."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end, _ = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``spans`` (kind, start, end, score).

    Null text counts as empty and has no spans; null ids pass through; repeated rows are judged each for itself.
    All searches are linear in the length of the text. Rows never leave their task.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            spans = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find(t)]
                     for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPAN_TYPE)], ["doc_id", "spans"])

    df = id_text(docs, id_col, text_col)
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda k: k == kind


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact_pii(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The documents with their spans replaced in the text; ``length_col`` gets the new number of characters.

    Null texts stay null. All other columns pass through.
    """
    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redact(t, find(t)))

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    return out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType)) if length_col else out
