"""DuckDB SQL for queries whose text is built from the operators' fixed values."""

from __future__ import annotations

from . import filter_audit, licenses, quality


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values: list) -> str:
    return "[" + ", ".join(_text(v) if isinstance(v, str) else repr(v) for v in values) + "]"


def licenses_sql(templates: list[licenses.Template] = licenses.TEMPLATES) -> str:
    """Every place of every key phrase, found by comparing word lists at each position."""
    places = []
    for t in templates:
        text, key = t.text.split(), t.key.split()
        shift = next(s for s in range(len(text)) if text[s:s + len(key)] == key)
        share = " + ".join(f"(CASE WHEN i - {shift - k} >= 1 AND w[i - {shift - k}] = {_text(x)} THEN 1 ELSE 0 END)" for k, x in enumerate(text))
        places.append(
            f"SELECT doc_id, {_text(t.label)} AS label, {str(t.base).lower()} AS base, i - 1 AS place, ({share}) / {len(text)}.0::DOUBLE AS share "
            f"FROM (SELECT doc_id, w, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(key) - 1}] = {_list(key)})) AS i FROM d WHERE {' AND '.join(f'list_contains(w, {_text(x)})' for x in sorted(set(key)))})")
    return f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
places AS ({' UNION ALL '.join(places)}),
found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM places GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN found USING (doc_id)
"""


def quality_sql(alpha: float = quality.ALPHA, delta: float = quality.DELTA) -> str:
    """Counts from token rows and window functions; binomial tails as plain sums of terms."""
    rules = quality.CUTOFFS
    each = alpha / len(rules)
    stat = {"symbols": "n_symbols / nullif(word_chars, 0)", "dup_lines": "n_dup_lines / nullif(n_lines, 0)",
            "repeats": "n_repeat_words / nullif(n_words, 0)", "long_words": "word_chars / nullif(n_words, 0)"}
    cuts = ", ".join(f"({_text(r)}, {i}, {c}::DOUBLE)" for r, cs in rules.items() for i, c in enumerate(cs, 1))
    stats = " UNION ALL ".join(
        f"SELECT doc_id, stratum, base_failed, {_text(r)} AS rule, coalesce({s}, 0)::DOUBLE AS stat FROM counted" for r, s in stat.items())
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '(none)') AS stratum, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n
          FROM (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t))),
again AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM grams WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
counted AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM (SELECT doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
               (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
               coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
        FROM t LEFT JOIN again USING (doc_id) LEFT JOIN lines USING (doc_id))),
stats AS ({stats}),
cuts(rule, step, cut) AS (VALUES {cuts}),
marks AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
goods AS (SELECT stratum, count(*) FILTER (good) AS n_good FROM counted JOIN marks USING (doc_id) WHERE NOT base_failed GROUP BY stratum),
tested AS (
  SELECT stratum, rule, step, cut, count(*) FILTER (good AND stat > cut) AS k, count(*) FILTER (good) AS n,
         count(*) FILTER (NOT good AND stat > cut) AS caught, count(*) FILTER (NOT good) AS n_bad,
         (SELECT count(*) FROM goods WHERE n_good > 0) AS n_strata
  FROM (SELECT s.*, m.good FROM stats s JOIN marks m USING (doc_id) WHERE NOT base_failed) x JOIN cuts USING (rule)
  GROUP BY stratum, rule, step, cut),
passed AS (
  SELECT *, max(CASE WHEN n > 0 AND k < n * {each} AND list_sum(list_transform(range(0, k + 1), lambda j:
      exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({each}) + (n - j) * ln(1 - {each})))) <= {delta} / (n_strata * {len(rules)})
      THEN 0 ELSE 1 END) OVER (PARTITION BY stratum, rule ORDER BY step) AS failed FROM tested),
useful AS (SELECT *, caught / n_bad - {quality.GOOD_WEIGHT} * k / n AS benefit FROM passed WHERE failed = 0 AND caught > 0),
chosen AS (SELECT stratum, rule, cut FROM useful WHERE benefit > 0
           QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY benefit DESC, step) = 1),
refused AS (SELECT DISTINCT s.doc_id FROM stats s JOIN chosen c ON c.rule = s.rule AND c.stratum = s.stratum WHERE s.stat > c.cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM refused) AS kept
FROM counted
"""


def filter_audit_sql() -> str:
    """Every order applied step by step to the sets of failed filters; shares as plain sums over the orders."""
    letters = " CROSS JOIN ".join(f"(SELECT unnest({_list(list(filter_audit.FILTERS))}) AS f{i})" for i in range(1, 6))
    apart = " AND ".join(f"f{i} <> f{j}" for i in range(1, 6) for j in range(i + 1, 6))
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words, coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS again FROM t),
marks AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, doc_id,
         (CASE WHEN len(words) < {filter_audit.MIN_WORDS} THEN 'A' ELSE '' END)
         || (CASE WHEN 100 * len(list_distinct(words)) < {filter_audit.DISTINCT_PERCENT} * len(words) THEN 'B' ELSE '' END)
         || (CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {filter_audit.UPPER_PERCENT} * length(t) THEN 'C' ELSE '' END)
         || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN again THEN 'E' ELSE '' END) AS fails
  FROM w),
groups AS (
  SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS n_good, coalesce(sum(toxic), 0) AS n_toxic
  FROM failed LEFT JOIN marks USING (doc_id) GROUP BY part, fails),
orders AS (SELECT f1 || f2 || f3 || f4 || f5 AS filter_order FROM {letters} WHERE {apart}),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
gone AS (
  SELECT part, fails, n, n_good, n_toxic, filter_order,
         CASE WHEN fails = '' THEN 9 ELSE list_min(list_transform(string_split(fails, ''), lambda f: instr(filter_order, f))) END AS first_step
  FROM groups CROSS JOIN orders),
counted AS (
  SELECT part, filter_order, step, substr(filter_order, step, 1) AS f,
         sum(CASE WHEN first_step > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN first_step = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN first_step < step AND contains(fails, substr(filter_order, step, 1)) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails = substr(filter_order, step, 1) THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN first_step = step THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN first_step = step THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM gone JOIN steps USING (filter_order) GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM counted
"""


CRC_NIBBLES = [  # fixed values: CRC-32 (reflected polynomial EDB88320) of the sixteen half bytes
    0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
    0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C,
]


def prefix_trie_sql() -> str:
    """Prefixes as chained hashes, level by level; what a node has below it is added up along the conversations that own it."""
    crc = "4294967295::BIGINT"
    half = lambda c, b: f"xor({c} >> 4, nibbles[1 + (xor({c}, {b}) & 15)])"
    step = half("(" + half("acc", "b") + ")", "(b >> 4)")
    return f"""
WITH RECURSIVE t AS (
  SELECT conv_id, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS words, turn
  FROM (SELECT conv_id, turn, role, text FROM conversations) WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, g, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) - 1 AS p FROM t),
c AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(4294967295::BIGINT, list_reduce(list_prepend({crc}, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda acc, b: {step})) % 4 AS h
  FROM (SELECT DISTINCT conv_id, {_list(CRC_NIBBLES)}::BIGINT[] AS nibbles FROM o)),
r AS (
  SELECT c.conv_id, o.p AS place, o.g, o.words FROM c JOIN o ON o.conv_id = c.base AND o.p < c.h
  UNION ALL SELECT c.conv_id, o.p + 3, o.g, o.words FROM c JOIN o ON o.conv_id = c.conv_id AND o.p >= c.h),
d AS (SELECT conv_id, g, words, row_number() OVER (PARTITION BY conv_id ORDER BY place) AS depth FROM r),
k(conv_id, depth, key, parent, words) AS (
  SELECT conv_id, 0::BIGINT, '', NULL::VARCHAR, 0::BIGINT FROM c
  UNION ALL SELECT k.conv_id, d.depth, sha256(k.key || d.g), k.key, d.words FROM k JOIN d ON d.conv_id = k.conv_id AND d.depth = k.depth + 1),
l AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM k),
n AS (
  SELECT depth, key, min(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM l GROUP BY depth, key),
ch AS (SELECT depth - 1 AS depth, parent AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY depth, parent),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN ch USING (depth, key)),
owned AS (
  SELECT l.conv_id, l.depth, l.key,
         sum(CASE WHEN x.conv_id = l.conv_id AND n_children = 0 THEN 1 ELSE 0 END) OVER b AS leaves,
         sum(CASE WHEN x.conv_id = l.conv_id THEN (n_convs - 1) * x.words ELSE 0 END) OVER b AS saved
  FROM l JOIN x USING (depth, key) WINDOW b AS (PARTITION BY l.conv_id ORDER BY l.depth DESC)),
below AS (SELECT depth, key, sum(leaves) AS n_leaves, sum(saved) AS saved_tokens FROM owned GROUP BY depth, key)
SELECT x.conv_id, x.depth, y.conv_id AS parent_conv_id, x.n_convs::BIGINT AS n_convs, x.n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, x.ends_sha256
FROM x JOIN below USING (depth, key) LEFT JOIN x y ON y.depth = x.depth - 1 AND y.key = x.parent
"""
