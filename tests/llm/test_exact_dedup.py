import hashlib

from pyspark.sql import functions as F

from filingpanel.llm import exact_dedup

ROWS = [(1, "a", "x"), (2, "b", "x"), (3, "a", "y"), (4, None, "y"), (5, "", None), (6, "a ", None), (7, "z" * 100000, "q"),
        (8, "z" * 100000, "q"), (2, "b", "x"), (None, "a", "n"), (None, "only", "n")]
SCHEMA = "doc_id long, text string, h string"


def brute(keep):
    groups = {}
    for i, t, _ in ROWS:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, _ in ROWS:
        ids = [x for x in groups[t or ""] if x is not None]
        k = keep(ids) if ids else None
        out.append((str(i), str(k), len(groups[t or ""]), i == k, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


def as_rows(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_groups(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert as_rows(exact_dedup.exact_groups(df)) == brute(min)
    assert as_rows(exact_dedup.exact_groups(df, keep="max")) == brute(max)
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_colliding_hashes_are_told_apart(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    weak = lambda c: F.substring(F.md5(c), 1, 0)  # noqa: E731  one hash for all
    assert as_rows(exact_dedup.exact_groups(df, content_hash=weak)) == brute(min)


def test_kept_documents(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = exact_dedup.exact_dedup(df)
    assert out.columns == df.columns
    assert sorted(map(str, (tuple(r)[::2] for r in out.collect()))) == sorted(map(str, [
        (1, "x"), (2, "x"), (4, "y"), (6, None), (7, "q"), (None, "n")]))
    assert [r.text for r in out.where("doc_id = 4").collect()] == [None]
    assert sorted(r.doc_id or 0 for r in exact_dedup.exact_dedup(df, keep="max").collect()) == [0, 2, 3, 5, 6, 8]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_text_stays_out_of_the_join(spark):
    plan = exact_dedup.exact_groups(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "keep_id" in plan and not [line for line in plan.splitlines() if "Exchange" in line and "text#" in line]
