"""Checks of a table from one read."""

from pyspark.sql import functions as F

from filingpanel.operators import quality as qa




def test_all_checks_of_a_table(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        reads.add(1)
        return x

    rows = [(f"a{i}", "item1" if i % 4 else "item7", None if i % 5 == 0 else i, "" if i == 7 else "text", i / 10) for i in range(40)] + [("a1", "item1", 1, None, 0.5)]
    df = spark.createDataFrame(rows, "k string, item string, cik long, text string, x double").withColumn("text", seen("text"))
    df = df.select("*", F.length("text").alias("n_text"))
    t = (qa.TableChecks(df, "p").has_columns(["k", "tex"], prefix=True).has_columns(["nope"]).unique(["k", "item"]).covered("cik", 0.9).covered("x")
         .none_where("no empty text", F.col("n_text") == 0).none_where("small", F.col("x") > 3, "warning").counted("item", "items"))
    got = [tuple(r) for r in qa.checks_table(spark, [t]).collect()]
    assert got[:7] == [
        ("p", "schema", True, "error", "all present"), ("p", "schema", False, "error", "nope"), ("p", "unique keys", False, "error", "1"),
        ("p", "cik coverage", False, "warning", "80.49"), ("p", "x coverage", True, "warning", "100.0"), ("p", "no empty text", False, "error", "1"),
        ("p", "small", False, "warning", "9")]
    assert sorted(got[7:]) == [("p", "items", True, "info", "10"), ("p", "items", True, "info", "31")]
    assert reads.value == len(rows)  # every row was read once for all checks


def test_empty_tables_and_counts(spark):
    df = spark.range(5)
    one, two = qa.TableChecks(df, "a"), qa.TableChecks(df.limit(0), "b")
    two.as_many_as("same", one).unique(["id"]).covered("id").none_where("bad", F.lit(True)).counted("id", "ids")
    assert [tuple(r) for r in qa.checks_table(spark, [two]).collect()] == [
        ("b", "same", False, "error", "0"), ("b", "unique keys", True, "error", "0"), ("b", "id coverage", False, "warning", "0.0"), ("b", "bad", True, "error", "0")]
    assert qa.TableChecks(df, "c").as_many_as("same", one).rows() == [("c", "same", True, "error", "5")]
