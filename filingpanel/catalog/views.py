"""Inputs of the registered queries, derived from the given tables.

Each view exists twice: as a Spark function and as a SQL view text, built
independently from the same table, so both sides start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import concepts, prepare, textscore
from ..sources.store import spread

ENCODER_DIM, ENCODER_M, ENCODER_K = 64, 16, 4


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _parts(spark):
    """Number of parts for tables of one row group; set by whoever knows the files, e.g. the benchmark."""
    return spark.conf.get("spark.filingpanel.scanPartitions", None)


def _pick(index, *names):
    """The index-th of the names."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def document(spark, d):
    raw = F.regexp_extract("source", r"(\d+)", 1).cast("long") + 1000
    year = (F.lit(2001) + F.col("doc_id") % 24).cast("int")
    return (
        spread(table(spark, d, "documents"), _parts(spark), "doc_id")
        .withColumn("year", year)
        .select(
            "doc_id",
            F.format_string("%010d-%02d-%06d", raw, F.col("year") % 100, F.col("doc_id")).alias("accession_number"),
            F.when(F.col("doc_id") % 50 != 0, raw).alias("cik"),
            "year",
            _pick(F.floor(F.col("doc_id") / 24) % 3, "item1", "item1A", "item7").alias("item_type"),
            "text",
            F.col("n_chars").cast("int").alias("text_length"),
            F.make_date("year", F.lit(3), (F.col("doc_id") % 28 + 1).cast("int")).alias("filing_date"),
        )
    )


def metadata(spark, d):
    """Numeric accession numbers and text dates, for the labelled documents only."""
    doc = document(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    raw = F.substring("accession_number", 1, 10).cast("long")
    return doc.select(
        (raw * 100000000 + (F.col("year") % 100) * 1000000 + F.col("doc_id")).alias("accession_number"),
        raw.alias("cik"),
        F.col("year").alias("fiscal_year"),
        F.concat(F.lit("T"), raw.cast("string")).alias("ticker"),
        F.date_format("filing_date", "yyyy-MM-dd").alias("filing_date"),
    )


def sentence(spark, d):
    return prepare.sentence_table(document(spark, d))


def scored(spark, d):
    return textscore.novelty_proxy(textscore.relevance_proxy(sentence(spark, d)))


def sentence_embedding(spark, d):
    idx = F.floor(F.col("vec_id") / 5)
    return spread(table(spark, d, "embeddings"), _parts(spark), "vec_id").withColumn("_i", idx).select(
        "vec_id",
        F.format_string("%010d-%02d-%06d", 1000 + F.col("_i") % 20, 1 + F.col("_i") % 24, F.col("_i"))
        .alias("accession_number"),
        (F.col("vec_id") % 5).alias("sentence_id"),
        _pick(F.floor(F.col("vec_id") / 120) % 3, "item1", "item1A", "item7").alias("item_type"),
        (1000 + F.col("_i") % 20).alias("cik"),
        (2001 + F.col("_i") % 24).cast("int").alias("year"),
        F.make_date((2001 + F.col("_i") % 24).cast("int"), F.lit(4), (F.col("_i") % 28 + 1).cast("int"))
        .alias("filing_date"),
        F.col("label"),
        "embedding",
    )


def embedding_scores(spark, d):
    """Novelty and relevance of the embedded sentences, from the label; some novelty is null."""
    e = sentence_embedding(spark, d)
    return e.select(
        "accession_number", "sentence_id", "item_type",
        F.when(F.col("vec_id") % 11 != 0, (F.col("label") + 1) / F.lit(4.0)).alias("novelty_cln"),
        ((F.col("vec_id") % 9 + 1) / F.lit(9.0)).alias("relevance_kmnz"),
    )


def encoder(phase: float = 0.0, m: int = ENCODER_M) -> concepts.EncoderWeights:
    return concepts.closed_form_weights(m, ENCODER_DIM, phase)


def activation(spark, d):
    """Long-form k-sparse activations of the embedded sentences."""
    out = concepts.KSparseEncoderModel(encoder(), ENCODER_K).transform(sentence_embedding(spark, d))
    return concepts.to_long(out, ["accession_number", "sentence_id", "item_type"])


def sentence_panel(spark, d):
    e = sentence_embedding(spark, d).drop("embedding")
    return textscore.attach_scores(e, novelty=embedding_scores(spark, d), relevance=embedding_scores(spark, d))


def daily(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("permno"), F.to_date("ts").alias("date")).agg(
        (F.avg("value") / 1000).alias("ret"), F.count("*").cast("double").alias("vol"),
        F.max("value").alias("prc"), (F.lit(100.0) + F.min("event_id") % 7).alias("shrout"),
    )


def market(spark, d):
    e = daily(spark, d)
    return e.groupBy("date").agg(F.avg("ret").alias("mkt_ret"))


def filing(spark, d):
    """One filing per user and day with a sign-up."""
    e = table(spark, d, "events").where("event_type = 'signup'")
    return e.groupBy(F.col("user_id").alias("permno"), F.to_date("ts").alias("filing_date")).agg(
        F.min("event_id").alias("accession_number")
    ).withColumn("ticker", F.concat(F.lit("T"), F.col("permno").cast("string")))


def forecast(spark, d):
    e = table(spark, d, "events").where("event_type = 'view'")
    return e.select(
        F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"),
        F.to_date("ts").alias("forecast_date"), "event_id",
        (F.col("value") - 5).alias("mean_forecast"), (F.col("value") / 10).alias("forecast_stdev"),
        F.get_json_object("props", "$.k").cast("int").alias("num_analysts"),
    )


def link(spark, d):
    """Two validity intervals per user; the second is open."""
    g = table(spark, d, "events").groupBy("user_id").agg(
        F.to_date(F.min("ts")).alias("lo"), F.to_date(F.max("ts")).alias("hi")
    ).withColumn("mid", F.expr("date_add(lo, cast(floor(datediff(hi, lo) / 2) as int))"))
    rows = F.array(
        F.struct(F.col("lo").alias("start_date"), F.col("mid").alias("end_date"), F.lit(0).alias("part")),
        F.struct(F.date_add("mid", 1).alias("start_date"), F.lit(None).cast("date").alias("end_date"),
                 F.lit(1).alias("part")),
    )
    return g.select("user_id", F.explode(rows).alias("r")).select(
        F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"), F.col("user_id").alias("permno"),
        (F.col("user_id") * 10 + F.col("r.part")).alias("gvkey"), "r.start_date", "r.end_date",
    )


def fundamental(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")

    def gap(rest: int, share: float):
        return F.when(k % 7 != rest, p * F.lit(share))

    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("gvkey"), F.to_date("o_orderdate").alias("datadate"), k.alias("record_id"),
        p.alias("at"), gap(0, 0.5).alias("lt"), gap(1, 0.4).alias("ceq"), gap(2, 0.45).alias("seq"),
        gap(3, 0.1).alias("dlc"), gap(4, 0.2).alias("dltt"), gap(5, 0.03).alias("txditc"),
        F.when(k % 3 == 0, p * F.lit(0.01)).alias("pstkrv"), F.when(k % 3 != 2, p * F.lit(0.02)).alias("pstkl"),
        F.when(k % 5 != 2, p * F.lit(0.04)).alias("pstk"),
        (F.lit(10.0) + k % 90).alias("price"), (p / F.lit(50.0)).alias("shares"),
    )


def customer_filing(spark, d):
    """Ship dates of a customer's order lines stand for filing dates."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("gvkey"))
    li = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.to_date("l_shipdate").alias("filing_date")
    )
    return li.join(o, "o_orderkey").select(
        F.col("o_orderkey").alias("accession_number"), "l_linenumber", "gvkey", "filing_date"
    )


def monthly(spark, d):
    li = table(spark, d, "lineitem")
    m = F.trunc(F.to_date("l_shipdate"), "month")
    return li.groupBy(F.col("l_suppkey").alias("permno"), m.alias("date")).agg(
        (F.avg("l_discount") - 0.05).alias("ret"), F.sum("l_quantity").alias("vol"),
        (-F.max("l_extendedprice")).alias("prc"), F.min("l_quantity").alias("shrout"),
    )


def panel(spark, d):
    """Regression panel: one row per order line."""
    return spread(table(spark, d, "lineitem"), _parts(spark), "l_orderkey", "l_linenumber").select(
        F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey").alias("cik"),
        F.year("l_shipdate").alias("year"), F.to_date("l_shipdate").alias("filing_date"),
        F.col("l_discount").alias("y"), F.col("l_quantity").alias("x1"),
        (F.col("l_extendedprice") / 1000).alias("x2"), F.col("l_tax").alias("x3"),
    )


def test_result(spark, d):
    """A p-value per part with many ties."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("feature"), F.col("p_brand").alias("outcome"),
        (F.floor((F.col("p_partkey") * 37 % 100) / 10) * F.lit(0.004) + F.lit(0.0005)).alias("p_value"),
        ((F.col("p_size") - 25) * F.lit(0.01)).alias("coefficient"),
    )


def loss_log(spark, d):
    """A training log per user: value stands for the loss."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("run"), F.col("ts"), F.col("event_id"), F.col("value").alias("loss")
    )


WS = r"[\t-\r\x1c-\x20\x85\p{Z}]"
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"


def tok(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WS}+'), lambda t: t <> '')"


SQL_VIEWS: dict[str, str] = {
    "document": r"""
      select doc_id, printf('%010d-%02d-%06d', raw, yr % 100, doc_id) as accession_number,
             case when doc_id % 50 <> 0 then raw end as cik, yr as year,
             (['item1','item1A','item7'])[cast((doc_id // 24) % 3 as int) + 1] as item_type,
             text, cast(n_chars as int) as text_length,
             make_date(yr, 3, cast(1 + doc_id % 28 as int)) as filing_date, raw
      from (select *, cast(regexp_extract(source, '(\d+)', 1) as bigint) + 1000 as raw,
                   cast(2001 + doc_id % 24 as int) as yr from documents)""",
    "metadata": """
      select raw * 100000000 + (year % 100) * 1000000 + doc_id as accession_number, raw as cik,
             year as fiscal_year, 'T' || raw as ticker, strftime(filing_date, '%Y-%m-%d') as filing_date
      from document where doc_id in (select doc_id from labels)""",
    "sentence": rf"""
      select accession_number, cik, year, filing_date, item_type, cast(pos - 1 as int) as sentence_id,
             text, cast(length(text) as int) as sentence_length
      from (select accession_number, cik, year, filing_date, item_type,
                   unnest(s) as text, generate_subscripts(s, 1) as pos
            from (select *, list_filter(
                      list_transform(string_split(
                        regexp_replace(d.text, '([.!?]){WS}+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)),
                        lambda p: regexp_replace(p, '^{WS}+|{WS}+$', '', 'g')),
                      lambda p: length(p) >= 20 and not regexp_full_match(p, '{DIGIT}+')) as s
                  from document d))""",
    "word": f"""
      select *, {tok('text')} as w, {tok('lower(text)')} as lw from sentence""",
    "measured": r"""
      select *, 3e-1 * exp(-sentence_id / 10e0) + 3e-1 * least(kw / 5e0, 1e0)
                + 2e-1 * least(nums / 20e0, 1e0)
                + 2e-1 * case item_type when 'item7' then 1e0 when 'item1' then 7e-1 else 5e-1 end as relevance_kmnz
      from (select *, len(w) as nw, len(list_distinct(w)) / (len(w) + 1e0) as div,
                   len(list_filter(w, lambda x: regexp_matches(x, '""" + DIGIT + r"""'))) as nums,
                   len(list_filter(w, lambda x: regexp_matches(x, '^\p{Lu}') and length(x) > 1)) as caps,
                   len(list_intersect(list_distinct(lw), ['revenue','revenues','sales','income','earnings','profit',
                     'loss','cash','debt','assets','liabilities','equity','segment','segments','operations','margin',
                     'ebitda','goodwill','intangibles','impairment','acquisition'])) as kw
            from word)""",
    "scored": """
      select *, 4e-1 * abs(nw - firm_len) / (firm_len + 1) + 3e-1 * abs(div - firm_div)
                + 3e-1 * ((nums + caps) / (nw + 1e0)) as novelty_cln
      from measured
      join (select cik, avg(sentence_length) as firm_len, avg(div) as firm_div from measured group by cik) using (cik)""",
    "sentence_embedding": """
      select vec_id, printf('%010d-%02d-%06d', 1000 + i % 20, 1 + i % 24, i) as accession_number,
             vec_id % 5 as sentence_id,
             (['item1','item1A','item7'])[cast((vec_id // 120) % 3 as int) + 1] as item_type,
             1000 + i % 20 as cik, cast(2001 + i % 24 as int) as year,
             make_date(cast(2001 + i % 24 as int), 4, cast(i % 28 + 1 as int)) as filing_date, label, embedding
      from (select *, vec_id // 5 as i from embeddings)""",
    "embedding_scores": """
      select accession_number, sentence_id, item_type,
             case when vec_id % 11 <> 0 then (label + 1) / 4e0 end as novelty_cln,
             (vec_id % 9 + 1) / 9e0 as relevance_kmnz
      from sentence_embedding""",
    "encoder": """
      select j, [sin((j + 1e0) * (i + 1e0)) for i in range(64)] as w from range(16) t(j)""",
    "activation_all": """
      select accession_number, sentence_id, item_type, cast(j as int) as feature_id,
             list_inner_product(cast(embedding as double[]), w) as value
      from sentence_embedding cross join encoder""",
    "activation": """
      select accession_number, sentence_id, item_type, feature_id, value from (
        select *, row_number() over (partition by accession_number, sentence_id, item_type order by value desc) as r
        from activation_all) where r <= 4 and value > 0""",
    "sentence_panel": """
      select e.* exclude (embedding), s.novelty_cln, s.relevance_kmnz
      from sentence_embedding e join embedding_scores s using (accession_number, sentence_id, item_type)""",
    "daily": """
      select user_id as permno, cast(ts as date) as date, avg(value) / 1000 as ret, cast(count(*) as double) as vol,
             max(value) as prc, 100e0 + min(event_id) % 7 as shrout
      from events group by 1, 2""",
    "market": "select date, avg(ret) as mkt_ret from daily group by date",
    "abnormal": """
      select d.*, m.mkt_ret, d.ret - m.mkt_ret as abret from daily d left join market m using (date)""",
    "filing": """
      select user_id as permno, cast(ts as date) as filing_date, min(event_id) as accession_number,
             'T' || user_id as ticker
      from events where event_type = 'signup' group by user_id, cast(ts as date)""",
    "forecast": """
      select 'T' || user_id as ticker, cast(ts as date) as forecast_date, event_id, value - 5 as mean_forecast,
             value / 10 as forecast_stdev, cast(json_extract_string(props, '$.k') as int) as num_analysts
      from events where event_type = 'view'""",
    "link": """
      with g as (select user_id, cast(min(ts) as date) as lo, cast(max(ts) as date) as hi from events group by 1),
           h as (select *, lo + cast((hi - lo) // 2 as int) as mid from g)
      select 'T' || user_id as ticker, user_id as permno, user_id * 10 as gvkey, lo as start_date, mid as end_date
      from h
      union all
      select 'T' || user_id, user_id, user_id * 10 + 1, mid + 1, null from h""",
    "fundamental": """
      select o_custkey as gvkey, cast(o_orderdate as date) as datadate, o_orderkey as record_id,
             o_totalprice as "at",
             case when o_orderkey % 7 <> 0 then o_totalprice * 5e-1 end as lt,
             case when o_orderkey % 7 <> 1 then o_totalprice * 4e-1 end as ceq,
             case when o_orderkey % 7 <> 2 then o_totalprice * 45e-2 end as seq,
             case when o_orderkey % 7 <> 3 then o_totalprice * 1e-1 end as dlc,
             case when o_orderkey % 7 <> 4 then o_totalprice * 2e-1 end as dltt,
             case when o_orderkey % 7 <> 5 then o_totalprice * 3e-2 end as txditc,
             case when o_orderkey % 3 = 0 then o_totalprice * 1e-2 end as pstkrv,
             case when o_orderkey % 3 <> 2 then o_totalprice * 2e-2 end as pstkl,
             case when o_orderkey % 5 <> 2 then o_totalprice * 4e-2 end as pstk,
             10e0 + o_orderkey % 90 as price, o_totalprice / 50e0 as shares
      from orders""",
    "customer_filing": """
      select l_orderkey as accession_number, l_linenumber, o_custkey as gvkey, cast(l_shipdate as date) as filing_date
      from lineitem join orders on l_orderkey = o_orderkey""",
    "monthly": """
      select l_suppkey as permno, cast(date_trunc('month', l_shipdate) as date) as date,
             avg(l_discount) - 5e-2 as ret, sum(l_quantity) as vol, -max(l_extendedprice) as prc,
             min(l_quantity) as shrout
      from lineitem group by 1, 2""",
    "panel": """
      select l_orderkey, l_linenumber, l_partkey, l_suppkey as cik, cast(year(l_shipdate) as int) as year,
             cast(l_shipdate as date) as filing_date, l_discount as y, l_quantity as x1,
             l_extendedprice / 1000e0 as x2, l_tax as x3
      from lineitem""",
    "test_result": """
      select p_partkey as feature, p_brand as outcome, ((p_partkey * 37 % 100) // 10) * 4e-3 + 5e-4 as p_value,
             (p_size - 25) * 1e-2 as coefficient
      from part""",
    "loss_log": "select user_id as run, ts, event_id, value as loss from events",
}


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it uses, directly or through other views."""
    used: set[str] = set()

    def scan(text: str) -> None:
        for name, sql in SQL_VIEWS.items():
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                scan(sql)

    scan(body)
    if not used:
        return body
    ctes = ",\n".join(f"{n} as ({s})" for n, s in SQL_VIEWS.items() if n in used)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
