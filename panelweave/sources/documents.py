"""Nested sources: company facts, submissions, filings, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.operators.filings import CONCEPTS

FACTS = "struct<cik: long, facts: map<string, map<string, struct<units: map<string, array<struct<start: string, end: string, val: double, filed: string, form: string, accn: string>>>>>>>"
RECENT = "struct<form: array<string>, filingDate: array<string>, acceptanceDateTime: array<string>, items: array<string>, accessionNumber: array<string>, primaryDocument: array<string>, reportDate: array<string>>"
SUBMISSIONS = f"struct<cik: string, sic: string, sicDescription: string, filings: struct<recent: {RECENT}>>"
UNITS = ("USD", "shares", "USD/shares")
FORMS = r"^(10-K|10-Q|20-F|40-F)"


def company_facts(texts: DataFrame, cik: str | None = None) -> DataFrame:
    """(cik, metric, priority, start, end, val, filed, form, accn) from the JSON in
    `value`: every known concept with its place in its metric's list."""
    parsed = texts.select(*([F.col(cik).alias("cik")] if cik else []), F.from_json("value", FACTS).alias("j"))
    rows = parsed.select(*(["cik"] if cik else [F.col("j.cik").alias("cik")]), F.explode("j.facts").alias("taxonomy", "concepts"))
    rows = rows.select("cik", F.explode("concepts").alias("concept", "c")).select("cik", "concept", F.explode("c.units").alias("unit", "u"))
    rows = rows.filter(F.col("unit").isin(*UNITS)).select("cik", "concept", F.explode("u").alias("x")).select("cik", "concept", "x.*").filter(F.col("form").rlike(FORMS))
    listed = [(c, metric, i) for metric, names in CONCEPTS.items() for i, c in enumerate(names.split())]
    table = texts.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('{c}', '{m}', {i})" for c, m, i in listed) + " AS t(concept, metric, priority)")
    dates = {c: F.expr(f"try_cast(`{c}` AS DATE)") for c in ("start", "end", "filed")}
    out = rows.join(F.broadcast(table), "concept").withColumns(dates)  # some thirty concepts
    return out.dropna(subset=["end", "filed", "val"]).select("cik", "metric", "priority", "start", "end", "val", "filed", "form", "accn")


def submissions(texts: DataFrame, since: str | None = None) -> DataFrame:
    """A row for each filing: the parallel arrays of `value` zipped."""
    j = texts.select(F.from_json("value", SUBMISSIONS).alias("j"))
    zipped = j.select(F.col("j.cik").cast("long").alias("cik"), F.expr("try_cast(j.sic AS INT)").alias("sic"), F.col("j.sicDescription").alias("sic_description"), F.explode(F.arrays_zip(*[F.col(f"j.filings.recent.{c}").alias(c) for c in ("form", "filingDate", "acceptanceDateTime", "items", "accessionNumber", "primaryDocument", "reportDate")])).alias("x"))
    rows = zipped.select("cik", "sic", "sic_description", "x.*").withColumn("filed", F.expr("try_cast(filingDate AS DATE)"))
    return rows.filter(F.col("filed") >= F.lit(since).cast("date")) if since else rows


def release_dates(filings: DataFrame) -> DataFrame:
    """(cik, date, accepted): earnings releases (8-K, item 2.02), once a session date.

    Acceptance is market wall time whatever its suffix; from 16:00 on it counts
    for the next day; a missing one is the filing date at 08:00.
    """
    rows = filings.filter(F.col("form").startswith("8-K") & F.col("items").contains("2.02"))
    stamp = F.expr("try_cast(replace(acceptanceDateTime, 'Z', '') AS TIMESTAMP_NTZ)")
    rows = rows.withColumn("accepted", F.coalesce(stamp, F.expr("CAST(filed AS TIMESTAMP_NTZ) + INTERVAL 8 HOUR")))
    rows = rows.withColumn("date", F.date_add(F.to_date("accepted"), (F.hour("accepted") >= 16).cast("int")))
    return rows.filter("date IS NOT NULL").groupBy("cik", "date").agg(F.min("accepted").alias("accepted"))


def recent_filings(filings: DataFrame, base: str, forms=("10-K", "10-Q", "8-K"), n: int = 15) -> DataFrame:
    """Newest filings of the forms with the address of their document under `base`."""
    from pyspark.sql import Window

    newest = F.row_number().over(Window.partitionBy("cik").orderBy(F.desc("filed"), "accessionNumber"))
    rows = filings.filter(F.col("form").isin(*forms)).withColumn("_n", newest).filter(F.col("_n") <= n)
    url = F.concat_ws("/", F.lit(base.rstrip("/")), F.col("cik").cast("string"), F.regexp_replace("accessionNumber", "-", ""), "primaryDocument")
    return rows.select("cik", "form", "filed", F.expr("try_cast(reportDate AS DATE)").alias("report_date"), F.nullif("items", F.lit("")).alias("items"), url.alias("url"))


def rss_items(texts: DataFrame) -> DataFrame:
    """(ticker, ts, title, summary, url) of a feed's items; XML in `value`."""
    schema = "struct<channel: struct<item: array<struct<title: string, pubDate: string, description: string, link: string>>>>"
    rows = texts.select("ticker", F.explode(F.from_xml("value", schema).getField("channel").getField("item")).alias("x"))
    stamp = F.expr("try_to_timestamp(regexp_replace(x.pubDate, '^[A-Za-z]+, ', ''), 'd MMM yyyy HH:mm:ss Z')")
    return rows.select("ticker", stamp.alias("ts"), F.col("x.title").alias("title"), F.col("x.description").alias("summary"), F.col("x.link").alias("url")).filter("title IS NOT NULL")


def headline_items(texts: DataFrame) -> DataFrame:
    """(ticker, ts, title, summary, source, url) of a JSON array with epoch seconds."""
    rows = texts.select("ticker", F.explode(F.from_json("value", "array<struct<datetime: long, headline: string, summary: string, source: string, url: string>>")).alias("x"))
    return rows.filter("length(trim(x.headline)) > 0").select("ticker", F.timestamp_seconds("x.datetime").alias("ts"), F.col("x.headline").alias("title"), F.col("x.summary").alias("summary"), F.col("x.source").alias("source"), F.col("x.url").alias("url"))


def cik_map(texts: DataFrame) -> DataFrame:
    rows = texts.select(F.explode(F.from_json("value", "map<string, struct<cik_str: long, ticker: string>>")).alias("k", "x"))
    return rows.select(F.regexp_replace(F.upper("x.ticker"), "-", ".").alias("ticker"), F.col("x.cik_str").alias("cik"))
