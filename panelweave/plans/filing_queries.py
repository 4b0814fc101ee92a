"""Queries on facts, releases, curves and histories that the other modules leave out."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelweave.functions.frames import by_ticker, grouped_rolling, ratio
from panelweave.operators import backtest as bt
from panelweave.operators import crosssection, events, filings, serving, universe, validation
from panelweave.plans.backtest_queries import CONFIG, PREDICTIONS, predictions
from panelweave.plans.event_queries import cte
from panelweave.plans.panel_queries import USABLE, features, features_sql, rank_sql, sectors, usable, companies_cte
from panelweave.plans.proxies import view, with_sql
from panelweave.plans.registry import query
from panelweave.plans.serving_queries import six
from panelweave.sources import files

#: Monthly facts: a row for each supplier, return flag, month and date of filing.
MONTHLY = """SELECT l_suppkey AS cik, l_returnflag AS metric, 0 AS priority, CAST(date_trunc('month', l_shipdate) AS DATE) AS start, last_day(l_shipdate) AS "end", sum(l_extendedprice) AS val, CAST(l_shipdate AS DATE) + CAST(l_orderkey % 45 AS INT) AS filed,
    CAST(CAST(l_shipdate AS DATE) + CAST(l_orderkey % 45 AS INT) AS VARCHAR) AS accn, 'F' AS form FROM lineitem GROUP BY ALL"""


def monthly(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    dates = [F.trunc("l_shipdate", "month").alias("start"), F.last_day("l_shipdate").alias("end"), F.date_add(F.to_date("l_shipdate"), (F.col("l_orderkey") % 45).cast("int")).alias("filed")]
    # nearly every line is a filing of its own: sums before the exchange would hold them all and save none, and
    # what follows groups by company, metric and period too, so one exchange by these serves all. Its parts are a
    # fixed number, as adaptive execution would join them until a task holds 64 MB of packed rows several times
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("l_extendedprice", F.col("l_suppkey").alias("cik"), F.col("l_returnflag").alias("metric"), *dates).repartition(parts, "cik", "metric", "end")
    found = rows.groupBy("cik", "metric", "start", "end", "filed").agg(F.sum("l_extendedprice").alias("val"))
    return found.select("cik", "metric", F.lit(0).alias("priority"), "start", "end", "val", "filed", F.col("filed").cast("string").alias("accn"), F.lit("F").alias("form"))


@query(f"WITH f AS ({MONTHLY}), n AS (SELECT *, row_number() OVER (PARTITION BY cik, metric, start, \"end\" ORDER BY filed, priority) AS k FROM f) SELECT cik, metric, start, \"end\", round(val, 2) AS val, filed FROM n WHERE k = 1")
def f1_first_reported(spark, sf_dir):
    found = filings.first_reported(monthly(spark, sf_dir), ["cik", "metric", "start", "end"])
    return found.select("cik", "metric", "start", "end", F.round("val", 2).alias("val"), "filed")


@query(f"WITH f AS ({MONTHLY}), s AS (SELECT cik, metric, \"end\", accn, sum(val) AS val, min(filed) AS filed FROM f GROUP BY 1, 2, 3, 4), n AS (SELECT *, row_number() OVER (PARTITION BY cik, metric, \"end\" ORDER BY filed) AS k FROM s) SELECT cik, metric, \"end\", round(val, 2) AS value, filed AS available FROM n WHERE k = 1")
def f4_f5_share_counts(spark, sf_dir):
    found = filings.shares(monthly(spark, sf_dir))
    return found.select("cik", "metric", "end", F.round("value", 2).alias("value"), "available")


@query(f"""WITH f AS ({MONTHLY}), r AS (SELECT cik, metric, "end", round(sum(val), 2) AS value, "end" + CAST((cik * 7 + month("end") * 31) % 200 AS INT) AS available FROM f GROUP BY 1, 2, 3),
    b AS (SELECT *, max("end") OVER (PARTITION BY cik, metric ORDER BY available, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM r) SELECT cik, metric, "end", value, available FROM b WHERE p IS NULL OR "end" > p""")
def f6_known_as_of(spark, sf_dir):
    """Records whose period is later than all that were available before them."""
    rows = monthly(spark, sf_dir).groupBy("cik", "metric", "end").agg(F.round(F.sum("val"), 2).alias("value"))
    late = F.date_add("end", ((F.col("cik") * 7 + F.month("end") * 31) % 200).cast("int"))
    return filings.known_as_of(rows.withColumn("available", late), "value").select("cik", "metric", "end", "value", "available")


QUARTERLY = """SELECT s.l_suppkey AS cik, d.q AS start, CAST(d.q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS "end", coalesce(sum(l_extendedprice), 0) AS val FROM (SELECT DISTINCT l_suppkey FROM lineitem) s
    CROSS JOIN (SELECT DISTINCT CAST(date_trunc('quarter', l_shipdate) AS DATE) AS q FROM lineitem WHERE year(l_shipdate) BETWEEN 1993 AND 1997) d LEFT JOIN lineitem l ON l.l_suppkey = s.l_suppkey AND CAST(date_trunc('quarter', l.l_shipdate) AS DATE) = d.q GROUP BY 1, 2, 3"""


def year_to_date(spark, sf_dir):
    """Facts as companies file them: sums from the year's first day to each quarter's end."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_suppkey").alias("cik"), F.to_date(F.trunc("l_shipdate", "quarter")).alias("q"), "l_extendedprice")
    days = rows.filter(F.year("q").between(1993, 1997)).select("q").distinct()  # 20 quarters
    grid = rows.select("cik").distinct().crossJoin(F.broadcast(days))
    sums = grid.join(rows.groupBy("cik", "q").agg(F.sum("l_extendedprice").alias("v")), ["cik", "q"], "left").fillna(0, ["v"])
    from pyspark.sql import Window

    upto = Window.partitionBy("cik", F.year("q")).orderBy("q")
    end = F.date_add(F.add_months("q", 3), -1)
    return sums.select("cik", F.lit("revenue").alias("metric"), F.lit(0).alias("priority"), F.trunc("q", "year").alias("start"), end.alias("end"), F.sum("v").over(upto).alias("val"), F.date_add(end, 35).alias("filed"))


@query(f"WITH q AS ({QUARTERLY}) SELECT cik, start, \"end\", round(val, 2) AS val, \"end\" + 35 AS filed FROM q")
def f2_single_quarters(spark, sf_dir):
    found = filings.quarters(year_to_date(spark, sf_dir))
    return found.select("cik", "start", "end", F.round("val", 2).alias("val"), "filed")


@query(f"WITH q AS ({QUARTERLY}) SELECT cik, \"end\" AS period_end, round(CASE WHEN cik % 3 = 0 THEN val + 1 ELSE val END, 2) AS eps, \"end\" + 35 AS filed FROM q")
def f10_quarterly_eps(spark, sf_dir):
    """Two thirds of the companies file the preferred concept for all quarters, the others for one year alone."""
    rows = filings.quarters(year_to_date(spark, sf_dir)).select("cik", "start", "end", "val", "filed")
    best = rows.filter((F.col("cik") % 3 != 0) | (F.col("end") < "1993-10-01")).withColumn("priority", F.lit(0))
    other = rows.withColumns({"priority": F.lit(1), "val": F.col("val") + 1})
    found = filings.quarterly_eps(best.unionByName(other).withColumn("metric", F.lit("eps")))
    return found.select("cik", "period_end", F.round("eps", 2).alias("eps"), "filed")


@query(
    features_sql() + """, rel AS (SELECT DISTINCT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_linenumber = 4), ev AS (SELECT DISTINCT r.ticker, f.date FROM rel r ASOF JOIN features f ON r.ticker = f.ticker AND r.date <= f.date),
    x AS (SELECT f.ticker, f.date, e.ticker IS NOT NULL AS ev, return_1d - market_return_1d AS ab FROM features f LEFT JOIN ev e ON f.ticker = e.ticker AND f.date = e.date),
    y AS (SELECT *, CASE WHEN lag(ev) OVER (PARTITION BY ticker ORDER BY date) AND count(ab) OVER w = 3 THEN sum(ab) OVER w END AS known FROM x WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT ticker, date, round(last_value(known IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 63 PRECEDING AND CURRENT ROW), 6) AS ear FROM y"""
)
def f15_release_returns(spark, sf_dir):
    releases = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_linenumber = 4").select(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).distinct()
    found = events.earnings(features(spark, sf_dir), None, releases)
    return six(found.select("ticker", "date", "ear"))


@query(
    PREDICTIONS + " SELECT date, ticker, round(avg(probability) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS probability FROM p"
)
def b1_smoothed_scores(spark, sf_dir):
    rows = predictions(spark, sf_dir).filter("tradable_return IS NOT NULL AND probability IS NOT NULL")
    return six(bt.smooth(rows, "probability", 3).select("date", "ticker", "probability"))


@query(with_sql("macro") + " SELECT date, round(lead(vix, 5) OVER (ORDER BY date) / lead(vix, 1) OVER (ORDER BY date) - 1, 6) AS index_return FROM macro")
def b12_index_returns(spark, sf_dir):
    return six(bt.index_returns(view(spark, sf_dir, "macro").select("date", F.col("vix").alias("close")), CONFIG.holding_days))


@query(with_sql("panel", "macro") + ", d AS (SELECT DISTINCT date FROM panel), r AS (SELECT date AS rd, tbill_3m / 100 AS rate FROM macro WHERE CAST(date - DATE '1992-01-01' AS INT) % 7 = 0) SELECT d.date, round(coalesce(rate, 0) * 4 / 252, 8) AS cash FROM d ASOF LEFT JOIN r ON d.date >= r.rd")
def b25_j10_cash(spark, sf_dir):
    """The rate is known on one day of seven."""
    days = view(spark, sf_dir, "panel").select("date").distinct()
    rates = view(spark, sf_dir, "macro").filter("date_diff(date, DATE '1992-01-01') % 7 = 0").select("date", (F.col("tbill_3m") / 100).alias("rate"))
    return bt.with_cash(days, rates, CONFIG).select("date", F.round("cash", 8).alias("cash"))


@query(
    PREDICTIONS + ", " + companies_cte() + f""", z AS (SELECT p.*, sector FROM p JOIN companies USING (ticker)), a AS (SELECT 'year' AS slice, CAST(year(date) AS VARCHAR) AS "group", date, {rank_sql("probability", "date")} AS a, {rank_sql("tradable_return", "date")} AS b FROM z),
    s AS (SELECT 'sector' AS slice, sector AS "group", date, {rank_sql("probability", "date, sector")} AS a, {rank_sql("tradable_return", "date, sector")} AS b FROM z),
    ic AS (SELECT slice, "group", date, corr(a, b) AS ic FROM (FROM a UNION ALL FROM s) GROUP BY 1, 2, 3 HAVING count(*) >= 5 AND min(a) < max(a) AND min(b) < max(b)), k AS (SELECT *, count(*) OVER (PARTITION BY slice, "group") AS d FROM ic)
    SELECT slice, "group", round(avg(ic), 6) AS ic_mean, round(avg(CAST(ic > 1e-12 AS INT)), 6) AS ic_positive_share, count(*) AS ic_days FROM k WHERE slice = 'year' OR d >= 20 GROUP BY 1, 2"""
)
def v8_ic_breakdown(spark, sf_dir):
    rows = sectors(spark, sf_dir, predictions(spark, sf_dir)).withColumn("future_return", F.col("tradable_return"))
    return six(validation.ic_breakdown(rows, 5).select("slice", "group", "ic_mean", "ic_positive_share", "ic_days"))


@query(
    PREDICTIONS + f""", r AS (SELECT *, count(*) OVER w AS n, row_number() OVER (PARTITION BY date ORDER BY probability, ticker) AS rn FROM p WINDOW w AS (PARTITION BY date)),
    c AS (SELECT *, least(5, n) AS q, greatest(1, CAST(ceil((rn - 1) * least(5, n) / greatest(n - 1, 1)) AS INT)) AS bucket FROM r), z AS (SELECT date, {rank_sql("probability", "date")} AS a, {rank_sql("tradable_return", "date")} AS b FROM p),
    ic AS (SELECT date, corr(a, b) AS ic FROM z GROUP BY 1 HAVING count(*) >= 5 AND min(a) < max(a) AND min(b) < max(b))
    SELECT date, count(*) AS stocks, round(avg(tradable_return) FILTER (bucket = 5) - avg(tradable_return) FILTER (bucket = 1), 6) AS top_minus_bottom, round(any_value(ic), 6) AS ic FROM c LEFT JOIN ic USING (date) GROUP BY date"""
)
def v11_forward_test(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    return six(validation.forward_test(rows.filter("probability IS NOT NULL"), rows, "tradable_return").select("date", "stocks", "top_minus_bottom", "ic"))


PRICED = "px AS (SELECT l_suppkey AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, avg(l_extendedprice) AS close FROM lineitem GROUP BY 1, 2)"


def priced(spark, sf_dir):
    """Weekly mean prices, which move by halves and doubles."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("date")).agg(F.avg("l_extendedprice").alias("close"))


@query(f"WITH {PRICED}, m AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS mv, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS n FROM px), w AS (SELECT ticker, arg_max(date, abs(mv)) AS date, arg_max(mv, abs(mv)) AS move FROM m WHERE n <= 20 AND mv IS NOT NULL GROUP BY 1) SELECT ticker, date, round(move, 6) AS move FROM w WHERE abs(move) > 0.4")
def q16_m16_price_warning(spark, sf_dir):
    rows = priced(spark, sf_dir).withColumn("return_1d", ratio("close", F.lag("close").over(by_ticker())) - 1)
    return six(serving.data_warning(rows))


@query(f"WITH {PRICED}, m AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS move FROM px) SELECT ticker, date, round(move, 6) AS move FROM m WHERE abs(move) > 0.4 ORDER BY abs(m.move) DESC, ticker, date LIMIT 5")
def c12_extreme_moves(spark, sf_dir):
    return six(universe.extreme_moves(priced(spark, sf_dir)))


@query(
    with_sql("panel", "companies", "membership", "macro") + """, pr AS (SELECT DISTINCT ticker FROM panel), fm AS (SELECT ticker FROM membership GROUP BY 1 HAVING bool_and(end_date IS NOT NULL))
    SELECT (SELECT count(*) FROM pr) AS priced, (SELECT count(*) FROM companies WHERE ticker IN (FROM pr)) AS companies, (SELECT count(sector) FROM companies WHERE ticker IN (FROM pr)) AS with_sector, (SELECT count(DISTINCT industry) FROM companies WHERE ticker IN (FROM pr)) AS industries,
      (SELECT count(*) FROM fm) AS former_members, (SELECT count(*) FROM fm WHERE ticker IN (FROM pr)) AS former_priced, (SELECT count(DISTINCT ticker) FROM membership WHERE ticker NOT IN (FROM pr)) AS members_unpriced, (SELECT max(date) FROM macro) AS macro_end"""
)
def c13_data_quality(spark, sf_dir):
    return universe.data_quality(view(spark, sf_dir, "panel"), view(spark, sf_dir, "companies"), view(spark, sf_dir, "membership"), macro=view(spark, sf_dir, "macro"))


@query(
    with_sql("panel") + """, s AS (SELECT *, CASE WHEN (CAST(volume AS BIGINT) + ticker) % 97 = 0 THEN 2.0 END AS r FROM panel)
    SELECT ticker, date, round(exp(coalesce(sum(ln(coalesce(r, 1))) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)), 4) AS split_factor FROM s"""
)
def c2_unsplit(spark, sf_dir):
    split = F.when((F.col("volume").cast("long") + F.col("ticker")) % 97 == 0, F.lit(2.0))
    found = files.unsplit(view(spark, sf_dir, "panel").withColumn("split_ratio", split))
    return found.select("ticker", "date", F.round("split_factor", 4).alias("split_factor"))


@query(with_sql("panel") + f", g AS (SELECT ticker, date, {'CASE WHEN count(close) OVER w >= 4 THEN sum(close) OVER w END'} AS close, CASE WHEN count(volume) OVER w >= 4 THEN sum(volume) OVER w END AS volume FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT ticker, date, round(close, 6) AS close, round(CAST(volume AS DOUBLE), 2) AS volume FROM g")
def t17_grouped_rolling(spark, sf_dir):
    found = grouped_rolling(view(spark, sf_dir, "panel").select("ticker", "date", "close", "volume"), ["close", "volume"], 10, 4, "sum")
    return found.select("ticker", "date", F.round("close", 6).alias("close"), F.round(F.col("volume").cast("double"), 2).alias("volume"))


@query(
    features_sql() + ", " + cte("macro") + f""", m AS (SELECT date AS md, CASE WHEN count(vix) OVER w >= 126 THEN (vix - avg(vix) OVER w) / stddev_samp(vix) OVER w END AS vix_regime FROM macro WINDOW w AS (ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)),
    d AS (SELECT DISTINCT date FROM panel), j AS (SELECT d.date, vix_regime FROM d ASOF LEFT JOIN m ON d.date > m.md), u AS (SELECT * FROM features WHERE {USABLE}), k AS (SELECT u.*, vix_regime, (return_5d - avg(return_5d) OVER (PARTITION BY u.date)) AS return_5d_z FROM u LEFT JOIN j USING (date))
    SELECT ticker, date, round(return_5d_z * vix_regime, 5) AS reversal_x_vix FROM k"""
)
def x8_regime_products(spark, sf_dir):
    """The standard score is replaced by the distance from the date's mean, as only the product is of interest."""
    from pyspark.sql import Window

    df = events.macro(usable(features(spark, sf_dir)), view(spark, sf_dir, "macro"))
    df = df.withColumn("return_5d_z", F.col("return_5d") - F.avg("return_5d").over(Window.partitionBy("date")))
    return crosssection.regime_interactions(df).select("ticker", "date", F.round("reversal_x_vix", 5).alias("reversal_x_vix"))
