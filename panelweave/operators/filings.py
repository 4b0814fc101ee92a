"""Company facts: first reported values, single quarters, trailing years, timelines.

Facts are one long table (cik, metric, priority, start, end, val, filed, form,
accn); every operator keeps `keys` (cik, metric) so all companies are one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.shared import settle
from panelweave.operators.asof import asof_nearest

KEYS = ("cik", "metric")
QUARTER, HALF, NINE_MONTHS, YEAR = (80, 120), (170, 200), (260, 290), (350, 380)
# Concepts of each metric, the preferred one first.
CONCEPTS = {
    "revenue": "Revenues RevenueFromContractWithCustomerExcludingAssessedTax RevenueFromContractWithCustomerIncludingAssessedTax SalesRevenueNet SalesRevenueGoodsNet RevenuesNetOfInterestExpense",
    "net_income": "NetIncomeLoss NetIncomeLossAvailableToCommonStockholdersBasic ProfitLoss",
    "gross_profit": "GrossProfit",
    "cost_of_revenue": "CostOfRevenue CostOfGoodsAndServicesSold CostOfGoodsSold",
    "operating_cash_flow": "NetCashProvidedByUsedInOperatingActivities NetCashProvidedByUsedInOperatingActivitiesContinuingOperations",
    "equity": "StockholdersEquity StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest",
    "liabilities": "Liabilities",
    "assets": "Assets",
    "shares": "EntityCommonStockSharesOutstanding CommonStockSharesOutstanding",
    "eps": "EarningsPerShareDiluted EarningsPerShareBasic EarningsPerShareBasicAndDiluted",
}


def first_reported(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For each period the value filed first, of equal dates the best concept's."""
    by = Window.partitionBy(*keys).orderBy("filed", "priority")
    return facts.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def quarters(facts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Single quarters (keys, start, end, val, filed): as reported, as differences
    of year-to-date values, and as a year less its three quarters."""
    rows = settle(first_reported(facts.filter("start IS NOT NULL"), [*keys, "start", "end"]).select(*keys, "start", "end", "val", "filed"), "reported")  # read six times
    days = F.datediff("end", "start")
    plain = rows.filter(days.between(*QUARTER))
    running = rows.filter(days.between(*HALF) | days.between(*NINE_MONTHS))
    year = rows.filter(days.between(*YEAR))
    other = lambda df, p: df.select(*[F.col(k).alias(f"{p}_{k}") for k in keys], *[F.col(c).alias(f"{p}_{c}") for c in ("start", "end", "val", "filed")])
    same = lambda p: [F.col(k).eqNullSafe(F.col(f"{p}_{k}")) for k in keys]
    both = lambda p: [F.col(k) == F.col(f"{p}_{k}") for k in keys]
    shorter = other(plain.unionByName(running), "p")
    near = [F.abs(F.datediff("start", "p_start")) <= 3, F.col("p_end") < F.date_sub("end", 60), F.col("p_end") > F.date_sub("end", 120)]
    pairs = running.join(shorter, [*both("p"), *near])
    alone = pairs.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "start", "end"))).filter("_n = 1")
    derived = alone.select(*keys, F.date_add("p_end", 1).alias("start"), "end", (F.col("val") - F.col("p_val")).alias("val"), F.greatest("filed", "p_filed").alias("filed"))
    known = other(plain, "q")
    derived = derived.join(known, [*same("q"), F.abs(F.datediff("end", "q_end")) <= 7], "left_anti")
    single = settle(plain.unionByName(derived), "single-quarters")
    inside = year.join(other(single, "q"), [*both("q"), F.col("q_start") >= F.date_sub("start", 7), F.col("q_end") <= F.date_add("end", 7)])
    three = inside.groupBy(*keys, "start", "end").agg(
        F.count("*").alias("n"), F.max("q_end").alias("last"), F.sum("q_val").alias("part"), F.first("val").alias("val"), F.first("filed").alias("filed"), F.max((F.abs(F.datediff("q_end", "end")) <= 7).cast("int")).alias("hit")
    )
    fourth = three.filter("n = 3 AND hit = 0").select(*keys, F.date_add("last", 1).alias("start"), "end", (F.col("val") - F.col("part")).alias("val"), "filed")
    every = single.withColumn("_p", F.lit(0)).unionByName(fourth.withColumn("_p", F.lit(1)))
    once = Window.partitionBy(*keys, "end").orderBy("_p", "filed", "start")
    return every.withColumn("_n", F.row_number().over(once)).filter("_n = 1").drop("_n", "_p")


def trailing_year(facts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, end, ttm, available): four quarters end to end, else the year's value."""
    by = Window.partitionBy(*keys).orderBy("end")
    last4 = by.rowsBetween(-3, 0)
    rows = quarters(facts, keys)
    rows = rows.withColumn("_ok", (F.abs(F.datediff("start", F.lag("end").over(by)) - 1) <= 10).cast("int"))
    chained = rows.withColumns({"ttm": F.sum("val").over(last4), "available": F.max("filed").over(last4), "_links": F.sum("_ok").over(by.rowsBetween(-2, 0)), "_n": F.count("*").over(last4)})
    chained = chained.filter("_n = 4 AND _links = 3").select(*keys, "end", "ttm", "available")
    year = first_reported(facts.filter("start IS NOT NULL"), [*keys, "start", "end"]).filter(F.datediff("end", "start").between(*YEAR))
    year = year.select(*keys, "end", F.col("val").alias("ttm"), F.col("filed").alias("available"))
    have = chained.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("end").alias("_end"))
    rest = year.join(have, [*[F.col(k) == F.col(f"_{k}") for k in keys], F.abs(F.datediff("end", "_end")) <= 7], "left_anti")
    return chained.unionByName(rest)


def instants(facts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    rows = first_reported(facts, [*keys, "end"])
    return rows.select(*keys, "end", F.col("val").alias("value"), F.col("filed").alias("available"))


def shares(facts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Share counts summed over the classes of one filing, as first reported."""
    summed = facts.groupBy(*keys, "priority", "accn", "end", "form").agg(F.sum("val").alias("val"), F.min("filed").alias("filed"))
    return instants(summed, keys)


def known_as_of(records: DataFrame, value: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Records of a period later than all that were available before."""
    by = Window.partitionBy(*keys).orderBy("available", "end").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("end").over(by)
    return records.filter(F.col(value).isNotNull()).withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("end") > F.col("_b"))).drop("_b")


def growth(ttm: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Trailing values against those a year before (nearest end within 20 days)."""
    before = ttm.select(*keys, F.col("end").alias("prev_end"), F.col("ttm").alias("prev_ttm"))
    rows = ttm.withColumn("_target", F.date_sub("end", 365))
    rows = asof_nearest(rows, before, "_target", "prev_end", ["prev_ttm"], list(keys), 20)
    return rows.select(*keys, "end", F.when(F.col("prev_ttm") != 0, F.col("ttm") / F.col("prev_ttm") - 1).alias("value"), "available")


def timeline(facts: DataFrame) -> DataFrame:
    """One row per cik and date on which its known fundamentals changed, nine
    metrics and the period end. Each metric is a series of known records; all
    are stacked, and the last known value of each is carried along."""
    flows = trailing_year(facts.filter(F.col("metric").isin("revenue", "net_income", "gross_profit", "cost_of_revenue", "operating_cash_flow")))
    of = lambda m: flows.filter(F.col("metric") == m)
    cost = of("cost_of_revenue").select("cik", "end", F.col("ttm").alias("_c"), F.col("available").alias("_ca"))
    no_gross = of("revenue").join(of("gross_profit").select("cik").distinct(), "cik", "left_anti")
    made = no_gross.join(cost, ["cik", "end"]).select("cik", F.lit("gross_profit").alias("metric"), "end", (F.col("ttm") - F.col("_c")).alias("ttm"), F.greatest("available", "_ca").alias("available"))
    series = flows.filter("metric <> 'cost_of_revenue'").unionByName(made).withColumn("metric", F.concat("metric", F.lit("_ttm"))).withColumnRenamed("ttm", "value")
    series = series.unionByName(growth(of("revenue")).withColumn("metric", F.lit("revenue_growth_yoy")))
    series = series.unionByName(instants(facts.filter(F.col("metric").isin("equity", "liabilities", "assets"))))
    series = series.unionByName(shares(facts.filter("metric = 'shares'")).withColumn("metric", F.lit("shares_outstanding")))
    known = known_as_of(series.filter("available IS NOT NULL"), "value")
    names = ["revenue_ttm", "net_income_ttm", "revenue_growth_yoy", "equity", "liabilities", "shares_outstanding", "gross_profit_ttm", "operating_cash_flow_ttm", "assets"]
    dated = series.select("cik", "available").distinct().withColumns({"metric": F.lit(None).cast("string"), "end": F.lit(None).cast("date"), "value": F.lit(None).cast("double")})
    both = known.select("cik", "metric", "end", F.col("value").cast("double").alias("value"), "available").unionByName(dated)
    wide = both.groupBy("cik", "available").agg(
        *[F.max_by(F.when(F.col("metric") == n, F.col("value")), F.when(F.col("metric") == n, F.col("end"))).alias(n) for n in names],
        F.max(F.when(F.col("metric").isin("revenue_ttm", "net_income_ttm"), F.col("end"))).alias("period_end"),
    )
    by = Window.partitionBy("cik").orderBy("available").rowsBetween(Window.unboundedPreceding, 0)
    rows = wide.withColumns({n: F.last(n, ignorenulls=True).over(by) for n in names} | {"period_end": F.max("period_end").over(by)})
    never = F.max("liabilities").over(Window.partitionBy("cik")).isNull()
    rows = rows.withColumn("liabilities", F.when(never, F.col("assets") - F.col("equity")).otherwise(F.col("liabilities")))
    return rows.withColumnRenamed("available", "available_date")


def quarterly_eps(facts: DataFrame) -> DataFrame:
    """(cik, period_end, eps, filed) from the best concept with four quarters."""
    rows = facts.filter("metric = 'eps'").withColumn("metric", F.concat(F.lit("eps"), F.col("priority")))
    single = quarters(rows)
    n = single.withColumn("_n", F.count("*").over(Window.partitionBy(*KEYS))).filter("_n >= 4")
    best = n.withColumn("_b", F.min("metric").over(Window.partitionBy("cik"))).filter("metric = _b")
    return best.select("cik", F.col("end").alias("period_end"), F.col("val").alias("eps"), "filed")
