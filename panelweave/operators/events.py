"""Point-in-time signals: filings, earnings, insiders, macro conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.frames import by_ticker, ratio, roll, rolling
from panelweave.operators.asof import asof, asof_nearest, to_next_session

YEAR = 252
MAX_AGE = 550
BOOK_RANGE = (0.05, 200.0)
SUE_AGE = 120
EAR_SESSIONS = 63
INSIDER_SESSIONS = 63
FLOWS = ["revenue_ttm", "net_income_ttm", "revenue_growth_yoy", "equity", "liabilities", "shares_outstanding"]
EXTRA = ["gross_profit_ttm", "operating_cash_flow_ttm", "assets"]


def filed(df: DataFrame, pit: DataFrame, max_age: int = MAX_AGE) -> DataFrame:
    """`df` with what was filed before each date (strictly), at most `max_age` days old."""
    kept = [*FLOWS, *[c for c in EXTRA if c in pit.columns]]
    rows = asof(df, pit, "date", "available_date", kept, ["ticker"], strict=True, order=["period_end"] if "period_end" in pit.columns else [])
    fresh = F.datediff("date", "available_date") <= max_age
    return rows.withColumns({c: F.when(fresh, F.col(c)) for c in ["available_date", *kept]})


def fundamentals(df: DataFrame, pit: DataFrame, max_age: int = MAX_AGE) -> DataFrame:
    """Ratios from what was filed before each date."""
    return filed_ratios(filed(df, pit, max_age))


def filed_ratios(rows: DataFrame) -> DataFrame:
    """The ratios of the columns of `filed`.

    A price-to-book outside a plausible range drops the market cap; one that is
    unknown (no positive equity) does not.
    """
    df, extra = rows, [c for c in EXTRA if c in rows.columns]
    price = F.col("raw_close") if "raw_close" in df.columns else F.col("close")
    over = lambda top, under: F.when(under != 0, top / under)
    rows = rows.withColumns({"_equity": F.when(F.col("equity") > 0, F.col("equity")), "_cap": price * F.col("shares_outstanding")})
    book = over(F.col("_cap"), F.col("_equity"))
    odd = (book < BOOK_RANGE[0]) | (book > BOOK_RANGE[1])
    rows = rows.withColumn("market_cap", F.when(~F.coalesce(odd, F.lit(False)), F.col("_cap")))
    income, revenue, cap = F.col("net_income_ttm"), F.col("revenue_ttm"), F.col("market_cap")
    rows = rows.withColumns(
        {
            "fundamentals_as_of": F.col("available_date"),
            "earnings_yield": over(income, cap),
            "sales_yield": over(revenue, cap),
            "book_to_market": over(F.col("_equity"), cap),
            "pe_ratio": F.when(income > 0, cap / income),
            "revenue": revenue,
            "profit_margin": F.when(revenue > 0, income / revenue),
            "roe": over(income, F.col("_equity")),
            "liabilities_to_equity": over(F.col("liabilities"), F.col("_equity")),
        }
    )
    if "assets" in extra:
        rows = rows.withColumn("_assets", F.when(F.col("assets") > 0, F.col("assets")))
        if "gross_profit_ttm" in extra:
            rows = rows.withColumn("gross_profitability", ratio("gross_profit_ttm", "_assets"))
        if "operating_cash_flow_ttm" in extra:
            rows = rows.withColumn("accruals", ratio(income - F.col("operating_cash_flow_ttm"), "_assets"))
        rows = rows.withColumn("asset_growth", ratio("_assets", F.lag("_assets", YEAR).over(by_ticker())) - 1).drop("_assets")
    split = F.col("split_factor") if "split_factor" in df.columns else F.lit(1.0)
    rows = rows.withColumn("_shares", F.col("shares_outstanding") * split)
    before = F.lag("_shares", YEAR).over(by_ticker())
    rows = rows.withColumn("net_issuance", F.when(before != 0, F.col("_shares") / before - 1))
    return rows.drop("_shares", "_equity", "_cap", "available_date", "revenue_ttm", "equity", "liabilities", "shares_outstanding", *extra)


def surprises(eps: DataFrame, releases: DataFrame | None = None) -> DataFrame:
    """(ticker, period_end, available, sue): the change on the same quarter a year
    before, over the deviation of the eight such changes before it."""
    rows = eps.filter("period_end IS NOT NULL AND eps IS NOT NULL")
    first = Window.partitionBy("ticker", "period_end").orderBy("filed", "eps")
    rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select("ticker", "period_end", "eps", "filed")
    year_ago = rows.select("ticker", F.col("period_end").alias("prev_end"), F.col("eps").alias("prev_eps"))
    rows = rows.withColumn("target", F.date_sub("period_end", 365))
    rows = asof_nearest(rows, year_ago, "target", "prev_end", ["prev_eps"], ["ticker"], 20)
    by = Window.partitionBy("ticker").orderBy("period_end")
    rows = rows.withColumn("surprise", F.col("eps") - F.col("prev_eps")).withColumn("_before", F.lag("surprise").over(by))
    scale = roll("std", "_before", 8, 4, by)
    rows = rows.withColumn("_scale", scale).withColumn("sue", F.when(F.col("_scale") > 0, F.greatest(F.lit(-10.0), F.least(F.lit(10.0), F.col("surprise") / F.col("_scale")))))
    rows = rows.withColumn("available", F.date_add("filed", 1))
    if releases is not None:
        rows = rows.withColumn("_after", F.date_add("period_end", 1))
        known = releases.select("ticker", F.col("date").alias("release")).distinct()
        rows = asof(rows, known, "_after", "release", [], ["ticker"], "forward")
        rows = rows.withColumn("available", F.when(F.col("release") <= F.date_add("filed", 3), F.col("release")).otherwise(F.col("available")))
    return rows.filter("sue IS NOT NULL AND available IS NOT NULL").select("ticker", "period_end", "available", "sue")


def earnings(df: DataFrame, eps: DataFrame | None, releases: DataFrame | None) -> DataFrame:
    """`sue`, live for 120 days, and `ear`, the three-session abnormal return
    around a release, carried from the session after it."""
    if eps is not None:
        df = surprised(df, eps, releases)
    if releases is not None and "market_return_1d" in df.columns:
        df = after_releases(df.join(release_sessions(releases, df), ["ticker", "date"], "left"))
    return df


def surprised(df: DataFrame, eps: DataFrame, releases: DataFrame | None) -> DataFrame:
    """`df` with `sue`."""
    df = asof(df, surprises(eps, releases), "date", "available", ["sue"], ["ticker"], order=["period_end"])
    return df.withColumn("sue", F.when(F.datediff("date", "available") <= SUE_AGE, F.col("sue"))).drop("available")


def release_sessions(releases: DataFrame, sessions: DataFrame) -> DataFrame:
    """(ticker, date, _event): sessions on or after a release."""
    return to_next_session(releases.select("ticker", "date"), sessions).select("ticker", F.col("session").alias("date"), F.lit(1).alias("_event")).distinct()


def after_releases(df: DataFrame) -> DataFrame:
    """`ear` from the mark `_event` of release sessions."""
    df = df.withColumn("_ab", F.col("return_1d") - F.col("market_return_1d"))
    after = F.lag("_event").over(by_ticker()) == 1
    df = df.withColumn("_known", F.when(after, roll("sum", "_ab", 3, 3)))
    carried = F.last("_known", ignorenulls=True).over(by_ticker().rowsBetween(-EAR_SESSIONS, 0))
    return df.withColumn("ear", carried).drop("_event", "_ab", "_known")


def insiders(df: DataFrame, trades: DataFrame) -> DataFrame:
    """Open-market purchases and net buying over 63 sessions; usable from the
    session after filing. Purchases are distinct filings of a session, summed."""
    return insider_windows(df.join(insider_days(trades, df), ["ticker", "date"], "left"))


def insider_days(trades: DataFrame, sessions: DataFrame) -> DataFrame:
    """(ticker, date, _n, _buy, _sell): purchases and values by session."""
    events = trades.withColumn("date", F.date_add("filed", 1))
    aligned = to_next_session(events, sessions)
    bought = F.col("code") == "P"
    return aligned.groupBy("ticker", F.col("session").alias("date")).agg(
        F.count_distinct(F.when(bought, F.col("accession"))).alias("_n"), F.sum(F.when(bought, F.col("value")).otherwise(0.0)).alias("_buy"), F.sum(F.when(~bought, F.col("value")).otherwise(0.0)).alias("_sell")
    )


def insider_windows(df: DataFrame) -> DataFrame:
    df = df.fillna(0, ["_n", "_buy", "_sell"])
    df = rolling(df, {"insider_purchases_90d": ("sum", "_n", INSIDER_SESSIONS, 1), "_bought": ("sum", "_buy", INSIDER_SESSIONS, 1), "_sold": ("sum", "_sell", INSIDER_SESSIONS, 1)})
    df = df.withColumn("insider_net_90d", F.col("_bought") - F.col("_sold"))
    if "market_cap" in df.columns:
        df = df.withColumn("insider_net_value_90d", ratio("insider_net_90d", "market_cap"))
    return df.drop("_n", "_buy", "_sell", "_bought", "_sold")


def macro_conditions(macro: DataFrame) -> DataFrame:
    """The macro table filled forward, with the VIX's change and its regime: a
    score against its last 252 rows. One row a date."""
    by = Window.orderBy("date")
    filled = macro.withColumns({c: F.last(c, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)) for c in macro.columns if c != "date"})
    filled = rolling(filled, {"_mean": ("mean", "vix", 252, 126), "_std": ("std", "vix", 252, 126)}, keys=())
    return filled.withColumns({"vix_change_20d": ratio("vix", F.lag("vix", 20).over(by)) - 1, "vix_regime": ratio(F.col("vix") - F.col("_mean"), "_std")}).drop("_mean", "_std")


def macro(df: DataFrame, table: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Conditions known before each date: as-of on the dates alone (`days`, where they
    are at hand in a smaller table), then an equi-join."""
    known = macro_conditions(table).withColumnRenamed("date", "macro_date")
    columns = [c for c in known.columns if c != "macro_date"]
    by_date = asof((df if days is None else days).select("date").distinct(), known, "date", "macro_date", columns, strict=True)
    return df.join(F.broadcast(by_date.drop("macro_date")), "date", "left")  # a row a date
