"""Index membership, companies, delistings and checks of the price table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.frames import by_ticker, ratio

COVERAGE = 0.5
AFTER_REMOVAL_DAYS = 45
POOR_RETURN = -0.30
POOR_WORDS = ("bankrupt", "chapter 11", "delist", "default", "insolv", "liquidat")
EXTREME_MOVE = 0.4

# Inclusive ranges of industry codes and the sector each stands for; the first match counts.
SIC_SECTORS = """
2830-2836 3840-3851 5122-5122 8000-8099 Health Care
3570-3579 3600-3611 3614-3619 3640-3699 3820-3829 3861-3861 5045-5045 7370-7379 Information Technology
1200-1399 2900-2999 Energy
4900-4949 4960-4999 Utilities
6500-6553 6798-6798 Real Estate
6000-6799 9995-9995 Financials
2700-2799 4800-4899 7800-7899 Communication Services
100-999 2000-2199 2840-2844 5140-5149 5331-5331 5399-5399 5400-5499 5912-5912 Consumer Staples
1531-1531 2200-2399 2500-2599 3021-3021 3100-3199 3630-3639 3710-3716 3900-3999 5200-5999 7000-7099 7200-7299 7500-7599 7900-7999 Consumer Discretionary
1000-1099 1400-1499 2400-2499 2600-2699 2800-2899 3000-3099 3200-3399 Materials
1500-1799 3400-3599 3612-3629 3700-3799 Industrials
3800-3899 Information Technology
4000-4799 4950-4959 5000-5199 7300-7399 8100-8999 Industrials
"""


def sic_sector(code: Column) -> Column:
    """Sector of an industry code: one CASE of ranges, evaluated in the JVM."""
    out = F
    for line in SIC_SECTORS.strip().splitlines():
        parts = line.split(" ")
        spans = [p.split("-") for p in parts if "-" in p]
        hit = reduce(lambda a, b: a | b, [code.between(int(low), int(high)) for low, high in spans])
        out = out.when(hit, F.lit(" ".join(p for p in parts if "-" not in p)))
    return out


def sic_industry(code: Column) -> Column:
    return F.when(code.isNotNull(), F.format_string("SIC %02d", (code / 100).cast("int")))


def membership(current: DataFrame, changes: DataFrame, since: str) -> DataFrame:
    """Intervals [start, end) by ticker, from today's members and dated changes.

    `current` (ticker); `changes` (date, ticker, kind = added | removed). Newest
    first, a change takes effect if its kind differs from the one after it; a
    ticker's last known state counts as removed for current members (so that
    only an addition may follow, going back) and as added for others. Effective
    changes alternate, so intervals are neighbours.
    """
    rows = changes.filter(F.col("date") >= F.lit(since).cast("date")).join(current.select("ticker", F.lit("removed").alias("_seed")), "ticker", "left")
    newest = Window.partitionBy("ticker").orderBy(F.desc("date"), "kind")
    later = F.coalesce(F.lag("kind").over(newest), F.col("_seed"), F.lit("added"))
    real = rows.withColumn("_later", later).filter(F.col("kind") != F.col("_later"))
    oldest = Window.partitionBy("ticker").orderBy("date", F.desc("kind"))
    real = real.withColumns({"_next": F.lead("date").over(oldest), "_no": F.row_number().over(oldest)})
    opened = real.filter("kind = 'added'").select("ticker", F.col("date").alias("start_date"), F.col("_next").alias("end_date"))
    none = F.lit(None).cast("date")
    before = real.filter("_no = 1 AND kind = 'removed'").select("ticker", none.alias("start_date"), F.col("date").alias("end_date"))
    still = current.select("ticker").distinct().join(real.select("ticker").distinct(), "ticker", "left_anti")
    return opened.unionByName(before).unionByName(still.select("ticker", none.alias("start_date"), none.alias("end_date")))


def unresolved(current: DataFrame, changes: DataFrame, since: str) -> DataFrame:
    """Changes that the walk could not place: repeats of the kind after them."""
    rows = changes.filter(F.col("date") >= F.lit(since).cast("date")).join(current.select("ticker", F.lit("removed").alias("_seed")), "ticker", "left")
    later = F.coalesce(F.lag("kind").over(Window.partitionBy("ticker").orderBy(F.desc("date"), "kind")), F.col("_seed"), F.lit("added"))
    return rows.withColumn("_later", later).filter(F.col("kind") == F.col("_later")).drop("_seed", "_later")


def flag_members(df: DataFrame, intervals: DataFrame) -> DataFrame:
    """`in_index`: the date lies in one of the ticker's intervals."""
    spans = intervals.groupBy("ticker").agg(F.collect_list(F.struct("start_date", "end_date")).alias("_spans"))
    inside = F.exists("_spans", lambda s: (s["start_date"].isNull() | (F.col("date") >= s["start_date"])) & (s["end_date"].isNull() | (F.col("date") < s["end_date"])))
    return df.join(spans, "ticker", "left").withColumn("in_index", F.coalesce(inside, F.lit(False))).drop("_spans")


def weekdays(start: Column, end: Column) -> Column:
    """Weekdays in [start, end), by arithmetic."""
    monday = F.lit("1900-01-01").cast("date")
    upto = lambda d: F.floor(F.datediff(d, monday) / 7) * 5 + F.least(F.datediff(d, monday) % 7, F.lit(5))
    return F.greatest(F.lit(0), upto(end) - upto(start))


def clean_former(prices: DataFrame, intervals: DataFrame, current: DataFrame, since: str) -> DataFrame:
    """Prices without former members whose symbol was reused, and without rows
    well after a removal; current members and strangers to the index pass."""
    end = prices.agg(F.max("date").alias("_end"))
    begin = F.greatest(F.coalesce("start_date", F.lit(since).cast("date")), F.lit(since).cast("date"))
    spans = intervals.join(current.select("ticker"), "ticker", "left_anti").crossJoin(F.broadcast(end))
    spans = spans.withColumns({"_a": begin, "_b": F.coalesce("end_date", "_end")})
    in_span = prices.join(spans.select("ticker", "_a", "_b"), "ticker").filter((F.col("date") >= F.col("_a")) & (F.col("date") < F.col("_b")))
    covered = in_span.groupBy("ticker").agg(F.count("*").alias("_covered"))
    facts = spans.groupBy("ticker").agg(F.sum(weekdays(F.col("_a"), F.col("_b"))).alias("_days"), F.max("end_date").alias("_left"), F.bool_or(F.col("end_date").isNull()).alias("_open"))
    facts = facts.join(covered, "ticker", "left").withColumn("_bad", (F.col("_days") > 0) & (F.coalesce("_covered", F.lit(0)) / F.col("_days") < COVERAGE))
    rows = prices.join(facts.select("ticker", "_left", "_open", "_bad"), "ticker", "left")
    inside = F.coalesce(F.col("_open"), F.lit(True)) | (F.col("date") <= F.date_add("_left", AFTER_REMOVAL_DAYS))
    return rows.filter(~F.coalesce("_bad", F.lit(False)) & inside).drop("_left", "_open", "_bad")


def delistings(prices: DataFrame, removals: DataFrame | None = None, intervals: DataFrame | None = None) -> DataFrame:
    """(ticker, last_date, reason, delisting_return) of histories that stop early.

    `removals` (ticker, reason). Those trimmed after an index removal did not stop.
    """
    end = prices.agg(F.max("date").alias("_end"))
    rows = prices.withColumn("_q", F.lag("close", 62).over(by_ticker()))
    last = rows.groupBy("ticker").agg(F.max("date").alias("last_date"), F.max_by("close", "date").alias("_close"), F.max_by("_q", "date").alias("_q"))
    ended = last.crossJoin(F.broadcast(end)).filter(F.col("last_date") < F.date_sub("_end", 10))
    if intervals is not None:
        left = intervals.groupBy("ticker").agg(F.max("end_date").alias("_left"))
        ended = ended.join(left, "ticker", "left")
        ended = ended.filter(F.col("_left").isNull() | (F.col("last_date") < F.date_add("_left", AFTER_REMOVAL_DAYS - 7)))
    reason = removals.groupBy("ticker").agg(F.first("reason").alias("reason")) if removals is not None else None
    ended = ended.join(reason, "ticker", "left") if reason is not None else ended.withColumn("reason", F.lit(None).cast("string"))
    ended = ended.withColumn("reason", F.coalesce("reason", F.lit("")))
    poor = F.lower("reason").rlike("|".join(POOR_WORDS)) | F.coalesce(ratio("_close", "_q") - 1 < -0.5, F.lit(False))
    return ended.select("ticker", "last_date", "reason", F.when(poor, POOR_RETURN).otherwise(0.0).alias("delisting_return"))


def delisting_returns(stopped: DataFrame) -> DataFrame:
    """(ticker, delisting_return): one row for each ticker that stopped, its last."""
    return stopped.groupBy("ticker").agg(F.max_by("delisting_return", "last_date").alias("delisting_return"))


def company_table(current: DataFrame, former: DataFrame, priced: DataFrame, ciks: DataFrame, industries: DataFrame | None = None) -> DataFrame:
    """Names, sectors and industries of priced tickers; a former member's sector
    comes from its industry code, never from a placeholder."""
    here = current.select("ticker", "company_name", "sector", "sub_industry")
    gone = former.groupBy("ticker").agg(F.first("company_name").alias("company_name")).join(here, "ticker", "left_anti")
    found = here.unionByName(gone, allowMissingColumns=True).join(priced.select("ticker").distinct(), "ticker", "left_semi").join(ciks, "ticker", "left")
    if industries is None:
        return found
    found = found.join(industries.select("ticker", "sic", "sic_description"), "ticker", "left")
    return found.withColumns({"sector": F.coalesce("sector", sic_sector(F.col("sic"))), "industry": sic_industry(F.col("sic"))})


def normalise_ticker(value: Column) -> Column:
    return F.nullif(F.regexp_replace(F.upper(F.trim(value)), "-", "."), F.lit(""))


def price_checks(prices: DataFrame) -> DataFrame:
    """One row: size, span, duplicates, extreme moves, early ends, gaps, years."""
    by = by_ticker()
    steps = prices.withColumns({"_move": ratio("close", F.lag("close").over(by)) - 1, "_gap": F.datediff("date", F.lag("date").over(by))})
    total = steps.agg(
        F.count("*").alias("rows"), F.count_distinct("ticker").alias("tickers"), F.min("date").alias("start"), F.max("date").alias("end"),
        F.count_if(F.abs("_move") > EXTREME_MOVE).alias("extreme_daily_moves"), F.coalesce(F.max("_gap"), F.lit(0)).alias("longest_gap_days"),
    )
    again = prices.groupBy("ticker", "date").count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))
    spans = prices.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b"))
    ends = spans.crossJoin(F.broadcast(prices.agg(F.max("date").alias("e")))).agg(
        F.count_if(F.col("b") < F.date_sub("e", 10)).alias("tickers_ending_early"), F.round(F.median(F.datediff("b", "a") / 365.25), 1).alias("median_history_years")
    )
    return total.crossJoin(again).crossJoin(ends)  # three tables of one row


def extreme_moves(prices: DataFrame, n: int = 5) -> DataFrame:
    moves = prices.withColumn("move", ratio("close", F.lag("close").over(by_ticker())) - 1).filter(F.abs("move") > EXTREME_MOVE)
    return moves.select("ticker", "date", "move").orderBy(F.desc(F.abs("move")), "ticker", "date").limit(n)


def examples(rows: DataFrame, columns: list[str], n: int, to: str) -> DataFrame:
    """One row: the first `n` rows by the columns as an array of structs."""
    first = rows.select(*columns).distinct().orderBy(*columns).limit(n)
    return first.agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(to))


def data_quality(prices: DataFrame, companies: DataFrame, intervals: DataFrame | None = None, fundamentals: DataFrame | None = None, releases: DataFrame | None = None, macro: DataFrame | None = None, requested: DataFrame | None = None, failures: DataFrame | None = None, delistings: DataFrame | None = None) -> DataFrame:
    """One row of coverage figures over the tables of a dataset, with the first of the
    names asked for that have no prices and of those whose filings failed."""
    priced = prices.select("ticker").distinct()
    out = priced.agg(F.count("*").alias("priced"))
    known = companies.join(priced, "ticker", "left_semi")
    out = out.crossJoin(known.agg(F.count("*").alias("companies"), F.count("sector").alias("with_sector"), *([F.count_distinct("industry").alias("industries")] if "industry" in companies.columns else [])))
    if intervals is not None:
        former = intervals.groupBy("ticker").agg(F.bool_and(F.col("end_date").isNotNull()).alias("gone")).filter("gone").select("ticker")
        out = out.crossJoin(former.agg(F.count("*").alias("former_members"))).crossJoin(former.intersect(priced).agg(F.count("*").alias("former_priced")))
        out = out.crossJoin(intervals.select("ticker").subtract(priced).agg(F.count("*").alias("members_unpriced")))
    if fundamentals is not None:
        age = fundamentals.groupBy("ticker").agg(F.max("available_date").alias("d")).crossJoin(F.broadcast(prices.agg(F.max("date").alias("e"))))
        out = out.crossJoin(age.agg(F.count("*").alias("with_fundamentals"), F.median(F.datediff("e", "d")).alias("fundamentals_age_days")))
        out = out.withColumn("fundamentals_share", F.round(F.try_divide("with_fundamentals", "priced"), 3))
    if releases is not None:
        out = out.crossJoin(releases.agg(F.count_distinct("ticker").alias("with_releases"), F.count("*").alias("releases")))
    if requested is not None:
        asked = requested.select("ticker").distinct()
        missing = asked.join(priced, "ticker", "left_anti")
        out = out.crossJoin(asked.agg(F.count("*").alias("requested"))).crossJoin(missing.agg(F.count("*").alias("missing"))).crossJoin(examples(missing, ["ticker"], 15, "missing_examples"))
    if failures is not None:
        out = out.crossJoin(failures.agg(F.count_distinct("ticker").alias("failed"))).crossJoin(examples(failures, ["ticker", "reason"], 5, "failed_examples"))
    if delistings is not None:
        out = out.crossJoin(delistings.agg(F.count("*").alias("stocks_ending_early"), F.count_if(F.col("delisting_return") < 0).alias("assumed_performance_delistings")))
    if "sic" in companies.columns:
        without = F.count_if(F.col("sector").isNotNull() & F.col("sub_industry").isNull()) if "sub_industry" in companies.columns else F.lit(None).cast("long")
        out = out.crossJoin(companies.agg(F.round(F.avg(F.col("sic").isNotNull().cast("int")), 3).alias("share_with_sic"), without.alias("former_members_with_sector")))
    if macro is not None:
        out = out.crossJoin(macro.agg(F.max("date").alias("macro_end")))
    return out
