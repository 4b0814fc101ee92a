"""Analyst queries over the scored snapshot and the research tables.

`scored` is one row per ranked ticker: rank, model_probability, date and the
signals. Arguments are checked when the plan is built; a bad one raises ValueError.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.functions.frames import ratio
from panelweave.functions.shared import settle
from panelweave.sources.store import read

MOST = 50
SUSPECT = 0.4
SORTABLE = ("model_probability", "rank", "return_5d", "return_20d", "momentum_60d", "volatility_20d", "pe_ratio")
SUMMARY = ("rank", "model_probability", "return_5d", "return_20d", "momentum_60d", "volatility_20d")


def bounded(value: int, low: int, high: int, name: str) -> int:
    if not low <= int(value) <= high:
        raise ValueError(f"{name} must be from {low} to {high}")
    return int(value)


def label(df: DataFrame) -> Column:
    """The first company name there is, else the ticker."""
    names = [c for c in ("company_name", "company", "name", "longname") if c in df.columns]
    return F.coalesce(*names, F.col("ticker").cast("string"))


def stance(rank: Column, total: Column, share: float = 0.2) -> Column:
    """Favourable for the top fifth by rank, unfavourable for the bottom, at least one each."""
    k = F.greatest(F.lit(1), F.bround(total * share).cast("int"))
    return F.when(rank <= k, "favourable").when(rank > total - k, "unfavourable").otherwise("neutral")


def summary_rows(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    held = [c for c in (*SUMMARY, *extra) if c in df.columns]
    sector = [F.col("sector")] if "sector" in df.columns else []
    return df.select("ticker", label(df).alias("company"), *sector, *held)


def in_sector(scored: DataFrame, sector: str | None) -> DataFrame:
    """Rows of a sector: its whole name in any case, else names that contain it."""
    if not sector:
        return scored
    if "sector" not in scored.columns:
        raise ValueError("this dataset has no sectors")
    wanted, name = F.lit(sector.strip().lower()), F.lower("sector")
    marked = scored.withColumn("_e", F.coalesce(name == wanted, F.lit(False)))
    exact = F.max("_e").over(Window.partitionBy())  # the snapshot: a row a ticker
    return marked.withColumn("_any", exact).filter(F.when(F.col("_any"), F.col("_e")).otherwise(name.contains(wanted))).drop("_e", "_any")


def search_companies(scored: DataFrame, query: str, limit: int = 5) -> DataFrame:
    q = F.lit(query.strip().upper())
    if not query.strip():
        raise ValueError("an empty query")
    ticker, name = F.upper(F.col("ticker").cast("string")), F.upper(label(scored))
    as_int = lambda c: c.cast("int")
    score = as_int(ticker == q) * 4 + as_int(ticker.startswith(q)) * 2 + as_int(name.contains(q)) * 3 + as_int(F.exists(F.split(name, r"\s+"), lambda w: w.startswith(q)))
    hits = scored.withColumns({"score": score, "_name": label(scored)}).filter("score > 0").orderBy(F.desc("score"), "rank").limit(bounded(limit, 1, MOST, "limit"))
    return hits.select("ticker", F.col("_name").alias("company"), *(["sector"] if "sector" in scored.columns else []), "score", "rank")


def resolve(scored: DataFrame, known: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, ticker): what each asked symbol stands for; null if unknown."""
    symbol = F.regexp_replace(F.regexp_replace(F.upper(F.trim("asked")), r"^\$+", ""), "-", ".")
    both = scored.select("ticker").unionByName(known.select("ticker")).distinct()
    rows = asked.withColumn("_s", F.explode(F.array_distinct(F.array(symbol, F.regexp_replace(symbol, r"\.", "-")))))
    found = rows.join(both, F.col("_s") == F.col("ticker").cast("string"), "left")
    return found.groupBy("asked").agg(F.max_by("ticker", F.when(F.col("ticker").isNotNull(), F.col("_s") == symbol)).alias("ticker"))


def grams(text: Column, longest: int = 3) -> Column:
    """All distinct runs of up to `longest` characters of a text."""
    runs = [F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>")) for n in range(1, longest + 1)]  # noqa: B023
    return F.array_distinct(F.concat(*runs))


def containing(texts: DataFrame, key: str, columns: Sequence[str], asked: DataFrame, part: str = "_q", longest: int = 3) -> DataFrame:
    """Rows of `asked` beside the `key` of every text of which `part` is a part.

    An inverted table of short runs of characters answers by equality: a part is
    looked up by the rarest of its runs, and what that gives is verified.
    """
    runs = texts.select(F.col(key), F.explode(F.array_distinct(F.concat(*[F.coalesce(grams(F.col(c), longest), F.array().cast("array<string>")) for c in columns]))).alias("_gram"))
    index = settle(runs, "grams")
    often = index.groupBy("_gram").agg(F.count("*").alias("_n"))
    size = F.least(F.lit(longest), F.length(part))
    own = asked.filter(F.length(part) > 0).select("*", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(part) - size + 1), lambda i: F.substring(F.col(part), i, size)))).alias("_gram"))
    names = asked.columns
    counted = own.join(often, "_gram", "left").groupBy(*names).agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_gram")).alias("_gram"))
    # runs repeat, so the index is small as a file and large in memory: it must not go to all tasks
    return counted.join(index.hint("merge"), "_gram").drop("_gram").join(texts, key).filter(F.greatest(*[F.coalesce(F.contains(F.col(c), F.col(part)), F.lit(False)) for c in columns]))


def suggestions(scored: DataFrame, known: DataFrame, asked: DataFrame, most: int = 5) -> DataFrame:
    """(asked, ticker, suggestions): what each asked symbol stands for and, where it
    stands for none, the companies whose ticker or name it is part of, best first."""
    found = settle(resolve(scored, known, asked), "resolved")
    names = scored.select(F.col("ticker").alias("_t"), F.upper(F.col("ticker").cast("string")).alias("_u"), F.upper(label(scored)).alias("_n"), F.col("rank").alias("_r"))
    lost = found.filter("ticker IS NULL AND trim(asked) <> ''").select("asked", F.upper(F.trim("asked")).alias("_q")).distinct()
    hit, q = containing(names, "_t", ["_u", "_n"], lost), F.col("_q")
    as_int = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    score = as_int(F.col("_u") == q) * 4 + as_int(F.startswith("_u", q)) * 2 + as_int(F.contains("_n", q)) * 3 + as_int(F.exists(F.split("_n", r"\s+"), lambda w: w.startswith(q)))
    best = hit.withColumn("_s", score).withColumn("_k", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("_s"), "_r"))).filter(F.col("_k") <= most)
    lists = best.groupBy("asked").agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_t"))), lambda x: x["_t"]).alias("suggestions"))
    return found.join(lists, "asked", "left")


def data_warning(features: DataFrame, rows: int = 20) -> DataFrame:
    """(ticker, date, move): the largest suspect move among each ticker's last rows."""
    late = features.withColumn("_n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).filter(F.col("_n") <= rows)
    worst = late.groupBy("ticker").agg(F.max_by(F.struct("date", F.col("return_1d").alias("move")), F.abs("return_1d")).alias("w"))
    return worst.select("ticker", "w.*").filter(F.abs("move") > SUSPECT)


def rank_stocks(scored: DataFrame, n: int = 10, direction: str = "top", sector: str | None = None) -> DataFrame:
    if direction not in ("top", "bottom"):
        raise ValueError("direction is top or bottom")
    order = F.asc("model_probability") if direction == "bottom" else F.desc("model_probability")
    return summary_rows(in_sector(scored, sector).orderBy(order, "ticker").limit(bounded(n, 1, MOST, "n")))


def screen(
    scored: DataFrame, sector: str | None = None, min_probability: float | None = None, max_volatility: float | None = None, min_momentum_60d: float | None = None,
    max_pe_ratio: float | None = None, sort_by: str = "model_probability", ascending: bool = False, limit: int = 15,
) -> DataFrame:
    """Rows that meet every limit given, with `matches`, their number before the cut."""
    if sort_by not in SORTABLE or sort_by not in scored.columns:
        raise ValueError(f"sort_by must be one of {[c for c in SORTABLE if c in scored.columns]}")
    rows = in_sector(scored, sector)
    tests = [("model_probability", min_probability, lambda c, v: c >= v), ("volatility_20d", max_volatility, lambda c, v: c <= v), ("momentum_60d", min_momentum_60d, lambda c, v: c >= v), ("pe_ratio", max_pe_ratio, lambda c, v: (c <= v) & (c > 0))]
    for name, value, test in tests:
        if value is not None:
            if name not in rows.columns:
                raise ValueError(f"{name} is not in this dataset")
            rows = rows.filter(test(F.col(name), value))
    counted = rows.withColumn("matches", F.count("*").over(Window.partitionBy()))
    order = F.col(sort_by).asc_nulls_last() if ascending else F.col(sort_by).desc_nulls_last()
    return summary_rows(counted.orderBy(order, "ticker").limit(bounded(limit, 1, MOST, "limit")), ("pe_ratio", "matches"))


def compare(scored: DataFrame, tickers: Sequence) -> DataFrame:
    if not 2 <= len(tickers) <= 8:
        raise ValueError("2 to 8 tickers")
    return snapshot(scored, None).filter(F.col("ticker").isin(list(dict.fromkeys(tickers))))


def snapshot(scored: DataFrame, ticker) -> DataFrame:
    """One scored row (or all) with its stance and how many are ranked."""
    rows = scored.withColumn("out_of", F.count("*").over(Window.partitionBy()))
    rows = rows.withColumn("stance", stance(F.col("rank"), F.col("out_of"))).withColumn("company", label(rows))
    return rows if ticker is None else rows.filter(F.col("ticker") == ticker)


def newest(df: DataFrame, ticker, n: int, order: Sequence[Column]) -> DataFrame:
    """The first n rows in order, of one ticker or, with None, of each."""
    if ticker is not None:
        return df.filter(F.col("ticker") == ticker).orderBy(*order).limit(n)
    placed = df.withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy(*order)))
    return placed.filter(F.col("_k") <= n).drop("_k")


def price_history(features: DataFrame, ticker, days: int = 252, points: int = 60) -> DataFrame:
    """One row (None: a row a ticker) of the last sessions' figures, with a thinned series."""
    days = bounded(days, 20, 1260, "days")
    rows = price_series(features, ticker, days)
    by = Window.partitionBy("ticker").orderBy("date")
    rows = rows.withColumns({"_r": ratio("close", F.lag("close").over(by)) - 1, "_top": F.max("close").over(by.rowsBetween(Window.unboundedPreceding, 0)), "_i": F.row_number().over(by) - 1, "_n": F.count("*").over(Window.partitionBy("ticker"))})
    shown = (F.col("_i") % F.greatest(F.lit(1), F.ceil(F.col("_n") / points)) == 0) | (F.col("_i") == F.col("_n") - 1)
    first, last = F.min_by("close", "date"), F.max_by("close", "date")
    return rows.groupBy("ticker").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count("*").alias("trading_days"), first.alias("start_close"), last.alias("end_close"),
        (ratio(last, first) - 1).alias("total_return"), (F.stddev_samp("_r") * 252**0.5).alias("annualised_volatility"), F.min(ratio("close", "_top") - 1).alias("max_drawdown"),
        F.max("close").alias("high"), F.min("close").alias("low"), (ratio(last, F.max("close")) - 1).alias("distance_from_high"),
        F.sort_array(F.collect_list(F.when(shown, F.struct("date", "close")))).alias("series"),
    )


def price_series(features: DataFrame, ticker, days: int) -> DataFrame:
    keep = [c for c in ("ticker", "date", "close", "volume") if c in features.columns]
    return newest(features.select(*keep), ticker, days, [F.desc("date")])


def recent_news(news: DataFrame, ticker, limit: int = 8) -> DataFrame:
    keep = [c for c in ("date", "title", "sentiment_score", "source") if c in news.columns]
    rows = newest(news.select("ticker", *keep), ticker, bounded(limit, 1, 20, "limit"), [F.desc("date"), F.col("title")])
    return rows if ticker is None else rows.select(*keep)


def fundamentals_history(pit: DataFrame, ticker, quarters: int = 8) -> DataFrame:
    margin = F.when(F.col("revenue_ttm") > 0, F.col("net_income_ttm") / F.col("revenue_ttm"))
    rows = pit.withColumn("profit_margin", margin)
    return newest(rows, ticker, bounded(quarters, 1, 20, "quarters"), [F.desc("available_date")])


def macro_snapshot(macro: DataFrame) -> DataFrame:
    """(series, as_of, latest, year_ago, percentile_10y): one row for each series."""
    names = [c for c in ("vix", "tbill_3m", "treasury_10y", "term_spread") if c in macro.columns]
    by = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = macro.withColumns({c: F.last(c, ignorenulls=True).over(by) for c in names}).unpivot("date", names, "series", "value")
    whole = Window.partitionBy("series")
    rows = rows.withColumn("as_of", F.max("date").over(whole))
    rows = rows.withColumn("latest", F.max(F.when(F.col("date") == F.col("as_of"), F.col("value"))).over(whole))
    back = F.col("date") <= F.date_sub("as_of", 365)
    recent = F.col("date") >= F.date_sub("as_of", 3652)
    return rows.groupBy("series", "as_of", "latest").agg(F.max_by(F.when(back, F.col("value")), F.when(back, F.col("date"))).alias("year_ago"), F.avg(F.when(recent, F.coalesce(F.col("value") <= F.col("latest"), F.lit(False)).cast("int"))).alias("percentile_10y"))


def macro_series(macro: DataFrame) -> DataFrame:
    """The last ten years, every second row."""
    end = F.max("date").over(Window.partitionBy())
    rows = macro.withColumn("_e", end).filter(F.col("date") >= F.date_sub("_e", 3652))
    return rows.withColumn("_i", F.row_number().over(Window.orderBy("date")) - 1).filter("_i % 2 = 0").drop("_e", "_i")


def index_changes(changes: DataFrame, ticker=None, limit: int = 10, each: bool = False) -> DataFrame:
    """The newest changes of all tickers together, of one, or of each."""
    if each:
        return newest(changes, None, bounded(limit, 1, MOST, "limit"), [F.desc("date")])
    rows = changes if ticker is None else changes.filter(F.col("ticker") == ticker)
    return rows.orderBy(F.desc("date"), "ticker").limit(bounded(limit, 1, MOST, "limit"))


def currently_in(intervals: DataFrame) -> DataFrame:
    return intervals.groupBy("ticker").agg(F.bool_or(F.col("end_date").isNull()).alias("currently_in_index"), F.count("*").alias("periods"))


def sector_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("sector").agg(
        F.count("*").alias("stocks"), F.avg("model_probability").alias("mean_up_probability"), F.avg("return_20d").alias("mean_return_20d"), F.avg("volatility_20d").alias("mean_volatility"), F.min_by("ticker", "rank").alias("top_ranked")
    )


def filings(table: DataFrame, ticker, form: str | None = None, limit: int = 8) -> DataFrame:
    forms = ("10-K", "10-Q", "8-K")
    if form is not None and form not in forms:
        raise ValueError(f"form is one of {forms}")
    rows = table.filter(F.col("form").isin([form] if form else list(forms)))
    return newest(rows, ticker, bounded(limit, 1, 20, "limit"), [F.desc("filed")])


def screener_table(scored: DataFrame) -> DataFrame:
    rows = snapshot(scored, None)
    return rows.select("ticker", "company", *[c for c in ("sector", *SUMMARY, "momentum_12_1", "beta_252", "market_cap", "pe_ratio") if c in scored.columns], "stance")


def percentile_profile(scored: DataFrame, ticker) -> DataFrame:
    """One stock's percentile ranks (None: every stock's) as rows, unknown ones left out."""
    ranks = [c for c in scored.columns if c.endswith("_xs_rank")]
    one = scored if ticker is None else scored.filter(F.col("ticker") == ticker)
    rows = one.unpivot("ticker", ranks, "signal", "percentile")
    return rows.filter("percentile IS NOT NULL").withColumn("signal", F.regexp_replace("signal", "_xs_rank$", ""))


def overview(features: DataFrame, scored: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """One row: spans, counts and sectors of the dataset, tickers left out of the
    ranking, and the figures of a quality table of one row."""
    here = scored.agg(F.max("date").alias("as_of_date"), F.count("*").alias("stocks_ranked"), F.concat_ws(", ", F.sort_array(F.collect_set("sector"))).alias("sectors"))
    spans = features.agg(F.min("date").alias("history_start"), F.max("date").alias("history_end"), F.count_distinct("ticker").alias("tickers"), F.count("*").alias("rows"))
    out = here.crossJoin(spans).withColumn("left_out", F.col("tickers") - F.col("stocks_ranked"))  # a row each
    return out if quality is None else out.crossJoin(quality)


def front_page(features: DataFrame, scored: DataFrame, macro: DataFrame | None = None, summary: DataFrame | None = None, n: int = 10) -> DataFrame:
    """(section, place, name, figure, value): the overview, the top and bottom stocks,
    sectors, macro series and the strategies' figures, in long form."""
    def rows(section: str, df: DataFrame, name: str, order: Sequence[Column]) -> DataFrame:
        figures = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "bigint", "int") and f.name != name]
        placed = df.withColumn("_place", F.row_number().over(Window.orderBy(*order)))  # a few rows
        long = placed.select(F.lit(section).alias("section"), F.col("_place").alias("place"), F.col(name).cast("string").alias("name"), *[F.col(c).cast("double").alias(c) for c in figures])
        return long.unpivot(["section", "place", "name"], figures, "figure", "value").filter("value IS NOT NULL")

    whole = overview(features, scored)
    parts = [rows("overview", whole.drop("sectors"), "as_of_date", [F.col("as_of_date")])]
    parts += [rows(d, rank_stocks(scored, n, d).drop("sector", "company"), "ticker", [F.desc("model_probability") if d == "top" else F.asc("model_probability"), F.col("ticker")]) for d in ("top", "bottom")]
    if "sector" in scored.columns:
        parts.append(rows("sectors", sector_summary(scored).drop("top_ranked"), "sector", [F.desc("mean_up_probability"), F.col("sector")]))
    if macro is not None:
        parts.append(rows("macro", macro_snapshot(macro), "series", [F.col("series")]))
    if summary is not None:
        parts.append(rows("backtest", summary, "strategy", [F.col("strategy")]))
    return reduce(lambda a, b: a.unionByName(b), parts)


#: Tables that each evidence query shows, and how many rows of it (0: all).
MODEL_EVIDENCE = {"model_comparison": 0, "calibration": 0, "feature_importance": 8, "signal_ic": 8, "ic_breakdown": 0, "ic_decay": 0, "experiments": 0, "robustness": 0}
BACKTEST_EVIDENCE = {"backtest_summary": 0, "quantile_returns": 0, "constructions": 0, "cost_sensitivity": 0, "staggered": 0, "bootstrap": 0, "attribution": 0, "french_attribution": 0, "robustness": 0}


def evidence(spark: SparkSession, root: str, tables: dict[str, int]) -> dict[str, DataFrame]:
    """Saved artifacts by name, those that exist; a table with a number is cut to its
    first rows by its leading figure."""
    order = {"feature_importance": F.desc("importance_mean"), "signal_ic": F.desc(F.abs("ic_mean"))}
    found = {name: read(spark, f"{root}/{name}") for name in tables}
    return {name: df.orderBy(order[name]).limit(tables[name]) if tables[name] else df for name, df in found.items() if df is not None}


def model_evidence(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Comparison of models with the columns a reader needs, and what supports it;
    of the decay table the model's own score alone."""
    found = evidence(spark, root, MODEL_EVIDENCE)
    if "model_comparison" not in found:
        return {}
    shown = ("model", "ic_mean", "ic_tstat", "ic_tstat_nonoverlap", "auc_mean", "auc_std", "accuracy", "baseline_accuracy", "brier")
    table = found["model_comparison"]
    found["model_comparison"] = table.select(*[c for c in shown if c in table.columns])
    if "ic_decay" in found:
        found["ic_decay"] = found["ic_decay"].filter("signal = 'model_probability'")
    return found


def backtest_evidence(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The books' summary with its period, and what supports it; nothing without a summary."""
    found = evidence(spark, root, BACKTEST_EVIDENCE)
    if "backtest_summary" not in found:
        return {}
    returns = read(spark, f"{root}/backtest_returns")
    if returns is not None:
        found["period"] = returns.agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count_distinct("date").alias("rebalances"))
    return found


def late_rows(features: DataFrame, stale_days: int = 7) -> DataFrame:
    """Rows of the dates that `score_snapshot` can take a row from: what is ranked
    within dates need only be ranked there. The end is the last newest row of a member."""
    last = [F.max("date").alias("_last")]
    if "in_index" in features.columns:
        newest = features.groupBy("ticker").agg(*last, F.max_by("in_index", "date").alias("_in")).filter("_in")
    else:
        newest = features.select(F.col("date").alias("_last"))
    end = newest.agg(F.max("_last").alias("_end"))  # one row
    return features.crossJoin(F.broadcast(end)).filter(F.col("date") >= F.date_sub("_end", stale_days)).drop("_end")


def score_snapshot(features: DataFrame, score: str, stale_days: int = 7, recent: int = 5, history: DataFrame | None = None) -> DataFrame:
    """Each member's newest row, at most a week old and without a suspect move in
    its last rows (those of `history`, where `features` has only late rows), ranked
    by score. Only late rows are sorted by ticker."""
    late = late_rows(features, stale_days)
    fresh = late.withColumn("_n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).filter("_n = 1").drop("_n")
    if "in_index" in fresh.columns:
        fresh = fresh.filter("in_index")
    moves = data_warning(features if history is None else history, recent)
    fresh = fresh.join(moves.select("ticker"), "ticker", "left_anti").filter(F.col(score).isNotNull())
    return fresh.withColumn("model_probability", F.col(score)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), "ticker")).cast("long"))
