"""Quantile portfolios with smoothing, buffers, costs, drift and turnover.

Everything is long form (run, period, strategy, ticker), so all starting offsets
of a strategy are one job. Turnover needs no recursion: a period's trade is its
weights less the drifted weights of the period before, one union and aggregate.
Only the buffered selection depends on its own past; an array fold over chunks of
periods of one (run, side, sector) carries the names held.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.frames import ratio
from panelweave.functions.ordered import row_numbers
from panelweave.functions.shared import settle
from panelweave.operators.asof import asof
from panelweave.operators.stats import information_coefficients

YEAR = 252
SECTOR_NAMES = 4
#: Names of all periods that one row of a fold over buffered books takes.
MOST_NAMES = 4_000_000


@dataclass(frozen=True)
class Config:
    """How a portfolio is built; defaults trade the top and bottom fifth weekly."""

    score: str = "probability"
    returns: str = "tradable_return"
    holding_days: int = 5
    quantile: float = 0.2
    exit_quantile: float | None = None
    smooth_days: int = 1
    min_names: int = 5
    neutralize: str | None = None
    cost_bps: float = 10.0
    cost_model: str = "flat"
    spread_range: tuple[float, float] = (0.25, 4.0)
    borrow_bps: float = 0.0
    offsets: tuple[int, ...] = (0,)

    @staticmethod
    def for_target(target, **changes) -> Config:
        """Hold for the target's horizon; a sector target trades sector-neutral."""
        neutral = "sector" if target.relative_to == "sector" else None
        return Config(**({"holding_days": target.horizon, "neutralize": neutral} | changes))

    @property
    def per_year(self) -> float:
        return YEAR / self.holding_days


def smooth(predictions: DataFrame, score: str, days: int) -> DataFrame:
    """Each ticker's score averaged over its last `days` predictions."""
    if days <= 1:
        return predictions
    by = Window.partitionBy("ticker").orderBy("date").rowsBetween(1 - days, 0)
    return predictions.withColumn(score, F.avg(score).over(by))


def cross_sections(predictions: DataFrame, config: Config) -> DataFrame:
    """Rows of rebalance dates with enough names: run (the offset), period from 0."""
    rows = predictions.filter(F.col(config.score).isNotNull() & F.col(config.returns).isNotNull())
    rows = smooth(rows, config.score, config.smooth_days).withColumns({"_s": F.col(config.score), "_r": F.col(config.returns)})
    days = rows.groupBy("date").agg(F.count("*").alias("names")).withColumn("_no", F.row_number().over(Window.orderBy("date")) - 1)
    days = days.withColumn("run", F.explode(F.array(*[F.lit(o) for o in config.offsets])))
    days = days.filter((F.col("_no") >= F.col("run")) & ((F.col("_no") - F.col("run")) % config.holding_days == 0))
    days = days.filter(F.col("names") >= config.min_names)
    days = days.withColumn("period", F.row_number().over(Window.partitionBy("run").orderBy("date")) - 1)
    return rows.join(F.broadcast(days.drop("_no")), "date")  # a row a date and run


def unit_costs(rows: DataFrame, config: Config) -> DataFrame:
    """`unit`: cost of trading one unit of weight in each name."""
    flat = F.lit(config.cost_bps / 10_000)
    if config.cost_model != "spread" or "cs_spread_21d" not in rows.columns:
        return rows.withColumn("unit", flat)
    middle = F.median("cs_spread_21d").over(Window.partitionBy("run", "period"))
    low, high = config.spread_range
    relative = F.coalesce(F.greatest(F.lit(low), F.least(F.lit(high), F.col("cs_spread_21d") / middle)), F.lit(1.0))
    return rows.withColumn("unit", F.when(middle > 0, flat * relative).otherwise(flat))


def _sides(rows: DataFrame, keys: Sequence[str], config: Config) -> DataFrame:
    """Ranks from the top and the bottom, and how many names each book takes."""
    by = Window.partitionBy(*keys)
    n = F.count("*").over(by)
    up = F.row_number().over(by.orderBy(F.desc("_s"), "ticker"))
    rows = rows.withColumns({"_n": n, "_top": up}).withColumn("_bottom", F.col("_n") - F.col("_top") + 1)
    size = lambda q: F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(q)).cast("int"))
    rows = rows.withColumn("_k", size(config.quantile))
    return rows.withColumn("_exit", F.greatest(F.col("_k"), size(config.exit_quantile or config.quantile)))


def buffered(ranked: DataFrame, keys: Sequence[str], chunk: int = 64) -> DataFrame:
    """Names held under a buffer: holdings inside the top `_exit` stay (at most
    `_k`), the rest is filled from the top. Input (keys, period, ticker, _rank, _k,
    _exit); returns (keys, period, ticker). Groups are one run, side and sector.

    A group's period becomes its names in order; a fold over the periods carries
    the held names. It runs over `chunk` periods at a time (fewer, where they have
    over `MOST_NAMES` names), with the held names of each group handed on in a small
    table, so a row never holds a group's history.
    """
    spark, kind = ranked.sparkSession, ranked.schema["ticker"].dataType.simpleString()
    # only names that could be held: inside the exit rank or the first k of any order
    able = ranked.filter(F.col("_rank") <= F.col("_exit") + F.col("_k"))
    order = F.transform(F.sort_array(F.collect_list(F.struct("_rank", "ticker"))), lambda x: x["ticker"]).alias("names")
    days = settle(able.groupBy(*keys, "period").agg(F.first("_k").alias("k"), F.first("_exit").alias("leave"), order), "ranked-names")

    def choose(held: Column, day: Column) -> Column:
        # a set of the held names, in the order of the day: looking each up in the array took names squared
        stay = F.slice(F.array_intersect(F.slice(day["names"], F.lit(1), day["leave"]), F.array_compact(held)), F.lit(1), day["k"])
        return F.concat(stay, F.slice(F.array_except(day["names"], stay), F.lit(1), day["k"] - F.size(stay)))

    def step(state: Column, day: Column) -> Column:
        held = choose(state["held"], day)
        return F.struct(held.alias("held"), F.concat(state["all"], F.array(F.struct(day["period"].alias("period"), held.alias("held")))).alias("all"))

    last, most = days.agg(F.max("period"), F.max(F.size("names"))).first()
    chunk = max(1, min(chunk, MOST_NAMES // max(most or 1, 1)))
    period = days.schema["period"].dataType.simpleString()
    start = f"struct<held:array<{kind}>,all:array<struct<period:{period},held:array<{kind}>>>>"
    held, found = None, None
    for first in range(0, (last + 1) if last is not None else 0, chunk):
        some = days.filter(F.col("period").between(first, first + chunk - 1))
        groups = some.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("period", "k", "leave", "names"))).alias("days"))
        none = F.array().cast(f"array<{kind}>")
        if held is None:
            groups = groups.withColumn("before", none)
        else:
            groups = groups.join(held, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left").drop(*[f"_{k}" for k in keys]).withColumn("before", F.coalesce("before", none))
        state = F.struct(F.col("before").alias("held"), F.array().cast(f"array<struct<period:{period},held:array<{kind}>>>").alias("all")).cast(start)
        folded = settle(groups.select(*keys, F.aggregate("days", state, lambda s, d: step(s, d).cast(start)).alias("state")), "held-names")
        now = folded.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("state.held").alias("before"))
        if held is not None:  # groups without a name in these periods hold on
            same = [now[f"_{k}"].eqNullSafe(held[f"_{k}"]) for k in keys]
            now = now.unionByName(held.join(now, same, "left_anti"))
        held = now
        rows = folded.select(*keys, F.explode("state.all").alias("x")).select(*keys, "x.period", F.explode("x.held").alias("ticker"))
        found = rows if found is None else found.unionByName(rows)
    return found if found is not None else spark.createDataFrame([], ranked.select(*keys, "period", "ticker").schema)


def weights(rows: DataFrame, config: Config) -> DataFrame:
    """(run, period, date, strategy, ticker, w, r, unit) of the three books."""
    keys = ["run", "period"]
    if config.neutralize == "sector":
        ranked = _sides(rows.filter("sector IS NOT NULL"), [*keys, "sector"], config).filter(F.col("_n") >= SECTOR_NAMES)
        group = ["run", "side", "sector"]
    else:
        ranked = _sides(rows, keys, config)
        group = ["run", "side"]
    both = ranked.select("*", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("_top").alias("_rank")), F.struct(F.lit(-1).alias("side"), F.col("_bottom").alias("_rank")))).alias("x")).select("*", "x.*")
    if (config.exit_quantile or 0) > config.quantile:
        picked = both.join(buffered(both, group).select("run", "side", "period", "ticker"), ["run", "side", "period", "ticker"])
    else:
        picked = both.filter(F.col("_rank") <= F.col("_k"))
    picked = picked.withColumn("w", F.col("side") / F.count("*").over(Window.partitionBy("run", "period", "side")))
    cols = ["run", "period", "date", "ticker", F.col("_r").alias("r"), "unit"]
    longs = picked.filter("side = 1").select(F.lit("long_only").alias("strategy"), "w", *cols)
    shorts = picked.select(F.lit("long_short").alias("strategy"), "w", *cols)
    # a name in both books of a small cross-section keeps two rows, as it trades twice
    whole = rows.select(F.lit("benchmark").alias("strategy"), (1 / F.col("names")).alias("w"), *cols)
    return longs.unionByName(shorts).unionByName(whole)


def drifted(book: DataFrame) -> DataFrame:
    """Weights after the period's returns, at the gross they started from."""
    by = Window.partitionBy("run", "period", "strategy")
    moved = F.col("w") * (1 + F.col("r"))
    gross = F.sum(F.abs(moved)).over(by)
    return book.withColumn("w_end", F.when(gross > 0, moved / gross * F.sum(F.abs("w")).over(by)).otherwise(F.col("w")))


def trades(book: DataFrame, rows: DataFrame) -> DataFrame:
    """(run, period, strategy, turnover, cost) of moving from the drifted weights
    of the period before to the new ones; names that left the cross-section cost
    its median."""
    old = drifted(book).select("run", (F.col("period") + 1).alias("period"), "strategy", "ticker", F.lit(0.0).alias("w"), F.col("w_end").alias("before"))
    new = book.select("run", "period", "strategy", "ticker", "w", F.lit(0.0).alias("before"))
    moved = new.unionByName(old).groupBy("run", "period", "strategy", "ticker").agg(F.sum("w").alias("w"), F.sum("before").alias("before"))
    price = rows.select("run", "period", "ticker", "unit")
    middle = rows.groupBy("run", "period").agg(F.median("unit").alias("_middle"))  # also drops the period after the last
    traded = F.abs(F.col("w") - F.col("before"))
    joined = moved.join(middle, ["run", "period"]).join(price, ["run", "period", "ticker"], "left")
    return joined.groupBy("run", "period", "strategy").agg(F.sum(traded).alias("turnover"), F.sum(traded * F.coalesce("unit", "_middle")).alias("cost"))


def backtest(predictions: DataFrame, config: Config = Config()) -> DataFrame:
    """(run, period, date, strategy, names, gross, turnover, cost, net)."""
    kept = [c for c in ("sector", "cs_spread_21d") if c in predictions.columns]
    rows = cross_sections(predictions, config).select("run", "period", "date", "names", "ticker", "_s", "_r", *kept)
    rows = settle(unit_costs(rows, config), "cross-sections")
    book = settle(weights(rows, config), "books")
    borrow = config.borrow_bps / 10_000 * config.holding_days / YEAR
    earned = book.groupBy("run", "period", "date", "strategy").agg(
        F.sum(F.col("w") * F.col("r")).alias("gross"), F.sum(F.when(F.col("strategy") == "long_short", F.greatest(-F.col("w"), F.lit(0.0))).otherwise(0.0)).alias("_short")
    )
    days = rows.select("run", "period", "names").distinct()
    found = earned.join(trades(book, rows), ["run", "period", "strategy"]).join(F.broadcast(days), ["run", "period"])
    found = found.withColumn("cost", F.col("cost") + borrow * F.col("_short")).drop("_short")
    return settle(found.withColumn("net", F.col("gross") - F.col("cost")), "returns")


def index_returns(index_prices: DataFrame, holding_days: int, lag: int = 1) -> DataFrame:
    """(date, index_return): enter `lag` index sessions after the date, hold on."""
    by = Window.orderBy("date")
    rows = index_prices.filter("close IS NOT NULL")
    return rows.select("date", (ratio(F.lead("close", lag + holding_days).over(by), F.lead("close", lag).over(by)) - 1).alias("index_return"))


def with_index(returns: DataFrame, index_prices: DataFrame, config: Config, covered: float = 0.9) -> DataFrame:
    """Add the index as a strategy if it covers over 90 % of the periods; periods
    without an index return are then dropped for every strategy."""
    market = index_returns(index_prices, config.holding_days)
    joined = settle(returns.join(F.broadcast(market), "date", "left"), "with-index")  # a row a period and strategy
    share = joined.select("date", "index_return").distinct().agg(F.avg(F.col("index_return").isNotNull().cast("int"))).first()[0]
    if not share or share <= covered:
        return returns
    kept = joined.filter("index_return IS NOT NULL")
    own = kept.filter("strategy = 'benchmark'").withColumns({"strategy": F.lit("index"), "gross": F.col("index_return"), "turnover": F.lit(0.0), "cost": F.lit(0.0), "net": F.col("index_return")})
    return kept.unionByName(own).drop("index_return")


def with_cash(returns: DataFrame, rates: DataFrame, config: Config) -> DataFrame:
    """`cash`: the last known annual rate, for the holding period. One row a date
    on either side, so the keyless as-of is small."""
    days = returns.select("date").distinct()
    known = rates.filter("rate IS NOT NULL").groupBy("date").agg(F.first("rate").alias("rate")).withColumnRenamed("date", "rate_date")
    cash = asof(days, known, "date", "rate_date", ["rate"]).select("date", (F.coalesce("rate", F.lit(0.0)) * config.holding_days / YEAR).alias("cash"))
    return returns.join(F.broadcast(cash), "date")


def max_drawdown(returns: DataFrame, keys: Sequence[str], value: str = "net", order: str = "date") -> DataFrame:
    """(keys, max_drawdown): the deepest fall below the running top."""
    by = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    curve = returns.withColumn("_e", F.product(1 + F.col(value)).over(by))
    curve = curve.withColumn("_d", ratio("_e", F.max("_e").over(by)) - 1)
    return curve.groupBy(*keys).agg(F.min("_d").alias("max_drawdown"))


def curves(returns: DataFrame, keys: Sequence[str] = ("run", "strategy"), value: str = "net") -> DataFrame:
    """Growth of one unit and fall below its top, by date."""
    by = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    rows = returns.withColumn("growth", F.product(1 + F.col(value)).over(by))
    return rows.select(*keys, "date", "growth", (ratio("growth", F.max("growth").over(by)) - 1).alias("drawdown"))


def sharpe(value: Column, per_year: float) -> Column:
    return F.when(F.stddev_samp(value) > 0, F.avg(value) / F.stddev_samp(value) * per_year**0.5)


def performance(returns: DataFrame, per_year: float, keys: Sequence[str] = ("run", "strategy"), value: str = "net") -> DataFrame:
    """Total, annual growth, volatility, Sharpe (above cash but for long-short),
    drawdown and hit rate."""
    rows = returns.filter(F.col(value).isNotNull())
    cash = F.when(F.col("strategy") != "long_short", F.coalesce("cash", F.lit(0.0))).otherwise(0.0) if "cash" in rows.columns else F.lit(0.0)
    rows = rows.withColumn("_x", F.col(value) - cash)
    growth, n = F.product(1 + F.col(value)), F.count("*")
    found = rows.groupBy(*keys).agg(
        n.alias("periods"),
        (growth - 1).alias("total_return"),
        F.when(growth > 0, F.pow(growth, per_year / n) - 1).otherwise(-1.0).alias("cagr"),
        (F.stddev_samp("_x") * per_year**0.5).alias("ann_volatility"),
        sharpe(F.col("_x"), per_year).alias("sharpe"),
        F.avg((F.col(value) > 0).cast("int")).alias("hit_rate"),
    )
    return found.join(max_drawdown(rows, keys, value), list(keys))


def summary(returns: DataFrame, config: Config) -> DataFrame:
    """Performance of each strategy with turnover (first rebalance left out), cost
    drag and, for long-only, the information ratio against the benchmark."""
    keys = ["run", "strategy"]
    later = F.avg(F.when(F.col("period") > 0, F.col("turnover")))
    extra = returns.groupBy(*keys).agg(later.alias("avg_turnover"), (F.avg("cost") * config.per_year).alias("cost_drag"), (F.product(1 + F.col("gross")) - 1).alias("gross_total_return"))
    base = returns.filter("strategy = 'benchmark'").select("run", "period", F.col("net").alias("_b"))
    active = returns.filter("strategy = 'long_only'").join(base, ["run", "period"]).withColumn("_a", F.col("net") - F.col("_b"))
    ratio = active.groupBy(*keys).agg(sharpe(F.col("_a"), config.per_year).alias("information_ratio"))
    found = performance(returns, config.per_year).join(extra, keys).join(ratio, keys, "left")
    equal = found.filter("strategy = 'benchmark'").select("run", F.col("cagr").alias("_c"))
    excess = F.when(F.col("strategy") == "long_only", F.col("cagr") - F.col("_c"))
    return found.join(equal, "run").withColumn("excess_cagr", excess).drop("_c")


def staggered(found: DataFrame) -> DataFrame:
    """Mean and range over the starting offsets, from one job's summary."""
    spread = [f(c).alias(f"{c}_{name}") for c in ("cagr", "sharpe") for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    return found.groupBy("strategy").agg(F.count_distinct("run").alias("offsets"), *spread)


def cost_sensitivity(returns: DataFrame, config: Config, levels: Sequence[float] = (0, 5, 10, 20, 40)) -> DataFrame:
    """Growth and Sharpe of both books at flat costs."""
    rows = returns.filter("strategy IN ('long_only', 'long_short')").withColumn("cost_bps", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    rows = rows.withColumn("net", F.col("gross") - F.col("turnover") * F.col("cost_bps") / 10_000)
    return performance(rows, config.per_year, ["run", "strategy", "cost_bps"]).select("run", "strategy", "cost_bps", "cagr", "sharpe")


def break_even(returns: DataFrame) -> DataFrame:
    """Cost in basis points at which each book's gross edge is used up."""
    pick = lambda c, s: F.avg(F.when(F.col("strategy") == s, F.col(c)))
    found = returns.groupBy("run").agg(*[pick(c, s).alias(f"_{c}_{s}") for c in ("gross", "turnover") for s in ("long_only", "long_short", "benchmark")])
    turned = F.col("_turnover_long_only") - F.col("_turnover_benchmark")
    return found.select(
        "run",
        F.when(turned > 0, (F.col("_gross_long_only") - F.col("_gross_benchmark")) / turned * 10_000).alias("long_only_vs_equal_weight_bps"),
        F.when(F.col("_turnover_long_short") > 0, F.col("_gross_long_short") / F.col("_turnover_long_short") * 10_000).alias("long_short_bps"),
    )


def quantile_returns(predictions: DataFrame, config: Config, buckets: int = 5) -> DataFrame:
    """Mean of the dates' mean returns by score bucket."""
    rows = cross_sections(predictions, config).filter(F.col("names") >= max(buckets, config.min_names))
    place = F.row_number().over(Window.partitionBy("run", "date").orderBy("_s", "ticker"))
    # whole numbers: a bucket edge must not hang on a rounding of rank / n
    bucket = F.floor((place * buckets + F.col("names") - 1) / F.col("names")).cast("int")
    dated = rows.withColumn("quantile", F.greatest(F.lit(1), F.least(F.lit(buckets), bucket))).groupBy("run", "date", "quantile").agg(F.avg("_r").alias("r"))
    return dated.groupBy("run", "quantile").agg(F.avg("r").alias("mean_return"), F.count("*").alias("observations"))


def rebalance_ic(predictions: DataFrame, config: Config) -> DataFrame:
    """Rank correlation of the smoothed score at the rebalance dates alone."""
    return information_coefficients(cross_sections(predictions, config), "_s", "_r", ["run", "date"], config.min_names)


def rolling_ic(ic: DataFrame, rows: int = 12, least: int = 6) -> DataFrame:
    by = Window.partitionBy("run").orderBy("date").rowsBetween(1 - rows, 0)
    return ic.withColumn("rolling_ic", F.when(F.count("ic").over(by) >= least, F.avg("ic").over(by)))


def pair_covariance(returns: DataFrame, last: int = 126, tile: int = 256, value: str = "return_1d", strips: int = 32) -> DataFrame:
    """(a, b, cov), a <= b: covariances of tickers' returns over the last dates,
    missing ones as 0.

    Tickers lie in tiles; a tile is a dense matrix of dates by tickers in one row.
    Tiles lie in `strips` strips at most, and every two strips meet in a task, which
    holds the tiles of one and takes those of the other one by one. So a tile is
    sent `strips` times however many tickers there are, and no row is made for a
    pair of tickers on a date.
    """
    known = settle(returns.filter(F.col(value).isNotNull()).select("ticker", "date", F.col(value).cast("double").alias("_x")), "covariance-returns")
    days = known.select("date").distinct().orderBy(F.desc("date")).limit(last).withColumn("_day", F.row_number().over(Window.orderBy("date")) - 1)  # `last` rows
    days = settle(days, "covariance-days")
    n = days.count()
    rows = known.join(F.broadcast(days), "date").select("ticker", "_day", "_x")
    names = row_numbers(rows.select("ticker").distinct(), ["ticker"], "_no", "covariance-names").withColumn("_no", F.col("_no") - 1)
    cells = rows.join(names, "ticker").withColumns({"_tile": F.floor(F.col("_no") / tile).cast("int"), "_at": (F.col("_no") % tile).cast("int")})
    cells = cells.groupBy("_tile").agg(F.collect_list(F.struct("_at", "_day", "_x")).alias("cells"))  # tile * last cells at most
    tickers = names.groupBy(F.floor(F.col("_no") / tile).cast("int").alias("_tile")).agg(F.transform(F.sort_array(F.collect_list(F.struct("_no", "ticker"))), lambda x: x["ticker"]).alias("tickers"))
    kind = returns.schema["ticker"].dataType.simpleString()

    def dense(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                at, day, x = (batch.column(1)[i].values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                m = np.zeros((n, len(batch.column(2)[i].values)))
                m[day, at] = x
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], batch.column(2)[i : i + 1], pa.array([(m - m.mean(0)).tobytes()], pa.binary())], ["_tile", "tickers", "m"])

    tiles = settle(cells.join(tickers, "_tile").select("_tile", "cells", "tickers").mapInArrow(dense, f"_tile int, tickers array<{kind}>, m binary"), "covariance-tiles")
    most = tiles.agg(F.max("_tile")).first()[0]
    if most is None:
        return returns.sparkSession.createDataFrame([], f"a {kind}, b {kind}, cov double")
    strips = min(strips, most + 1)
    strip = F.floor(F.col("_tile").cast("long") * strips / (most + 1)).cast("int")
    sent = tiles.withColumn("_strip", strip).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    sent = sent.select((F.least("_strip", "_other") * strips + F.greatest("_strip", "_other")).alias("_pair"), (F.col("_strip") > F.col("_other")).alias("_second"), "_tile", "tickers", "m")
    sent = sent.repartition(strips * (strips + 1) // 2, "_pair").sortWithinPartitions("_pair", "_second", "_tile")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        pair, first = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                at, second, no, tickers, data = (batch.column(k)[i] for k in range(5))
                if at.as_py() != pair:
                    pair, first = at.as_py(), []
                mine = no.as_py(), pa.array(tickers.as_py(), tickers.type.value_type), np.frombuffer(data.as_py()).reshape(n, -1)
                if not second.as_py():
                    first.append(mine)
                if second.as_py() or pair // strips == pair % strips:
                    for other, names, m in first:
                        cov = m.T @ mine[2] / n
                        a, b = np.nonzero(np.triu(np.ones(cov.shape, bool)) if other == mine[0] else np.ones(cov.shape, bool))
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), mine[1].take(pa.array(b)), pa.array(cov[a, b])], ["a", "b", "cov"])

    return sent.mapInArrow(run, f"a {kind}, b {kind}, cov double")


def neutral_weights(rows: DataFrame, exposures: Sequence[str], score: str = "probability", ic: float = 0.02, holding_days: int = 5, gross: float = 2.0) -> DataFrame:
    """Long-short weights along Grinold alphas with no net weight and no net
    exposure: each date's alphas are residualised on a constant and the exposures
    by closed-form regressions one after another (Gram-Schmidt), then scaled."""
    from panelweave.functions.frames import avg_rank, ppf_sql

    by = Window.partitionBy("date")

    def residual_slope(of, on):  # null where the exposure is constant or a sum of those before
        square = F.sum(F.col(on) * F.col(on)).over(by)
        return F.when(square > 1e-18, F.try_divide(F.sum(F.col(of) * F.col(on)).over(by), square))

    rows = rows.withColumn("_p", F.try_divide(avg_rank(score, ["date"]) - 0.5, F.count(score).over(by))).withColumn("_z", F.expr(ppf_sql("_p")))
    vol = F.coalesce("volatility_20d", F.median("volatility_20d").over(by), F.lit(0.3)) if "volatility_20d" in rows.columns else F.lit(0.3)
    rows = rows.withColumn("alpha", ic * vol * (holding_days / YEAR) ** 0.5 * F.col("_z"))
    done: list[str] = []
    for i, name in enumerate(exposures):
        held = F.coalesce(F.col(name), F.median(name).over(by), F.lit(0.0))
        rows = rows.withColumn(f"_x{i}", held)
        rows = rows.withColumn(f"_x{i}", F.col(f"_x{i}") - F.avg(f"_x{i}").over(by))
        for d in done:
            slope = residual_slope(f"_x{i}", d)
            rows = rows.withColumn(f"_x{i}", F.col(f"_x{i}") - F.coalesce(slope, F.lit(0.0)) * F.col(d))
        done.append(f"_x{i}")
    rows = rows.withColumn("_a", F.col("alpha") - F.avg("alpha").over(by))
    for d in done:
        rows = rows.withColumn("_a", F.col("_a") - F.coalesce(residual_slope("_a", d), F.lit(0.0)) * F.col(d))
    total = F.sum(F.abs("_a")).over(by)
    return rows.withColumn("w", F.when(total > 0, F.col("_a") / total * gross)).drop("_p", "_z", "_a", *done)
