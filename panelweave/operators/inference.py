"""Attribution regressions, resampling and multiple-testing statistics.

Inputs are return series of one row a period; sums and resamples run in Spark,
and only k x k cross-products or single moments are solved on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.functions.frames import cdf_sql, ppf_sql
from panelweave.functions.shared import settle

EULER = 0.5772156649015329


def usable_factors(data: DataFrame, y: str, factors: Sequence[str], present: float = 0.5) -> tuple[DataFrame, list[str]]:
    """Complete rows, and the factors that are mostly present and not constant."""
    share = data.agg(*[F.avg(F.col(c).isNotNull().cast("int")).alias(c) for c in factors]).first()
    kept = [c for c in factors if (share[c] or 0) > present]
    rows = data.dropna(subset=[y, *kept])
    spread = rows.agg(*[F.stddev_samp(c).alias(c) for c in kept]).first() if kept else {}
    return rows, [c for c in kept if spread[c] and spread[c] > 0]


def hac_regression(data: DataFrame, y: str, factors: Sequence[str], order: str = "date", lags: int | None = None) -> dict:
    """OLS with plain and Newey-West standard errors: the cross-products and the
    lagged products of the scores are Spark aggregates."""
    names = ["_one", *factors]
    rows = data.withColumn("_one", F.lit(1.0)).select(order, F.col(y).cast("double").alias("_y"), *names)
    k = len(names)
    sums = rows.agg(F.count("*").alias("n"), F.avg("_y").alias("m"), *[F.sum(F.col(a) * F.col(b)).alias(f"x{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i], *[F.sum(F.col(a) * F.col("_y")).alias(f"y{i}") for i, a in enumerate(names)]).first()
    n = sums.n
    cross = np.array([[sums[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
    inverse = np.linalg.inv(cross)
    coef = inverse @ np.array([sums[f"y{i}"] for i in range(k)])
    lags = math.floor(4 * (n / 100) ** (2 / 9)) if lags is None else lags
    fitted = sum((F.lit(float(c)) * F.col(x) for c, x in zip(coef, names, strict=True)), F.lit(0.0))
    rows = rows.withColumn("_e", F.col("_y") - fitted)
    by = Window.orderBy(order)  # a row a period
    scores = rows.select(order, "_e", *[(F.col(x) * F.col("_e")).alias(f"s{i}") for i, x in enumerate(names)])
    lagged = scores.withColumns({f"l{lag}_{i}": F.lag(f"s{i}", lag).over(by) for lag in range(1, min(lags, n - 1) + 1) for i in range(k)})
    products = [F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m0_{i}_{j}") for i in range(k) for j in range(k)]
    products += [F.sum(F.col(f"s{i}") * F.col(f"l{lag}_{j}")).alias(f"m{lag}_{i}_{j}") for lag in range(1, min(lags, n - 1) + 1) for i in range(k) for j in range(k)]
    found = lagged.agg(F.sum(F.col("_e") * F.col("_e")).alias("ee"), *products).first()
    spread = rows.agg(F.sum(F.pow(F.col("_y") - sums.m, 2))).first()[0]
    meat = np.array([[found[f"m0_{i}_{j}"] for j in range(k)] for i in range(k)])
    for lag in range(1, min(lags, n - 1) + 1):
        gamma = np.array([[found[f"m{lag}_{i}_{j}"] or 0.0 for j in range(k)] for i in range(k)])
        meat += (1 - lag / (lags + 1)) * (gamma + gamma.T)
    plain = np.sqrt(np.diag(found.ee / (n - k) * inverse))
    robust = np.sqrt(np.clip(np.diag(inverse @ meat @ inverse * n / (n - k)), 0, None))
    return {"names": names, "coef": coef, "se": plain, "se_hac": robust, "n": n, "r_squared": 1 - found.ee / spread if spread else None}


def attribute(data: DataFrame, y: str, factors: Sequence[str], per_year: float, order: str = "date") -> dict:
    """Annual alpha, betas and t-statistics; empty with too few periods."""
    rows, kept = usable_factors(data, y, factors)
    if rows.count() < len(kept) + 5:
        return {}
    found = hac_regression(rows, y, kept, order)
    coef, robust, plain = found["coef"], found["se_hac"], found["se"]
    out = {"alpha_annual": coef[0] * per_year, "alpha_tstat": coef[0] / robust[0], "alpha_tstat_ols": coef[0] / plain[0], "r_squared": found["r_squared"], "periods": found["n"]}
    for i, c in enumerate(kept, 1):
        out |= {f"beta_{c}": coef[i], f"tstat_{c}": coef[i] / robust[i]}
    return {k: None if v is None else float(v) for k, v in out.items()}


# The characteristic each factor sorts on, and the sign of high minus low.
FACTORS = {"SMB": ("market_cap", -1), "HML": ("book_to_market", 1), "MOM": ("momentum_12_1", 1)}


def factor_returns(panel: DataFrame, returns: str, share: float = 0.3, least: int = 30, factors: dict = FACTORS) -> DataFrame:
    """(date, one column a factor): top less bottom `share` by characteristic, null
    under `least` names."""
    from panelweave.functions.frames import places

    out = None
    for name, (column, sign) in factors.items():
        if column not in panel.columns:
            continue
        rows = panel.filter(F.col(column).isNotNull() & F.col(returns).isNotNull()).select("date", column, F.col(returns).alias("_r"))
        rows = places(rows, [column], ["date"]).withColumn("_p", F.col(f"_place_{column}") / F.col(f"_known_{column}"))
        spread = F.avg(F.when(F.col("_p") >= 1 - share, F.col("_r"))) - F.avg(F.when(F.col("_p") <= share, F.col("_r")))
        found = rows.groupBy("date").agg(F.when(F.count("*") >= least, sign * spread).alias(name))
        out = found if out is None else out.join(found, "date", "outer")
    return out


def compound_factors(daily: DataFrame, holding_days: int, lag: int = 1) -> DataFrame:
    """Daily factor returns compounded over the sessions lag + 1 to lag + holding
    after each date; null where the window is not whole."""
    names = [c for c in daily.columns if c != "date"]
    frame = Window.orderBy("date").rowsBetween(lag + 1, lag + holding_days)  # a row a date
    return daily.select("date", *[F.when(F.count(c).over(frame) == holding_days, F.product(1 + F.col(c)).over(frame) - 1).alias(c) for c in names])


def uniform(seed: int, *parts: Column | str) -> Column:
    """Numbers from 0 to 1 from the first 52 bits of an MD5 digest of the parts, which
    any engine can draw again."""
    text = F.concat_ws(":", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def block_draws(spark: SparkSession, n: int, reps: int, mean_block: float, seed: int = 42) -> DataFrame:
    """(rep, block, first, start, size): stationary bootstrap of n periods. Block b of
    a repetition fills the places from `first` on with `size` periods from `start`,
    going round at the end; sizes are geometric, and the last block is cut at n.

    Blocks are drawn until their sizes reach n: eight deviations more than the
    expected number are drawn, and the last of those takes what would be left.
    """
    most = min(n, math.ceil(n / max(mean_block, 1.0) + 8 * math.sqrt(n / max(mean_block, 1.0))) + 8)
    rows = spark.range(reps).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("block"))
    long = F.floor(F.ln(1 - uniform(seed, "rep", "block", F.lit("size"))) / math.log(1 - 1 / mean_block)) if mean_block > 1 else F.lit(0)
    rows = rows.withColumns({"size": F.least(F.lit(n), 1 + long).cast("int"), "start": F.floor(uniform(seed, "rep", "block", F.lit("start")) * n).cast("int")})
    by = Window.partitionBy("rep").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("first", (F.sum("size").over(by) - F.col("size")).cast("int")).filter(F.col("first") < n)
    rest = n - F.col("first")
    return rows.select("rep", "block", "first", "start", F.when(F.col("block") == most - 1, rest).otherwise(F.least("size", rest)).alias("size"))


def bootstrap_indices(spark: SparkSession, n: int, reps: int, mean_block: float, seed: int = 42) -> DataFrame:
    """(rep, t, idx): every place of every repetition, for what is not a sum."""
    rows = block_draws(spark, n, reps, mean_block, seed).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
    return rows.select("rep", (F.col("first") + F.col("k")).alias("t"), ((F.col("start") + F.col("k")) % n).alias("idx"))


def numbered(series: DataFrame, order: str = "date") -> DataFrame:
    return series.withColumn("idx", F.row_number().over(Window.orderBy(order)) - 1)  # a row a period


def block_sums(series: DataFrame, draws: DataFrame, n: int, sums: dict[str, Column], keys: Sequence[str] = (), most: int = 200_000) -> DataFrame:
    """(rep, keys, a column for each of `sums`): sums over each resample.

    The series goes round once more and is summed up from its start, so a block's
    sum is the difference of two of its rows: a resample costs its blocks, not its
    periods. Rows of `series` have `idx` from 0 to n - 1 within the keys.
    """
    twice = series.withColumn("_turn", F.explode(F.array(F.lit(0), F.lit(n)))).select(*keys, (F.col("idx") + F.col("_turn")).alias("_at"), *[c.alias(name) for name, c in sums.items()])
    by = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    upto = settle(twice.select(*keys, "_at", *[F.sum(c).over(by).alias(c) for c in sums]), "running-sums")
    size = upto.count()
    small = F.broadcast if size <= most else lambda df: df
    ends = draws.select("rep", F.explode(F.array(F.struct((F.col("start") + F.col("size") - 1).alias("_at"), F.lit(1.0).alias("_sign")), F.struct((F.col("start") - 1).alias("_at"), F.lit(-1.0).alias("_sign")))).alias("_e")).select("rep", "_e.*").filter("_at >= 0")
    return ends.join(small(upto), "_at").groupBy("rep", *keys).agg(*[F.sum(F.col("_sign") * F.col(c)).alias(c) for c in sums])


def bootstrap_performance(series: DataFrame, strategies: Sequence[str], per_year: float, cash: str | None = None, reps: int = 2000, mean_block: float | None = None, seed: int = 42, no_cash: Sequence[str] = ("long_short",)) -> DataFrame:
    """95 % intervals of growth and Sharpe; all strategies share the resampled dates."""
    rows = settle(numbered(series.dropna(subset=list(strategies))), "series")
    n = rows.count()
    draws = block_draws(series.sparkSession, n, reps, mean_block or max(2.0, n ** (1 / 3)), seed)
    long = rows.unpivot(["idx", *([cash] if cash else [])], list(strategies), "strategy", "r")
    excess = F.col("r") - (F.when(F.col("strategy").isin(list(no_cash)), 0.0).otherwise(F.col(cash)) if cash else F.lit(0.0))
    long = long.withColumn("_x", excess).withColumn("_m", F.avg("_x").over(Window.partitionBy("strategy")))  # n rows a strategy
    grown, off = 1 + F.col("r"), F.col("_x") - F.col("_m")
    sums = {"log": F.when(grown != 0, F.ln(F.abs(grown))).otherwise(0.0), "lost": (grown == 0).cast("double"), "below": (grown < 0).cast("double"), "x": off, "xx": off * off, "m": F.col("_m") / n}
    found = block_sums(long, draws, n, sums, ["strategy"])
    growth = F.when((F.round("lost") == 0) & (F.round("below") % 2 == 0), F.exp("log"))
    spread = F.col("xx") - F.col("x") * F.col("x") / n
    deviation = F.sqrt(F.when(spread > 1e-14 * F.col("xx"), spread) / (n - 1)) if n > 1 else F.lit(None).cast("double")
    paths = found.select("strategy", F.when(growth.isNotNull(), F.pow(growth, per_year / n) - 1).otherwise(-1.0).alias("cagr"), ((F.col("x") / n + F.col("m")) / deviation * per_year**0.5).alias("sharpe"))
    cut = lambda c, p: F.percentile(c, F.lit(p))
    return paths.groupBy("strategy").agg(
        cut("cagr", 0.025).alias("cagr_low"), cut("cagr", 0.975).alias("cagr_high"), cut("sharpe", 0.025).alias("sharpe_low"), cut("sharpe", 0.975).alias("sharpe_high"), F.avg((F.col("sharpe") <= 0).cast("int")).alias("prob_sharpe_not_positive")
    )


def bootstrap_alpha(data: DataFrame, y: str, factors: Sequence[str], per_year: float, reps: int = 2000, mean_block: float | None = None, seed: int = 42) -> DataFrame:
    """95 % interval of the annual alpha: each resample's cross-products are sums over
    its blocks, and its small system is solved in a batch of many."""
    rows, kept = usable_factors(data, y, factors)
    rows = settle(numbered(rows).withColumn("_one", F.lit(1.0)), "alpha-series")
    n, names = rows.count(), ["_one", *kept]
    k = len(names)
    draws = block_draws(data.sparkSession, n, reps, mean_block or max(2.0, n ** (1 / 3)), seed)
    sums = {f"x{i}_{j}": F.col(a) * F.col(b) for i, a in enumerate(names) for j, b in enumerate(names) if i <= j} | {f"y{i}": F.col(a) * F.col(y) for i, a in enumerate(names)}
    found = block_sums(rows, draws, n, sums)
    cells = found.select(F.array(*[F.col(f"x{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)]).alias("xx"), F.array(*[F.col(f"y{i}") for i in range(k)]).alias("xy"))

    def solve(batches):
        import pandas as pd

        for pdf in batches:
            xx = np.array(pdf.xx.tolist(), float).reshape(-1, k, k)
            xy = np.array(pdf.xy.tolist(), float).reshape(-1, k)
            yield pd.DataFrame({"alpha": (np.linalg.pinv(xx) @ xy[:, :, None])[:, 0, 0] * per_year})

    found = cells.mapInPandas(solve, "alpha double")
    return found.agg(F.percentile("alpha", F.lit(0.025)).alias("alpha_low"), F.percentile("alpha", F.lit(0.975)).alias("alpha_high"), F.avg((F.col("alpha") <= 0).cast("int")).alias("prob_alpha_not_positive"))


def moments(series: DataFrame, value: str = "r", keys: Sequence[str] = ("series",)) -> DataFrame:
    """(keys, n, mean, std, skew, kurtosis): sample-corrected moments of each series;
    a normal one has a kurtosis of 3."""
    n = F.count(value)
    skew = F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)
    kurtosis = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6) + 3
    enough = (n > 3) & (F.stddev_samp(value) > 0)
    return series.groupBy(*keys).agg(n.alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.when(enough, skew).alias("skew"), F.when(enough, kurtosis).alias("kurtosis"))


def best_by_luck(trials: DataFrame, counted: int | None = None) -> DataFrame:
    """One row (trials, threshold): the Sharpe ratio that the best of so many unskilled
    trials would show, from the deviation of column `sharpe`; 0 for under two trials."""
    known = F.when(F.abs("sharpe") < float("inf"), F.col("sharpe"))
    of = trials.agg(F.count(known).alias("_k"), F.stddev_samp(known).alias("_spread")).withColumn("trials", F.lit(counted).cast("long") if counted else F.col("_k"))
    of = of.withColumns({"_p": 1 - F.try_divide(F.lit(1.0), F.col("trials")), "_q": 1 - F.try_divide(F.lit(1 / math.e), F.col("trials"))})
    top = F.col("_spread") * ((1 - EULER) * F.expr(ppf_sql("_p")) + EULER * F.expr(ppf_sql("_q")))
    return of.select("trials", F.when(F.least("_k", "trials") > 1, top).otherwise(0.0).alias("threshold"))


def sharpe_tests(series: DataFrame, luck: DataFrame, value: str = "r", keys: Sequence[str] = ("series",), least: int = 10) -> DataFrame:
    """(keys, sharpe_per_period, trials, expected_max_sharpe_per_period,
    probabilistic_sharpe, deflated_sharpe): chances that a series' true Sharpe ratio
    is above 0, and above `luck` (the row of `best_by_luck`), given its length, skew
    and kurtosis. Series of under `least` periods, or constant ones, have no row."""
    rows = moments(series, value, keys).filter((F.col("n") >= least) & (F.col("std") > 0)).join(F.broadcast(luck))  # one row
    rows = rows.withColumn("_sr", F.col("mean") / F.col("std"))
    wide = 1 - F.col("skew") * F.col("_sr") + (F.col("kurtosis") - 1) / 4 * F.col("_sr") * F.col("_sr")
    rows = rows.withColumn("_scale", F.when(wide > 0, F.sqrt((F.col("n") - 1) / wide)))
    rows = rows.withColumns({"_z0": F.col("_sr") * F.col("_scale"), "_z1": (F.col("_sr") - F.col("threshold")) * F.col("_scale")})
    chance = lambda z: F.when(F.col(z).isNotNull(), F.expr(cdf_sql(z)))
    return rows.select(*keys, F.col("_sr").alias("sharpe_per_period"), "trials", F.col("threshold").alias("expected_max_sharpe_per_period"), chance("_z0").alias("probabilistic_sharpe"), chance("_z1").alias("deflated_sharpe"))


def overfitting_probability(trials: DataFrame, names: Sequence[str], splits: int = 16, order: str = "date") -> DataFrame:
    """One row: how often the best strategy in one half of the blocks ranks in the
    lower half of the other, over every way to halve the blocks.

    Of equal Sharpe ratios the first strategy by `names` counts as best and ranks
    first; one without a ratio in a half is never best there and ranks last.
    Blocks are summed once; the halves are the numbers below 2^splits with half
    their bits set, so all combinations are one join of small tables.
    """
    rows = trials.dropna(subset=list(names))
    n = rows.count()
    splits = min(splits, n // 4) // 2 * 2
    if len(names) < 2 or splits < 4:
        return trials.sparkSession.createDataFrame([], "pbo double, combinations long, strategies int, splits int")
    size, more = divmod(n, splits)  # the first `more` blocks have one row more
    at = F.row_number().over(Window.orderBy(order)) - 1
    block = F.when(F.col("_i") < more * (size + 1), F.floor(F.col("_i") / (size + 1))).otherwise(more + F.floor((F.col("_i") - more * (size + 1)) / size))
    long = rows.withColumn("_i", at).withColumn("block", block.cast("int")).unpivot("block", list(names), "strategy", "r")
    sums = settle(long.groupBy("block", "strategy").agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.col("r")).alias("q"), F.count("*").alias("c")), "blocks")
    halves = trials.sparkSession.range(1 << splits).filter(F.bit_count("id") == splits // 2)
    inside = F.expr("(shiftright(id, block) & 1) = 1")
    joined = halves.join(F.broadcast(sums)).withColumn("_in", inside)  # blocks x strategies rows beside each half
    total = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))

    def sharpe(when):
        c, s, q = total("c", when), total("s", when), total("q", when)
        mean = F.try_divide(s, c)
        var = F.try_divide(q - c * mean * mean, c - 1)
        return F.when(var > 0, mean / F.sqrt(var))

    both = joined.groupBy("id", "strategy").agg(sharpe(F.col("_in")).alias("sin"), sharpe(~F.col("_in")).alias("sout"))
    both = both.withColumn("_no", F.array_position(F.array(*[F.lit(x) for x in names]), F.col("strategy")))
    ranked = both.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.asc_nulls_last("sout"), "_no")))
    best = ranked.groupBy("id").agg(F.min_by("place", F.when(F.col("sin").isNotNull(), F.struct((-F.col("sin")).alias("s"), "_no"))).alias("place"))
    share = F.col("place") / (len(names) + 1)
    return best.agg(F.avg((F.ln(share / (1 - share)) <= 0).cast("int")).alias("pbo"), F.count("*").alias("combinations"), F.lit(len(names)).alias("strategies"), F.lit(splits).alias("splits"))
