"""Setups side by side: portfolio constructions, targets, a holdout, robustness."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.shared import settle
from panelweave.operators import backtest as bt
from panelweave.operators import inference, models
from panelweave.operators.labels import Target
from panelweave.operators.stats import information_coefficients
from panelweave.operators.validation import ic_summary
from panelweave.sources.store import append_log, read

#: Names and changes to a configuration of the constructions that are compared.
CONSTRUCTIONS = {
    "no buffer": {"exit_quantile": None, "smooth_days": 1},
    "buffer": {"exit_quantile": 0.4, "smooth_days": 1},
    "buffer, 3-day scores": {"exit_quantile": 0.4, "smooth_days": 3},
}


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def constructions(predictions: DataFrame, config: bt.Config, variants: Mapping[str, Mapping] = CONSTRUCTIONS) -> DataFrame:
    """Period returns of every variant with the column `construction`."""
    return union([bt.backtest(predictions, replace(config, **changes)).withColumn("construction", F.lit(name)) for name, changes in variants.items()])


def construction_table(predictions: DataFrame, config: bt.Config, variants: Mapping[str, Mapping] = CONSTRUCTIONS) -> DataFrame:
    """A row for each construction: both books' growth, Sharpe, turnover and costs;
    `production` marks the variant that equals `config`."""
    rows = constructions(predictions, config, variants)
    wide = []
    for name, changes in variants.items():
        own = bt.summary(rows.filter(F.col("construction") == name).drop("construction"), config)
        wide.append(own.withColumns({"construction": F.lit(name), "production": F.lit(replace(config, **changes) == config)}))
    pick = lambda strategy, column: F.max(F.when(F.col("strategy") == strategy, F.col(column)))
    figures = {f"{s}_{name}": pick(s, c) for s in ("long_only", "long_short") for name, c in (("cagr", "cagr"), ("sharpe", "sharpe"), ("turnover", "avg_turnover"), ("cost_drag", "cost_drag"))}
    figures |= {"excess_vs_equal_weight": pick("long_only", "excess_cagr"), "information_ratio": pick("long_only", "information_ratio")}
    return union(wide).groupBy("construction", "production").agg(*[c.alias(name) for name, c in figures.items()])


def sharpe_per_period(value: str) -> Column:
    """Mean over deviation of a period; null for two periods or fewer, or no spread."""
    return F.when((F.count(value) > 2) & (F.stddev_samp(value) > 0), F.try_divide(F.avg(value), F.stddev_samp(value)))


def robustness(returns: DataFrame, trials: DataFrame, configurations: int = 0, splits: int = 16) -> DataFrame:
    """(series, figure, value): deflated Sharpe ratios of the long-short book and of
    long-only over the benchmark, and the probability of backtest overfitting.

    `returns` (date, long_only, long_short, benchmark); `trials` (trial, date, r),
    every backtest that was tried. Trials share the horizon if over half of their
    dates are those of `returns`; all trials, or `configurations` if more, count.
    """
    trials = settle(trials.select("trial", "date", "r"), "trials")
    marked = trials.join(returns.select("date", F.lit(1).alias("_in")).distinct(), "date", "left")
    judged = settle(marked.groupBy("trial").agg(F.avg(F.coalesce("_in", F.lit(0))).alias("share"), sharpe_per_period("r").alias("sharpe")), "judged")  # a row a trial
    same = judged.filter("share > 0.5")
    counts = judged.agg(F.greatest(F.count("*"), F.lit(configurations)).cast("double").alias("counted"), F.count_if(F.col("share") > 0.5).cast("double").alias("same_horizon"))
    active = returns.select("date", F.col("long_short"), (F.col("long_only") - F.col("benchmark")).alias("long_only_vs_equal_weight"))
    series = active.unpivot("date", ["long_short", "long_only_vs_equal_weight"], "series", "r")
    luck = inference.best_by_luck(same, int(counts.first().counted))
    tests = inference.sharpe_tests(series, luck)
    long = lambda df, name: df.select(F.lit(name).alias("series") if isinstance(name, str) else name, F.explode(F.create_map(*[x for c in df.columns if c != "series" for x in (F.lit(c), F.col(c).cast("double"))])).alias("figure", "value"))
    out = long(counts, "trials").unionByName(long(tests, F.col("series")))
    names = [r.trial for r in same.select("trial").orderBy("trial").collect()]  # columns of a wide table
    if len(names) < 2:
        return out
    wide = trials.groupBy("date").pivot("trial", names).agg(F.first("r")).toDF("date", *[f"t{i}" for i in range(len(names))])
    return out.unionByName(long(inference.overfitting_probability(wide, [f"t{i}" for i in range(len(names))], splits), "pbo"))


def experiments(features: DataFrame, candidates: Sequence[str], targets: Sequence[Target], base: bt.Config = bt.Config(), production: Target = Target(), panel_of: Callable[[DataFrame], DataFrame] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """A row for each target with the same kind of linear model, walked forward and
    backtested; and (trial, date, r), the long-short returns of each.

    A target with too few dates or names gets a row with a note. The loop is over
    targets, a handful; everything inside it is Spark work.
    """
    rows, trials = [], []
    for target in targets:
        name = models.linear_model_for(target)
        label = f"{target.horizon}d {target.relative_to} {target.kind}"
        head = {"setup": label, "horizon": target.horizon, "relative_to": target.relative_to, "target": target.kind, "model": name, "production": target == production}
        try:
            found = models.walk_forward(features, name, candidates, target, **options)
        except models.TooFewDates as e:
            rows.append(features.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in head.items()], F.lit(str(e)).alias("note")))
            continue
        config = replace(bt.Config.for_target(target), score="probability", cost_bps=base.cost_bps, borrow_bps=base.borrow_bps, quantile=base.quantile, min_names=base.min_names)
        returns = bt.backtest(found.predictions, config)
        stats = bt.summary(returns, config)
        pick = lambda strategy, column: F.max(F.when(F.col("strategy") == strategy, F.col(column)))  # noqa: E731, B023
        books = stats.agg(
            *[pick(s, c).alias(f"{s}_{c}") for s in ("long_only", "long_short", "benchmark") for c in ("cagr", "sharpe")], pick("long_only", "avg_turnover").alias("turnover"), pick("long_only", "periods").alias("rebalances")
        )
        quality = models.summarise(name, found, target).select("auc_mean", "ic_mean", "ic_tstat")
        one = quality.crossJoin(books)  # a row each
        rows.append(one.select(*[F.lit(v).alias(k) for k, v in head.items()], *one.columns, F.lit(None).cast("string").alias("note")))
        trials.append(returns.filter("strategy = 'long_short'").select(F.lit(f"{name} / {label}").alias("trial"), "date", F.col("net").alias("r")))
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    none = features.sparkSession.createDataFrame([], "trial string, date date, r double")
    return table, union(trials) if trials else none


def evaluate_holdout(features: DataFrame, name: str, candidates: Sequence[str], holdout: str, log: str | None = None, target: Target = Target(), params: dict | None = None, base: bt.Config = bt.Config(), revision: str | None = None, **options) -> DataFrame:
    """One row: a frozen model walked through the dates from `holdout` on, nothing
    chosen anew, its IC and its books. The row is added to the log, and
    `previous_evaluations` says how many it held before."""
    spark = features.sparkSession
    found = models.walk_forward(features, name, candidates, target, params=params or {}, test_start=holdout, **options)
    config = replace(bt.Config.for_target(target), cost_bps=base.cost_bps, borrow_bps=base.borrow_bps, quantile=base.quantile, min_names=base.min_names, exit_quantile=base.exit_quantile, smooth_days=base.smooth_days)
    stats = bt.summary(bt.backtest(found.predictions, config), config)
    ic = ic_summary(information_coefficients(found.predictions, "probability", "future_return"), target.horizon)
    pick = lambda strategy, column: F.max(F.when(F.col("strategy") == strategy, F.col(column)))
    books = stats.agg(pick("long_only", "cagr").alias("long_only_cagr"), pick("benchmark", "cagr").alias("equal_weight_cagr"), pick("long_short", "cagr").alias("long_short_cagr"), pick("long_short", "sharpe").alias("long_short_sharpe"), pick("long_only", "periods").alias("rebalances"))
    end = found.predictions.agg(F.max("date").alias("holdout_end"))
    before = 0
    if log is not None and read(spark, log, "json") is not None:
        before = read(spark, log, "json").count()
    head = {"evaluated_at": F.current_timestamp(), "revision": F.lit(revision), "holdout_start": F.lit(holdout).cast("date"), "model": F.lit(name), "target": F.lit(target.column), "portfolio": F.lit(str(config)), "previous_evaluations": F.lit(before)}
    row = settle(end.crossJoin(ic).crossJoin(books).withColumns(head), "holdout")  # a row each
    if log is not None:
        append_log(row, log)
    return row


def shrinkage(returns: DataFrame, last: int = 126, value: str = "return_1d") -> DataFrame:
    """One row (dates, tickers, mean_variance, shrinkage): the Ledoit-Wolf intensity
    of the covariance of tickers' returns over the last dates, missing ones as 0.

    Sums over pairs of tickers equal sums over pairs of dates (the trace of a
    product does not hang on its order), and there are `last` dates, so the join
    is of dates within a ticker and gives `last` squared rows at most.
    """
    days = returns.filter(F.col(value).isNotNull()).select("date").distinct().orderBy(F.desc("date")).limit(last)
    n = days.count()
    rows = returns.join(F.broadcast(days), "date").filter(F.col(value).isNotNull()).select("ticker", "date", F.col(value).alias("x"))  # `last` rows
    mean = rows.groupBy("ticker").agg((F.sum("x") / n).alias("m"))
    known = rows.join(mean, "ticker")
    moved = known.groupBy("date").agg(F.sum(F.col("x") * F.col("m")).alias("mx"))
    whole = mean.agg(F.count("*").alias("tickers"), F.sum(F.col("m") * F.col("m")).alias("mm"))
    other = rows.select("ticker", F.col("date").alias("other"), F.col("x").alias("y"))
    pairs = rows.join(other, "ticker").groupBy("date", "other").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    every = days.crossJoin(F.broadcast(days.withColumnRenamed("date", "other")))  # `last` x `last`
    gram = every.join(pairs, ["date", "other"], "left").join(moved, "date").join(moved.select(F.col("date").alias("other"), F.col("mx").alias("my")), "other").crossJoin(F.broadcast(whole))
    gram = gram.withColumn("g", F.coalesce("xy", F.lit(0.0)) - F.col("mx") - F.col("my") + F.col("mm"))
    own = F.col("date") == F.col("other")
    sums = gram.groupBy("tickers").agg(F.sum(F.when(own, F.col("g"))).alias("trace"), F.sum(F.when(own, F.col("g") * F.col("g"))).alias("fourth"), F.sum(F.col("g") * F.col("g")).alias("square"))
    p, mu = F.col("tickers"), F.col("trace") / n / F.col("tickers")
    noise = (F.col("fourth") / n - F.col("square") / (n * n)) / (p * n)
    spread = F.col("square") / (n * n) / p - mu * mu
    share = F.when(F.least(noise, spread) <= 0, 0.0).otherwise(F.try_divide(F.least(noise, spread), spread))
    return sums.select(F.lit(n).alias("dates"), F.col("tickers"), mu.alias("mean_variance"), share.alias("shrinkage"))
