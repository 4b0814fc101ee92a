"""What the future held: forward and tradable returns, and targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.frames import avg_rank, by_ticker, ratio

HORIZONS = (5, 21)
LAG = 1
ENDED_DAYS = 10
PEERS = 4
VOL_FLOOR = 0.05


def forward_returns(prices: DataFrame, delistings: DataFrame | None = None, horizons=HORIZONS) -> DataFrame:
    """`future_return_`, `tradable_return_` and `target_up_` for each horizon.

    A ticker whose last row is over ten days before the data's end has stopped:
    a horizon past its end earns the last close compounded with its delisting
    return (0 unless `delistings` (ticker, delisting_return) says so). The
    data's last date is one aggregated row, joined to all.
    """
    end = prices.agg(F.max("date").alias("_end"))
    df = prices.crossJoin(F.broadcast(end))
    if delistings is not None:
        df = df.join(delistings.select("ticker", "delisting_return"), "ticker", "left")
    else:
        df = df.withColumn("delisting_return", F.lit(0.0))
    by, whole = by_ticker(), Window.partitionBy("ticker")
    last = F.last("close", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    df = df.withColumns(
        {
            "_left": F.count("*").over(whole) - F.row_number().over(by),
            "_ended": F.max("date").over(whole) < F.date_sub("_end", ENDED_DAYS),
            "_exit": last * (1 + F.coalesce("delisting_return", F.lit(0.0))),
        }
    )

    def ahead(n: int) -> Column:
        return F.when(F.col("_ended") & (F.col("_left") < n), F.col("_exit")).otherwise(F.lead("close", n).over(by))

    for h in horizons:
        df = df.withColumns({f"future_return_{h}d": ratio(ahead(h), "close") - 1, f"tradable_return_{h}d": ratio(ahead(h + LAG), F.lead("close", LAG).over(by)) - 1})
        known = F.col(f"future_return_{h}d")
        df = df.withColumn(f"target_up_{h}d", F.when(known.isNotNull(), (known > 0).cast("double")))
    return df.drop("_end", "_left", "_ended", "_exit", "delisting_return")


def relative_targets(df: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Beat-the-median and rank targets, in the market and in the sector."""
    member = F.col("in_index") if "in_index" in df.columns else F.lit(True)
    vol = F.greatest(F.col("volatility_20d"), F.lit(VOL_FLOOR))
    vol = F.when(F.col("volatility_20d").isNotNull(), vol)
    groups = {"market": ["date"]} | ({"sector": ["date", "sector"]} if "sector" in df.columns else {})
    for h in horizons:
        future = f"future_return_{h}d"
        df = df.withColumns({"_f": F.when(member, F.col(future)), "_s": F.when(member, F.col(future) / vol)})
        for name, keys in groups.items():
            peers = Window.partitionBy(*keys)
            enough = F.count("_f").over(peers) >= PEERS
            real = F.lit(True) if name == "market" else F.col("sector").isNotNull()
            beat = F.when(F.col("_f").isNotNull() & enough & real, (F.col(future) > F.median("_f").over(peers)).cast("double"))
            rank = F.when(F.col("_f").isNotNull() & enough & real, (avg_rank("_s", keys) - 0.5) / F.count("_s").over(peers))
            df = df.withColumns({f"target_beat_{'median' if name == 'market' else 'sector'}_{h}d": beat, f"target_rank_{name}_{h}d": rank})
    return df.drop("_f", "_s")


@dataclass(frozen=True)
class Target:
    """A choice of horizon, peers and kind, and the columns it stands for."""

    horizon: int = 5
    relative_to: str = "market"
    kind: str = "rank"

    def __post_init__(self):
        if self.horizon not in HORIZONS or self.relative_to not in ("market", "sector", "absolute") or self.kind not in ("binary", "rank"):
            raise ValueError(f"no such target: {self}")
        if self.relative_to == "absolute" and self.kind == "rank":
            raise ValueError("an absolute target is binary")

    @property
    def binary(self) -> str:
        name = {"market": "beat_median", "sector": "beat_sector", "absolute": "up"}[self.relative_to]
        return f"target_{name}_{self.horizon}d"

    @property
    def column(self) -> str:
        return self.binary if self.kind == "binary" else f"target_rank_{self.relative_to}_{self.horizon}d"

    @property
    def future(self) -> str:
        return f"future_return_{self.horizon}d"

    @property
    def tradable(self) -> str:
        return f"tradable_return_{self.horizon}d"


def labelled(df: DataFrame, target: Target) -> DataFrame:
    """Member rows with the target known, under general names."""
    rows = df.filter("in_index") if "in_index" in df.columns else df
    names = {"target": target.column, "label": target.binary, "future_return": target.future, "tradable_return": target.tradable}
    return rows.withColumns({k: F.col(v) for k, v in names.items()}).filter("target IS NOT NULL")


def research_window(df: DataFrame, holdout: str | None, horizons=HORIZONS) -> DataFrame:
    """Rows before the holdout, labels blanked whose exit reaches into it."""
    if holdout is None:
        return df
    cut = F.to_date(F.lit(holdout))
    days = df.select("date").distinct().withColumn("_no", F.row_number().over(Window.orderBy("date")) - 1)
    first = days.filter(F.col("date") >= cut).agg(F.min("_no").alias("_first"))
    rows = df.filter(F.col("date") < cut).join(F.broadcast(days), "date").crossJoin(F.broadcast(first))
    for h in horizons:
        reaches = F.col("_no") + h + LAG >= F.col("_first")
        for c in [c for c in df.columns if c.endswith(f"_{h}d") and c.startswith(("future_return", "tradable_return", "target_"))]:
            rows = rows.withColumn(c, F.when(F.coalesce(~reaches, F.lit(True)), F.col(c)))
    return rows.drop("_no", "_first")
