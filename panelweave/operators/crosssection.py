"""Where a stock stands among the members of its date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.frames import group_count, places, ppf_sql

INDUSTRY_NAMES = 5


def member(df: DataFrame) -> Column:
    return F.col("in_index") if "in_index" in df.columns else F.lit(True)


def investable(df: DataFrame) -> DataFrame:
    return df.filter("in_index") if "in_index" in df.columns else df


def industry_groups(df: DataFrame, least: int = INDUSTRY_NAMES) -> DataFrame:
    """The industry if it has `least` members on the date, else the sector; rows
    outside the universe always take the sector."""
    if "industry" not in df.columns:
        return df.withColumn("industry_group", F.col("sector"))
    size = F.count(F.when(member(df), F.col("ticker"))).over(Window.partitionBy("date", "industry"))
    own = F.when(member(df) & (size >= least), F.col("industry"))
    return df.withColumn("industry_group", F.coalesce(own, F.col("sector")) if "sector" in df.columns else own)


def _among(df: DataFrame, how, column: str, group: str) -> Column:
    inside = member(df) & F.col(group).isNotNull()
    return F.when(inside, how(F.when(inside, F.col(column))).over(Window.partitionBy("date", group)))


def relative_returns(df: DataFrame) -> DataFrame:
    """Returns against industry and sector medians; industry momentum."""
    if "sector" in df.columns or "industry" in df.columns:
        df = industry_groups(df)
        for c in ("return_5d", "return_20d"):
            df = df.withColumn(f"{c}_vs_industry", F.col(c) - _among(df, F.median, c, "industry_group"))
        df = df.withColumn("industry_momentum", _among(df, F.avg, "momentum_12_1", "industry_group"))
    if "sector" in df.columns:
        df = df.withColumn("return_20d_vs_sector", F.col("return_20d") - _among(df, F.median, "return_20d", "sector"))
    return df


def percentile_ranks(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("date",)) -> DataFrame:
    """`<name>_xs_rank`: average rank over the number ranked."""
    found = places(df, columns, keys, member(df) if "in_index" in df.columns else None)
    shares = {f"{c}_xs_rank": F.col(f"_place_{c}") / F.col(f"_known_{c}") for c in columns}
    return found.withColumns(shares).drop(*[f"_{p}_{c}" for c in columns for p in ("place", "known")])


def ranks_and_scores(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`percentile_ranks` and `gaussian_ranks` of the columns by date, from one pass."""
    found = places(df, columns, ["date"], member(df) if "in_index" in df.columns else None)
    shares = {f"{c}_xs_rank": F.col(f"_place_{c}") / F.col(f"_known_{c}") for c in columns}
    found = found.withColumns(shares).withColumns({f"_{c}": (F.col(f"{c}_xs_rank") * F.col(f"_known_{c}") - 0.5) / F.col(f"_known_{c}") for c in columns})
    return found.withColumns({f"{c}_z": F.expr(ppf_sql(f"`_{c}`")) for c in columns}).drop(*[f"_{p}{c}" for c in columns for p in ("", "place_", "known_")])


def gaussian_ranks(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("date",)) -> DataFrame:
    """`<name>_z`: ranks scaled to (0, 1) and mapped to a standard normal. Columns
    whose `<name>_xs_rank` is there already are not ranked again."""
    m = member(df)
    have = [c for c in columns if f"{c}_xs_rank" in df.columns]
    rest = [c for c in columns if c not in have]
    df = df.withColumns({f"_{c}": (F.col(f"{c}_xs_rank") * group_count(c, keys, m) - 0.5) / group_count(c, keys, m) for c in have})
    if rest:
        df = places(df, rest, keys, m if "in_index" in df.columns else None)
        df = df.withColumns({f"_{c}": (F.col(f"_place_{c}") - 0.5) / F.col(f"_known_{c}") for c in rest}).drop(*[f"_{p}_{c}" for c in rest for p in ("place", "known")])
    return df.withColumns({f"{c}_z": F.expr(ppf_sql(f"`_{c}`")) for c in columns}).drop(*[f"_{c}" for c in columns])


def with_values(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Those of the columns that hold a value anywhere."""
    row = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def regime_interactions(df: DataFrame) -> DataFrame:
    """Reversal and momentum times the VIX regime."""
    if "vix_regime" not in df.columns:
        return df
    reversal = next((c for c in ("return_5d_vs_industry_z", "return_5d_z") if c in df.columns), None)
    if reversal:
        df = df.withColumn("reversal_x_vix", F.col(reversal) * F.col("vix_regime"))
    if "momentum_12_1_z" in df.columns:
        df = df.withColumn("momentum_x_vix", F.col("momentum_12_1_z") * F.col("vix_regime"))
    return df
