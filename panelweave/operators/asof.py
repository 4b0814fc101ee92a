"""As-of joins by one union and one sorted window: n log n, one shuffle. Without a
key, or where a key may hold a large part of the rows, rows are sorted by ranges of
(key, time) and the last match of each range is carried into the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.shared import settle


def asof(
    left: DataFrame,
    right: DataFrame,
    on: str,
    right_on: str,
    columns: Sequence[str],
    by: Sequence[str] = (),
    direction: str = "backward",
    strict: bool = False,
    order: Sequence[str] = (),
    spread: bool | None = None,
) -> DataFrame:
    """`left` with `columns` of the right row nearest before (or after) its `on`.

    `strict` excludes equal times. Of right rows at one time, the last in `order`
    is taken backward and the first forward. Left rows without a match get nulls;
    null times match nothing. A key's rows meet in one task unless `spread`, the
    default without `by`, deals them to ranges of time.
    """
    back = direction == "backward"
    names = list(dict.fromkeys([right_on, *columns]))
    first = lambda side: F.lit((1 if side == "left" else 0) if not strict else (0 if side == "left" else 1))
    tie = F.struct(*[F.col(c) for c in order]) if order else F.lit(0)
    keys = [F.col(c) for c in by]
    here = left.select(*keys, F.col(on).alias("_t"), first("left").alias("_side"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(tie.alias("o")).schema["o"].dataType).alias("_o"))
    there = right.filter(F.col(right_on).isNotNull()).select(*keys, F.col(right_on).alias("_t"), first("right").alias("_side"), tie.alias("_o"), F.struct(*names).alias("_r"))
    both = here.unionByName(there, allowMissingColumns=True)
    sort = ["_t", "_side", "_o"] if back else [F.desc("_t"), "_side", F.desc("_o")]
    if spread or spread is None and not by:
        both = _carried(both, list(by), sort, back)
    else:
        both = both.withColumn("_m", F.last("_r", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0)))
    matched = both.withColumn("_m", F.when(F.col("_t").isNotNull(), F.col("_m"))).filter("_l IS NOT NULL")
    kept = [c for c in left.columns if c not in names]
    return matched.select(*[F.col("_l")[c].alias(c) for c in kept], *[F.col("_m")[c].alias(c) for c in names])


def _carried(both: DataFrame, by: list[str], sort: list, back: bool) -> DataFrame:
    """`both` with `_m`, the last `_r` up to each row in the order of (by, sort).

    Rows lie in ranges of that order, so at most one key goes on from one range
    into the next: what such keys had last in the ranges before is a table of a row a
    range at most, and goes to all tasks.
    """
    ranged = settle(both.repartitionByRange(*by, *sort).withColumn("_range", F.spark_partition_id()), "as-of")
    within = F.last("_r", ignorenulls=True).over(Window.partitionBy("_range", *by).orderBy(*sort).rowsBetween(Window.unboundedPreceding, 0))
    key = F.struct(*[F.col(c) for c in by]) if by else F.lit(0)
    ends = ranged.groupBy("_range").agg(F.min(key).alias("_low"), F.max(key).alias("_high"))  # a row a range
    ends = ends.withColumn("_goes_on", F.lead("_low").over(Window.orderBy("_range")).eqNullSafe(F.col("_high")))
    place = F.when(F.col("_r").isNotNull(), F.struct("_t", "_o"))
    at_end = ranged.join(F.broadcast(ends.select("_range", "_high")), "_range").filter(key.eqNullSafe(F.col("_high")))
    last = at_end.groupBy("_range").agg((F.max_by if back else F.min_by)("_r", place).alias("_last"))
    # a key that fills whole ranges without a match keeps the match from before them
    chain = ends.join(last, "_range", "left").withColumn("_run", F.sum(F.when(F.coalesce(F.lag("_goes_on").over(Window.orderBy("_range")), F.lit(False)) & F.col("_low").eqNullSafe(F.col("_high")), 0).otherwise(1)).over(Window.orderBy("_range")))
    so_far = F.last("_last", ignorenulls=True).over(Window.partitionBy("_run").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    carry = chain.withColumn("_so_far", so_far).withColumns({"_carry": F.lag("_so_far").over(Window.orderBy("_range")), "_on": F.lag("_goes_on").over(Window.orderBy("_range"))})
    carry = carry.filter(F.col("_on")).select("_range", F.col("_low").alias("_first_key"), "_carry")
    joined = ranged.withColumn("_m", within).join(F.broadcast(carry), "_range", "left")
    return joined.withColumn("_m", F.coalesce("_m", F.when(key.eqNullSafe(F.col("_first_key")), F.col("_carry")))).drop("_range", "_first_key", "_carry")


def asof_nearest(left: DataFrame, right: DataFrame, on: str, right_on: str, columns: Sequence[str], by: Sequence[str], tolerance: int) -> DataFrame:
    """The right row nearest in days, at most `tolerance` away; ties go back."""
    names = list(dict.fromkeys([right_on, *columns]))
    rows = asof(left, right, on, right_on, columns, by)
    rows = rows.withColumn("_back", F.struct(*names)).drop(*names)
    rows = asof(rows, right, on, right_on, columns, by, direction="forward")
    rows = rows.withColumn("_next", F.struct(*names)).drop(*names)
    gap: dict[str, Column] = {s: F.abs(F.datediff(on, F.col(s)[right_on])) for s in ("_back", "_next")}
    near = {s: F.when(gap[s] <= tolerance, gap[s]) for s in gap}
    use = F.when(near["_back"].isNotNull() & (near["_next"].isNull() | (near["_back"] <= near["_next"])), F.col("_back")).when(near["_next"].isNotNull(), F.col("_next"))
    return rows.withColumn("_use", use).select(*[c for c in rows.columns if not c.startswith("_")], *[F.col("_use")[c].alias(c) for c in names])


def to_next_session(events: DataFrame, sessions: DataFrame, on: str = "date") -> DataFrame:
    """Events with `session`, their ticker's first session on or after; later ones go."""
    known = sessions.select("ticker", F.col("date").alias("session")).distinct()
    return asof(events, known, on, "session", [], ["ticker"], "forward").filter("session IS NOT NULL")
