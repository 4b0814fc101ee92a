"""Column builders that the operators share: rolling statistics, ranks, normals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows up to which a sliding frame is read anew for each row.
SLIDING = 21
STATS = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "max": F.max, "min": F.min}


def ratio(top: Column | str, under: Column | str) -> Column:
    """`top` over `under`, null where that is 0: a price or a sum of 0 stops no query."""
    return F.try_divide(top, under)


def rounded(value: Column | str, places: int) -> Column:
    """`value` to so many places; what rounds to 0 keeps its sign (-0.0), as in SQL
    engines that round doubles, where Spark's decimals have no sign of 0."""
    value = F.col(value) if isinstance(value, str) else value
    found = F.round(value, places)
    return F.when(found == 0, value * 0.0).otherwise(found)


def by_ticker() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def roll(how: str, value: Column | str, rows: int, least: int, by: WindowSpec | None = None) -> Column:
    """Statistic of the last `rows` rows, null with under `least` values among them."""
    frame = (by or by_ticker()).rowsBetween(1 - rows, 0)
    return F.when(F.count(value).over(frame) >= least, STATS[how](value).over(frame))


def rolling(df: DataFrame, wanted: Mapping[str, tuple[str, str, int, int]], keys: Sequence[str] = ("ticker",), order: Sequence[str] = ("date",)) -> DataFrame:
    """Add columns {to: (how, value, rows, least)}: statistics of the last `rows` rows.

    A frame that slides is read anew for each row, so only windows of up to
    `SLIDING` rows use one. Beyond that a sum is the difference of two running
    sums, and a maximum the largest of a few maxima of `SLIDING` rows that cover the
    window, so the work for a row does not grow with the window; all of it follows
    one sort by (keys, order). Deviations come from running sums of squares around
    the group's mean; what lies within rounding of those counts as 0. Values that
    are not finite count as missing in long windows, as they would stay in a
    running sum for good.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    short = {to: roll(*w, by) for to, w in wanted.items() if w[2] <= SLIDING}
    long = {to: w for to, w in wanted.items() if w[2] > SLIDING}
    if not long:
        return df.withColumns(short)
    values = list(dict.fromkeys(w[1] for w in long.values()))
    centred = {w[1] for w in long.values() if w[0] == "std"}
    whole = {f.name for f in df.schema if f.name in values and f.name not in centred and f.dataType.typeName() in ("byte", "short", "integer", "long")}
    known = {v: F.col(v) if v in whole else F.when(F.abs(F.col(v)) < float("inf"), F.col(v)) for v in values}
    df = df.withColumns({f"_c_{v}": F.avg(known[v]).over(Window.partitionBy(*keys)) for v in values if v in centred})
    so_far, ends = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(1 - SLIDING, 0)
    running = {}
    for v in values:
        off = known[v] - F.col(f"_c_{v}") if v in centred else known[v]
        running |= {f"_n_{v}": F.count(known[v]).over(so_far), f"_s_{v}": F.coalesce(F.sum(off).over(so_far), F.lit(0))}
        if v in centred:
            running[f"_q_{v}"] = F.coalesce(F.sum(off * off).over(so_far), F.lit(0))
    running |= {f"_{how}_{v}": STATS[how](known[v]).over(ends) for how, v, _, _ in long.values() if how in ("max", "min")}
    df = df.withColumns(running)
    found = {}
    for to, (how, v, rows, least) in long.items():
        last = lambda c: F.col(f"_{c}_{v}") - F.coalesce(F.lag(f"_{c}_{v}", rows).over(by), F.lit(0))  # noqa: B023, E731
        n, centre = last("n"), F.col(f"_c_{v}") if v in centred else F.lit(0)
        if how == "sum":
            value = last("s") + n * centre
        elif how == "mean":
            value = last("s") / n + centre
        elif how == "std":
            spread = last("q") - last("s") * last("s") / n
            value = F.when(n > 1, F.sqrt(F.when(spread > 1e-14 * F.col(f"_q_{v}"), spread).otherwise(0.0) / (n - 1)))
        else:
            parts = [*range(0, rows - SLIDING, SLIDING), rows - SLIDING]
            value = (F.greatest if how == "max" else F.least)(*[F.lag(f"_{how}_{v}", k).over(by) for k in parts]) if len(parts) > 1 else F.col(f"_{how}_{v}")
        found[to] = F.when((n >= least) & (n > 0), value)
    return df.withColumns(short | found).drop(*running, *[f"_c_{v}" for v in centred])


def grouped_rolling(df: DataFrame, columns: Sequence[str], rows: int, least: int, how: str) -> DataFrame:
    """Each column replaced by its rolling statistic within the ticker."""
    found = rolling(df, {f"_roll_{c}": (how, c, rows, least) for c in columns})
    return found.drop(*columns).withColumnsRenamed({f"_roll_{c}": c for c in columns}).select(*df.columns)


def avg_rank(value: str, keys: Sequence[str], members: Column | None = None) -> Column:
    """Average rank within the group, ties sharing the mean of their places; place
    and number of peers come from one sort."""
    shown = F.col(value) if members is None else F.when(members, F.col(value))
    by = Window.partitionBy(*keys).orderBy(shown.asc_nulls_last())
    tied = F.count(shown).over(by.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(shown.isNotNull(), F.rank().over(by) + (tied - 1) / 2)


def group_count(value: str, keys: Sequence[str], members: Column | None = None) -> Column:
    shown = F.col(value) if members is None else F.when(members, F.col(value))
    return F.count(shown).over(Window.partitionBy(*keys))


def _places(columns: Sequence[str]):
    """`_place_<c>` and `_known_<c>` of a group's rows: average rank, nulls without
    one, NaN last and all tied; and how many have one."""

    def run(group: pa.Table) -> pa.Table:
        for c in columns:
            shown = group.column(f"_shown_{c}").combine_chunks()
            known = np.flatnonzero(shown.is_valid().to_numpy(zero_copy_only=False))
            x = shown.to_numpy(zero_copy_only=False)[known]
            order = np.argsort(x)
            x = x[order]
            new = np.append(True, (x[1:] != x[:-1]) & ~(np.isnan(x[1:]) & np.isnan(x[:-1])))[: len(x)]
            first = np.flatnonzero(new)
            tied = np.diff(np.append(first, len(x)))
            place = np.full(len(shown), np.nan)
            place[known[order]] = np.repeat(first + 1 + (tied - 1) / 2, tied)
            without = np.ones(len(shown), bool)
            without[known] = False
            group = group.append_column(f"_place_{c}", pa.array(place, mask=without)).append_column(f"_known_{c}", pa.array(np.full(len(shown), len(known))))
        return group.drop_columns([f"_shown_{c}" for c in columns])

    return run


def places(df: DataFrame, columns: Sequence[str], keys: Sequence[str], members: Column | None = None) -> DataFrame:
    """`df` with `_place_<c>`, the average rank within the group, and `_known_<c>`, how
    many are ranked, for every column: as `avg_rank` and `group_count`, but one exchange
    and one sort by the keys serve all columns, where windows sort and hold the group
    anew for each. `df` should hold no more columns than are needed."""
    shown = {f"_shown_{c}": (F.col(c) if members is None else F.when(members, F.col(c))).cast("double") for c in columns}
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`_place_{c}` double, `_known_{c}` long" for c in columns]
    return df.withColumns(shown).groupBy(*keys).applyInArrow(_places(list(columns)), ", ".join(fields))


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinities of all floating columns become null."""
    floats = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({c: F.when(F.abs(F.col(c)) < float("inf"), F.col(c)) for c in floats})


# Coefficients of P. Acklam's inverse normal approximation.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
# Coefficients of G. West's cumulative normal (after J. Hart).
_N = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
_M = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(coefficients: Sequence[float], x: str) -> str:
    """Polynomial as nested SQL; exponents make every constant a double in both engines."""
    out = f"{coefficients[0]:.16e}"
    for c in coefficients[1:]:
        out = f"({out}*{x}+({c:.16e}))"
    return out


def ppf_sql(p: str) -> str:
    """Inverse normal of an SQL expression, in words that Spark and DuckDB share."""
    q, r = f"({p}-0.5)", f"(({p}-0.5)*({p}-0.5))"
    low, high = f"sqrt(-2*ln({p}))", f"sqrt(-2*ln(1-({p})))"
    return (
        f"CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL "
        f"WHEN {p} < 0.02425 THEN {_horner(_C, low)}/{_horner(_D, low)} "
        f"WHEN {p} <= 0.97575 THEN {_horner(_A, r)}*{q}/{_horner(_B, r)} "
        f"ELSE -{_horner(_C, high)}/{_horner(_D, high)} END"
    )


def cdf_sql(x: str) -> str:
    """Cumulative normal of an SQL expression."""
    z = f"abs({x})"
    tail = f"(exp(-{z}*{z}/2)*{_horner(_N, z)}/{_horner(_M, z)})"
    return f"CASE WHEN {z} > 7 THEN CASE WHEN {x} > 0 THEN 1.0 ELSE 0.0 END WHEN {x} > 0 THEN 1-{tail} ELSE {tail} END"


def ppf(df: DataFrame, column: str, to: str) -> DataFrame:
    return df.withColumn(to, F.expr(ppf_sql(f"`{column}`")))


def cdf(df: DataFrame, column: str, to: str) -> DataFrame:
    return df.withColumn(to, F.expr(cdf_sql(f"`{column}`")))
