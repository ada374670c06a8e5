"""Ordered scans per group that do not put a whole group into one task.

``Window.partitionBy(report_id).orderBy(...)`` sorts a whole report in one task. That is the right plan while reports are
small and the wrong one as soon as a single report holds a large share of the rows. ``ordered_scan`` looks at the size
of the biggest group first (a column-pruned count, one number comes back) and then takes one of two exact ways:

* every group fits in a task: the plain window;
* otherwise: range-partition by (group, order), store the slices so that their numbers stay fixed, scan each slice on
  its own, and add what the slices before it carry over. Only one row per (group, slice) is ever gathered.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docket.session import stored

# Rows of one group a single task may sort. Tests lower it to force the sliced way.
GROUP_ROWS = 4_000_000

SLICE = "__slice"


def biggest_group(df: DataFrame, by: Sequence[str]) -> tuple[int, int]:
    """(rows of the largest group, rows in all)."""
    row = (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.max("n").alias("top"), F.sum("n").alias("total"))
        .first()
    )
    return (row["top"] or 0, row["total"] or 0)


def _size(df: DataFrame, by: Sequence[str], size: DataFrame | tuple[int, int] | None, limit: int) -> tuple[int, int]:
    """Rows of the largest group, or an upper bound that is within ``limit``. Groups by the first column alone hold the
    finer ones and are cheaper to count, so they are looked at first."""
    if isinstance(size, tuple):
        return size
    coarse = biggest_group(df if size is None else size, by[:1])
    return coarse if coarse[0] <= limit or len(by) == 1 else biggest_group(df, by)


def ordered_scan(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    position: str | None = None,
    sums: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    maxs: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    leads: Mapping[str, Column] | None = None,
    group_rows: int | None = None,
    size: DataFrame | tuple[int, int] | None = None,
) -> DataFrame:
    """Add running values over the rows of each ``by`` group in ``order`` (ascending columns, unique within a group).

    ``position`` is the 1-based row number; ``sums``, ``mins`` and ``maxs`` run up to and including the row; ``lags``
    and ``leads`` are the value of the row before and after. Nulls are passed over by sums, mins and maxs.

    ``size`` is what the choice of way goes by: a cheaper table whose groups are at least as large (an input the rows
    were filtered from), or figures from ``biggest_group`` that are already known.
    """
    sums, mins, maxs = dict(sums or {}), dict(mins or {}), dict(maxs or {})
    lags, leads = dict(lags or {}), dict(leads or {})
    if position:
        sums[position] = F.lit(1).cast("long")
    limit = group_rows or GROUP_ROWS
    top, total = _size(df, by, size, limit)

    if top <= limit:
        ordered = Window.partitionBy(*by).orderBy(*order)
        return df.withColumns(_local(ordered, sums, mins, maxs, lags, leads))

    slices = max(2, math.ceil(total / limit) * 2)
    keys = list(by)
    cut = df.repartitionByRange(slices, *keys, *order).withColumn(SLICE, F.spark_partition_id())
    cut = stored(cut)

    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)
    local = cut.withColumns(_local(inside, sums, mins, maxs, lags, leads))

    ends = [F.struct(*order)]
    carry = cut.groupBy(*keys, SLICE).agg(
        *[F.sum(c).alias(f"__{n}") for n, c in sums.items()],
        *[F.min(c).alias(f"__{n}") for n, c in mins.items()],
        *[F.max(c).alias(f"__{n}") for n, c in maxs.items()],
        *[F.max_by(F.struct(c.alias("v")), *ends).alias(f"__{n}") for n, c in lags.items()],
        *[F.min_by(F.struct(c.alias("v")), *ends).alias(f"__{n}") for n, c in leads.items()],
        F.min(ends[0]).alias("__first"),
        F.max(ends[0]).alias("__last"),
    )
    # One row per (group, slice): at most the number of slices in a group.
    across = Window.partitionBy(*keys).orderBy(SLICE)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.select(
        *keys,
        SLICE,
        *[F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums],
        *[F.min(f"__{n}").over(before).alias(f"__{n}") for n in mins],
        *[F.max(f"__{n}").over(before).alias(f"__{n}") for n in maxs],
        *[F.lag(f"__{n}").over(across).alias(f"__{n}") for n in lags],
        *[F.lead(f"__{n}").over(across).alias(f"__{n}") for n in leads],
        "__first",
        "__last",
    )
    joined = local.join(carry, [*keys, SLICE])
    at = F.struct(*order)
    out = {
        **{n: F.coalesce(F.col(n), F.lit(0)) + F.col(f"__{n}") for n in sums},
        **{n: F.least(F.col(n), F.col(f"__{n}")) for n in mins},
        **{n: F.greatest(F.col(n), F.col(f"__{n}")) for n in maxs},
        **{n: F.when(at == F.col("__first"), F.col(f"__{n}.v")).otherwise(F.col(n)) for n in lags},
        **{n: F.when(at == F.col("__last"), F.col(f"__{n}.v")).otherwise(F.col(n)) for n in leads},
    }
    return joined.withColumns(out).select(*df.columns, *out)


def _local(window, sums, mins, maxs, lags, leads) -> dict[str, Column]:
    running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return {
        **{n: F.coalesce(F.sum(c).over(running), F.lit(0)) for n, c in sums.items()},
        **{n: F.min(c).over(running) for n, c in mins.items()},
        **{n: F.max(c).over(running) for n, c in maxs.items()},
        **{n: F.lag(c).over(window) for n, c in lags.items()},
        **{n: F.lead(c).over(window) for n, c in leads.items()},
    }


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group. Spark cuts each map task's groups to ``k`` before the shuffle
    (WindowGroupLimit), so a hot group never travels whole."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def group_join(df: DataFrame, table: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows with a table of one row per group (inner, left, left_semi or left_anti). Adaptive execution splits the rows of
    a hot group (``session`` lets it do so even at the cost of an exchange) and the table's single row goes to each part."""
    return df.join(table, list(by), how)


def group_figures(df: DataFrame, by: Sequence[str], figures: Mapping[str, Column]) -> DataFrame:
    """Add aggregates of each row's group: summed partially before the shuffle, then joined back, so no group is ever gathered
    as a window would. Null keys form a group."""
    keys = list(by)
    stats = df.groupBy(*keys).agg(*[c.alias(n) for n, c in figures.items()]).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    return df.join(stats, same, "left").select(*df.columns, *figures)
