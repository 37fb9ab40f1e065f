"""Order-dependent columns in two levels: within a day of a key by a window, and from day to day by a
small table of a row for each key and day. So a key's rows never meet in one task, however many.

`time` is a column of milliseconds by which rows are in order; `order` must begin with it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def _day(time: str) -> Column:
    return F.floor(F.col(time) / DAY_MS)


def _joined(rows: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the columns of edges that begin with "_e", of the same keys and day."""
    edges = edges.select(*[F.col(k).alias(f"_j_{k}") for k in (*keys, "_day")], *[c for c in edges.columns if c.startswith("_e")])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in (*keys, "_day")])
    return rows.join(edges, same, "left").drop(*[f"_j_{k}" for k in (*keys, "_day")])


def with_previous(rows: DataFrame, keys: list[str], order: list[str], values: list[str], out: str = "before") -> DataFrame:
    """`out`: a struct of the `values` of the row before this one of the same keys, or null."""
    return _neighbour(rows, keys, order, values, out, True)


def with_next(rows: DataFrame, keys: list[str], order: list[str], values: list[str], out: str = "after") -> DataFrame:
    """`out`: a struct of the `values` of the row after this one of the same keys, or null."""
    return _neighbour(rows, keys, order, values, out, False)


def _neighbour(rows: DataFrame, keys: list[str], order: list[str], values: list[str], out: str, back: bool) -> DataFrame:
    rows = rows.withColumn("_day", _day(order[0]))
    value, at = F.struct(*values), F.struct(*order)
    within = Window.partitionBy(*keys, "_day").orderBy(*order)
    days = Window.partitionBy(*keys).orderBy("_day")
    edges = rows.groupBy(*keys, "_day").agg((F.max_by(value, at) if back else F.min_by(value, at)).alias("_v"))
    edges = edges.withColumn("_edge", (F.lag("_v") if back else F.lead("_v")).over(days))
    near = (F.lag(value) if back else F.lead(value)).over(within)
    return _joined(rows.withColumn(out, near), edges, keys).withColumn(out, F.coalesce(out, "_edge")).drop("_edge", "_day")


def with_running(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, str] | None = None, maxima: dict[str, str] | None = None, before: bool = False) -> DataFrame:
    """Running sums and maxima (new column: column) up to this row by `order`, or up to the one before it."""
    sums, maxima = sums or {}, maxima or {}
    rows = rows.withColumn("_day", _day(order[0]))
    within = Window.partitionBy(*keys, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_day").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()], *[F.max(c).alias(f"_t_{n}") for n, c in maxima.items()])
    edges = totals.withColumns({f"_e_{n}": F.sum(f"_t_{n}").over(earlier) for n in sums} | {f"_e_{n}": F.max(f"_t_{n}").over(earlier) for n in maxima})
    found = {n: F.sum(c).over(within) for n, c in sums.items()} | {n: F.max(c).over(within) for n, c in maxima.items()}
    out = _joined(rows.withColumns(found), edges, keys)
    merged = {n: F.coalesce(n, F.lit(0)) + F.coalesce(f"_e_{n}", F.lit(0)) for n in sums} | {n: F.greatest(n, f"_e_{n}") for n in maxima}
    return out.withColumns(merged).drop("_day", *[f"_e_{n}" for n in (*sums, *maxima)])


def with_last(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, str], before: bool = False) -> DataFrame:
    """The last value that isn't null (new column: column) up to this row by `order`, or up to the one before it."""
    rows = rows.withColumn("_day", _day(order[0]))
    within = Window.partitionBy(*keys, "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    earlier = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    at = F.struct(*order)
    lasts = rows.groupBy(*keys, "_day").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(f"_t_{n}") for n, c in values.items()])
    edges = lasts.withColumns({f"_e_{n}": F.last(f"_t_{n}", True).over(earlier) for n in values})
    out = _joined(rows.withColumns({n: F.last(c, True).over(within) for n, c in values.items()}), edges, keys)
    return out.withColumns({n: F.coalesce(n, f"_e_{n}") for n in values}).drop("_day", *[f"_e_{n}" for n in values])
