"""Finite machines over rows in order of time, without a key's rows ever meeting in one task.

What a run of rows does to a machine is a function from state to state, an array with an entry a state. Runs of
PIECE rows become such functions, a day's pieces compose to the day's, and days, a small table of a row for each
key and day, compose to the state in which each day begins. From there states go back down: to the day's
pieces, then to the rows of a piece. Nothing but arrays of PIECE rows and of a day's pieces is held.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import DAY_MS

#: Rows of the smallest run.
PIECE = 64


@dataclass(frozen=True)
class Machine:
    """moves[state][symbol] is the next state; it begins in state `start`."""

    moves: tuple[tuple[int, ...], ...]
    start: int = 0

    def step(self, state: Column, symbol: Column) -> Column:
        flat = F.array(*[F.lit(x) for row in self.moves for x in row])
        return F.element_at(flat, state * len(self.moves[0]) + symbol + 1)

    @property
    def identity(self) -> Column:
        return F.array(*[F.lit(i) for i in range(len(self.moves))])


def composed(functions: Column, field: str, machine: Machine) -> Column:
    """The function of several in a row: first the first, then the next."""
    return F.aggregate(functions, machine.identity, lambda f, g: F.transform(f, lambda s: F.element_at(g[field], s + 1)))


def entries(functions: Column, field: str, start: Column) -> Column:
    """The states in which each of several functions in a row is entered, and that after the last."""
    return F.aggregate(functions, F.array(start), lambda a, g: F.concat(a, F.array(F.element_at(g[field], F.element_at(a, -1) + 1))))


def same(keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def renamed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: f"{prefix}{k}" for k in keys})


def states(rows: DataFrame, keys: list[str], order: list[str], symbol: Column, machine: Machine, before: str = "state_before", after: str = "state") -> DataFrame:
    """rows with the machine's state before and after each of them, a machine for each value of the keys (null
    is one). order begins with milliseconds and has no ties; symbol is an int."""
    day = [*keys, "_day"]
    numbered = rows.select(F.struct(*rows.columns).alias("_row"), *[F.col(k).alias(k) for k in keys], *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], symbol.cast("int").alias("_x")).withColumn("_day", F.floor(F.col("_o0") / DAY_MS))
    numbered = numbered.withColumn("_n", F.row_number().over(Window.partitionBy(*day).orderBy(*[f"_o{i}" for i in range(len(order))])) - 1)
    pieces = numbered.groupBy(*day, F.floor(F.col("_n") / PIECE).alias("_piece")).agg(F.array_sort(F.collect_list(F.struct("_n", "_x", "_row"))).alias("_rows"))
    does = F.aggregate("_rows", machine.identity, lambda f, r: F.transform(f, lambda s: machine.step(s, r["_x"])))
    days = pieces.select(*day, "_piece", does.alias("_f")).groupBy(*day).agg(F.array_sort(F.collect_list(F.struct("_piece", "_f"))).alias("_pieces"))
    per = days.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_day", composed(F.col("_pieces"), "_f", machine).alias("_f")))).alias("_days"))
    begun = per.withColumn("_in", entries(F.col("_days"), "_f", F.lit(machine.start))).select(*keys, F.posexplode("_days").alias("_i", "_d"), "_in").select(*keys, F.col("_d._day").alias("_day"), F.get("_in", F.col("_i")).alias("_in"))
    days = days.join(renamed(begun, day, "_e"), same(day, "_e"))
    inside = days.withColumn("_at", entries(F.col("_pieces"), "_f", F.col("_in"))).select(*day, F.posexplode("_pieces").alias("_i", "_p"), "_at").select(*day, F.col("_p._piece").alias("_piece"), F.get("_at", F.col("_i")).alias("_in"))
    found = pieces.join(renamed(inside, [*day, "_piece"], "_e"), same([*day, "_piece"], "_e"))
    along = F.aggregate("_rows", F.array("_in"), lambda a, r: F.concat(a, F.array(machine.step(F.element_at(a, -1), r["_x"]))))
    out = found.select("_rows", along.alias("_along")).select(F.posexplode("_rows").alias("_i", "_r"), "_along")
    return out.select("_r._row.*", F.get("_along", F.col("_i")).alias(before), F.get("_along", F.col("_i") + 1).alias(after))
