"""Exact order statistics of groups of any size by counting: no group is sorted in one task or gathered into one value.

A wanted place lies in a range of its group's values, at first from the least to the most. A pass counts the range's
values in BINS equal parts, each with its own least and most, and keeps the part that holds the place; once a range has
LAST_ROWS values or fewer, or equal ones only, they are ranked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.operators.store import fitting, written

#: Parts that a pass counts a range in, and values that one task ranks at most.
BINS, LAST_ROWS = 1024, 100_000

Place = Callable[[Column], Column]
RANGE = ["pw_key", "lo", "hi"]


def nearest(p: float) -> Place:
    """The place of round-half-even(p * (n - 1))."""
    return lambda n: F.bround(F.lit(p) * (n - 1)) + 1


def finite(p: float) -> Place:
    """The place min(n, ceil(p (n + 1)))."""
    if not 0 < p < 1:
        raise ValueError(f"a probability lies between 0 and 1: {p}")
    return lambda n: F.least(n, F.ceil(F.lit(p) * (n + 1)))


def upper_middle(n: Column) -> Column:
    return F.floor(n / 2) + 1


def lower_middle(n: Column) -> Column:
    return F.floor((n + 1) / 2)


FIVE: dict[str, Place] = {"least": lambda n: F.lit(1), "p25": nearest(0.25), "low": lower_middle, "high": upper_middle, "p75": nearest(0.75), "most": lambda n: n}
MIDDLE: dict[str, Place] = {"low": lower_middle, "high": upper_middle}


def bin_of(value: Column) -> Column:
    return F.least(F.lit(BINS - 1), F.floor((value - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS)).cast("long")


def held(counts: DataFrame, wanted: DataFrame, order: str) -> DataFrame:
    """``wanted`` places with the row of ``counts`` (RANGE, ``order``, c, bin_lo, bin_hi) that holds each: that is their range.

    The window over a range has a row per part or value of it, not per row of the group.
    """
    before = F.sum("c").over(W.partitionBy(*RANGE).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("c")
    told = counts.withColumn("before", before)
    inner = F.col("place") - F.col("base")
    met = wanted.join(told, RANGE).where((F.col("before") < inner) & (inner <= F.col("before") + F.col("c")))
    return met.select("pw_key", "name", "place", F.col("bin_lo").alias("lo"), F.col("bin_hi").alias("hi"), F.col("c").alias("size"), (F.col("base") + F.col("before")).alias("base"))


def order_statistics(values: DataFrame, group: Sequence[str], value: str, places: dict[str, Place]) -> DataFrame:
    """(``group``, n, a column per name of ``places``): the value at each place of each group, n its values.

    Null and NaN values do not count; a group without values has no row; groups of null are groups. Values are written
    once; each pass reads them and shuffles counts only.
    """
    rows = written(values.select(F.struct(*group).alias("pw_key"), F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)"))
    stats = written(rows.groupBy("pw_key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    named = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), f(F.col("n")).cast("long").alias("place")) for k, f in places.items()]))
    wanted = stats.select("pw_key", "lo", "hi", F.col("n").alias("size"), named.alias("x")).select("pw_key", "x.name", "x.place", "lo", "hi", "size", F.lit(0).cast("long").alias("base"))
    wide = F.col("size") > LAST_ROWS
    while (largest := wanted.where("lo < hi").agg(F.max("size")).first()[0]) and largest > LAST_ROWS:
        ranges = wanted.where(wide & (F.col("lo") < F.col("hi")))
        counts = inside(rows, ranges).groupBy(*RANGE, bin_of(F.col("v")).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("bin_lo"), F.max("v").alias("bin_hi"))
        wanted = written(held(counts, ranges, "bin").unionByName(wanted.where(~wide | (F.col("lo") == F.col("hi"))).select("pw_key", "name", "place", "lo", "hi", "size", "base")))
    open_ = wanted.where("lo < hi")
    turn = F.row_number().over(W.partitionBy(*RANGE).orderBy("v")).alias("rn")
    ranked = inside(rows, open_).select(*RANGE, "v", turn)
    found = open_.join(ranked, RANGE).where("rn = place - base").select("pw_key", "name", "v")
    found = found.unionByName(wanted.where("lo = hi").select("pw_key", "name", F.col("lo").alias("v")))
    wide_ = found.groupBy("pw_key").agg(*[F.max(F.when(F.col("name") == k, F.col("v"))).alias(f"pw_{k}") for k in places])
    return stats.select("pw_key", "n").join(wide_, "pw_key").select(*[F.col(f"pw_key.{g}").alias(g) for g in group], "n", *[F.col(f"pw_{k}").alias(k) for k in places])


def weighted_places(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(pw_key, name, v): of ``rows`` (pw_key, v, c), each v counted c times or, below 0, taken off, the value at each place of
    ``wanted`` (pw_key, name, place), counted from 1."""
    rows = written(rows)
    stats = rows.groupBy("pw_key").agg(F.count(F.lit(1)).alias("size"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    upto = lambda order: F.sum("c").over(W.partitionBy(*RANGE).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow))
    inner = F.col("place") - F.col("base")
    here = (F.col("upto") - F.col("c") < inner) & (inner <= F.col("upto"))
    wanted = written(wanted.join(stats, "pw_key").withColumn("base", F.lit(0.0)))
    wide = (F.col("size") > LAST_ROWS) & (F.col("lo") < F.col("hi"))
    while not (ranges := wanted.where(wide)).isEmpty():
        counts = inside(rows, ranges).groupBy(*RANGE, bin_of(F.col("v")).alias("bin")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("rows"), F.min("v").alias("bin_lo"), F.max("v").alias("bin_hi"))
        met = ranges.join(counts.withColumn("upto", upto("bin")), RANGE).where(here)
        met = met.select("pw_key", "name", "place", F.col("rows").alias("size"), F.col("bin_lo").alias("lo"), F.col("bin_hi").alias("hi"), (F.col("base") + F.col("upto") - F.col("c")).alias("base"))
        wanted = written(met.unionByName(wanted.where(~wide)))
    open_ = wanted.where("lo < hi")
    ranked = inside(rows, open_).groupBy(*RANGE, "v").agg(F.sum("c").alias("c")).withColumn("upto", upto("v"))
    found = open_.join(ranked, RANGE).where(here).select("pw_key", "name", "v")
    return found.unionByName(wanted.where("lo = hi").select("pw_key", "name", F.col("lo").alias("v")))


def inside(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """The rows in each of the ranges; these are few and broadcast while they are."""
    return rows.join(fitting(ranges.select(*RANGE).distinct()), "pw_key").where("v BETWEEN lo AND hi")


def middle(low: str = "low", high: str = "high") -> Column:
    """The true median from its two places."""
    return (F.col(low) + F.col(high)) / 2


def medians(values: DataFrame, group: Sequence[str], value: str, name: str) -> DataFrame:
    """(``group``, n, ``name``): the true median of each group."""
    return order_statistics(values, group, value, MIDDLE).select(*group, "n", middle().alias(name))


def five_numbers(rows: DataFrame, group: Sequence[str], values: dict[str, str]) -> DataFrame:
    """(``group``, prefix_least, prefix_p25, prefix_median, prefix_p75, prefix_most) of several columns, {prefix: column},
    from one selection: quartiles by nearest rank, true medians, rounded."""
    long = F.explode(F.array(*[F.struct(F.lit(p).alias("pw_measure"), F.col(c).cast("double").alias("pw_value")) for p, c in values.items()]))
    told = order_statistics(rows.select(*group, long.alias("x")).select(*group, "x.*"), [*group, "pw_measure"], "pw_value", FIVE)
    of = {"least": F.col("least"), "p25": F.col("p25"), "median": middle(), "p75": F.col("p75"), "most": F.col("most")}
    return told.groupBy(*group).agg(*[F.max(F.when(F.col("pw_measure") == p, F.round(c, 6))).alias(f"{p}_{n}") for p in values for n, c in of.items()])


def beside(left: DataFrame, right: DataFrame, group: Sequence[str]) -> DataFrame:
    """Left join of two summaries of the same groups, null groups too; the group's columns once."""
    other = right.withColumnsRenamed({g: f"pw_{g}" for g in group})
    on = [left[g].eqNullSafe(other[f"pw_{g}"]) for g in group]
    return left.join(other, on, "left").drop(*[f"pw_{g}" for g in group])
