"""Ordered operators: halves, transitions, rolling folds, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split_halves(df: DataFrame, group: list[str], order: list[str], alternating: bool = False) -> DataFrame:
    """Add half: left for the first n // 2 rows, or for every other row."""
    rn, n = F.row_number().over(W.partitionBy(*group).orderBy(*order)), F.count(F.lit(1)).over(W.partitionBy(*group))
    left = (rn - 1) % 2 == 0 if alternating else rn <= F.floor(n / 2)
    return df.withColumn("half", F.when(left, "left").otherwise("right"))


def fold_rows(df: DataFrame, year: str, first: int, last: int, window: int) -> DataFrame:
    """Add as_of: each row in every fold whose history [as_of - window, as_of) holds its year; meant for sums by year, whose
    number does not grow with the rows behind them."""
    low, high = F.greatest(F.col(year) + 1, F.lit(first)), F.least(F.col(year) + window, F.lit(last))
    return df.withColumn("as_of", F.explode(F.when(low <= high, F.sequence(low, high))))


def rolling_distinct(df: DataFrame, group: list[str], year: str, value: str, first: int, last: int, window: int) -> DataFrame:
    """(group, as_of, n): distinct values in each history [as_of - window, as_of) from ``first`` to ``last`` that has any.

    Distinct counts do not add up over years, but spans do: a value seen in a year is in the histories of the ``window``
    years after it, up to the year in which it is seen again, whose own span goes on from there. The spans of a value do
    not overlap, so a history's count is the number of spans that hold its year: sums of +1 and -1 at their ends. No row
    is repeated per history. Nulls do not count.
    """
    seen = df.where(F.col(value).isNotNull()).select(*group, F.col(year).alias("y"), F.col(value).alias("v")).distinct()
    again = F.lead("y").over(W.partitionBy(*group, "v").orderBy("y"))
    spans = seen.select(*group, F.greatest(F.col("y") + 1, F.lit(first)).alias("begin"), F.least(F.col("y") + window, F.lit(last), again).alias("end")).where("begin <= end")
    ends = F.explode(F.array(F.struct(F.col("begin").alias("at"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("at"), F.lit(-1).alias("d"))))
    steps = spans.select(*group, ends.alias("x")).groupBy(*group, "x.at").agg(F.sum("x.d").alias("d"))
    w = W.partitionBy(*group).orderBy("at")  # a row per year at most
    held = steps.select(*group, "at", F.sum("d").over(w).alias("n"), F.lead("at").over(w).alias("upto")).where("n > 0")
    return held.select(*group, F.explode(F.sequence("at", F.col("upto") - 1)).alias("as_of"), "n")


def top_k(df: DataFrame, count: str, name: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(count), name).limit(k)


def hash_sample(df: DataFrame, key: str, k: int) -> DataFrame:
    return df.orderBy(F.sha2(F.col(key).cast("string"), 256), key).limit(k)


def round_robin(df: DataFrame, status: str, key: str, k: int) -> DataFrame:
    """One row of each status in turn until there are ``k``, least keys first. No task ranks a whole status: each of 64
    parts of it keeps its first ``k``."""
    part = F.row_number().over(W.partitionBy(status, F.pmod(F.xxhash64(key), F.lit(64))).orderBy(key))
    few = df.withColumn("pw_part", part).where(F.col("pw_part") <= k).drop("pw_part")
    turn = F.row_number().over(W.partitionBy(status).orderBy(key))
    return few.withColumn("turn", turn).orderBy("turn", status).limit(k)


def argmin(df: DataFrame, group: list[str], score: str, strength: str) -> DataFrame:
    """The strength of least score, the smaller one of equals."""
    return df.groupBy(*group).agg(F.min(F.struct(score, strength)).alias("best")).select(*group, f"best.{score}", f"best.{strength}")


def first_failures(states: DataFrame, group: str, ordinal: str, expected: dict[str, Column], start: dict[str, Column]) -> DataFrame:
    """Lag validation: by induction a group is sound when its first row is the start and each row follows from the last.

    ``expected`` maps a code to whether a row disagrees with its predecessor (prev_ columns), in order of precedence.
    """
    w = W.partitionBy(group).orderBy(ordinal)
    names = [c for c in states.columns if c != group]
    seen = states.withColumns({f"prev_{c}": F.lag(c).over(w) for c in names} | {"rn": F.row_number().over(w)})
    code = F.lit(None).cast("string")
    for name, bad in reversed(list(expected.items())):
        code = F.when((F.col("rn") > 1) & bad, name).otherwise(code)
    for name, bad in reversed(list(start.items())):
        code = F.when((F.col("rn") == 1) & bad, name).otherwise(code)
    judged = seen.withColumn("code", code)
    return judged.groupBy(group).agg(F.count(F.lit(1)).alias("points"), F.min(F.when(F.col("code").isNotNull(), F.struct(ordinal, "code"))).alias("bad")).select(group, "points", F.coalesce("bad.code", F.lit("ok")).alias("verdict"), F.col(f"bad.{ordinal}").alias("failed_at"))
