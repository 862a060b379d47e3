"""Summaries: coverage, reconciliation, exposure, diversity, calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.functions.stats import bucket_of_ten
from pointweave.operators import selection


def share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def five_number(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Least, quartiles by nearest rank and most of each group's values."""
    places = {"least": selection.FIVE["least"], "p25": selection.nearest(0.25), "p50": selection.nearest(0.5), "p75": selection.nearest(0.75), "most": selection.FIVE["most"]}
    return selection.order_statistics(df, group, value, places).drop("n")


def coverage(df: DataFrame, dimensions: list[str], eligible: Column, known: Column) -> DataFrame:
    """Eligible and known rows overall and per value of each dimension, from one expansion."""
    pairs = F.array(F.struct(F.lit("all").alias("dimension"), F.lit("").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    rows = df.select(eligible.alias("e"), (eligible & known).alias("k"), F.explode(pairs).alias("p"))
    g = rows.groupBy("p.dimension", "p.value").agg(F.count_if("e").alias("eligible"), F.count_if("k").alias("known"))
    return g.withColumn("share", F.round(share(F.col("known"), F.col("eligible")), 6))


def reconcile(computed: DataFrame, published: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(metric, comparable, exact, rate, mae) of equally named columns."""
    both = computed.join(published.select(*keys, *[F.col(m).alias(f"p_{m}") for m in metrics]), keys)
    rows = both.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("a"), F.col(f"p_{m}").cast("double").alias("b")) for m in metrics])).alias("r")).where("r.a is not null and r.b is not null")
    d = F.abs(F.col("r.a") - F.col("r.b"))
    return rows.groupBy("r.metric").agg(F.count(F.lit(1)).alias("comparable"), F.count_if(d == 0).alias("exact"), F.round(F.avg((d == 0).cast("double")), 6).alias("rate"), F.round(F.avg(d), 6).alias("mae"))


def diversity(df: DataFrame, group: list[str], cluster: str, trials: str, distinct: list[str]) -> DataFrame:
    """Clusters, distinct values (blanks not counted), largest share and Kish's effective clusters."""
    n = F.col("n")
    per = df.groupBy(*group, cluster).agg(F.sum(trials).alias("n"))
    sizes = per.groupBy(*group).agg(F.count(F.lit(1)).alias("clusters"), F.max(n).alias("m"), F.sum(n).alias("s"), F.sum(n * n).alias("q"))
    g = sizes.join(df.groupBy(*group).agg(*[F.count_distinct(F.nullif(F.col(c).cast("string"), F.lit(""))).alias(f"n_{c}") for c in distinct]), group)
    return g.select(*group, "clusters", *[f"n_{c}" for c in distinct], F.round(share(F.col("m"), F.col("s")), 6).alias("largest_share"), F.round(share(F.col("s") * F.col("s"), F.col("q")), 6).alias("effective"))


def calibration_error(df: DataFrame, p: str, y: str) -> DataFrame:
    bins = df.groupBy(bucket_of_ten(F.col(p)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my"))
    return bins.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n"), 6).alias("error"))


def leave_one_out(df: DataFrame, level: list[str], own: str, successes: str, trials: str) -> DataFrame:
    """Totals of a level without the own contribution."""
    mine = df.groupBy(*level, own).agg(F.sum(successes).alias("s"), F.sum(trials).alias("t"))
    every = df.groupBy(*level).agg(F.sum(successes).alias("all_s"), F.sum(trials).alias("all_t"))
    return mine.join(every, level).select(*level, own, (F.col("all_s") - F.col("s")).alias("other_s"), (F.col("all_t") - F.col("t")).alias("other_t"))
