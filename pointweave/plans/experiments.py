"""Further registered queries: paired bootstrap, upper median, several ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.operators import resampling, selection
from pointweave.plans.registry import r6, read, registered

@registered(f"""WITH m AS (SELECT o_orderpriority AS grp, strftime(o_orderdate, '%Y%m') AS match_id, avg((o_totalprice > 150000)::INT) AS rate FROM orders GROUP BY 1, 2),
v AS MATERIALIZED (SELECT grp, match_id, (rate - 0.45) * (rate - 0.45) - (rate - 0.5) * (rate - 0.5) AS v FROM m), {resampling.bootstrap_sql()}
SELECT grp, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN high < 0 THEN 'favors left' WHEN low > 0 THEN 'favors right' ELSE 'inconclusive' END AS verdict FROM i""")
def M21_paired_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Two predictions' squared errors per month, paired by month."""
    hit = (F.col("o_totalprice") > 150000).cast("int")
    m = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("grp"), F.date_format("o_orderdate", "yyyyMM").alias("match_id")).agg(F.avg(hit).alias("rate"))
    m = m.withColumn("v", F.expr("(rate - 0.45D) * (rate - 0.45D) - (rate - 0.5D) * (rate - 0.5D)"))
    i = resampling.paired_bootstrap(m, "grp", "match_id", "v")
    return i.select("grp", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), resampling.comparison(F.col("low"), F.col("high")).alias("verdict"))


@registered("SELECT c_nationkey, list_sort(list(c_acctbal))[(count(*) // 2)::INT + 1] AS upper_median FROM customer GROUP BY 1")
def G9_upper_median(spark: SparkSession, d: str) -> DataFrame:
    """sorted[n // 2]."""
    return selection.order_statistics(read(spark, d, "customer"), ["c_nationkey"], "c_acctbal", {"upper_median": selection.upper_middle}).drop("n")


@registered("SELECT o_custkey, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1")
def G15_multi_id(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderpriority").alias("priorities")).where("priorities > 1")
