"""Conservative entity resolution: an equi key plus a date band, statuses instead of guesses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Days before and after that a target may lie.
BEFORE, AFTER = 7, 20


def resolve(left: DataFrame, right: DataFrame, keys: list[str], id_col: str, target: str, date: str, target_date: str, supports: Column, exact: Column, before: int = BEFORE, after: int = AFTER) -> DataFrame:
    """One row per left id: status, method, candidate_count and sorted candidates.

    ``supports`` and ``exact`` compare a left row with a candidate's columns (prefixed c_). The equi key keeps it a hash
    join with the band as a residual; only counters and the ids of one left row's candidates are gathered.
    """
    renamed = right.select(*keys, *[F.col(c).alias(f"c_{c}") for c in right.columns if c not in keys])
    days = F.datediff(F.col(date), F.col(f"c_{target_date}"))
    inside = F.col(f"c_{target}").isNotNull() & days.between(-before, after)
    joined = left.join(renamed, keys, "left").withColumns({"inside": inside, "ok": inside & supports, "same": inside & exact})
    ids = F.col(f"c_{target}")
    g = joined.groupBy(id_col).agg(F.count(ids).alias("pairs"), F.count_if("inside").alias("n"), F.count_if("ok").alias("n_ok"), F.count_if("same").alias("n_same"), F.sort_array(F.collect_list(ids)).alias("every"), F.sort_array(F.collect_list(F.when(F.col("inside"), ids))).alias("near"), F.max(F.when(F.col("same"), ids)).alias("same_id"))
    n = F.col("n")
    status = F.when(F.col("pairs") == 0, "unresolved_pair").when(n == 0, "unresolved_date_window").when((n == 1) & (F.col("n_ok") == 0), "conflicting_context").when(n == 1, "matched").when(F.col("n_same") == 1, "matched").otherwise("ambiguous")
    method = F.when(n == 1, "exact_pair_date_unique").when((n > 1) & (F.col("n_same") == 1), "exact_pair_date_tournament_round_unique")
    chosen = F.when((n == 1) & (F.col("n_ok") == 1), F.get("near", F.lit(0))).when((n > 1) & (F.col("n_same") == 1), F.col("same_id"))
    return g.select(id_col, status.alias("status"), method.alias("method"), n.alias("candidate_count"), F.array_join(F.when(n == 0, F.col("every")).otherwise(F.col("near")).cast("array<string>"), ",").alias("candidates"), chosen.alias("target"))


def collision_free(resolved: DataFrame, id_col: str) -> DataFrame:
    """Matched rows whose target no other matched row has."""
    count = F.count(F.lit(1)).over(W.partitionBy("target"))
    return resolved.where("status = 'matched'").withColumn("times", count).where("times = 1").select(id_col, "target")


def with_collisions(resolved: DataFrame) -> DataFrame:
    count = F.count_if(F.col("status") == "matched").over(W.partitionBy("target"))
    hit = (F.col("status") == "matched") & (count > 1)
    return resolved.withColumn("status", F.when(hit, "canonical_collision").otherwise(F.col("status")))
