"""Reconciliation of computed with published counters, and the audit of a join: agreement, coverage, evidence rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.operators.summaries import share
from pointweave.operators.windows import hash_sample, round_robin

#: The unresolved counters that must be 0 for a metric to be comparable, and the cells of the direction rows.
OVERVIEW = {"serve_pts": (), "aces": ("unresolved_ace",), "dfs": ("unresolved_df",), "first_in": ("unresolved_first_in",), "second_in": ("unresolved_first_in", "unresolved_second_in")}
CELLS = tuple(f"{side}_{way}" for side in ("deuce", "ad") for way in ("wide", "middle", "t"))
ROWS = {"1": (("1",), "unresolved_direction_1"), "2": (("2",), "unresolved_direction_2"), "Total": (("1", "2"), "unresolved_direction")}
DIMENSIONS = ("tour", "season", "surface", "chart_author")


def overview_rows(computed: DataFrame, published: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, dimensions, metric, raw, published, difference, marginal) of the comparable records of each metric."""
    both = computed.join(published.select(*keys, *[F.col(m).alias(f"p_{m}") for m in OVERVIEW]), list(keys))
    parts = []
    for metric, blocked in OVERVIEW.items():
        clear = F.lit(True)
        for b in blocked:
            clear = clear & (F.col(b) == 0)
        difference = F.abs(F.col(metric) - F.col(f"p_{metric}"))
        parts.append(F.struct(F.lit(metric).alias("metric"), clear.alias("clear"), F.col(metric).alias("raw"), F.col(f"p_{metric}").alias("published"), difference.alias("difference"), difference.alias("marginal")))
    return both.select(*keys, *DIMENSIONS, F.explode(F.array(*parts)).alias("x")).where("x.clear").select(*keys, *DIMENSIONS, "x.metric", "x.raw", "x.published", "x.difference", "x.marginal")


def direction_rows(computed: DataFrame, published: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same for the direction rows 1, 2 and Total: difference is summed over six cells, marginal over three ways."""
    sums = {r: {c: sum((F.col(f"direction_{n}_{c}") for n in numbers[1:]), F.col(f"direction_{numbers[0]}_{c}")) for c in CELLS} for r, (numbers, _) in ROWS.items()}
    parts = [F.struct(F.lit(r).alias("row"), (F.col(blocked) == 0).alias("clear"), *[sums[r][c].alias(c) for c in CELLS]) for r, (_, blocked) in ROWS.items()]
    long = computed.select(*keys, *DIMENSIONS, F.explode(F.array(*parts)).alias("x")).where("x.clear").select(*keys, *DIMENSIONS, "x.row", *[f"x.{c}" for c in CELLS])
    both = long.join(published.select(*keys, "row", *[F.col(c).alias(f"p_{c}") for c in CELLS]), [*keys, "row"])
    ways = [sum((F.col(c) for c in CELLS if c.endswith(w)), F.lit(0)) - sum((F.col(f"p_{c}") for c in CELLS if c.endswith(w)), F.lit(0)) for w in ("_wide", "_middle", "_t")]
    total = lambda cols: sum((F.abs(c) for c in cols[1:]), F.abs(cols[0]))
    shown = lambda p: F.concat_ws(",", *[F.col(f"{p}{c}").cast("string") for c in CELLS])
    return both.select(*keys, *DIMENSIONS, F.concat(F.lit("direction "), "row").alias("metric"), shown("").alias("raw"), shown("p_").alias("published"), total([F.col(c) - F.col(f"p_{c}") for c in CELLS]).alias("difference"), total(ways).alias("marginal"))


def summary(rows: DataFrame, cells: int = 1, ways: int = 1) -> DataFrame:
    """Per metric: comparable, exact, rates and mean absolute differences per cell."""
    n, d, m = F.count(F.lit(1)), F.col("difference"), F.col("marginal")
    r = lambda c: F.round(c, 6)
    return rows.groupBy("metric").agg(
        n.alias("comparable"), F.count_if(d == 0).alias("exact"), r(F.count_if(d == 0) / n).alias("exact_rate"), r(F.sum(d) / (n * cells)).alias("mean_difference"),
        F.count_if(m == 0).alias("marginal_exact"), r(F.count_if(m == 0) / n).alias("marginal_rate"), r(F.sum(m) / (n * ways)).alias("marginal_mean_difference"),
    )


def examples(rows: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    """The first ``k`` mismatches of each metric in the order of their keys, with their place.

    Mismatches of one metric are ranked after those beyond the first ``k`` of each key range are gone: a task keeps k.
    """
    spread = F.pmod(F.xxhash64(*keys), F.lit(64))
    part = F.row_number().over(W.partitionBy("metric", spread).orderBy(*keys))
    few = rows.where("difference <> 0").withColumn("pw_part", part).where(F.col("pw_part") <= k)
    place = F.row_number().over(W.partitionBy("metric").orderBy(*keys))
    return few.withColumn("place", place).where(F.col("place") <= k).select("metric", "place", *keys, F.col("raw").cast("string").alias("raw"), F.col("published").cast("string").alias("published"))


def mismatch_rates(rows: DataFrame) -> DataFrame:
    """Per metric and value of each dimension: comparable, mismatches (of cells and of marginals) and their rate."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS])
    long = rows.select("metric", "difference", "marginal", F.explode(pairs).alias("x"))
    n, bad = F.count(F.lit(1)), F.count_if(F.col("difference") != 0)
    return long.groupBy("metric", "x.dimension", "x.value").agg(n.alias("comparable"), bad.alias("mismatches"), F.count_if(F.col("marginal") != 0).alias("marginal_mismatches"), F.round(bad / n, 6).alias("rate"))


# The audit of a resolved join

def with_target(resolved: DataFrame, left: DataFrame, right: DataFrame, id_col: str, target: str) -> DataFrame:
    """Resolution rows with the columns of their own side, and of the context they name prefixed c_."""
    other = right.select(F.col(target).alias("target"), *[F.col(c).alias(f"c_{c}") for c in right.columns])
    return resolved.join(left, id_col).join(other, "target", "left")


def agreement(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(field, comparable, agrees, rate) over matched rows, from one pass."""
    n = F.count(F.lit(1))
    stats = [F.struct(F.lit(f).alias("field"), n.alias("comparable"), F.count_if(c).alias("agrees"), F.round(share(F.count_if(c), n), 6).alias("rate")) for f, c in fields.items()]
    return rows.agg(F.array(*stats).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def join_coverage(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """(dimension, value, matches, matched, rate) of resolution rows with a status."""
    pairs = F.array(*[F.struct(F.lit(n).alias("dimension"), c.cast("string").alias("value")) for n, c in dimensions.items()])
    n, hit = F.count(F.lit(1)), F.count_if(F.col("status") == "matched")
    return rows.select("status", F.explode(pairs).alias("x")).groupBy("x.dimension", "x.value").agg(n.alias("matches"), hit.alias("matched"), F.round(hit / n, 6).alias("rate"))


def review_queue(rows: DataFrame, id_col: str, matched: int = 25, exceptions: int = 25) -> DataFrame:
    """Rows for human eyes: the matched ones of least hash, and the others in turn by status; (id, queue)."""
    good = hash_sample(rows.where("status = 'matched'").select(id_col), id_col, matched).select(id_col, F.lit("matched").alias("queue"))
    bad = round_robin(rows.where("status <> 'matched'").select("status", id_col), "status", id_col, exceptions)
    return good.unionByName(bad.select(id_col, F.lit("exception").alias("queue")))


def evidence(rows: DataFrame, own: dict[str, Column], context: dict[str, Column], agrees: dict[str, Column]) -> DataFrame:
    """Review rows: own side, resolution, context (blank without one), agreement as true or false, two fields to fill."""
    known = F.col("target").isNotNull()
    filled = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    there = lambda c: F.when(known, filled(c)).otherwise("")
    return rows.select(
        *[filled(c).alias(n) for n, c in own.items()], filled(F.col("status")).alias("status"), filled(F.col("method")).alias("method"), filled(F.col("candidate_count")).alias("candidate_count"), filled(F.col("candidates")).alias("candidate_context_ids"),
        *[there(c).alias(n) for n, c in context.items()], *[there(F.coalesce(c, F.lit(False))).alias(n) for n, c in agrees.items()], F.lit("").alias("review_status"), F.lit("").alias("review_notes"),
    )


def enrich(records: DataFrame, links: DataFrame, tour: str = "tour", player: str = "player", opponent: str = "opponent", match: str = "match_id") -> tuple[DataFrame, DataFrame]:
    """(records with id and ranks of their context, counters of what was lost).

    ``links`` has a row per safely linked match: match, winner_name, winner_id, winner_rank, loser_name, loser_id,
    loser_rank. Both names of a record must be the link's; players of a tour whose name has several ids are left out.
    """
    rows = records.join(links.withColumn("linked", F.lit(True)), match, "left")
    own = F.when(F.col(player) == F.col("winner_name"), F.struct(F.col("winner_id").alias("id"), F.col("winner_rank").alias("rank"))).when(F.col(player) == F.col("loser_name"), F.struct(F.col("loser_id").alias("id"), F.col("loser_rank").alias("rank")))
    other = F.when(F.col(opponent) == F.col("winner_name"), F.col("winner_rank")).when(F.col(opponent) == F.col("loser_name"), F.col("loser_rank"))
    met = own.isNotNull() & F.col(opponent).isin(F.col("winner_name"), F.col("loser_name"))
    told = rows.withColumns({"pw_own": own, "opponent_rank": other, "kind": F.when(F.col("linked").isNull(), "missing").when(F.coalesce(met, F.lit(False)), "linked").otherwise("mismatch")})
    told = told.withColumns({"context_player_id": F.col("pw_own.id"), "player_rank": F.col("pw_own.rank")}).drop("pw_own", "linked", *[c for c in links.columns if c != match])
    linked = told.where("kind = 'linked'")
    several = linked.groupBy(tour, player).agg(F.min("context_player_id").alias("x"), F.max("context_player_id").alias("y")).where("x <> y").select(tour, player)
    good = linked.join(several, [tour, player], "left_anti").drop("kind")
    before = told.agg(F.count(F.lit(1)).alias("records"), F.count_if(F.col("kind") == "missing").alias("missing_link"), F.count_if(F.col("kind") == "mismatch").alias("identity_mismatch"), F.count_if(F.col("kind") == "linked").alias("linked"))
    after = good.agg(F.count(F.lit(1)).alias("eligible"), F.count_distinct(match).alias("eligible_matches"), F.count_distinct(tour, player).alias("eligible_players"), F.count("player_rank").alias("player_rank_known"), F.count("opponent_rank").alias("opponent_rank_known"))
    hit = several.agg(F.count(F.lit(1)).alias("id_collisions"))
    counts = before.crossJoin(F.broadcast(after)).crossJoin(F.broadcast(hit)).withColumn("collision_records", F.col("linked") - F.col("eligible"))  # one row each
    return good, counts


def windows_matched(left: DataFrame, right: DataFrame, keys: Sequence[str], id_col: str, target: str, date: str, target_date: str, supports: Column, exact: Column, windows: Sequence[tuple[int, int]]) -> DataFrame:
    """(days_before, days_after, matched) of every window from one join: candidates are counted per window."""
    renamed = right.select(*keys, *[F.col(c).alias(f"c_{c}") for c in right.columns if c not in keys])
    days = F.datediff(F.col(date), F.col(f"c_{target_date}"))
    joined = left.join(renamed, list(keys)).where(days.between(-max(b for b, _ in windows), max(a for _, a in windows))).withColumns({"days": days, "ok": supports, "same": exact})
    counts = []
    for k, (before, after) in enumerate(windows):
        inside = F.col("days").between(-before, after)
        counts += [F.count_if(inside).alias(f"n_{k}"), F.count_if(inside & F.col("ok")).alias(f"ok_{k}"), F.count_if(inside & F.col("same")).alias(f"same_{k}")]
    per = joined.groupBy(id_col).agg(*counts)
    hits = [F.count_if(((F.col(f"n_{k}") == 1) & (F.col(f"ok_{k}") == 1)) | ((F.col(f"n_{k}") > 1) & (F.col(f"same_{k}") == 1))) for k in range(len(windows))]
    told = per.agg(F.array(*[F.struct(F.lit(b).alias("days_before"), F.lit(a).alias("days_after"), h.alias("matched")) for (b, a), h in zip(windows, hits, strict=True)]).alias("x"))
    return told.select(F.explode("x").alias("x")).select("x.*")
