"""Registered queries that hold computed counters against published ones, and the join with its evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions import text
from pointweave.operators import audit, charting, resolve
from pointweave.operators.store import written
from pointweave.plans.charting import METRICS, charted
from pointweave.plans.registry import RESOLVED, _resolved, r6, read, registered
from pointweave.sources import readers

WINDOWS = ((1, 14), (7, 20), (14, 28))
#: Orders as matches: two players, and what the breakdowns need.
MATCH = {
    "match_id": "o_orderkey", "player_1": "concat('p', o_custkey % 60)", "player_2": "concat('q', o_custkey % 45)", "raw_id": "concat('2000-', CASE WHEN o_custkey % 2 = 0 THEN 'M' ELSE 'W' END, '-x')", "raw_date": "CASE WHEN o_orderkey % 19 = 0 THEN 'n/a' ELSE concat(1990 + o_custkey % 7, '0101') END",
    "raw_surface": "CASE o_custkey % 4 WHEN 0 THEN ' Hard' WHEN 1 THEN 'CLAY ' WHEN 2 THEN '' ELSE 'Grass' END", "raw_author": "CASE WHEN o_custkey % 5 = 0 THEN ' ' ELSE concat('A', o_custkey % 5) END",
}
SERVER = "cast(l_linenumber % 4 as int)"


def _computed(spark: SparkSession, d: str) -> DataFrame:
    """Counters of (match, player) with the names that metadata gives the server's number, and four dimensions."""
    points = charted(spark, d).withColumn("server", F.expr(SERVER))
    metrics = charting.server_metrics(points, ["l_orderkey", "server"], F.col("a"), F.col("b"), F.col("label")).withColumnRenamed("l_orderkey", "match_id")
    matches = read(spark, d, "orders").where("o_orderstatus <> 'P'").select(*[F.expr(v).alias(n) for n, v in MATCH.items()])
    rows = charting.named_records(metrics, matches, "match_id", "server")
    return rows.withColumns(text.context_values(F.col("raw_id"), F.col("raw_date"), F.col("raw_surface"), F.col("raw_author"))).drop("raw_id", "raw_date", "raw_surface", "raw_author")


COMPUTED = (
    METRICS.format(keys=f"l_orderkey AS match_id, {SERVER} AS server", group="1, 2")
    + ", matches AS (SELECT " + ", ".join(f"{v} AS {n}" for n, v in MATCH.items()) + " FROM orders WHERE o_orderstatus <> 'P'), computed AS (SELECT m.* EXCLUDE (server), CASE server WHEN 1 THEN player_1 ELSE player_2 END AS player, CASE server WHEN 1 THEN player_2 ELSE player_1 END AS opponent, "
    + "CASE WHEN contains(raw_id, '-M-') THEN 'ATP' ELSE 'WTA' END AS tour, CASE WHEN regexp_matches(raw_date[1:4], '^[0-9]{4}$') THEN raw_date[1:4] ELSE 'invalid-date' END AS season, CASE WHEN trim(raw_surface) = '' THEN '(blank)' ELSE lower(trim(raw_surface)) END AS surface, CASE WHEN trim(raw_author) = '' THEN '(blank)' ELSE trim(raw_author) END AS chart_author "
    + "FROM metrics m JOIN matches USING (match_id) WHERE server IN (1, 2))"
)
NOISE = {"serve_pts": "CASE WHEN match_id % 13 = 0 THEN 1 ELSE 0 END", "aces": "CASE WHEN match_id % 17 = 0 THEN 2 ELSE 0 END", "dfs": "CASE WHEN match_id % 29 = 0 THEN 1 ELSE 0 END", "first_in": "0", "second_in": "CASE WHEN match_id % 7 = 0 THEN 1 ELSE 0 END"}
PUBLISHED_IF = "match_id % 11 <> 0"
ROW_IF = {"1": "match_id % 5 <> 0", "2": "true", "Total": "match_id % 3 <> 0"}


def _cell_value(row: str, c: str, a: str = "") -> str:
    total = " + ".join(f"{a}direction_{n}_{c}" for n in audit.ROWS[row][0])
    moved = {"deuce_wide": f"CASE WHEN {a}match_id % 6 = 0 THEN 1 ELSE 0 END", "ad_wide": f"CASE WHEN {a}match_id % 6 = 0 THEN -1 ELSE 0 END", "deuce_t": f"CASE WHEN {a}match_id % 10 = 0 THEN 1 ELSE 0 END"}.get(c, "0")
    return f"{total} + {moved}"


def _overview(spark: SparkSession, d: str) -> DataFrame:
    c = written(_computed(spark, d))  # both sides are read from it
    published = c.where(PUBLISHED_IF).select("match_id", "player", *[(F.col(m) + F.expr(v)).alias(m) for m, v in NOISE.items()])
    return audit.overview_rows(c, published, ["match_id", "player"])


def _directions(spark: SparkSession, d: str) -> DataFrame:
    c = written(_computed(spark, d))  # both sides are read from it
    rows = F.array(*[F.struct(F.lit(r).alias("row"), F.expr(ROW_IF[r]).alias("there"), *[F.expr(_cell_value(r, x)).cast("long").alias(x) for x in audit.CELLS]) for r in audit.ROWS])
    published = c.select("match_id", "player", F.explode(rows).alias("x")).where("x.there").select("match_id", "player", "x.*").drop("there")
    return audit.direction_rows(c, published, ["match_id", "player"])


DIMS = ", ".join(audit.DIMENSIONS)
OVERVIEW = COMPUTED + ", rows AS (" + " UNION ALL ".join(
    f"SELECT match_id, player, {DIMS}, '{m}' AS metric, {m}::VARCHAR AS raw, ({m} + {NOISE[m]})::VARCHAR AS published, abs({NOISE[m]}) AS difference, abs({NOISE[m]}) AS marginal FROM computed WHERE {PUBLISHED_IF}" + "".join(f" AND {b} = 0" for b in blocked)
    for m, blocked in audit.OVERVIEW.items()) + ")"
DIRECTIONS = COMPUTED + ", dr AS (" + " UNION ALL ".join(
    f"SELECT match_id, player, {DIMS}, 'direction {r}' AS metric, " + ", ".join(f"{' + '.join(f'direction_{n}_{c}' for n in numbers)} AS {c}, {_cell_value(r, c)} AS p_{c}" for c in audit.CELLS) + f" FROM computed WHERE {ROW_IF[r]} AND {blocked} = 0"
    for r, (numbers, blocked) in audit.ROWS.items()) + "), rows AS (SELECT *, concat_ws(',', " + ", ".join(audit.CELLS) + ") AS raw, concat_ws(',', " + ", ".join(f"p_{c}" for c in audit.CELLS) + ") AS published, " + " + ".join(f"abs({c} - p_{c})" for c in audit.CELLS) + " AS difference, " + " + ".join(f"abs(deuce_{w} + ad_{w} - p_deuce_{w} - p_ad_{w})" for w in ("wide", "middle", "t")) + " AS marginal FROM dr)"


def _summary_sql(cells: int, ways: int) -> str:
    return f" SELECT metric, count(*) AS comparable, count(*) FILTER (difference = 0) AS exact, round(count(*) FILTER (difference = 0) / count(*)::DOUBLE, 6) AS exact_rate, round(sum(difference) / (count(*) * {cells})::DOUBLE, 6) AS mean_difference, count(*) FILTER (marginal = 0) AS marginal_exact, round(count(*) FILTER (marginal = 0) / count(*)::DOUBLE, 6) AS marginal_rate, round(sum(marginal) / (count(*) * {ways})::DOUBLE, 6) AS marginal_mean_difference FROM rows GROUP BY 1"


@registered(COMPUTED + " SELECT match_id, player, opponent, tour, season, surface, chart_author, serve_pts, first_in FROM computed")
def J2_named_records(spark: SparkSession, d: str) -> DataFrame:
    return _computed(spark, d).select("match_id", "player", "opponent", *audit.DIMENSIONS, "serve_pts", "first_in")


@registered(OVERVIEW + _summary_sql(1, 1))
def G10_reconcile_overview(spark: SparkSession, d: str) -> DataFrame:
    """Five published totals; records with an unresolved counter of a metric are not compared in it."""
    return audit.summary(_overview(spark, d))


@registered(DIRECTIONS + _summary_sql(6, 3))
def G11_reconcile_directions(spark: SparkSession, d: str) -> DataFrame:
    return audit.summary(_directions(spark, d), 6, 3)


@registered(OVERVIEW + ", x AS (" + " UNION ALL ".join(f"SELECT metric, '{k}' AS dimension, {k} AS value, difference, marginal FROM rows" for k in audit.DIMENSIONS) + ") SELECT metric, dimension, value, count(*) AS comparable, count(*) FILTER (difference <> 0) AS mismatches, count(*) FILTER (marginal <> 0) AS marginal_mismatches, round(count(*) FILTER (difference <> 0) / count(*)::DOUBLE, 6) AS rate FROM x GROUP BY ALL")
def G12_mismatch_rates(spark: SparkSession, d: str) -> DataFrame:
    return audit.mismatch_rates(_overview(spark, d))


@registered(DIRECTIONS + " SELECT metric, place, match_id, player, raw, published FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY match_id, player)::INT AS place FROM rows WHERE difference <> 0) WHERE place <= 10")
def O4_examples(spark: SparkSession, d: str) -> DataFrame:
    return audit.examples(_directions(spark, d), ["match_id", "player"])


# The join of orders with orders

SIDE = {"tour": "CASE WHEN o_custkey % 2 = 0 THEN 'ATP' ELSE 'WTA' END", "surface": "CASE WHEN o_totalprice < 100000 THEN 'Hard' ELSE 'Clay' END", "best_of": "CASE WHEN o_totalprice < 300000 THEN '3' ELSE '5' END", "rank": "CASE WHEN o_orderkey % 9 < 2 THEN '' ELSE cast(o_orderkey % 200 as varchar(9)) END"}


def _audited(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("*", *[F.expr(v).alias(n) for n, v in SIDE.items()])
    return audit.with_target(resolve.with_collisions(_resolved(spark, d)), o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_orderkey", "o_orderkey")


AUDITED = RESOLVED.format(before=7, after=20) + f""", q AS (SELECT *, {", ".join(f"{v} AS {n}" for n, v in SIDE.items())} FROM orders), st AS (SELECT * REPLACE (CASE WHEN status = 'matched' AND count(*) FILTER (status = 'matched') OVER (PARTITION BY target) > 1 THEN 'canonical_collision' ELSE status END AS status) FROM resolved),
au AS (SELECT st.*, l.* EXCLUDE (o_orderkey), c.o_orderdate AS c_date, c.o_orderpriority AS c_priority, c.o_orderstatus AS c_status, c.surface AS c_surface, c.best_of AS c_best_of, c.rank AS c_rank, date_diff('day', c.o_orderdate::DATE, l.o_orderdate::DATE) AS days FROM st JOIN q l USING (o_orderkey) LEFT JOIN q c ON c.o_orderkey = st.target)"""


@registered(AUDITED + " SELECT 'status' AS kind, status AS name, count(*) AS n FROM au GROUP BY ALL UNION ALL SELECT 'method', method, count(*) FROM au WHERE status = 'matched' GROUP BY ALL UNION ALL SELECT 'rank', 'eligible', count(*) FROM au WHERE status = 'matched' UNION ALL SELECT 'rank', 'known', count(*) FILTER (c_rank <> '') FROM au WHERE status = 'matched'")
def G13_join_counts(spark: SparkSession, d: str) -> DataFrame:
    """Statuses, methods of the matched and how many of them have a rank, from one pass over the resolution."""
    ok = F.col("status") == "matched"
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), n.alias("name"), c.alias("counts")) for k, n, c in (("status", F.col("status"), F.lit(True)), ("method", F.col("method"), ok), ("rank", F.lit("eligible"), ok), ("rank", F.lit("known"), ok & (F.col("c_rank") != "")))])
    return _audited(spark, d).select(F.explode(parts).alias("x")).where("x.counts").groupBy("x.kind", "x.name").agg(F.count(F.lit(1)).alias("n"))


@registered(AUDITED + " SELECT dimension, value, count(*) AS matches, count(*) FILTER (status = 'matched') AS matched, round(count(*) FILTER (status = 'matched') / count(*)::DOUBLE, 6) AS rate FROM (SELECT 'tour' AS dimension, tour AS value, status FROM au UNION ALL SELECT 'season', year(o_orderdate)::VARCHAR, status FROM au) GROUP BY ALL")
def G13_join_coverage(spark: SparkSession, d: str) -> DataFrame:
    return audit.join_coverage(_audited(spark, d), {"tour": F.col("tour"), "season": F.year("o_orderdate")})


_AGREE = {"surface": "surface = c_surface", "round": "o_orderstatus = c_status", "tournament": "o_orderpriority = c_priority", "best_of": "best_of = c_best_of"}


@registered(AUDITED + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS field, count(*) AS comparable, count(*) FILTER ({c}) AS agrees, round(count(*) FILTER ({c}) / count(*)::DOUBLE, 6) AS rate FROM au WHERE status = 'matched'" for f, c in _AGREE.items()) + ")")
def G13_agreement(spark: SparkSession, d: str) -> DataFrame:
    c = {"surface": F.col("surface") == F.col("c_surface"), "round": F.col("o_orderstatus") == F.col("c_o_orderstatus"), "tournament": F.col("o_orderpriority") == F.col("c_o_orderpriority"), "best_of": F.col("best_of") == F.col("c_best_of")}
    return audit.agreement(_audited(spark, d).where("status = 'matched'"), c)


@registered(AUDITED + ", w AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT 'window {b} {a}' AS name, (SELECT count(*) FILTER (status = 'matched') FROM ({RESOLVED.format(before=b, after=a)} SELECT * FROM resolved))::DOUBLE AS value" for b, a in WINDOWS) + ")), m AS (SELECT * FROM au WHERE status = 'matched') SELECT 'matches' AS name, count(*)::DOUBLE AS value FROM au UNION ALL SELECT 'matched', count(*) FROM m UNION ALL SELECT 'match rate', round((SELECT count(*) FROM m) / count(*)::DOUBLE, 6) FROM au UNION ALL SELECT 'least offset', min(days) FROM m UNION ALL SELECT 'median offset', list_sort(list(days))[(count(*) // 2)::INT + 1] FROM m UNION ALL SELECT 'greatest offset', max(days) FROM m UNION ALL SELECT 'colliding targets', count(*) FROM (SELECT target FROM au WHERE status = 'canonical_collision' GROUP BY 1) UNION ALL SELECT * FROM w")
def E9_join_audit(spark: SparkSession, d: str) -> DataFrame:
    """The audit's figures: match rate, offsets with their upper median, colliding targets, matches of each window."""
    rows = _audited(spark, d)
    ok = F.col("status") == "matched"
    days = F.when(ok, F.datediff("o_orderdate", "c_o_orderdate"))
    told = rows.select("status", "target", days.alias("days")).groupBy("status", "target", "days").agg(F.count(F.lit(1)).alias("n"))
    upto = told.where("days is not null").groupBy("days").agg(F.sum("n").alias("n")).withColumns({"upto": F.sum("n").over(W.orderBy("days")), "every": F.sum("n").over(W.partitionBy())})  # a row per day of the window
    middle = upto.where("upto > floor(every / 2)").agg(F.min("days").cast("double").alias("median"))
    hit = F.sum(F.when(F.col("status") == "matched", F.col("n")))
    one = told.agg(F.sum("n").alias("all"), F.coalesce(hit, F.lit(0)).alias("hit"), F.min("days").alias("low"), F.max("days").alias("high"), F.count_distinct(F.when(F.col("status") == "canonical_collision", F.col("target"))).alias("shared")).crossJoin(F.broadcast(middle))  # one row each
    row = lambda n, c: F.struct(F.lit(n).alias("name"), c.cast("double").alias("value"))
    figures = one.select(F.explode(F.array(row("matches", F.col("all")), row("matched", F.col("hit")), row("match rate", F.round(F.col("hit") / F.col("all"), 6)), row("least offset", F.col("low")), row("median offset", F.col("median")), row("greatest offset", F.col("high")), row("colliding targets", F.col("shared")))).alias("x")).select("x.*")
    tried = G14_window_sensitivity(spark, d)
    return figures.unionByName(tried.select(F.concat_ws(" ", F.lit("window"), "days_before", "days_after").alias("name"), F.col("matched").cast("double").alias("value")))


@registered(" UNION ALL ".join(f"SELECT * FROM ({RESOLVED.format(before=b, after=a)} SELECT {b}::INT AS days_before, {a}::INT AS days_after, count(*) FILTER (status = 'matched') AS matched FROM resolved)" for b, a in WINDOWS))
def G14_window_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Three windows from one join at the widest of them."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    priority, status = F.col("o_orderpriority") == F.col("c_o_orderpriority"), F.col("o_orderstatus") == F.col("c_o_orderstatus")
    return audit.windows_matched(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey", "o_orderkey", "o_orderdate", "o_orderdate", priority | status, priority & status, WINDOWS)


_QUEUE = ", good AS (SELECT o_orderkey, 'matched' AS queue FROM au WHERE status = 'matched' ORDER BY sha256(o_orderkey::VARCHAR), o_orderkey LIMIT 25), bad AS (SELECT o_orderkey, 'exception' AS queue FROM (SELECT o_orderkey, status, row_number() OVER (PARTITION BY status ORDER BY o_orderkey) AS turn FROM au WHERE status <> 'matched') ORDER BY turn, status LIMIT 25), queue AS (SELECT * FROM good UNION ALL SELECT * FROM bad)"
_TEXT = lambda e: f"CASE WHEN target IS NULL THEN '' ELSE coalesce(({e})::VARCHAR, '') END"
_ROW_SQL = " SELECT o_orderkey::VARCHAR AS mcp_match_id, strftime(o_orderdate, '%Y-%m-%d') AS mcp_date, o_orderpriority AS mcp_tournament, o_orderstatus AS mcp_round, surface AS mcp_surface, best_of AS mcp_best_of, o_custkey::VARCHAR AS mcp_players, status, coalesce(method, '') AS method, candidate_count::VARCHAR AS candidate_count, candidates AS candidate_context_ids, " + ", ".join(f"{_TEXT(e)} AS {n}" for n, e in {"context_match_id": "target", "context_tournament_date": "strftime(c_date, '%Y-%m-%d')", "context_tournament": "c_priority", "context_round": "c_status", "context_surface": "c_surface", "context_best_of": "c_best_of", "context_players": "o_custkey", "context_source_file": "'orders'", "date_offset_days": "days", "surface_agrees": _AGREE["surface"], "round_agrees": _AGREE["round"], "tournament_agrees": _AGREE["tournament"], "best_of_agrees": _AGREE["best_of"]}.items()) + ", '' AS review_status, '' AS review_notes FROM au"


def _evidence(rows: DataFrame) -> DataFrame:
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    own = {"mcp_match_id": F.col("o_orderkey"), "mcp_date": day("o_orderdate"), "mcp_tournament": F.col("o_orderpriority"), "mcp_round": F.col("o_orderstatus"), "mcp_surface": F.col("surface"), "mcp_best_of": F.col("best_of"), "mcp_players": F.col("o_custkey")}
    context = {"context_match_id": F.col("target"), "context_tournament_date": day("c_o_orderdate"), "context_tournament": F.col("c_o_orderpriority"), "context_round": F.col("c_o_orderstatus"), "context_surface": F.col("c_surface"), "context_best_of": F.col("c_best_of"), "context_players": F.col("o_custkey"), "context_source_file": F.lit("orders"), "date_offset_days": F.datediff("o_orderdate", "c_o_orderdate")}
    agrees = {"surface_agrees": F.col("surface") == F.col("c_surface"), "round_agrees": F.col("o_orderstatus") == F.col("c_o_orderstatus"), "tournament_agrees": F.col("o_orderpriority") == F.col("c_o_orderpriority"), "best_of_agrees": F.col("best_of") == F.col("c_best_of")}
    return audit.evidence(rows, own, context, agrees)


@registered(AUDITED + _ROW_SQL)
def P25_review_rows(spark: SparkSession, d: str) -> DataFrame:
    """All 26 columns of evidence for every resolution, a context or not."""
    return _evidence(_audited(spark, d))


@registered(AUDITED + _QUEUE + _ROW_SQL + " JOIN queue USING (o_orderkey)")
def K3_review_queue(spark: SparkSession, d: str) -> DataFrame:
    """The queue of 25 and 25 written as one CSV file and read back."""
    rows = _audited(spark, d)
    queue = audit.review_queue(rows.select("status", "o_orderkey"), "o_orderkey").select("o_orderkey")
    told = _evidence(rows.join(F.broadcast(queue), "o_orderkey", "left_semi"))  # 50 ids
    path = readers.shared_dir(spark)
    readers.write_review_csv(told, path)
    return readers.read_csv(spark, path, told.columns).drop("source_file")


LINKS = "l AS (SELECT o_orderkey AS match_id, 'p' || o_custkey % 60 AS winner_name, CASE WHEN o_custkey % 60 < 3 THEN o_orderkey % 2 ELSE o_custkey % 60 END AS winner_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey % 150)::INT END AS winner_rank, CASE WHEN o_orderkey % 31 = 0 THEN 'other' ELSE 'q' || o_custkey % 45 END AS loser_name, 100 + o_custkey % 45 AS loser_id, (o_orderkey % 90)::INT AS loser_rank FROM orders WHERE o_orderkey % 8 <> 0)"
ENRICHED = COMPUTED + f""", {LINKS}, en AS (SELECT c.match_id, tour, player, opponent, l.match_id IS NULL AS missing, CASE WHEN player = winner_name THEN winner_id WHEN player = loser_name THEN loser_id END AS id, CASE WHEN player = winner_name THEN winner_rank WHEN player = loser_name THEN loser_rank END AS player_rank,
CASE WHEN opponent = winner_name THEN winner_rank WHEN opponent = loser_name THEN loser_rank END AS opponent_rank, coalesce(player IN (winner_name, loser_name) AND opponent IN (winner_name, loser_name), false) AS met FROM computed c LEFT JOIN l ON l.match_id = c.match_id),
several AS (SELECT tour, player FROM en WHERE met GROUP BY 1, 2 HAVING count(DISTINCT id) > 1), good AS (SELECT * FROM en WHERE met AND (tour, player) NOT IN (SELECT tour, player FROM several))"""


def _links(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").where("o_orderkey % 8 <> 0").selectExpr("o_orderkey as match_id", "concat('p', o_custkey % 60) as winner_name", "if(o_custkey % 60 < 3, o_orderkey % 2, o_custkey % 60) as winner_id", "if(o_orderkey % 7 = 0, null, cast(o_orderkey % 150 as int)) as winner_rank", "if(o_orderkey % 31 = 0, 'other', concat('q', o_custkey % 45)) as loser_name", "100 + o_custkey % 45 as loser_id", "cast(o_orderkey % 90 as int) as loser_rank")


@registered(ENRICHED + " SELECT match_id, tour, player, opponent, id AS context_player_id, player_rank, opponent_rank FROM good")
def J7_enriched_records(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = audit.enrich(_computed(spark, d), _links(spark, d))
    return rows.select("match_id", "tour", "player", "opponent", "context_player_id", "player_rank", "opponent_rank")


@registered(ENRICHED + " SELECT (SELECT count(*) FROM en) AS records, (SELECT count(*) FROM en WHERE missing) AS missing_link, (SELECT count(*) FROM en WHERE NOT missing AND NOT met) AS identity_mismatch, (SELECT count(*) FROM en WHERE met) AS linked, (SELECT count(*) FROM several) AS id_collisions, (SELECT count(*) FROM en WHERE met) - count(*) AS collision_records, count(*) AS eligible, count(DISTINCT match_id) AS eligible_matches, count(DISTINCT (tour, player)) AS eligible_players, count(player_rank) AS player_rank_known, count(opponent_rank) AS opponent_rank_known FROM good")
def E12_record_enrichment(spark: SparkSession, d: str) -> DataFrame:
    return audit.enrich(_computed(spark, d), _links(spark, d))[1]


# Profiles

@registered("WITH x AS (SELECT year(o_orderdate) + 20 AS y, o_totalprice > 200000 AS ok FROM orders) SELECT CASE WHEN y <= 2009 THEN 'through 2009' WHEN y <= 2018 THEN '2010-18' WHEN y <= 2019 THEN '2019' WHEN y <= 2023 THEN '2020-23' ELSE '2024-26' END AS era, count(*) AS cells, count(*) FILTER (ok) AS valid, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS rate FROM x GROUP BY 1")
def O7_eras(spark: SparkSession, d: str) -> DataFrame:
    ok = F.col("o_totalprice") > 200000
    n = F.count(F.lit(1))
    return read(spark, d, "orders").groupBy(text.era(F.year("o_orderdate") + 20).alias("era")).agg(n.alias("cells"), F.count_if(ok).alias("valid"), F.round(F.count_if(ok) / n, 6).alias("rate"))


FIELD = {"a": "a <> ''", "b": "trim(b) <> ''", "label": "label <> 'bad'"}
GROUPS = {"season": "CASE WHEN regexp_matches(raw_date[1:4], '^[0-9]{4}$') THEN raw_date[1:4] ELSE 'invalid-date' END", "tournament": "raw_author"}


@registered(METRICS.split(", m1 AS")[0].split(", cells AS")[0] + ", mt AS (SELECT " + ", ".join(f"{v} AS {n}" for n, v in MATCH.items()) + " FROM orders), j AS (SELECT * FROM points JOIN mt ON match_id = l_orderkey), e AS (" + " UNION ALL ".join([f"SELECT '{k}' AS dimension, {v} AS value, a, b, label FROM j" for k, v in GROUPS.items()] + [f"SELECT 'player', {p}, a, b, label FROM j" for p in ("player_1", "player_2")]) + "), c AS (SELECT dimension, value, count(*) AS points, " + ", ".join(f"count(*) FILTER ({v}) AS {n}" for n, v in FIELD.items()) + " FROM e GROUP BY ALL) SELECT dimension, value, points, " + ", ".join(f"round({n} / points::DOUBLE, 6) AS {n}" for n in FIELD) + " FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY points DESC, value) AS rn FROM c) WHERE rn <= 10")
def G29_field_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of the fields in the ten largest groups of each dimension; a point counts for both its players."""
    m = read(spark, d, "orders").select(*[F.expr(v).alias(n) for n, v in MATCH.items()]).withColumnRenamed("match_id", "l_orderkey")
    season = F.when(F.substring("raw_date", 1, 4).rlike("^[0-9]{4}$"), F.substring("raw_date", 1, 4)).otherwise("invalid-date")
    pairs = F.array(*[F.struct(F.lit(k).alias("dimension"), v.alias("value")) for k, v in (("season", season), ("tournament", F.col("raw_author")), ("player", F.col("player_1")), ("player", F.col("player_2")))])
    e = charted(spark, d).join(m, "l_orderkey").select(F.explode(pairs).alias("x"), *[F.expr(v).alias(n) for n, v in FIELD.items()])
    c = e.groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("points"), *[F.count_if(n).alias(n) for n in FIELD])
    rn = F.row_number().over(W.partitionBy("dimension").orderBy(F.desc("points"), "value"))
    return c.withColumn("rn", rn).where("rn <= 10").select("dimension", "value", "points", *[r6(F.col(n) / F.col("points")).alias(n) for n in FIELD])

