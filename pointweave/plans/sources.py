"""Registered queries on sources: the driver's tables are written as the files that the readers know, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions import stats, text
from pointweave.operators import integrity
from pointweave.plans.registry import r6, read, registered
from pointweave.sources import readers


def exported(spark: SparkSession, d: str, table: str, columns: dict[str, str], where: str = "true") -> DataFrame:
    return read(spark, d, table).where(where).select(*[F.expr(v).alias(n) for n, v in columns.items()])


def selected(columns: dict[str, str], table: str, where: str = "true") -> str:
    """The same columns in SQL."""
    return "SELECT " + ", ".join(f'{v} AS "{n}"' for n, v in columns.items()) + f" FROM {table} WHERE {where}"


POINT = {
    "match_id": "concat('2000-', CASE WHEN l_orderkey % 2 = 0 THEN 'M' ELSE 'W' END, '-', l_orderkey)", "Pt": "CASE WHEN l_partkey % 97 = 0 THEN 'x' WHEN l_partkey % 89 = 0 THEN '0' ELSE cast(l_linenumber as varchar(9)) END",
    "Set1": "cast(l_partkey % 2 as varchar(9))", "Set2": "'0'", "Gm1": "cast(l_suppkey % 6 as varchar(9))", "Gm2": "cast(l_linenumber % 6 as varchar(9))", "Pts": "CASE WHEN l_linenumber % 2 = 0 THEN '15-0' ELSE '' END",
    "Svr": "CASE WHEN l_partkey % 83 = 0 THEN '3' ELSE cast(1 + l_orderkey % 2 as varchar(9)) END", "PtWinner": "CASE WHEN l_partkey % 79 = 0 THEN '' ELSE cast(1 + l_suppkey % 2 as varchar(9)) END",
}
SHARDS = 6
RAW = "raw AS (" + selected(POINT | {"shard": "cast(l_suppkey % 6 as varchar(9))"}, "lineitem") + ")"
VALUES = ", ".join(f'"{c}"' for c in list(POINT)[2:])
GROUPS = f"""g AS (SELECT match_id, "Pt", count(*) AS copies, count(DISTINCT ({VALUES})) AS kinds, min(({VALUES})) AS v, min(shard) AS first_shard FROM raw GROUP BY 1, 2)"""


def _shards(spark: SparkSession, d: str) -> list[str]:
    """Line items as six point shards."""
    root = readers.shared_dir(spark)
    rows = exported(spark, d, "lineitem", POINT | {"shard": "cast(l_suppkey % 6 as varchar(9))"})
    rows.write.partitionBy("shard").csv(root, header=True, escape='"', emptyValue="")
    return [f"{root}/shard={k}" for k in range(SHARDS)]


@registered(f"""WITH {RAW}, {GROUPS}, c AS (SELECT DISTINCT raw.* EXCLUDE (shard) FROM raw JOIN g USING (match_id, "Pt") WHERE kinds = 1),
t AS (SELECT match_id, TRY_CAST("Pt" AS INT) AS point, TRY_CAST("Gm1" AS INT) AS gm1, "Pts" AS label, TRY_CAST("Svr" AS INT) - 1 AS server, TRY_CAST("PtWinner" AS INT) - 1 AS winner FROM c)
SELECT *, CASE WHEN match_id = '' THEN 'match_id' WHEN coalesce(point < 1, true) THEN 'point' WHEN NOT coalesce(server IN (0, 1), false) THEN 'server' WHEN NOT coalesce(winner IN (0, 1), false) THEN 'winner' END AS error FROM t""")
def S1_points(spark: SparkSession, d: str) -> DataFrame:
    """Shards read in one scan, equal copies collapsed, conflicts left out whole, rows typed with their first error."""
    return readers.read_points(spark, _shards(spark, d)).select("match_id", "point", "gm1", "label", "server", "winner", "error")


@registered(f"WITH {RAW}, {GROUPS}, u AS (SELECT first_shard AS shard, count(*) AS usable FROM g WHERE kinds = 1 GROUP BY 1) SELECT shard, count(*) AS raw_rows, count(DISTINCT match_id) AS matches, any_value(usable) AS usable_rows FROM raw JOIN u USING (shard) GROUP BY 1")
def S2_shard_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each shard, and the usable points credited to the first shard that has them: what adding each shard's
    counters and taking back those of later conflicts comes to (A5)."""
    paths = _shards(spark, d)
    raw = readers.read_csv(spark, paths, list(POINT)).withColumn("shard", F.regexp_extract("source_file", "shard=([0-9]+)", 1)).drop("source_file")
    values = [c for c in POINT if c not in ("match_id", "Pt")]
    row = F.struct(*values)
    g = raw.groupBy("match_id", "Pt").agg(F.min(row).eqNullSafe(F.max(row)).alias("one"), F.min("shard").alias("shard")).where("one").groupBy("shard").agg(F.count(F.lit(1)).alias("usable_rows"))
    return raw.groupBy("shard").agg(F.count(F.lit(1)).alias("raw_rows"), F.count_distinct("match_id").alias("matches")).join(g, "shard")


@registered(f"WITH {RAW} SELECT DISTINCT match_id, CASE WHEN contains(match_id, '-M-') THEN 'ATP' WHEN contains(match_id, '-W-') THEN 'WTA' ELSE 'Unknown' END AS tour FROM raw")
def S7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ids: only their column is parsed."""
    ids = spark.read.csv(_shards(spark, d), header=True).select("match_id").distinct()
    return ids.select("match_id", text.tour_of(F.col("match_id")).alias("tour"))


VALID = {"Pt": "regexp_matches(v, '^[0-9]+$')", "Svr": "v IN ('1', '2')", "PtWinner": "v IN ('1', '2')", "Pts": "v <> ''", "Gm1": "regexp_matches(v, '^[0-9]+$')"}


@registered(f"WITH {RAW} SELECT field, count(*) AS n_rows, count(*) FILTER (v <> '') AS non_empty, count(*) FILTER (ok) AS n_valid FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, v, {ok} AS ok FROM (SELECT trim(\"{c}\") AS v FROM raw)" for c, ok in VALID.items()) + ") GROUP BY 1")
def P7_valid_values(spark: SparkSession, d: str) -> DataFrame:
    rows = exported(spark, d, "lineitem", POINT)
    return integrity.completeness(rows, {c: text.valid_value(c, F.col(c)) for c in VALID})


MATCH = {
    "match_id": "concat('m', o_orderkey - CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 0 END)", "Player 1": "concat('p', o_custkey % 50)", "Player 2": "concat('q', o_custkey % 31)", "Date": "CASE WHEN o_orderkey % 41 = 0 THEN '2024131' WHEN o_orderkey % 43 = 0 THEN '20001340' ELSE concat('2000', lpad(cast(1 + o_custkey % 12 as varchar(9)), 2, '0'), '15') END",
    "Tournament": "concat('T ', o_custkey % 7)", "Round": "o_orderstatus", "Surface": "CASE o_custkey % 9 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Clay' WHEN 2 THEN 'Grass' ELSE 'Hard' END", "Best of": "CASE WHEN o_orderkey % 37 = 0 THEN '7' ELSE '3' END",
}
MATCH_SQL = "raw AS (" + selected(MATCH, "orders") + """), m AS (SELECT match_id, count(*) AS copies, count(DISTINCT ("Player 1", "Player 2", "Date", "Tournament", "Round", "Surface", "Best of")) > 1 AS conflicting,
bool_or(TRY_STRPTIME(CASE WHEN regexp_matches("Date", '^[0-9]{8}$') THEN "Date" END, '%Y%m%d') IS NULL) AS invalid_date, bool_or("Surface" NOT IN ('Hard', 'Clay', 'Grass', 'Carpet')) AS invalid_surface, bool_or("Best of" NOT IN ('3', '5')) AS invalid_best_of, any_value("Date") AS d, any_value("Surface") AS s FROM raw GROUP BY 1),
ms AS (SELECT *, NOT conflicting AND NOT invalid_date AND NOT invalid_surface AND NOT invalid_best_of AS safe FROM m)"""


def _matches(spark: SparkSession, d: str) -> DataFrame:
    path = readers.write_csv(exported(spark, d, "orders", MATCH), readers.shared_dir(spark))
    return readers.read_matches(spark, [path])


@registered(f"WITH {MATCH_SQL} SELECT match_id, copies, conflicting, invalid_date, invalid_surface, invalid_best_of, safe FROM ms")
def S3_metadata(spark: SparkSession, d: str) -> DataFrame:
    return _matches(spark, d).select("match_id", "copies", "conflicting", "invalid_date", "invalid_surface", "invalid_best_of", "safe")


@registered(f"WITH {MATCH_SQL} SELECT count(*) AS ids, count(*) FILTER (copies > 1) AS duplicate_ids, count(*) FILTER (conflicting) AS conflicting_ids, count(*) FILTER (invalid_date OR invalid_surface OR invalid_best_of) AS anomalous_ids, count(*) FILTER (safe) AS safe_ids FROM ms")
def A2_metadata_dedup(spark: SparkSession, d: str) -> DataFrame:
    m = _matches(spark, d)
    return m.agg(F.count(F.lit(1)).alias("ids"), F.count_if(F.col("copies") > 1).alias("duplicate_ids"), F.count_if("conflicting").alias("conflicting_ids"), F.count_if(F.expr("invalid_date or invalid_surface or invalid_best_of")).alias("anomalous_ids"), F.count_if("safe").alias("safe_ids"))


@registered(f"WITH {MATCH_SQL} SELECT dimension, value, count(*) AS n FROM (SELECT 'season' AS dimension, d[1:4] AS value FROM ms WHERE safe UNION ALL SELECT 'surface', s FROM ms WHERE safe) GROUP BY ALL")
def G28_match_values(spark: SparkSession, d: str) -> DataFrame:
    """Distribution of match-level values over the safe matches."""
    safe = _matches(spark, d).where("safe").select(F.explode(F.array(F.struct(F.lit("season").alias("dimension"), F.substring("row.Date", 1, 4).alias("value")), F.struct(F.lit("surface").alias("dimension"), F.col("row.Surface").alias("value")))).alias("x"))
    return safe.groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("n"))


DATES = "CASE o_custkey % 6 WHEN 0 THEN '2024131' WHEN 1 THEN '20240230' WHEN 2 THEN ' 20240229' WHEN 3 THEN '' ELSE concat('2019', lpad(cast(1 + o_custkey % 12 as varchar(9)), 2, '0'), '28') END"


@registered(f"SELECT o_orderkey, raw, CASE WHEN regexp_matches(raw, '^[0-9]{{8}}$') THEN strftime(TRY_STRPTIME(raw, '%Y%m%d'), '%Y-%m-%d') END AS day FROM (SELECT o_orderkey, {DATES} AS raw FROM orders)")
def P6_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "orders").select("o_orderkey", F.expr(DATES).alias("raw"))
    return rows.select("o_orderkey", "raw", text.compact_date(F.col("raw")).cast("string").alias("day"))


OVERVIEW = {"match_id": "concat('m', l_orderkey)", "player": "concat('p', l_suppkey % 3)", "set": "CASE l_linenumber % 3 WHEN 0 THEN 'Total' ELSE cast(l_linenumber % 3 as varchar(9)) END", "serve_pts": "CASE WHEN l_partkey % 61 = 0 THEN 'n/a' WHEN l_partkey % 5 = 0 THEN concat('0', cast(l_quantity as int)) ELSE cast(cast(l_quantity as int) as varchar(9)) END", "aces": "CASE WHEN l_partkey % 53 = 0 THEN '-3' WHEN l_partkey % 59 = 0 THEN '' ELSE cast(l_suppkey % 4 as varchar(9)) END"}
DIRECTION = {"match_id": "concat('m', l_orderkey)", "server": "concat('p', l_suppkey % 4)", "returner": "concat('r', l_partkey % 4)", "row": "cast(l_linenumber % 3 as varchar(9))", "deuce_wide": "cast(l_partkey % 3 as varchar(9))"}
_NUMBERS = {"overview": (OVERVIEW, ["serve_pts", "aces"], ["match_id", "player", "set"], ["player"]), "direction": (DIRECTION, ["deuce_wide"], ["match_id", "server", "returner", "row"], ["server", "returner"])}


def _profile_sql(name: str) -> str:
    columns, numbers, keys, players = _NUMBERS[name]
    key, quoted = ", ".join(f'"{k}"' for k in keys), lambda c: f"trim(\"{c}\")"
    count = lambda cond: " + ".join(f"({cond.format(v=quoted(c))})::INT" for c in numbers)
    every = ", ".join(f'"{c}"' for c in columns)
    return f"""SELECT '{name}' AS file, sum(copies)::BIGINT AS rows, sum(copies - 1)::BIGINT AS duplicate_rows, count(*) FILTER (copies > 1) AS duplicate_groups, count(*) FILTER (copies > 1 AND kinds = 1) AS exact_groups, count(*) FILTER (kinds > 1) AS conflicting_groups, count(DISTINCT match_id) FILTER (kinds > 1) AS conflicting_matches,
sum(f)::BIGINT AS numbers, sum(b)::BIGINT AS invalid_numbers, sum(l)::BIGINT AS negative_numbers, (SELECT count(DISTINCT match_id) FROM {name}) AS matches, (SELECT count(DISTINCT match_id) FROM {name} WHERE match_id NOT IN (SELECT id FROM safe)) AS orphan_ids, (SELECT count(DISTINCT match_id) FROM {name} WHERE match_id IN (SELECT id FROM charted)) AS charted_covered,
(SELECT count(DISTINCT p) FROM ({' UNION ALL '.join(f'SELECT {p} AS p FROM {name}' for p in players)})) AS players FROM (SELECT {key}, count(*) AS copies, count(DISTINCT ({every})) AS kinds, sum({count("{v} <> ''")}) AS f, sum({count("{v} <> '' AND TRY_CAST({v} AS INT) IS NULL")}) AS b, sum({count("coalesce(TRY_CAST({v} AS INT) < 0, false)")}) AS l FROM {name} GROUP BY {key})"""


AGGREGATES = f"WITH overview AS ({selected(OVERVIEW, 'lineitem')}), direction AS ({selected(DIRECTION, 'lineitem')}), safe AS (SELECT 'm' || o_orderkey AS id FROM orders WHERE o_orderstatus <> 'P'), charted AS (SELECT 'm' || o_orderkey AS id FROM orders WHERE o_orderstatus = 'F')"


@registered(f"{AGGREGATES} {_profile_sql('overview')} UNION ALL {_profile_sql('direction')}")
def G26_aggregate_files(spark: SparkSession, d: str) -> DataFrame:
    """Profiles of two files of different columns, each by the grain that its columns make."""
    o = read(spark, d, "orders").select(F.concat(F.lit("m"), "o_orderkey").alias("match_id"), "o_orderstatus")
    out = None
    for name, (columns, *_) in _NUMBERS.items():
        path = readers.write_csv(exported(spark, d, "lineitem", columns), readers.shared_dir(spark))
        one = readers.profile_aggregate(spark, path, o.where("o_orderstatus <> 'P'"), o.where("o_orderstatus = 'F'")).withColumn("file", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


ACCEPTED = f"WITH overview AS ({selected(OVERVIEW, 'lineitem')}), a AS (SELECT match_id, player, \"set\", TRY_CAST(serve_pts AS INT) AS serve_pts, TRY_CAST(aces AS INT) AS aces FROM overview WHERE \"set\" = 'Total'), g AS (SELECT match_id, player, \"set\", count(*) AS copies, count(DISTINCT (serve_pts, aces)) AS kinds, any_value(serve_pts) AS serve_pts, any_value(aces) AS aces FROM a WHERE serve_pts IS NOT NULL AND aces IS NOT NULL GROUP BY 1, 2, 3)"


def _accepted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    path = readers.write_csv(exported(spark, d, "lineitem", OVERVIEW), readers.shared_dir(spark))
    return readers.read_aggregate_rows(spark, [path], "set", ["Total"], ["serve_pts", "aces"])


@registered(f"{ACCEPTED} SELECT match_id, player, \"set\", serve_pts, aces FROM g WHERE kinds = 1")
def S5_aggregate_rows(spark: SparkSession, d: str) -> DataFrame:
    return _accepted(spark, d)[0]


@registered(f"{ACCEPTED} SELECT (SELECT count(*) FROM a) AS accepted_rows, (SELECT count(*) FROM a WHERE serve_pts IS NULL OR aces IS NULL) AS invalid_rows, count(*) AS groups, count(*) FILTER (kinds = 1) AS safe, count(*) FILTER (copies > 1) AS duplicate_groups, count(*) FILTER (kinds > 1) AS conflicting_groups FROM g")
def A3_aggregate_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _accepted(spark, d)[1]


CONTEXT = {
    "tourney_id": "CASE WHEN o_orderkey % 71 = 0 THEN ' ' ELSE concat('2000-', o_custkey % 40) END", "tourney_name": "concat('T ', o_custkey % 7)", "surface": "'Hard'", "tourney_date": "CASE WHEN o_orderkey % 67 = 0 THEN '' ELSE '20000115' END", "match_num": "cast(o_orderkey % 60 as varchar(9))", "winner_id": "cast(o_custkey % 2 as varchar(9))",
    "winner_name": "concat('p', o_custkey % 2)", "loser_id": "'7'", "loser_name": "'q 7'", "best_of": "'3'", "round": "'R32'", "winner_rank": "'10'", "loser_rank": "''",
}
FILES = {"atp/atp_matches_2000.csv": 0, "wta/wta_matches_2000.csv": 1, "atp/atp_matches_futures_2000.csv": 2, "wta/wta_matches_qual_itf_2000.csv": 3, "atp/atp_players.csv": 4}
ARCHIVE = "WITH raw AS (" + selected(CONTEXT | {"f": "o_orderkey % 5", "x": "o_custkey"}, "orders") + """), n AS (SELECT *, CASE WHEN f % 2 = 0 THEN 'ATP' ELSE 'WTA' END AS tour, CASE f WHEN 2 THEN 'futures' WHEN 3 THEN 'qual_itf' ELSE 'tour' END AS family FROM raw WHERE f < 4),
c AS (SELECT *, 'context:' || lower(tour) || ':' || family || ':' || tourney_id || ':' || match_num AS canonical_id, tourney_date <> '' AND trim(tourney_id) <> '' AS valid FROM n),
g AS (SELECT canonical_id, any_value(tour) AS tour, any_value(family) AS family, count(*) AS copies, count(DISTINCT (tourney_name, winner_id, winner_name)) AS kinds, min(winner_id) AS winner_id FROM c WHERE valid GROUP BY 1)"""


def _archive(spark: SparkSession, d: str) -> DataFrame:
    """The archive's folder of files, one of which is none of matches."""
    root = readers.shared_dir(spark)
    for name, k in FILES.items():
        folder = readers.write_csv(exported(spark, d, "orders", CONTEXT, f"o_orderkey % 5 = {k}").coalesce(1), f"{root}-parts/{k}")
        part = readers.discover(spark, f"{folder}/part-*.csv", 1)[0]
        path = spark._jvm.org.apache.hadoop.fs.Path
        store = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path(f"{root}/{name}").getParent())
        store.rename(path(part), path(f"{root}/{name}"))
    readers.discover(spark, f"{root}/*/*.csv", len(FILES))
    return readers.read_context(spark, root)


@registered(f"{ARCHIVE} SELECT canonical_id, tour, family, winner_id, 'atp/atp_matches_2000.csv' AS source_file FROM g WHERE kinds = 1 AND tour = 'ATP' AND family = 'tour' UNION ALL SELECT canonical_id, tour, family, winner_id, CASE family WHEN 'futures' THEN 'atp/atp_matches_futures_2000.csv' WHEN 'qual_itf' THEN 'wta/wta_matches_qual_itf_2000.csv' ELSE 'wta/wta_matches_2000.csv' END FROM g WHERE kinds = 1 AND NOT (tour = 'ATP' AND family = 'tour')")
def S6_context_archive(spark: SparkSession, d: str) -> DataFrame:
    """Safe matches of a folder of files: tour from the folder, family from the name, namespaced ids."""
    return readers.safe_context(_archive(spark, d)).select("canonical_id", "tour", "family", "winner_id", "source_file")


@registered(f"{ARCHIVE} SELECT (SELECT count(*) FROM c) AS raw_rows, (SELECT count(*) FROM c WHERE NOT valid) AS invalid_rows, count(*) FILTER (kinds = 1) AS safe_matches, coalesce(sum(copies - 1) FILTER (kinds = 1), 0)::BIGINT AS exact_duplicate_rows, count(*) FILTER (kinds > 1) AS conflicting_keys FROM g")
def A4_context_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = _archive(spark, d)
    values = [c for c in rows.columns if c not in ("canonical_id", "valid")]
    g = integrity.grouped(rows.where("valid"), ["canonical_id"], values)
    bad = F.col("conflicting")
    counts = g.agg(F.count_if(~bad).alias("safe_matches"), F.coalesce(F.sum(F.when(~bad, F.col("copies") - 1)), F.lit(0)).alias("exact_duplicate_rows"), F.count_if(bad).alias("conflicting_keys"))
    return rows.agg(F.count(F.lit(1)).alias("raw_rows"), F.count_if(~F.col("valid")).alias("invalid_rows")).crossJoin(F.broadcast(counts))  # one row each


@registered(f"{ARCHIVE} SELECT tour, family, count(*) AS n_rows, count(*) FILTER (valid) AS valid_rows FROM c GROUP BY 1, 2")
def F3_context_filter(spark: SparkSession, d: str) -> DataFrame:
    return _archive(spark, d).groupBy("tour", "family").agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("valid").alias("valid_rows"))


STATE = {
    "match_id": "CASE o_orderkey % 29 WHEN 0 THEN '-1' WHEN 1 THEN 'm' ELSE cast(o_orderkey as varchar(9)) END", "sets_p1": "CASE o_custkey % 23 WHEN 0 THEN 'x' WHEN 1 THEN '-1' ELSE '0' END", "sets_p2": "CASE WHEN o_custkey % 31 = 0 THEN '' ELSE '1' END", "games_p1": "CASE o_custkey % 11 WHEN 0 THEN '[6' WHEN 1 THEN '[]' WHEN 2 THEN '[-1, 2]' ELSE concat('[6, ', o_custkey % 6, ']') END", "games_p2": "CASE WHEN o_custkey % 13 = 0 THEN '' ELSE concat('[', o_custkey % 5, ']') END",
    "points_p1": "CASE o_custkey % 7 WHEN 0 THEN 'A' WHEN 1 THEN 'x' WHEN 2 THEN '' ELSE '40' END", "points_p2": "CASE WHEN o_custkey % 17 = 0 THEN 'AD' ELSE '17' END", "server": "CASE o_custkey % 10 WHEN 0 THEN '' WHEN 1 THEN '3' ELSE cast(1 + o_custkey % 2 as varchar(9)) END", "is_tiebreak": "CASE WHEN o_custkey % 19 = 0 THEN 'True' ELSE 'False' END", "timestamp_utc": "concat('2026-01-01T00:00:', o_custkey % 60)",
}
LIVE = "WITH raw AS (" + selected(STATE, "orders") + """), t AS (SELECT *, TRY_CAST(nullif(games_p1, '') AS INT[]) AS g1, TRY_CAST(nullif(games_p2, '') AS INT[]) AS g2, CASE WHEN server <> '' THEN TRY_CAST(server AS INT) - 1 END AS s FROM raw),
states AS (SELECT TRY_CAST(match_id AS INT) AS match_id, TRY_CAST(sets_p1 AS INT) AS sets_1, TRY_CAST(sets_p2 AS INT) AS sets_2, g1, g2, coalesce(g1[-1], 0) AS now_1, coalesce(g2[-1], 0) AS now_2, s AS server, lower(is_tiebreak) = 'true' AS tiebreak, timestamp_utc, CASE WHEN coalesce(TRY_CAST(match_id AS INT) < 0, true) THEN 'match_id' WHEN coalesce(least(TRY_CAST(sets_p1 AS INT), TRY_CAST(sets_p2 AS INT)) < 0 OR TRY_CAST(sets_p1 AS INT) IS NULL OR TRY_CAST(sets_p2 AS INT) IS NULL, true) THEN 'sets' WHEN g1 IS NULL OR g2 IS NULL OR len(list_filter(g1, lambda x: x < 0)) > 0 THEN 'games' WHEN server <> '' AND s NOT IN (0, 1) THEN 'server'
  WHEN NOT regexp_matches(points_p1, '^(|[0-9]+|A|AD)$') OR NOT regexp_matches(points_p2, '^(|[0-9]+|A|AD)$') THEN 'points' END AS error FROM t)"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    return readers.read_states(spark, readers.write_csv(exported(spark, d, "orders", STATE), readers.shared_dir(spark), compression="gzip"))


@registered(f"{LIVE} SELECT match_id, sets_1, sets_2, now_1, now_2, server, tiebreak, timestamp_utc, error FROM states")
def P15_live_states(spark: SparkSession, d: str) -> DataFrame:
    """Gzip files of scoreboard states, typed, with the current set's games and the first thing that cannot be read."""
    return _states(spark, d).select("match_id", "sets_1", "sets_2", "now_1", "now_2", "server", "tiebreak", "timestamp_utc", "error")


@registered(f"{LIVE} SELECT coalesce(error, 'ok') AS error, count(*) AS states, count(DISTINCT match_id) AS matches, count(*) FILTER (server IS NULL) AS without_server, count(*) FILTER (now_1 = 0 AND now_2 = 0) AS at_start, count(*) FILTER (tiebreak) AS tiebreaks FROM states GROUP BY 1")
def E11_live_inspection(spark: SparkSession, d: str) -> DataFrame:
    s = _states(spark, d)
    return s.groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count(F.lit(1)).alias("states"), F.count_distinct("match_id").alias("matches"), F.count_if(F.col("server").isNull()).alias("without_server"), F.count_if((F.col("now_1") == 0) & (F.col("now_2") == 0)).alias("at_start"), F.count_if("tiebreak").alias("tiebreaks"))


@registered("SELECT r_name AS name, upper(sha256(r_name || chr(10))) AS sha256 FROM region")
def S12_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """A file per region, its bytes hashed, keyed by the folder that names it."""
    root = readers.shared_dir(spark)
    r = read(spark, d, "region").select(F.col("r_name").alias("value"), F.col("r_name").alias("name"))
    r.repartition("name").write.partitionBy("name").text(root)
    files = readers.fingerprints(spark, f"{root}/*/part-*")
    return files.select(F.replace(F.regexp_extract("path", "name=([^/]+)/", 1), F.lit("%20"), F.lit(" ")).alias("name"), "sha256")


# Reviews

REVIEW = {"mcp_match_id": "concat('m', o_orderkey)", "mcp_date": "CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE concat('2017-07-', lpad(cast(1 + o_custkey % 28 as varchar(9)), 2, '0')) END", "status": "CASE o_orderkey % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'ambiguous' ELSE 'unresolved_pair' END", "surface_agrees": "CASE o_custkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END"}
HUMAN = REVIEW | {
    "mcp_date": "CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE concat(lpad(cast(1 + o_custkey % 28 as varchar(9)), 2, '0'), '/07/2017') END", "surface_agrees": "CASE o_custkey % 3 WHEN 0 THEN CASE WHEN o_orderkey % 31 = 0 THEN 'FALSO' ELSE 'VERDADEIRO' END WHEN 1 THEN 'FALSO' ELSE '' END",
    "review_status": "CASE WHEN o_orderkey % 23 = 0 THEN 'different' WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN ' Unsure' ELSE 'Same ' END", "review_notes": "CASE WHEN o_orderkey % 5 = 0 THEN 'a; note' ELSE '' END",
}
#: What a reviewer may write, and what it decides.
DECISIONS = {"same": "same_match", "different": "different_match", "unsure": "uncertain", "": "not_reviewed"}


def _reviews(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The automated file and the reviewer's, each read with the delimiter that it has, evidence in one spelling."""
    out = []
    for columns, sep in ((REVIEW, ","), (HUMAN, ";")):
        path = readers.write_csv(exported(spark, d, "orders", columns), readers.shared_dir(spark), sep)
        raw = readers.read_csv(spark, path, list(columns), readers.sniffed(spark, path)).drop("source_file")
        out.append(raw.withColumns({"mcp_date": F.coalesce(text.iso_date(F.col("mcp_date")), F.lit("?")), "surface_agrees": F.coalesce(text.plain_boolean(F.col("surface_agrees")), F.lit("?"))}))
    return out[0], out[1]


@registered("SELECT 'm' || o_orderkey AS mcp_match_id, 'surface_agrees' AS change FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 31 = 0")
def F14_review_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence that a review changed, after dates, booleans and delimiters of either language were read."""
    a, h = _reviews(spark, d)
    return integrity.evidence_changes(a, h, "mcp_match_id", ["mcp_date", "status", "surface_agrees"])


REVIEW_SQL = f"WITH r AS ({selected(HUMAN, 'orders')}), v AS (SELECT status, CASE lower(trim(review_status)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DECISIONS.items()) + " END AS decision FROM r)"


def _decided(spark: SparkSession, d: str) -> DataFrame:
    a, h = _reviews(spark, d)
    names = F.create_map(*[F.lit(x) for kv in DECISIONS.items() for x in kv])
    said = h.select("mcp_match_id", F.element_at(names, F.lower(F.trim("review_status"))).alias("decision"))
    return a.select("mcp_match_id", "status").join(said, "mcp_match_id")


@registered(f"{REVIEW_SQL} SELECT status, " + ", ".join(f"count(*) FILTER (decision = '{v}') AS {v}" for v in DECISIONS.values()) + " FROM v GROUP BY 1")
def G25_review_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).groupBy("status").agg(*[F.count_if(F.col("decision") == v).alias(v) for v in DECISIONS.values()])


Z = "1.959963984540054"


@registered(f"{REVIEW_SQL}, m AS (SELECT count(*) AS reviewed, count(*) FILTER (decision = 'same_match') AS same FROM v WHERE status = 'matched'), x AS (SELECT *, same / reviewed::DOUBLE AS p, {Z} * {Z} AS z2 FROM m) SELECT reviewed, same, round(p, 6) AS precision, round((p + z2 / (2 * reviewed) - {Z} * sqrt(p * (1 - p) / reviewed + z2 / (4.0 * reviewed * reviewed))) / (1 + z2 / reviewed), 6) AS low, round((p + z2 / (2 * reviewed) + {Z} * sqrt(p * (1 - p) / reviewed + z2 / (4.0 * reviewed * reviewed))) / (1 + z2 / reviewed), 6) AS high FROM x")
def E10_review_summary(spark: SparkSession, d: str) -> DataFrame:
    """Precision of the matched rows that were reviewed, with its Wilson interval."""
    m = _decided(spark, d).where("status = 'matched'").agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(F.col("decision") == "same_match").alias("same"))
    w = stats.wilson(F.col("same"), F.col("reviewed"))
    return m.select("reviewed", "same", r6(F.col("same") / F.col("reviewed")).alias("precision"), r6(w["low"]).alias("low"), r6(w["high"]).alias("high"))
