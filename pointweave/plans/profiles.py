"""Registered profiles: a whole snapshot's and a single shard's figures, and the small operators that they rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions import text
from pointweave.functions.metrics import serve_in, terminal
from pointweave.functions.notation import parse_notation
from pointweave.operators import integrity, studies
from pointweave.plans import audits, charting, registry, sources  # noqa: F401, audits registers what E7 is made of
from pointweave.plans.registry import KEYS, r6, read, registered
from pointweave.plans.studies import RECORDS, _profile_sql, records


@registered("SELECT c_custkey, CASE WHEN a < b THEN a || '|' || b ELSE b || '|' || a END AS pair FROM (SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) AS a, trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', ' ', 'g')) AS b FROM customer)")
def P3_pairs(spark: SparkSession, d: str) -> DataFrame:
    a, b = text.normalise_identity(F.col("c_name")), text.normalise_identity(F.col("c_mktsegment"))
    return read(spark, d, "customer").select("c_custkey", a.alias("a"), b.alias("b")).select("c_custkey", text.pair(F.col("a"), F.col("b")).alias("pair"))


@registered(f"WITH {charting.POINTS_SQL}, " + charting.parse_sql("SELECT DISTINCT a AS cell FROM points") + " SELECT cell, CASE WHEN outcome = 'serve_fault' THEN false WHEN outcome IN ('ace', 'unreturnable') OR shots > 0 THEN true END AS serve_in, shots > 0 OR coalesce(outcome IN ('ace', 'unreturnable', 'serve_fault'), false) AS terminal FROM parsed")
def P13_P14_serves(spark: SparkSession, d: str) -> DataFrame:
    """Whether a serve went in (unknown where the cell does not tell) and whether the cell ends the point."""
    cells = charting.charted(spark, d).select(F.col("a").alias("cell")).distinct().withColumn("p", parse_notation(F.col("cell")))
    p = {k: F.col(f"p.{k}") for k in ("outcome", "shots")}
    return cells.select("cell", serve_in(p).alias("serve_in"), terminal(p).alias("terminal"))


_PROFILE = _profile_sql("")["outcome"]


@registered(f"WITH {RECORDS}, s AS (SELECT player, {', '.join(f'sum({c}) AS {c}' for c in studies.COUNTERS)} FROM rec GROUP BY 1), op AS (SELECT player, {_PROFILE} AS o FROM s) SELECT player, round(o[1], 6) AS first_in, round(o[2], 6) AS aces, round(o[3], 6) AS dfs FROM op")
def G16_outcome_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Three outcome rates per player, null where any of them has no trials."""
    sums = records(spark, d).groupBy("player").agg(*[F.sum(c).alias(c) for c in studies.COUNTERS])
    p = studies.profiles(sums, ["player"])
    return p.select("player", *[r6(F.get("outcome", F.lit(i))).alias(n) for i, n in enumerate(studies.BINARY)])


_SIDE = {s: " + ".join(studies.cell(1, s, w) for w in studies.WAYS) for s in studies.SIDES}


@registered(f"WITH {RECORDS}, a AS (SELECT tour, surface, ({_SIDE['deuce']}) > 0 AS x, ({_SIDE['ad']}) > 0 AS y FROM rec), e AS (SELECT 'overall' AS dimension, 'all' AS value, x, y FROM a UNION ALL SELECT 'tour', tour, x, y FROM a UNION ALL SELECT 'surface', tour || '|' || surface, x, y FROM a) SELECT dimension, value, count(*) FILTER (x AND y) AS both_sides, count(*) FILTER (x <> y) AS one_side, count(*) FILTER (NOT x AND NOT y) AS no_direction, round(count(*) FILTER (x AND y) / nullif(count(*) FILTER (x OR y), 0)::DOUBLE, 6) AS both_given_any FROM e GROUP BY ALL")
def G21_court_sides(spark: SparkSession, d: str) -> DataFrame:
    """Records with both court sides, one or none: overall, by tour, and by tour and surface."""
    x, y = (F.expr(_SIDE[s]) > 0 for s in studies.SIDES)
    rows = studies.cut_by(records(spark, d).withColumns({"x": x, "y": y}), {"overall": F.lit("all"), "tour": F.col("tour"), "surface": F.concat_ws("|", "tour", "surface")})
    both, some = F.count_if(F.col("x") & F.col("y")), F.count_if(F.col("x") | F.col("y"))
    return rows.groupBy("dimension", "value").agg(both.alias("both_sides"), F.count_if(F.col("x") != F.col("y")).alias("one_side"), F.count_if(~F.col("x") & ~F.col("y")).alias("no_direction"), F.round(F.when(some > 0, both / some), 6).alias("both_given_any"))


@registered("SELECT l_orderkey, l_linenumber, arg_min(l_partkey, (l_shipdate, l_partkey)) AS l_partkey, arg_min(l_suppkey, (l_shipdate, l_partkey)) AS l_suppkey FROM lineitem GROUP BY 1, 2")
def W6_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each key by an ordinal that the source carries."""
    first = F.min_by(F.struct("l_partkey", "l_suppkey"), F.struct("l_shipdate", "l_partkey")).alias("x")
    return read(spark, d, "lineitem").groupBy(*KEYS).agg(first).select(*KEYS, "x.l_partkey", "x.l_suppkey")


@registered(f"WITH {RECORDS} SELECT tour, player, match_id, row_number() OVER (PARTITION BY tour, player ORDER BY month, match_id)::INT AS place FROM rec")
def W7_record_order(spark: SparkSession, d: str) -> DataFrame:
    """The place of each record in its player's order of date and match."""
    w = W.partitionBy("tour", "player").orderBy("month", "match_id")
    return records(spark, d).select("tour", "player", "match_id", F.row_number().over(w).alias("place"))


@registered("SELECT c_mktsegment AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment)::INT AS place FROM customer GROUP BY 1 HAVING count(*) > 0")
def O6_sorted_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters in the order of their counts, ties by value; the counters are few, their rows are not ranked."""
    n = read(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(W.orderBy(F.desc("n"), "value")))


@registered("SELECT (SELECT count(*) FROM (SELECT DISTINCT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_left, (SELECT count(*) FROM (SELECT DISTINCT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer)) AS only_right, (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)) AS in_both")
def T4_key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Whether two key sets are equal: they are if nothing is on one side only."""
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("k")).distinct().withColumn("a", F.lit(True))
    b = read(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct().withColumn("b", F.lit(True))
    return a.join(b, "k", "full").agg(F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a").isNull()).alias("only_right"), F.count_if(F.expr("a and b")).alias("in_both"))


def _rows(df: DataFrame, section: str) -> DataFrame:
    """One row of figures as (section, name, value) rows."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in df.columns])).alias("x")).select("x.*")


def _rows_sql(sql: str, section: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, '{c}' AS name, {c}::BIGINT AS value FROM ({sql})" for c in columns)


def _long(df: DataFrame, section: str, by: str, columns: list[str]) -> DataFrame:
    """Figures of several things as (section and thing, name, value) rows."""
    figures = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in columns]))
    return df.select(F.concat_ws(" ", F.lit(section), F.col(by).cast("string")).alias("section"), figures.alias("x")).select("section", "x.*")


def _long_sql(sql: str, section: str, by: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{section} ' || {by}, '{c}', {c}::BIGINT FROM ({sql})" for c in columns)


_DEDUP = ["raw_rows", "unique_keys", "usable_rows", "duplicate_groups", "exact_groups", "conflicting_groups", "excess_rows", "conflicting_rows"]
_META = ["ids", "duplicate_ids", "conflicting_ids", "anomalous_ids", "safe_ids"]
_COMPLETE = ["n_rows", "non_empty", "n_valid"]
_FILE = ["rows", "duplicate_rows", "duplicate_groups", "exact_groups", "conflicting_groups", "conflicting_matches", "numbers", "invalid_numbers", "negative_numbers", "matches", "orphan_ids", "charted_covered", "players"]
_RECONCILED = ["comparable", "exact", "marginal_exact"]
_SQL = registry._SQL
E7 = " UNION ALL ".join([
    _rows_sql(_SQL["A1_dedup_counts"], "points", _DEDUP), _rows_sql(_SQL["A2_metadata_dedup"], "metadata", _META), _rows_sql(_SQL["J1_orphans"], "orphans", ["orphan_rows", "orphan_ids"]),
    f"SELECT 'notation ' || field, name, n FROM ({_SQL['G3_notation_counters']}) WHERE kind IN ('validity', 'attribute', 'issue')",
    f"SELECT 'exposure', 'players', count(*) FROM ({_SQL['G5_exposure']}) UNION ALL SELECT 'exposure', 'matches', sum(matches)::BIGINT FROM ({_SQL['G5_exposure']})",
    f"SELECT 'values ' || dimension, value, n FROM ({_SQL['G28_match_values']})",
    _long_sql(_SQL["G2_field_completeness"], "fields", "field", _COMPLETE), f"SELECT 'coverage ' || dimension, value::VARCHAR, points FROM ({_SQL['G29_field_coverage']})",
    _long_sql(_SQL["G26_aggregate_files"], "aggregates", "file", _FILE), _long_sql(_SQL["G10_reconcile_overview"], "reconciliation", "metric", _RECONCILED),
])


@registered(E7)
def E7_snapshot_profile(spark: SparkSession, d: str) -> DataFrame:
    """The figures of a whole snapshot: duplicates, metadata, orphans, notation, exposure, match values, field completeness,
    coverage by season, tournament and player, aggregate files and reconciliation."""
    q = {k: (lambda f=f: f(spark, d)) for k, f in registry.queries().items()}
    notes = q["G3_notation_counters"]().where("kind in ('validity', 'attribute', 'issue')").select(F.concat_ws(" ", F.lit("notation"), "field").alias("section"), "name", F.col("n").alias("value"))
    exposed = q["G5_exposure"]().agg(F.count(F.lit(1)).alias("players"), F.sum("matches").alias("matches"))
    values = q["G28_match_values"]().select(F.concat_ws(" ", F.lit("values"), "dimension").alias("section"), F.col("value").alias("name"), F.col("n").alias("value"))
    covered = q["G29_field_coverage"]().select(F.concat_ws(" ", F.lit("coverage"), "dimension").alias("section"), F.col("value").cast("string").alias("name"), F.col("points").alias("value"))
    parts = [_rows(q["A1_dedup_counts"](), "points"), _rows(q["A2_metadata_dedup"](), "metadata"), _rows(q["J1_orphans"](), "orphans"), notes, _rows(exposed, "exposure"), values, covered]
    parts += [_long(q["G2_field_completeness"](), "fields", "field", _COMPLETE), _long(q["G26_aggregate_files"](), "aggregates", "file", _FILE), _long(q["G10_reconcile_overview"](), "reconciliation", "metric", _RECONCILED)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_ONE = sources.RAW.replace("FROM lineitem WHERE true", "FROM lineitem WHERE l_suppkey % 6 = 0")
_FIELDS = ["Pt", "Svr", "PtWinner", "Pts", "Gm1"]


@registered(f"WITH {_ONE}, {sources.GROUPS}, f AS (SELECT field, count(*) FILTER (v <> '') AS filled, count(*) FILTER (ok) AS valid FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS field, v, {ok} AS ok FROM (SELECT trim(\"{c}\") AS v FROM raw)" for c, ok in sources.VALID.items()) + ") GROUP BY 1) SELECT 'points' AS section, 'raw_rows' AS name, (SELECT count(*) FROM raw) AS value UNION ALL SELECT 'points', 'matches', (SELECT count(DISTINCT match_id) FROM raw) UNION ALL SELECT 'points', 'usable_rows', (SELECT count(*) FROM g WHERE kinds = 1) UNION ALL SELECT 'points', 'conflicting_groups', (SELECT count(*) FROM g WHERE kinds > 1) UNION ALL SELECT 'filled', field, filled FROM f UNION ALL SELECT 'valid', field, valid FROM f")
def E8_shard_profile(spark: SparkSession, d: str) -> DataFrame:
    """The figures of one shard, read from its file: rows, matches, duplicates, and what each field holds."""
    path = sources._shards(spark, d)[0]
    raw = sources.readers.read_csv(spark, path, sources.readers.POINTS).drop("source_file")
    values = [c for c in raw.columns if c not in ("match_id", "Pt")]
    c = integrity.conflict_counts(raw, ["match_id", "Pt"], values).select("raw_rows", "usable_rows", "conflicting_groups")
    filled = integrity.completeness(raw, {k: text.valid_value(k, F.col(k)) for k in _FIELDS})
    fields = filled.select("field", F.explode(F.array(F.struct(F.lit("filled").alias("section"), F.col("non_empty").alias("value")), F.struct(F.lit("valid").alias("section"), F.col("n_valid").alias("value")))).alias("x"))
    matches = raw.agg(F.count_distinct("match_id").alias("matches"))
    return _rows(c, "points").unionByName(_rows(matches, "points")).unionByName(fields.select("x.section", F.col("field").alias("name"), "x.value"))
