"""Registered queries: the operators on the driver's tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions import notation, stats, text
from pointweave.operators import integrity, resolve, selection, studies, summaries, windows

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

KEYS, COLORS = ["l_orderkey", "l_linenumber"], ["l_linestatus", "l_returnflag"]


def registered(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


#: The JVM interprets methods of more bytes of code than this for good; Spark's own limit is eight times as much.
COMPILED = ("spark.sql.codegen.hugeMethodLimit", "8000")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Wide stages (notation, scores, counters) fall back to generated code in methods that the JVM compiles,
    unless the session's builder set the limit."""
    if spark.sparkContext.getConf().get(COMPILED[0]) is None:
        spark.conf.set(*COMPILED)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def points(spark: SparkSession, d: str) -> DataFrame:
    """Line items as points: a supplier's month is a match, six cells are status by return flag."""
    day = F.col("l_shipdate")
    hit = (F.col("l_discount") > 0.05).cast("int")
    return read(spark, d, "lineitem").select("*", F.col("l_suppkey").alias("player"), F.year(day).cast("long").alias("season"), F.concat_ws("-", "l_suppkey", F.date_format(day, "yyyyMM")).alias("match_id"), (F.col("l_suppkey") % 2).alias("tour"), hit.alias("hit"))


POINTS = """WITH points AS (SELECT *, l_suppkey AS player, year(l_shipdate)::BIGINT AS season, l_suppkey || '-' || strftime(l_shipdate, '%Y%m') AS match_id,
  l_suppkey % 2 AS tour, (l_discount > 0.05)::INT AS hit FROM lineitem)"""
GROUPED = """g AS (SELECT l_orderkey, l_linenumber, count(*) AS copies, count(DISTINCT l_linestatus || '|' || l_returnflag) AS kinds,
  min(l_linestatus) AS l_linestatus, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL)"""
CELLS = [(s, f) for s in "FO" for f in "ANR"]


def cell_counts(df: DataFrame, *group: str) -> DataFrame:
    return df.groupBy(*group).agg(*[F.count_if((F.col("l_linestatus") == s) & (F.col("l_returnflag") == f)).alias(f"{s}{f}".lower()) for s, f in CELLS])


CELL_SQL = ", ".join(f"count(*) FILTER (l_linestatus = '{s}' AND l_returnflag = '{f}') AS \"{s.lower()}{f.lower()}\"" for s, f in CELLS)


def cell_profile(df: DataFrame, *keep: str) -> DataFrame:
    """Shares within each side; null where a side is empty."""
    out = [*keep]
    for s in "fo":
        total = F.col(f"{s}a") + F.col(f"{s}n") + F.col(f"{s}r")
        out += [summaries.share(F.col(f"{s}{k}"), total).alias(f"p_{s}{k}") for k in "anr"]
    return df.select(*out)


PROFILE_SQL = ", ".join(f'CASE WHEN "{s}a" + "{s}n" + "{s}r" > 0 THEN "{s}{k}" / ("{s}a" + "{s}n" + "{s}r")::DOUBLE END AS p_{s}{k}' for s in "fo" for k in "anr")
SIX = [f"p_{s}{k}" for s in "fo" for k in "anr"]


@registered(f"WITH {GROUPED} SELECT l_orderkey, l_linenumber, l_linestatus, l_returnflag FROM g WHERE kinds = 1")
def A1_dedup_conflict(spark: SparkSession, d: str) -> DataFrame:
    return integrity.collapse(read(spark, d, "lineitem"), KEYS, COLORS)


@registered(f"""WITH {GROUPED} SELECT sum(copies)::BIGINT AS raw_rows, count(*) AS unique_keys, count(*) FILTER (kinds = 1) AS usable_rows, count(*) FILTER (copies > 1) AS duplicate_groups,
count(*) FILTER (copies > 1 AND kinds = 1) AS exact_groups, count(*) FILTER (kinds > 1) AS conflicting_groups, sum(copies - 1)::BIGINT AS excess_rows, coalesce(sum(copies) FILTER (kinds > 1), 0)::BIGINT AS conflicting_rows FROM g""")
def A1_dedup_counts(spark: SparkSession, d: str) -> DataFrame:
    return integrity.conflict_counts(read(spark, d, "lineitem"), KEYS, COLORS)


@registered("SELECT l_orderkey, l_linenumber, sha256(l_orderkey || chr(0) || l_linenumber || chr(0) || l_linestatus || chr(0) || l_returnflag) AS signature FROM lineitem")
def A6_signature(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(*KEYS, integrity.signature([*KEYS, *COLORS]).alias("signature"))


@registered("""WITH r AS (SELECT l_orderkey, l_linenumber, l_linestatus, l_returnflag, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_linestatus, l_returnflag) AS t FROM lineitem)
SELECT a.l_orderkey, a.l_linenumber, concat_ws(',', CASE WHEN a.l_linestatus <> b.l_linestatus THEN 'l_linestatus' END, CASE WHEN a.l_returnflag <> b.l_returnflag THEN 'l_returnflag' END) AS differing
FROM r a JOIN r b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.t = 1 AND b.t = 2 WHERE a.l_linestatus <> b.l_linestatus OR a.l_returnflag <> b.l_returnflag""")
def A7_conflict_diff(spark: SparkSession, d: str) -> DataFrame:
    return integrity.conflict_diff(read(spark, d, "lineitem"), KEYS, COLORS)


@registered("""SELECT o_custkey, bool_or(o_orderstatus = 'P') AS pending, bool_or(o_totalprice < 20000) AS cheap, NOT (bool_or(o_orderstatus = 'P') OR bool_or(o_totalprice < 20000)) AS safe FROM orders GROUP BY 1""")
def F2_anomaly_poison(spark: SparkSession, d: str) -> DataFrame:
    return integrity.poison(read(spark, d, "orders"), "o_custkey", {"pending": F.col("o_orderstatus") == "P", "cheap": F.col("o_totalprice") < 20000})


@registered("""WITH a AS (SELECT doc_id, quality, toxic FROM labels), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END AS quality, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE toxic END AS toxic FROM labels WHERE doc_id % 11 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'removed' ELSE concat_ws(',', CASE WHEN a.quality <> b.quality THEN 'quality' END, CASE WHEN a.toxic <> b.toxic THEN 'toxic' END) END AS change
FROM a FULL JOIN b ON a.doc_id = b.doc_id WHERE b.doc_id IS NULL OR a.quality <> b.quality OR a.toxic <> b.toxic""")
def F14_evidence_diff(spark: SparkSession, d: str) -> DataFrame:
    a = read(spark, d, "labels")
    b = a.where("doc_id % 11 <> 0").select("doc_id", F.expr("if(doc_id % 7 = 0, 1 - quality, quality)").alias("quality"), F.expr("if(doc_id % 5 = 0, 1, toxic)").alias("toxic"))
    return integrity.evidence_changes(a, b, "doc_id", ["quality", "toxic"])


@registered(f"{POINTS} SELECT player, season, {CELL_SQL}, sum(hit)::BIGINT AS hits, count(*) AS n FROM points GROUP BY 1, 2")
def G1_additive_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    return cell_counts(p, "player", "season").join(p.groupBy("player", "season").agg(F.sum("hit").alias("hits"), F.count(F.lit(1)).alias("n")), ["player", "season"])


@registered("""SELECT field, count(*) AS n_rows, count(*) FILTER (trim(v) <> '') AS non_empty, count(*) FILTER (ok) AS n_valid FROM (
SELECT 'c_name' AS field, c_name AS v, c_name <> '' AS ok FROM customer UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, c_nationkey BETWEEN 0 AND 9 FROM customer
UNION ALL SELECT 'c_mktsegment', c_mktsegment, c_mktsegment IN ('BUILDING', 'MACHINERY') FROM customer) GROUP BY 1""")
def G2_field_completeness(spark: SparkSession, d: str) -> DataFrame:
    return integrity.completeness(read(spark, d, "customer"), {"c_name": F.col("c_name") != "", "c_nationkey": F.col("c_nationkey").between(0, 9), "c_mktsegment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY")})


@registered(f"""{POINTS}, e AS (SELECT 'all' AS dimension, '' AS value, * FROM points UNION ALL SELECT 'tour', tour::VARCHAR, * FROM points UNION ALL SELECT 'season', season::VARCHAR, * FROM points)
SELECT dimension, value, count(*) FILTER (l_quantity > 10) AS eligible, count(*) FILTER (l_quantity > 10 AND hit = 1) AS known, round(count(*) FILTER (l_quantity > 10 AND hit = 1) / nullif(count(*) FILTER (l_quantity > 10), 0)::DOUBLE, 6) AS share FROM e GROUP BY 1, 2""")
def G4_coverage_sets(spark: SparkSession, d: str) -> DataFrame:
    return summaries.coverage(points(spark, d), ["tour", "season"], F.col("l_quantity") > 10, F.col("hit") == 1)


@registered(f"{POINTS} SELECT player, count(DISTINCT match_id) AS matches, count(*) AS n_points, count(DISTINCT l_partkey) AS opponents, count(DISTINCT season) AS seasons FROM points GROUP BY 1")
def G5_exposure(spark: SparkSession, d: str) -> DataFrame:
    c = F.count_distinct
    return points(spark, d).groupBy("player").agg(c("match_id").alias("matches"), F.count(F.lit(1)).alias("n_points"), c("l_partkey").alias("opponents"), c("season").alias("seasons"))


RANK = "list_sort(v)[round_even({p} * (len(v) - 1), 0)::INT + 1]"


@registered("WITH g AS (SELECT c_nationkey, list(c_acctbal) AS v FROM customer GROUP BY 1) SELECT c_nationkey, " + ", ".join(f"{RANK.format(p=p)} AS {n}" for n, p in (("least", 0.0), ("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("most", 1.0))) + " FROM g")
def G6_five_number(spark: SparkSession, d: str) -> DataFrame:
    return summaries.five_number(read(spark, d, "customer"), ["c_nationkey"], "c_acctbal")


@registered("WITH g AS (SELECT c_nationkey, list(c_acctbal) AS v, median(c_acctbal) AS m FROM customer GROUP BY 1) SELECT c_nationkey, " + RANK.format(p=0.25) + " AS p25, round(m, 6) AS middle, " + RANK.format(p=0.75) + " AS p75, list_sort(v)[(len(v) // 2 + 1)::INT] AS upper_median FROM g")
def G7_quantiles(spark: SparkSession, d: str) -> DataFrame:
    told = selection.order_statistics(read(spark, d, "customer"), ["c_nationkey"], "c_acctbal", selection.FIVE)
    return told.select("c_nationkey", "p25", r6(selection.middle()).alias("middle"), "p75", F.col("high").alias("upper_median"))


@registered("""WITH c AS (SELECT l_orderkey AS k, count(*) AS n_lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1), p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 4 END AS n_lines, floor(o_totalprice / 1000) AS quantity FROM orders),
r AS (SELECT 'n_lines' AS metric, c.n_lines::DOUBLE AS a, p.n_lines::DOUBLE AS b FROM c JOIN p USING (k) UNION ALL SELECT 'quantity', c.quantity, p.quantity FROM c JOIN p USING (k))
SELECT metric, count(*) AS comparable, count(*) FILTER (a = b) AS exact, round(avg((a = b)::INT), 6) AS rate, round(avg(abs(a - b)), 6) AS mae FROM r WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1""")
def G10_reconcile(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("quantity"))
    p = read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.expr("if(o_orderkey % 5 = 0, 4, null)").alias("n_lines"), F.floor(F.col("o_totalprice") / 1000).alias("quantity"))
    return summaries.reconcile(c, p, ["k"], ["n_lines", "quantity"])


@registered(f"{POINTS}, c AS (SELECT player, {CELL_SQL} FROM points GROUP BY 1), p AS (SELECT player, {PROFILE_SQL} FROM c) SELECT player, " + ", ".join(f"round({c}, 6) AS {c}" for c in SIX) + " FROM p")
def G16_profiles(spark: SparkSession, d: str) -> DataFrame:
    return cell_profile(cell_counts(points(spark, d), "player"), "player").select("player", *[r6(F.col(c)).alias(c) for c in SIX])


@registered(f"{POINTS}, m AS (SELECT player, match_id, avg(hit) AS a FROM points GROUP BY 1, 2) SELECT player, round(avg(a), 6) AS match_mean FROM m GROUP BY 1")
def G18_match_average(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy("player", "match_id").agg(F.avg("hit").alias("a")).groupBy("player").agg(r6(F.avg("a")).alias("match_mean"))


@registered(f"""{POINTS}, m AS (SELECT player, match_id, count(*) AS n FROM points GROUP BY 1, 2), x AS (SELECT player, count(DISTINCT season) AS n_season, count(DISTINCT l_returnflag) AS n_l_returnflag FROM points GROUP BY 1)
SELECT player, count(*) AS clusters, any_value(n_season) AS n_season, any_value(n_l_returnflag) AS n_l_returnflag, round(max(n) / sum(n)::DOUBLE, 6) AS largest_share, round(sum(n)::DOUBLE * sum(n) / sum(n * n), 6) AS effective FROM m JOIN x USING (player) GROUP BY 1""")
def G19_diversity(spark: SparkSession, d: str) -> DataFrame:
    return summaries.diversity(points(spark, d).withColumn("one", F.lit(1)), ["player"], "match_id", "one", ["season", "l_returnflag"])


@registered(f"""{POINTS}, c AS (SELECT player, match_id, {CELL_SQL} FROM points GROUP BY 1, 2), s AS (SELECT player % 2 AS tour, (fa + fn + fr > 0) AS f, (oa + "on" + "or" > 0) AS o FROM c)
SELECT tour, count(*) FILTER (f AND o) AS both_sides, count(*) FILTER (f <> o) AS one_side, count(*) FILTER (NOT f AND NOT o) AS no_side FROM s GROUP BY GROUPING SETS ((tour), ())""")
def G21_side_audit(spark: SparkSession, d: str) -> DataFrame:
    c = cell_counts(points(spark, d), "player", "match_id").select((F.col("player") % 2).alias("tour"), (F.expr("fa + fn + fr") > 0).alias("f"), (F.expr("oa + `on` + `or`") > 0).alias("o"))
    return c.rollup("tour").agg(F.count_if(F.col("f") & F.col("o")).alias("both_sides"), F.count_if(F.col("f") != F.col("o")).alias("one_side"), F.count_if(~F.col("f") & ~F.col("o")).alias("no_side"))


@registered(f"""{POINTS}, b AS (SELECT least(floor(l_tax * 12 * 10), 9)::INT AS bin, l_tax * 12 AS p, hit FROM points), s AS (SELECT bin, count(*) AS n, avg(p) AS mp, avg(hit) AS my FROM b GROUP BY 1)
SELECT sum(n)::BIGINT AS n, round(sum(n * abs(mp - my)) / sum(n), 6) AS error FROM s""")
def G24_calibration(spark: SparkSession, d: str) -> DataFrame:
    return summaries.calibration_error(points(spark, d).select((F.col("l_tax") * 12).alias("p"), "hit"), "p", "hit")


@registered("SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'")
def J1_inner(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return read(spark, d, "lineitem").select(*KEYS).join(o, "l_orderkey")


@registered("SELECT count(*) AS orphan_rows, count(DISTINCT l_orderkey) AS orphan_ids FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def J1_orphans(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, d, "lineitem").select("l_orderkey").join(o, "l_orderkey", "left_anti").agg(F.count(F.lit(1)).alias("orphan_rows"), F.count_distinct("l_orderkey").alias("orphan_ids"))


def _resolved(spark: SparkSession, d: str, before: int = 7, after: int = 20) -> DataFrame:
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    left, right = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1")
    priority, status = F.col("o_orderpriority") == F.col("c_o_orderpriority"), F.col("o_orderstatus") == F.col("c_o_orderstatus")
    return resolve.resolve(left, right, ["o_custkey"], "o_orderkey", "o_orderkey", "o_orderdate", "o_orderdate", priority | status, priority & status, before, after)


RESOLVED = """WITH l AS (SELECT * FROM orders WHERE o_orderkey % 2 = 0), r AS (SELECT * FROM orders WHERE o_orderkey % 2 = 1),
j AS (SELECT l.o_orderkey, r.o_orderkey AS c, r.o_orderkey IS NOT NULL AND date_diff('day', r.o_orderdate::DATE, l.o_orderdate::DATE) BETWEEN -{before} AND {after} AS inside,
  l.o_orderpriority = r.o_orderpriority AS p, l.o_orderstatus = r.o_orderstatus AS s FROM l LEFT JOIN r ON l.o_custkey = r.o_custkey),
g AS (SELECT o_orderkey, count(c) AS pairs, count(*) FILTER (inside) AS n, count(*) FILTER (inside AND (p OR s)) AS n_ok, count(*) FILTER (inside AND p AND s) AS n_same,
  coalesce(string_agg(c::VARCHAR, ',' ORDER BY c), '') AS every, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (inside) AS near, min(c) FILTER (inside) AS first, max(c) FILTER (inside AND p AND s) AS same_id FROM j GROUP BY 1),
resolved AS (SELECT o_orderkey, CASE WHEN pairs = 0 THEN 'unresolved_pair' WHEN n = 0 THEN 'unresolved_date_window' WHEN n = 1 AND n_ok = 0 THEN 'conflicting_context' WHEN n = 1 OR n_same = 1 THEN 'matched' ELSE 'ambiguous' END AS status,
  CASE WHEN n = 1 THEN 'exact_pair_date_unique' WHEN n > 1 AND n_same = 1 THEN 'exact_pair_date_tournament_round_unique' END AS method, n AS candidate_count, CASE WHEN n = 0 THEN every ELSE near END AS candidates,
  CASE WHEN n = 1 AND n_ok = 1 THEN first WHEN n > 1 AND n_same = 1 THEN same_id END AS target FROM g)"""


@registered(RESOLVED.format(before=7, after=20) + " SELECT * FROM resolved")
def J4_resolution(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d)


@registered(RESOLVED.format(before=7, after=20) + " SELECT o_orderkey, target FROM resolved WHERE status = 'matched' QUALIFY count(*) OVER (PARTITION BY target) = 1")
def J6_collision_free(spark: SparkSession, d: str) -> DataFrame:
    return resolve.collision_free(_resolved(spark, d), "o_orderkey")


@registered(RESOLVED.format(before=7, after=20) + ", x AS (SELECT *, count(*) FILTER (status = 'matched') OVER (PARTITION BY target) AS k FROM resolved) SELECT CASE WHEN status = 'matched' AND k > 1 THEN 'canonical_collision' ELSE status END AS status, count(*) AS n FROM x GROUP BY 1")
def G13_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return resolve.with_collisions(_resolved(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@registered("SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(DISTINCT s_suppkey) > 4)")
def J8_id_collision_anti(spark: SparkSession, d: str) -> DataFrame:
    many = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count_distinct("s_suppkey").alias("n")).where("n > 4")
    return read(spark, d, "customer").select("c_custkey", "c_nationkey").join(many, "c_nationkey", "left_anti")


def _halves(spark: SparkSession, d: str, alternating: bool = False) -> DataFrame:
    m = cell_counts(points(spark, d), "player", "match_id").withColumn("month", F.substring("match_id", -6, 6))
    return windows.split_halves(m, ["player"], ["month", "match_id"], alternating)


@registered(None)
def W1_chronological_split(spark: SparkSession, d: str) -> DataFrame:
    return _halves(spark, d).groupBy("player", "half").agg(F.count(F.lit(1)).alias("matches"), F.max("month").alias("latest"))


@registered(None)
def W2_alternating_split(spark: SparkSession, d: str) -> DataFrame:
    return _halves(spark, d, True).groupBy("player", "half").agg(F.count(F.lit(1)).alias("matches"), F.max("month").alias("latest"))


SPLIT = f"""{POINTS}, m AS (SELECT DISTINCT player, match_id, right(match_id, 6) AS month FROM points), h AS (SELECT player, month, CASE WHEN {{cond}} THEN 'left' ELSE 'right' END AS half FROM (
SELECT *, row_number() OVER (PARTITION BY player ORDER BY month, match_id) AS rn, count(*) OVER (PARTITION BY player) AS n FROM m)) SELECT player, half, count(*) AS matches, max(month) AS latest FROM h GROUP BY 1, 2"""
_SQL["W1_chronological_split"] = SPLIT.format(cond="rn <= n // 2")
_SQL["W2_alternating_split"] = SPLIT.format(cond="rn % 2 = 1")


def _half_profiles(spark: SparkSession, d: str) -> DataFrame:
    h = _halves(spark, d)
    sums = h.groupBy("player", "half").agg(*[F.sum(f"`{s}{k}`").alias(f"{s}{k}") for s in "fo" for k in "anr"])
    return cell_profile(sums, "player", "half")


STABLE = f"""{POINTS}, m AS (SELECT DISTINCT player, match_id, right(match_id, 6) AS month FROM points), h AS (SELECT player, match_id, CASE WHEN rn <= n // 2 THEN 'left' ELSE 'right' END AS half FROM (
SELECT *, row_number() OVER (PARTITION BY player ORDER BY month, match_id) AS rn, count(*) OVER (PARTITION BY player) AS n FROM m)),
c AS (SELECT player, half, l_linestatus AS s, l_returnflag AS f, count(*) AS k FROM points JOIN h USING (player, match_id) GROUP BY ALL),
v AS (SELECT player, half, s, f, k / sum(k) OVER (PARTITION BY player, half, s)::DOUBLE AS p FROM c),
w AS (SELECT player, half, {", ".join(f"coalesce(max(p) FILTER (s = '{s}' AND f = '{f}'), 0) AS p_{s.lower()}{f.lower()}" for s, f in CELLS)}, count(DISTINCT s) AS sides FROM v GROUP BY 1, 2)"""


@registered(STABLE + " SELECT l.player, round((" + " + ".join(f"abs(l.{c} - r.{c})" for c in SIX) + ") / 6, 6) AS mean_absolute, round((" + " + ".join(f"abs(l.{c} - r.{c})" for c in SIX) + ") / 4, 6) AS total_variation FROM w l JOIN w r ON l.player = r.player AND l.half = 'left' AND r.half = 'right' WHERE l.sides = 2 AND r.sides = 2")
def M7_M8_distance(spark: SparkSession, d: str) -> DataFrame:
    p = _half_profiles(spark, d)
    left, right = p.where("half = 'left'").drop("half"), p.where("half = 'right'").select("player", *[F.col(c).alias(f"r_{c}") for c in SIX])
    a, b = [F.col(c) for c in SIX], [F.col(f"r_{c}") for c in SIX]
    both = left.join(right, "player").select("player", r6(stats.mean_absolute(a, b)).alias("mean_absolute"), r6(stats.total_variation(a, b)).alias("total_variation"))
    return both.where("mean_absolute is not null")


@registered(f"{POINTS}, k AS (SELECT DISTINCT player, l_partkey % 3 AS k, season FROM points) SELECT a.season AS train, count(*) AS n FROM k a JOIN k b ON a.player = b.player AND a.k = b.k AND b.season = a.season + 1 JOIN k c ON a.player = c.player AND a.k = c.k AND c.season = a.season + 2 GROUP BY 1")
def J10_triple_semi(spark: SparkSession, d: str) -> DataFrame:
    """Keys of each season that the next two have, too: train, validation and test."""
    k = points(spark, d).select("player", (F.col("l_partkey") % 3).alias("k"), F.col("season").alias("train")).distinct()
    later = lambda n: k.withColumn("train", F.col("train") - n)
    on = ["player", "k", "train"]
    return k.join(later(1), on, "left_semi").join(later(2), on, "left_semi").groupBy("train").agg(F.count(F.lit(1)).alias("n"))


@registered(f"{POINTS}, y AS (SELECT unnest(range(1900, 2100)) AS y), b AS (SELECT min(season) AS lo, max(season) AS hi FROM points) SELECT y AS as_of, player, count(*) AS n, sum(hit)::BIGINT AS hits, count(DISTINCT match_id) AS matches FROM points, y, b WHERE y BETWEEN lo + 3 AND hi AND season >= y - 3 AND season < y GROUP BY 1, 2")
def J12_fold_expand(spark: SparkSession, d: str) -> DataFrame:
    """Histories of three seasons before every season that has so many before it."""
    p = points(spark, d)
    low, high = studies.years(p)
    yearly = p.groupBy("player", "season").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    f = windows.fold_rows(yearly, "season", low + 3, high, 3).groupBy("as_of", "player").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    matches = windows.rolling_distinct(p, ["player"], "season", "match_id", low + 3, high, 3)
    return f.join(matches.select("as_of", "player", F.col("n").cast("long").alias("matches")), ["as_of", "player"])


@registered(f"{POINTS}, m AS (SELECT season, tour, player, sum(hit)::BIGINT AS s, count(*) AS t FROM points GROUP BY ALL) SELECT season, tour, player, (sum(s) OVER w - s)::BIGINT AS other_s, (sum(t) OVER w - t)::BIGINT AS other_t FROM m WINDOW w AS (PARTITION BY season, tour)")
def J13_leave_one_out(spark: SparkSession, d: str) -> DataFrame:
    return summaries.leave_one_out(points(spark, d).withColumn("one", F.lit(1)), ["season", "tour"], "player", "hit", "one")


@registered(f"{POINTS}, y AS (SELECT player, season, sum(hit) AS s, count(*) AS t FROM points GROUP BY ALL) SELECT player, season, coalesce(sum(s) OVER w, 0)::BIGINT AS past_hits, coalesce(sum(t) OVER w, 0)::BIGINT AS past FROM y WINDOW w AS (PARTITION BY player ORDER BY season RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def W4_rolling_history(spark: SparkSession, d: str) -> DataFrame:
    y = points(spark, d).groupBy("player", "season").agg(F.sum("hit").alias("s"), F.count(F.lit(1)).alias("t"))
    w = W.partitionBy("player").orderBy("season").rangeBetween(-5, -1)
    return y.select("player", "season", F.coalesce(F.sum("s").over(w), F.lit(0)).alias("past_hits"), F.coalesce(F.sum("t").over(w), F.lit(0)).alias("past"))


@registered("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def O1_topk(spark: SparkSession, d: str) -> DataFrame:
    return windows.top_k(read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")), "n", "l_partkey", 20)


@registered("SELECT o_orderkey FROM orders ORDER BY sha256(o_orderkey::VARCHAR), o_orderkey LIMIT 25")
def O2_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return windows.hash_sample(read(spark, d, "orders").select("o_orderkey"), "o_orderkey", 25)


@registered("SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)::INT AS turn FROM orders ORDER BY turn, o_orderpriority LIMIT 25")
def O3_round_robin(spark: SparkSession, d: str) -> DataFrame:
    return windows.round_robin(read(spark, d, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", 25)


@registered("SELECT l_suppkey, min(l_discount) AS l_discount, arg_min(l_linenumber, (l_discount, l_linenumber)) AS l_linenumber FROM lineitem GROUP BY 1")
def O5_argmin(spark: SparkSession, d: str) -> DataFrame:
    return windows.argmin(read(spark, d, "lineitem"), ["l_suppkey"], "l_discount", "l_linenumber")


@registered("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def T1_intersect(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).intersect(read(spark, d, "supplier").select("s_nationkey"))


@registered("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def T2_except(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@registered("SELECT c_nationkey AS k, 'c' AS side FROM customer UNION SELECT s_nationkey, 's' FROM supplier")
def T3_union(spark: SparkSession, d: str) -> DataFrame:
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    return c.select(F.col("c_nationkey").alias("k"), F.lit("c").alias("side")).unionByName(s.select(F.col("s_nationkey").alias("k"), F.lit("s").alias("side"))).distinct()


@registered("SELECT DISTINCT text AS name, trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS identity FROM documents")
def P2_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Names are normalised once each and joined back by the caller."""
    names = read(spark, d, "documents").select(F.col("text").alias("name")).distinct()
    return names.select("name", text.normalise_identity(F.col("name")).alias("identity"))


@registered("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE (c_custkey % 300 + 1)::INT END AS rank, CASE WHEN c_custkey % 10 = 0 THEN 'missing' WHEN c_custkey % 300 + 1 <= 10 THEN '1-10' WHEN c_custkey % 300 + 1 <= 25 THEN '11-25' WHEN c_custkey % 300 + 1 <= 50 THEN '26-50' WHEN c_custkey % 300 + 1 <= 100 THEN '51-100' WHEN c_custkey % 300 + 1 <= 200 THEN '101-200' ELSE '201+' END AS band FROM customer")
def P8_P9_rank_band(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("c_custkey") % 10 == 0, "NR").otherwise(F.concat((F.col("c_custkey") % 300 + 1).cast("string"), F.lit(".0")))
    rank = text.parse_rank(raw)
    return read(spark, d, "customer").select("c_custkey", rank.alias("rank"), text.rank_band(rank).alias("band"))


@registered("""WITH l AS (SELECT l_orderkey, l_linenumber, ['0', '15', '30', '40', 'AD'][(l_partkey % 5 + 1)::INT] AS a, ['0', '15', '30', '40', 'AD', '7'][(l_suppkey % 6 + 1)::INT] AS b FROM lineitem),
t AS (SELECT *, CASE WHEN b <> '7' THEN list_position(['0', '15', '30', '40', 'AD'], a) + list_position(['0', '15', '30', '40', 'AD'], b) WHEN a <> 'AD' THEN a::BIGINT + 7 END AS n FROM l)
SELECT l_orderkey, l_linenumber, a || '-' || b AS label, CASE n % 2 WHEN 0 THEN 'deuce' WHEN 1 THEN 'ad' END AS side FROM t""")
def P11_court_side(spark: SparkSession, d: str) -> DataFrame:
    own, other = (F.element_at(F.array(*map(F.lit, names)), (F.col(c) % len(names) + 1).cast("int")) for names, c in ((text.LABELS, "l_partkey"), ((*text.LABELS, "7"), "l_suppkey")))
    label = F.concat_ws("-", own, other)
    return read(spark, d, "lineitem").select(*KEYS, label.alias("label"), text.court_side(label).alias("side"))


#: Notation cells from integer columns, the same text in both engines: (alphabet, column, divisor) each.
PARTS = (("cc", "l_orderkey", 7), ("0456", "l_partkey", 1), ("+++", "l_orderkey", 5), ("fbsrn*#d", "l_suppkey", 1), ("+-1230", "l_partkey", 3), ("0789+", "l_suppkey", 3), ("fbzn@#*C", "l_orderkey", 11), ("+12", "l_partkey", 7), ("nwd@*#C", "l_suppkey", 7), ("@*", "l_orderkey", 13))
CELL = "concat(" + ", ".join(f"substr('{a}', cast(floor({c} / {k}) as int) % {2 * len(a) if i in (0, 2, 9) else len(a)} + 1, 1)" for i, (a, c, k) in enumerate(PARTS)) + ")"


def _notation_sql() -> str:
    n = notation
    rest = f"regexp_replace(cell, '{n.HEAD}', '')"
    return f"""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, {CELL} AS cell FROM lineitem), a AS (SELECT *, regexp_matches(cell, '{n.HEAD}') AS served, {rest} AS rest FROM c),
b AS (SELECT *, regexp_matches(rest, '^[{n.FAULTS}]') AS isf, regexp_matches(rest, '^[*#]') AS ise, regexp_extract(rest, '{n.RALLY}') AS prefix FROM a),
d AS (SELECT *, served AND NOT isf AND NOT ise AND rest <> '' AS rally, regexp_extract_all(prefix, '[{n.TYPES}][^{n.TYPES}]*') AS found, substr(rest, length(prefix) + 1) AS tail FROM b),
e AS (SELECT *, CASE WHEN rally THEN coalesce(list_position(list_transform(found, lambda s: regexp_matches(s, '{n.TWICE}')), true), 0) END AS doubled FROM d),
f AS (SELECT *, CASE WHEN rally AND doubled = 0 AND prefix <> '' THEN regexp_extract(tail, '^{n.ENDING}') END AS ending FROM e),
g AS (SELECT *, CASE WHEN NOT served THEN 'expected_serve_direction' WHEN isf AND length(rest) > 1 THEN 'trailing_after_serve_fault' WHEN ise AND length(rest) > 1 THEN 'trailing_after_serve_outcome' WHEN NOT rally THEN NULL
  WHEN doubled > 0 THEN 'duplicate_modifier' WHEN ending <> '' AND length(tail) > length(ending) THEN 'trailing_after_rally_outcome' WHEN ending <> '' THEN NULL WHEN length(tail) > 0 THEN 'expected_shot_type' ELSE 'missing_point_ending' END AS issue FROM f)
SELECT cell, count(*) AS n, any_value(issue IS NULL) AS valid, any_value(CASE WHEN served THEN regexp_extract(cell, '{n.HEAD}', 2) END) AS direction, any_value((CASE WHEN NOT rally THEN 0 WHEN doubled > 0 THEN doubled - 1 ELSE len(found) END)::INT) AS shots,
any_value(CASE WHEN NOT served THEN NULL WHEN isf THEN 'serve_fault' WHEN starts_with(rest, '*') THEN 'ace' WHEN starts_with(rest, '#') THEN 'unreturnable' WHEN rest = '' THEN 'incomplete' ELSE CASE right(ending, 1) WHEN '*' THEN 'winner' WHEN '@' THEN 'unforced_error' WHEN '#' THEN 'forced_error' WHEN 'C' THEN 'incorrect_challenge' END END) AS outcome,
any_value(issue) AS issue FROM g GROUP BY cell"""


@registered(_notation_sql())
def P12_notation(spark: SparkSession, d: str) -> DataFrame:
    cells = read(spark, d, "lineitem").select(F.expr(CELL).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    parsed = cells.select("cell", "n", notation.parse_notation(F.col("cell")).alias("p"))
    return parsed.select("cell", "n", *[F.col(f"p.{k}").alias(k) for k in ("valid", "direction", "shots", "outcome", "issue")])


@registered("SELECT event_id, user_id, props->>'$.k' IS NOT NULL AS parsed, TRY_CAST(props->>'$.k' AS INT) AS k FROM events")
def P15_json_key(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return read(spark, d, "events").select("event_id", "user_id", k.isNotNull().alias("parsed"), k.try_cast("int").alias("k"))


@registered("""SELECT a::INT AS a, b::INT AS b, CASE WHEN a >= 3 AND b >= 3 THEN CASE WHEN a = b THEN '40-40' WHEN a > b THEN 'AD-40' ELSE '40-AD' END ELSE ['0', '15', '30', '40'][least(a, 3)::INT + 1] || '-' || ['0', '15', '30', '40'][least(b, 3)::INT + 1] END AS label, count(*) AS n
FROM (SELECT l_partkey % 6 AS a, l_suppkey % 6 AS b FROM lineitem) GROUP BY 1, 2, 3""")
def P20_score_label(spark: SparkSession, d: str) -> DataFrame:
    ab = read(spark, d, "lineitem").select((F.col("l_partkey") % 6).cast("int").alias("a"), (F.col("l_suppkey") % 6).cast("int").alias("b"))
    return ab.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).select("a", "b", text.point_label(F.col("a"), F.col("b")).alias("label"), "n")


HITS = f"{POINTS}, h AS (SELECT player, sum(hit) AS s, count(*) AS n FROM points GROUP BY 1)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return points(spark, d).groupBy("player").agg(F.sum("hit").alias("s"), F.count(F.lit(1)).alias("n"))


@registered(HITS + ", x AS (SELECT player, s + 0.4 * 25 + 0.5 AS a, n - s + 0.6 * 25 + 0.5 AS b FROM h) SELECT player, round(a / (a + b), 6) AS mean, round(sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS sd FROM x")
def M1_beta(spark: SparkSession, d: str) -> DataFrame:
    p = stats.beta_posterior(F.col("s"), F.col("n"), F.lit(0.4), 25)
    return _hits(spark, d).select("player", r6(p["mean"]).alias("mean"), r6(p["sd"]).alias("sd"))


@registered(f"{POINTS}, h AS (SELECT player, count(*) FILTER (l_returnflag = 'A') + 8.5 AS a, count(*) FILTER (l_returnflag = 'N') + 8.5 AS b, count(*) FILTER (l_returnflag = 'R') + 8.5 AS c FROM points GROUP BY 1) SELECT player, " + ", ".join(f"round({k} / (a + b + c), 6) AS mean_{k}, round(sqrt({k} * (a + b + c - {k}) / ((a + b + c) * (a + b + c) * (a + b + c + 1))), 6) AS sd_{k}" for k in "abc") + " FROM h")
def M2_dirichlet(spark: SparkSession, d: str) -> DataFrame:
    c = points(spark, d).groupBy("player").agg(*[F.count_if(F.col("l_returnflag") == f).alias(f.lower() + "_n") for f in "ANR"])
    post = stats.dirichlet_posterior([F.col("a_n"), F.col("n_n"), F.col("r_n")], [F.lit(1 / 3)] * 3, 24)
    return c.select("player", *[r6(p[m]).alias(f"{m}_{k}") for k, p in zip("abc", post, strict=True) for m in ("mean", "sd")])


@registered(HITS + " SELECT player, round(-(s / n::DOUBLE * ln(0.45) + (n - s) / n::DOUBLE * ln(0.55)), 6) AS log_loss, round((s / n::DOUBLE - 0.45) * (s / n::DOUBLE - 0.45), 6) AS brier FROM h")
def M5_M6_losses(spark: SparkSession, d: str) -> DataFrame:
    rates, p = [F.col("s") / F.col("n"), (F.col("n") - F.col("s")) / F.col("n")], [F.lit(0.45), F.lit(0.55)]
    return _hits(spark, d).select("player", r6(stats.cross_entropy(rates, p)).alias("log_loss"), r6(stats.brier(rates, p)).alias("brier"))


@registered(f"{POINTS}, m AS (SELECT player, match_id, sum(hit)::DOUBLE AS c, count(*)::DOUBLE AS t FROM points GROUP BY 1, 2), g AS (SELECT player, count(*) AS m, sum(c) AS sc, sum(t) AS st FROM m GROUP BY 1) SELECT player, any_value(g.m) AS matches, round(sqrt(any_value(g.m) / (any_value(g.m) - 1.0) * sum((c - sc / st * t) * (c - sc / st * t)) / (any_value(st) * any_value(st))), 6) AS se FROM m JOIN g USING (player) GROUP BY 1 HAVING any_value(g.m) > 1")
def M9_cluster_se(spark: SparkSession, d: str) -> DataFrame:
    """From residuals about each player's rate, so that nothing cancels."""
    m = points(spark, d).groupBy("player", "match_id").agg(F.sum("hit").alias("c1"), F.count(F.lit(1)).alias("t"))
    rows = m.select("player", "match_id", "c1", (F.col("t") - F.col("c1")).alias("c2"), F.lit(0).cast("long").alias("c3"), F.lit(2).alias("k"), F.lit("hit").alias("target"), F.lit("").alias("side"))
    return studies.component_estimates(studies.partials(rows, ["player"]), ["player"]).where("matches > 1").select("player", "matches", r6(F.col("se")).alias("se"))


Z = "1.959963984540054"


@registered(HITS + f", x AS (SELECT player, s / n::DOUBLE AS p, n, {Z} * {Z} AS z2 FROM h) SELECT player, round((p + z2 / (2 * n) - {Z} * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n)) ) / (1 + z2 / n), 6) AS low, round((p + z2 / (2 * n) + {Z} * sqrt(p * (1 - p) / n + z2 / (4.0 * n * n))) / (1 + z2 / n), 6) AS high FROM x")
def M12_wilson(spark: SparkSession, d: str) -> DataFrame:
    w = stats.wilson(F.col("s"), F.col("n"))
    return _hits(spark, d).select("player", r6(w["low"]).alias("low"), r6(w["high"]).alias("high"))


@registered("SELECT c_nationkey, list_sort(list(c_acctbal))[least(count(*), ceil(0.95 * (count(*) + 1)))::INT] AS q95 FROM customer GROUP BY 1")
def M14_finite_quantile(spark: SparkSession, d: str) -> DataFrame:
    return selection.order_statistics(read(spark, d, "customer"), ["c_nationkey"], "c_acctbal", {"q95": selection.finite(0.95)}).drop("n")


@registered("""WITH s AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS prev, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, CASE WHEN rn = 1 AND event_type = 'purchase' THEN 'start' WHEN rn > 1 AND event_type = prev THEN 'repeat' WHEN rn > 1 AND event_type = 'purchase' AND prev <> 'click' THEN 'jump' END AS code FROM s)
SELECT user_id, count(*) AS points, coalesce(arg_min(code, event_id) FILTER (code IS NOT NULL), 'ok') AS verdict, min(event_id) FILTER (code IS NOT NULL) AS failed_at FROM b GROUP BY 1""")
def W3_lag_validation(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "events").select("user_id", "event_id", "event_type")
    kind, prev = F.col("event_type"), F.col("prev_event_type")
    return windows.first_failures(s, "user_id", "event_id", {"repeat": kind == prev, "jump": (kind == "purchase") & (prev != "click")}, {"start": kind == "purchase"})


@registered("WITH h AS (SELECT md5(p_partkey || '|' || p_name) AS h FROM part), n AS (SELECT ('0x' || substr(h, 1, 8))::BIGINT AS a, ('0x' || substr(h, 9, 8))::BIGINT AS b FROM h) SELECT count(*) AS rows, sum(a)::BIGINT AS sum_a, sum(b)::BIGINT AS sum_b, bit_xor(a) AS xor_a, bit_xor(b) AS xor_b FROM n")
def S12_table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Of a table's rows in any order: sums and parities of row hashes, combined before anything is shuffled."""
    h = F.md5(F.concat_ws("|", "p_partkey", "p_name"))
    part = lambda at: F.conv(F.substring(h, at, 8), 16, 10).cast("long")
    n = read(spark, d, "part").select(part(1).alias("a"), part(9).alias("b"))
    return n.agg(F.count(F.lit(1)).alias("rows"), F.sum("a").alias("sum_a"), F.sum("b").alias("sum_b"), F.bit_xor("a").alias("xor_a"), F.bit_xor("b").alias("xor_b"))
