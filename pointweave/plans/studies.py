"""Registered studies on the driver's tables: a supplier is a player, its month a match, line items its points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions import text
from pointweave.operators import resampling, selection, studies, windows
from pointweave.operators.store import written
from pointweave.plans.registry import r6, read, registered

HITS = {"first_in": "l_discount > 0.03", "resolved_first": "l_quantity > 5", "aces": "l_tax > 0.06", "resolved_ace": "true", "dfs": "l_quantity > 45", "resolved_df": "l_quantity > 25"}
HITS["first_in"] += " AND l_quantity > 5"
CELLS = {studies.cell(n, s, w): f"(l_quantity > 25) = {'true' if n == 2 else 'false'} AND l_linestatus = '{f}' AND l_returnflag = '{g}'" for n in (1, 2) for s, f in zip(studies.SIDES, "FO", strict=True) for w, g in zip(studies.WAYS, "ANR", strict=True)}
COUNTED = HITS | CELLS
#: What a match is like, the same text in both engines.
CONTEXT = {
    "tour": "CASE WHEN player % 2 = 0 THEN 'ATP' ELSE 'WTA' END",
    "surface": "CASE mm % 3 WHEN 0 THEN 'hard' WHEN 1 THEN 'clay' ELSE '' END",
    "opponent_rank": "CASE WHEN (player + mm) % 10 = 0 THEN NULL ELSE cast((player * 37 + mm * 11) % 260 + 1 as int) END",
    "player_rank": "CASE WHEN player % 11 = 0 THEN NULL ELSE cast((player * 53 + season) % 260 + 1 as int) END",
    "opponent": "cast((player * 7 + mm) % 30 as varchar(9))",
    "tournament": "concat('T', mm)",
    "author": "CASE WHEN mm % 4 = 0 THEN '' ELSE concat('a', mm % 4) END",
}


def records(spark: SparkSession, d: str) -> DataFrame:
    """A row per player and month. A line item goes to its match as a bit per condition: that is narrower than counters of
    all of them, and a task's line items share few matches that it could add up before."""
    day = F.col("l_shipdate")
    bits = sum((F.when(F.expr(c), F.lit(1 << i)).otherwise(0) for i, c in enumerate(COUNTED.values())), F.lit(0))
    p = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("player"), F.year(day).cast("long").alias("season"), F.month(day).alias("mm"), bits.alias("bits"))
    g = p.repartition("player", "season", "mm").groupBy("player", "season", "mm").agg(*[F.count_if(F.col("bits").bitwiseAND(1 << i) != 0).alias(n) for i, n in enumerate(COUNTED)])
    month = F.concat(F.lpad(F.col("season").cast("string"), 4, "0"), F.lpad(F.col("mm").cast("string"), 2, "0"))
    g = g.select("player", "season", month.alias("month"), "mm", *COUNTED)
    return g.select("*", F.concat_ws("-", "player", "month").alias("match_id"), *[F.expr(v).alias(n) for n, v in CONTEXT.items()]).withColumn("surface", F.when(F.col("surface") == "", "(blank)").otherwise(F.col("surface")))


def observed(spark: SparkSession, d: str) -> DataFrame:
    return studies.observations(records(spark, d))


def band_sql(rank: str) -> str:
    return "CASE WHEN " + rank + " IS NULL THEN 'missing' " + " ".join(f"WHEN {rank} <= {m} THEN '{n}'" for m, n in text.BANDS) + " ELSE '201+' END"


RECORDS = (
    "p AS (SELECT *, l_suppkey AS player, year(l_shipdate)::BIGINT AS season, strftime(l_shipdate, '%Y%m') AS month, month(l_shipdate) AS mm FROM lineitem), g0 AS (SELECT player, season, month, mm, "
    + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in COUNTED.items())
    + " FROM p GROUP BY ALL), g1 AS (SELECT *, player || '-' || month AS match_id, "
    + ", ".join(f"{v} AS {n}" for n, v in CONTEXT.items())
    + f" FROM g0), rec AS (SELECT * REPLACE (CASE WHEN surface = '' THEN '(blank)' ELSE surface END AS surface), {band_sql('opponent_rank')} AS band, {band_sql('player_rank')} AS own_band FROM g1)"
)
OBSERVED = (
    RECORDS
    + ", obs AS MATERIALIZED ("
    + " UNION ALL ".join(
        [f"SELECT tour, player, surface, band, opponent, tournament, author, season, match_id, '{n}' AS target, '' AS side, {s} AS c1, {t} - {s} AS c2, 0::BIGINT AS c3, 2 AS k FROM rec WHERE {t} > 0 AND {s} BETWEEN 0 AND {t}" for n, (s, t) in studies.BINARY.items()]
        + [
            f"SELECT tour, player, surface, band, opponent, tournament, author, season, match_id, 'direction_{n}', '{s}', {', '.join(studies.cell(n, s, w) for w in studies.WAYS)}, 3 FROM rec WHERE " + " AND ".join("(" + " + ".join(studies.cell(n, x, w) for w in studies.WAYS) + ") > 0" for x in studies.SIDES)
            for n in (1, 2)
            for s in studies.SIDES
        ]
    )
    + ")"
)


# Halves

def _profile_sql(p: str) -> dict[str, str]:
    rates = ", ".join(f"{p}{s} / {p}{t}::DOUBLE" for s, t in studies.BINARY.values())
    some = " AND ".join(f"{p}{t} > 0" for _, t in studies.BINARY.values())
    out = {"outcome": f"CASE WHEN {some} THEN [{rates}] END"}
    for n in (1, 2):
        total = {s: "(" + " + ".join(p + studies.cell(n, s, w) for w in studies.WAYS) + ")" for s in studies.SIDES}
        out[f"direction_{n}"] = f"CASE WHEN {' AND '.join(t + ' > 0' for t in total.values())} THEN [" + ", ".join(f"{p}{studies.cell(n, s, w)} / {total[s]}::DOUBLE" for s in studies.SIDES for w in studies.WAYS) + "] END"
    return out


def _distance_sql(f: str, a: str, b: str) -> str:
    size, by = (3, 3) if f == "outcome" else (6, 4)
    return "(" + " + ".join(f"abs({a}[{i}] - {b}[{i}])" for i in range(1, size + 1)) + f") / {by}"


def halves_sql(source: str, groups: list[str], strategies: list[str], least: tuple, reps: int, cells: list[str]) -> str:
    who, peers = ["strategy", *groups], groups[:-1]
    keys = [*cells, "strategy", "family"]
    key = ", ".join(keys)
    by = ", ".join(who)
    half = "CASE strategy " + " ".join(f"WHEN '{s}' THEN " + ("pl <= np // 2" if s == "chronological" else "pl % 2 = 1") for s in strategies) + " END"
    sums = ", ".join(f"sum({c}) AS {c}" for c in studies.COUNTERS)
    profile = ", ".join(f"{v} AS {f}" for f, v in _profile_sql("").items())
    both = lambda t: f"SELECT {', '.join('l.' + w for w in who)}{{extra}}, " + ", ".join(f"l.{f} AS l_{f}, r.{f} AS r_{f}" for f in studies.FAMILIES) + f" FROM {t} l JOIN {t} r ON " + " AND ".join(f"l.{w} = r.{w}" for w in who) + "{on} AND l.half = 'left' AND r.half = 'right'"
    long = lambda t, right, keep: " UNION ALL ".join(f"SELECT {keep}, '{f}' AS family, {_distance_sql(f, 'l_' + f, right + f)} AS t FROM {t} WHERE l_{f} IS NOT NULL AND {right}{f} IS NOT NULL" for f in studies.FAMILIES)
    keep = ", ".join(dict.fromkeys([*cells, "strategy", "n"]))
    grid = f"(SELECT unnest([{', '.join(map(str, least))}])::INT AS least_matches)"
    p = resampling.PRIME
    sql = f"""{source}, s0 AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY month, match_id) AS pl, count(*) OVER (PARTITION BY {by}) AS np FROM src, (SELECT unnest({strategies}) AS strategy)),
s1 AS (SELECT *, CASE WHEN {half} THEN 'left' ELSE 'right' END AS half FROM s0), s2 AS (SELECT *, row_number() OVER (PARTITION BY {by}, half ORDER BY month, match_id) AS rn, count(*) OVER (PARTITION BY {by}, half) AS n FROM s1),
a0 AS (SELECT {by}, half, max(n) AS n, {sums} FROM s2 GROUP BY {by}, half), a1 AS (SELECT {by}, half, n, {profile} FROM a0),
pl AS ({both('a1').format(extra=', least(l.n, r.n) AS n', on='')}), w0 AS ({long('pl', 'r_', keep)}),
near AS (SELECT {key}, least_matches, count(*) AS players, median(t) AS within FROM w0, {grid} WHERE n >= least_matches GROUP BY {key}, least_matches),
x0 AS (SELECT {', '.join('a.' + c for c in dict.fromkeys([*cells, 'strategy']))}, least(a.n, b.n) AS n, """ + ", ".join(f"CASE WHEN a.r_{f} IS NOT NULL THEN a.l_{f} END AS l_{f}, CASE WHEN b.l_{f} IS NOT NULL THEN b.r_{f} END AS r_{f}" for f in studies.FAMILIES) + f""" FROM pl a JOIN pl b ON a.strategy = b.strategy AND {' AND '.join(f'a.{c} = b.{c}' for c in peers)} AND a.{groups[-1]} <> b.{groups[-1]}),
x1 AS ({long('x0', 'r_', keep)}), far AS (SELECT {key}, least_matches, count(*) AS pairs, median(t) AS between_m FROM x1, {grid} WHERE n >= least_matches GROUP BY {key}, least_matches)"""
    on = " AND ".join(f"near.{k} = {{t}}.{k}" for k in [*keys, "least_matches"])
    told = f"SELECT {', '.join('near.' + k for k in keys)}, near.least_matches, players, coalesce(pairs, 0) AS pairs, round(within, 6) AS within_median, round(between_m, 6) AS between_median, round(CASE WHEN between_m > 0 THEN within / between_m END, 6) AS ratio"
    if not reps:
        return f"WITH {sql} {told} FROM near LEFT JOIN far ON {on.format(t='far')}"
    sql += f""", d0 AS (SELECT {by}, half, n, rn AS slot, rep, ('0x' || substr(md5(concat_ws('|', {by}, half)), 1, 7))::BIGINT AS num FROM s2, (SELECT unnest(range(0, {reps})) AS rep)),
d1 AS (SELECT *, (num + rep * 7919 + slot * 104729) % {p} AS y0 FROM d0), d2 AS (SELECT *, (y0 * y0 + num) % {p} AS y1 FROM d1), d3 AS (SELECT *, (y1 * y1 + slot) % {p} AS y2 FROM d2), d4 AS (SELECT *, (y2 * y2 + rep) % {p} % n + 1 AS pick FROM d3),
b0 AS (SELECT {', '.join('d.' + w for w in who)}, d.half, rep, {', '.join(f'sum(s.{c}) AS {c}' for c in studies.COUNTERS)} FROM d4 d JOIN s2 s ON {' AND '.join(f'd.{w} = s.{w}' for w in who)} AND d.half = s.half AND d.pick = s.rn GROUP BY ALL),
b1 AS (SELECT {by}, half, rep, {profile} FROM b0), b2 AS ({both('b1').format(extra=', l.rep', on=' AND l.rep = r.rep')}), b3 AS (SELECT b2.*, pl.n FROM b2 JOIN pl USING ({by})), b4 AS ({long('b3', 'r_', keep + ', rep')}),
md AS (SELECT {key}, least_matches, rep, median(t) AS m FROM b4, {grid} WHERE n >= least_matches GROUP BY {key}, least_matches, rep), ra AS (SELECT {key}, least_matches, list_sort(list(m)) AS v FROM md GROUP BY {key}, least_matches)"""
    rank = lambda q: f"round(v[round_even({q} * (len(v) - 1), 0)::INT + 1], 6)"
    return f"WITH {sql} {told}, {rank(0.025)} AS low, {rank(0.975)} AS high FROM near LEFT JOIN far ON {on.format(t='far')} LEFT JOIN ra ON {on.format(t='ra')}"


BOTH = ["chronological", "alternating"]
SRC = RECORDS + ", src AS (SELECT * FROM rec)"
STRATA_SQL = RECORDS + ", src AS (" + " UNION ALL ".join(f"SELECT *, '{n}' AS dimension, {v} AS stratum FROM rec" for n, v in {
    "surface": "surface", "era": "(season // 10 * 10) || 's'", "player_rank_band": "own_band", "opponent_rank_band": "band", "tournament": "tournament", "chart_author": "CASE WHEN author = '' THEN '(blank)' ELSE author END",
    "joint_basic_context": "surface || '|' || (season // 10 * 10) || 's' || '|' || band"}.items()) + ")"


@registered(halves_sql(SRC, ["tour", "player"], BOTH, studies.LEAST_MATCHES, 100, []))
def E1_stability(spark: SparkSession, d: str) -> DataFrame:
    """All 24 cells: three families, both splits, four thresholds, 100 resamples (the interval is M20)."""
    return studies.halves_study(records(spark, d), ["tour", "player"], BOTH, studies.LEAST_MATCHES, 100, [])


@registered(halves_sql(SRC, ["tour", "player"], BOTH, studies.LEAST_MATCHES, 0, ["tour"]))
def E1_stability_by_tour(spark: SparkSession, d: str) -> DataFrame:
    return studies.halves_study(records(spark, d), ["tour", "player"], BOTH, studies.LEAST_MATCHES, 0, ["tour"])


@registered(halves_sql(SRC, ["tour", "player"], ["chronological"], (2,), 50, ["tour"]).replace("SELECT near.tour", "SELECT near.tour", 1))
def M20_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Range of the median distance within players per tour, 50 resamples of the matches of each half."""
    return studies.halves_study(records(spark, d), ["tour", "player"], ["chronological"], (2,), 50, ["tour"])


@registered(halves_sql(STRATA_SQL, ["tour", "dimension", "stratum", "player"], ["chronological"], (2, 5), 50, ["dimension"]))
def E2_context_stability(spark: SparkSession, d: str) -> DataFrame:
    """All 42 cells: three families, seven dimensions of context, two thresholds, 50 resamples."""
    return studies.halves_study(records(spark, d), ["tour", "dimension", "stratum", "player"], ["chronological"], (2, 5), 50, ["dimension"], studies.contexts())


@registered(STRATA_SQL.join(["WITH ", " SELECT dimension, stratum, count(*) AS matches, count(DISTINCT player) AS players FROM src GROUP BY ALL"]))
def P10_strata(spark: SparkSession, d: str) -> DataFrame:
    return studies.strata(records(spark, d)).groupBy("dimension", "stratum").agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("player").alias("players"))


# Readiness of histories

KEY = "tour, player, surface"


def estimates_sql(name: str, source: str, keys: str) -> str:
    """CTEs up to ``name``: estimates of each component of the histories in ``source``, residuals about the rate."""
    part = f"PARTITION BY {keys}, target, side"
    cats = " UNION ALL ".join(f"SELECT {keys}, target, side, {i} AS category, matches, k, total, a{i + 1} AS count, q{i + 1} AS sq FROM {name}1" + (" WHERE k = 3" if i else "") for i in range(3))
    return f"""{name}0 AS (SELECT *, c1 + c2 + c3 AS t, sum(c1 + c2 + c3) OVER ({part}) AS total, sum(c1) OVER ({part}) AS a1, sum(c2) OVER ({part}) AS a2, sum(c3) OVER ({part}) AS a3 FROM {source}),
{name}1 AS (SELECT {keys}, target, side, count(*) AS matches, max(k) AS k, max(total) AS total, max(a1) AS a1, max(a2) AS a2, max(a3) AS a3, {', '.join(f'sum(power(c{i} - a{i} / total::DOUBLE * t, 2)) AS q{i}' for i in (1, 2, 3))} FROM {name}0 GROUP BY {keys}, target, side),
{name} AS (SELECT {keys}, target, side, category, matches, total, count, count / total::DOUBLE AS share, (count + 0.5) / (total + 0.5 * k) AS conditional_mean,
  sqrt((count + 0.5) * (total + 0.5 * k - count - 0.5) / ((total + 0.5 * k) * (total + 0.5 * k) * (total + 0.5 * k + 1))) AS conditional_sd, CASE WHEN matches > 1 THEN sqrt(matches / (matches - 1.0) * sq) / total END AS se FROM ({cats}))"""


YEARS = ", yr AS (SELECT min(season) AS lo, max(season) AS hi FROM rec)"
DIAGNOSED = "WITH " + OBSERVED + YEARS + f""", hist AS (SELECT obs.*, as_of FROM obs, yr, (SELECT unnest(range(1900, 2100)) AS as_of) WHERE as_of BETWEEN lo + {studies.SEASONS} AND hi AND season >= as_of - {studies.SEASONS} AND season < as_of),
pm AS (SELECT as_of, target, {KEY}, match_id, sum(c1 + c2 + c3) AS n, max(season) AS season, max(opponent) AS opponent, max(tournament) AS tournament, max(author) AS author FROM hist GROUP BY ALL),
ex AS (SELECT as_of, target, {KEY}, count(*) AS matches, count(DISTINCT season) AS seasons, count(DISTINCT nullif(trim(opponent), '')) AS opponents, count(DISTINCT nullif(trim(tournament), '')) AS tournaments, count(DISTINCT nullif(trim(author), '')) AS authors,
  sum(n) AS events, max(n) / sum(n)::DOUBLE AS largest_share, sum(n)::DOUBLE * sum(n) / sum(n * n) AS effective FROM pm GROUP BY ALL), """ + estimates_sql("e", "hist", f"as_of, {KEY}") + f""",
wo AS (SELECT as_of, target, {KEY}, max(se) AS cluster_se, max(conditional_sd) AS conditional_sd, max(CASE WHEN conditional_sd > 0 THEN se / conditional_sd END) AS ratio FROM e GROUP BY ALL),
dg AS (SELECT * FROM ex JOIN wo USING (as_of, target, {KEY})), cutd AS (SELECT 'overall' AS dimension, 'all' AS value, * FROM dg UNION ALL SELECT 'tour', tour, * FROM dg UNION ALL SELECT 'surface', tour || '|' || surface, * FROM dg UNION ALL SELECT 'as_of', as_of::VARCHAR, * FROM dg)"""


def five_sql(value: str, prefix: str) -> str:
    v = f"list_sort(list({value}) FILTER ({value} IS NOT NULL))"
    at = lambda p: f"{v}[round_even({p} * (len({v}) - 1), 0)::INT + 1]"
    values = {"least": f"min({value})", "p25": at(0.25), "median": f"median({value})", "p75": at(0.75), "most": f"max({value})"}
    return ", ".join(f"round(({e})::DOUBLE, 6) AS {prefix}_{n}" for n, e in values.items())


def _diagnosed(spark: SparkSession, d: str) -> DataFrame:
    r = written(records(spark, d))
    low, high = studies.years(r)
    return studies.wide_diagnostics(r, low + studies.SEASONS, high)


def _cut(rows: DataFrame, fold: str = "as_of") -> DataFrame:
    return studies.cut_by(rows, {"overall": F.lit("all"), "tour": F.col("tour"), "surface": F.concat_ws("|", "tour", "surface"), fold: F.col(fold)})


EXPOSED = ("matches", "events", "effective", "largest_share")


@registered(DIAGNOSED + " SELECT target, dimension, value, count(*) AS histories, count(DISTINCT tour || player) AS players, count(*) FILTER (" + studies.SOUND + ") AS sound, round(count(*) FILTER (" + studies.SOUND + ") / count(*)::DOUBLE, 6) AS sound_share, " + ", ".join(five_sql(v, v) for v in EXPOSED) + " FROM cutd GROUP BY ALL")
def E4_readiness(spark: SparkSession, d: str) -> DataFrame:
    """Five targets, every as-of year: what histories rest on, overall and by tour, surface and year."""
    group = ["target", "dimension", "value"]
    rows = _cut(written(_diagnosed(spark, d)))
    sound = F.count_if(F.expr(studies.SOUND))
    told = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("histories"), F.count_distinct("tour", "player").alias("players"), sound.alias("sound"), F.round(sound / F.count(F.lit(1)), 6).alias("sound_share"))
    return selection.beside(told, selection.five_numbers(rows, group, {v: v for v in EXPOSED}), group)


THRESHOLDS = [(n, v, ">=") for n, vs in studies.GRIDS.items() for v in vs] + [("largest_share", v, "<=") for v in studies.SHARE_GRID]


@registered(DIAGNOSED + " SELECT target, grid, threshold, n FROM (" + " UNION ALL ".join(f"SELECT target, '{g}' AS grid, {v}::DOUBLE AS threshold, count(*) FILTER ({g} {op} {v}) AS n FROM dg GROUP BY 1" for g, v, op in THRESHOLDS) + ")")
def G20_threshold_grids(spark: SparkSession, d: str) -> DataFrame:
    """Histories at or beyond each threshold of the seven grids, all from one pass."""
    counts = [F.struct(F.lit(g).alias("grid"), F.lit(float(v)).alias("threshold"), F.count_if(F.expr(f"{g} {op} {v}")).alias("n")) for g, v, op in THRESHOLDS]
    told = _diagnosed(spark, d).groupBy("target").agg(F.array(*counts).alias("x"))
    return told.select("target", F.explode("x").alias("x")).select("target", "x.*")


@registered(DIAGNOSED + f" SELECT as_of, target, {KEY}, matches, round(cluster_se, 6) AS cluster_se, round(conditional_sd, 6) AS conditional_sd, round(ratio, 6) AS ratio, round(1.96 * cluster_se, 6) AS half_width FROM dg")
def M10_history_errors(spark: SparkSession, d: str) -> DataFrame:
    """Greatest clustered error, conditional sd and ratio over a history's components, and the half-width."""
    return _diagnosed(spark, d).select("as_of", "target", *studies.KEY, "matches", *[r6(F.col(c)).alias(c) for c in ("cluster_se", "conditional_sd", "ratio")], r6(1.96 * F.col("cluster_se")).alias("half_width"))


@registered(DIAGNOSED + ", u AS (SELECT *, 1.96 * cluster_se AS half_width, least_matches FROM dg, (SELECT unnest([0, 2, 5, 10, 20])::INT AS least_matches) WHERE matches >= least_matches AND cluster_se IS NOT NULL) SELECT target, least_matches, count(*) AS histories, " + five_sql("half_width", "half_width") + ", " + five_sql("ratio", "ratio") + " FROM u GROUP BY ALL")
def G32_uncertainty(spark: SparkSession, d: str) -> DataFrame:
    """Half-widths and ratios of the histories that have an error, of all and by least number of matches."""
    group = ["target", "least_matches"]
    rows = _diagnosed(spark, d).where("cluster_se is not null").withColumns({"half_width": 1.96 * F.col("cluster_se"), "least_matches": F.explode(F.array(*map(F.lit, (0, *studies.LEAST_MATCHES))))}).where("matches >= least_matches")
    rows = written(rows)
    told = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("histories"))
    return selection.beside(told, selection.five_numbers(rows, group, {v: v for v in ("half_width", "ratio")}), group)


@registered("WITH " + OBSERVED + f" SELECT target, {KEY}, count(DISTINCT match_id) AS matches FROM obs GROUP BY ALL")
def G30_valid_matches(spark: SparkSession, d: str) -> DataFrame:
    return observed(spark, d).groupBy("target", *studies.KEY).agg(F.count_distinct("match_id").alias("matches"))


# Robustness and process uncertainty

def compared_sql(first: str) -> str:
    ws = ", ".join(map(str, studies.WINDOWS))
    return "WITH " + OBSERVED + YEARS + f""", o1 AS (SELECT * FROM obs WHERE target = 'direction_1'),
hw AS (SELECT o1.*, as_of, win AS "window" FROM o1, yr, (SELECT unnest(range(1900, 2100)) AS as_of), (SELECT unnest([{ws}])::INT AS win) WHERE as_of BETWEEN {first} AND hi - 1 AND season >= as_of - win AND season < as_of),
now0 AS (SELECT *, season AS as_of FROM o1), """ + estimates_sql("pa", "hw", f'"window", as_of, {KEY}') + ", " + estimates_sql("no", "now0", f"as_of, {KEY}") + f""",
cm AS (SELECT pa.*, no.share AS now_share, no.conditional_sd AS now_conditional_sd, no.se AS now_se, least_matches FROM pa JOIN no USING (as_of, {KEY}, side, category), (SELECT unnest([{', '.join(map(str, studies.LEAST_MATCHES))}])::INT AS least_matches) WHERE no.matches >= {studies.LEAST_TEST} AND pa.matches >= least_matches),
ju AS (SELECT *, abs(share - now_share) AS error, (abs(conditional_mean - now_share) <= 1.96 * sqrt(power(conditional_sd, 2) + power(now_conditional_sd, 2)))::INT AS conditional_covered, power(se, 2) + power(now_se, 2) AS base FROM cm),
jd AS (SELECT *, (error <= 1.96 * sqrt(base))::INT AS clustered_covered FROM ju)"""


def _compared(spark: SparkSession, d: str, extra: int = 0) -> DataFrame:
    """Histories from ``window`` seasons (and ``extra``) after the first one on, up to the last whole season."""
    r = written(records(spark, d))
    low, high = studies.years(r)
    both = studies.comparisons(studies.observations(r), studies.WINDOWS, low + min(studies.WINDOWS), high - 1, studies.LEAST_MATCHES)
    return both.where(F.col("as_of") >= F.lit(low) + F.col("window") + extra)


PERIODS = f""", pe AS (SELECT "window", least_matches, as_of, {KEY}, avg(error) AS error, avg(conditional_covered) AS conditional_covered, avg(clustered_covered) AS clustered_covered,
  least(max(total) FILTER (side = 'deuce'), max(total) FILTER (side = 'ad')) / (max(total) FILTER (side = 'deuce') + max(total) FILTER (side = 'ad'))::DOUBLE AS smaller_share FROM jd GROUP BY ALL),
pc AS (SELECT 'overall' AS dimension, 'all' AS value, * FROM pe UNION ALL SELECT 'tour', tour, * FROM pe UNION ALL SELECT 'surface', tour || '|' || surface, * FROM pe UNION ALL SELECT 'as_of', as_of::VARCHAR, * FROM pe)"""
FIVE = compared_sql('lo + win')
CONFIG = '"window", least_matches'


@registered(FIVE + PERIODS + f" SELECT {CONFIG}, dimension, value, count(*) AS periods, count(DISTINCT tour || player) AS players, round(avg(error), 6) AS mean_error, round(median(error), 6) AS median_error, round(avg(conditional_covered), 6) AS conditional_coverage, round(avg(clustered_covered), 6) AS clustered_coverage, " + five_sql("smaller_share", "share") + ", " + ", ".join(f"count(*) FILTER (smaller_share >= {v}) AS share_{str(v)[2:]}" for v in studies.SIDE_GRID) + " FROM pc GROUP BY ALL")
def E5_robustness(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen configurations of window and least matches, overall and by tour, surface and season."""
    group = ["window", "least_matches", "dimension", "value"]
    rows = studies.periods(studies.judged(_compared(spark, d)), ["window", "least_matches", "as_of"], ["error", "conditional_covered", "clustered_covered"])
    rows = _cut(written(rows))
    a = lambda c, n: F.round(F.avg(c), 6).alias(n)
    told = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("periods"), F.count_distinct("tour", "player").alias("players"), a("error", "mean_error"), a("conditional_covered", "conditional_coverage"), a("clustered_covered", "clustered_coverage"), *[F.count_if(F.col("smaller_share") >= v).alias(f"share_{str(v)[2:]}") for v in studies.SIDE_GRID])
    fives = selection.five_numbers(rows, group, {"share": "smaller_share", "error": "error"})
    kept = [c for c in fives.columns if not c.startswith("error_")]
    return selection.beside(told, fives.select(*kept, F.col("error_median").alias("median_error")), group)


@registered(FIVE + f" SELECT {CONFIG}, side, category, round(avg(error), 6) AS mean_error, round(avg(conditional_covered), 6) AS conditional_coverage, round(avg(clustered_covered), 6) AS clustered_coverage FROM jd GROUP BY ALL")
def G22_component_coverage(spark: SparkSession, d: str) -> DataFrame:
    a = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return studies.judged(_compared(spark, d)).groupBy("window", "least_matches", "side", "category").agg(a("error", "mean_error"), a("conditional_covered", "conditional_coverage"), a("clustered_covered", "clustered_coverage"))


@registered(FIVE + f' SELECT "window", as_of, {KEY}, side, category, matches, round(share, 6) AS share, round(conditional_mean, 6) AS conditional_mean, round(conditional_sd, 6) AS conditional_sd, round(se, 6) AS se FROM pa WHERE matches > 1')
def M16_component_estimates(spark: SparkSession, d: str) -> DataFrame:
    r = written(records(spark, d))
    low, high = studies.years(r)
    obs = studies.observations(r).where("target = 'direction_1'")
    est = studies.component_estimates(studies.histories(studies.partials(obs), studies.WINDOWS, low + min(studies.WINDOWS), high - 1), ["window", "as_of", *studies.KEY])
    est = est.where((F.col("as_of") >= F.lit(low) + F.col("window")) & (F.col("matches") > 1))
    return est.select("window", "as_of", *studies.KEY, "side", "category", "matches", *[r6(F.col(c)).alias(c) for c in ("share", "conditional_mean", "conditional_sd", "se")])


@registered(FIVE + f" SELECT {CONFIG}, as_of, {KEY}, side, category, round(error, 6) AS error, conditional_covered, clustered_covered FROM jd")
def M17_coverage_tests(spark: SparkSession, d: str) -> DataFrame:
    rows = studies.judged(_compared(spark, d))
    return rows.select("window", "least_matches", "as_of", *studies.KEY, "side", "category", r6(F.col("error")).alias("error"), F.col("conditional_covered").cast("int").alias("conditional_covered"), F.col("clustered_covered").cast("int").alias("clustered_covered"))


@registered(FIVE + PERIODS + f" SELECT {CONFIG}, as_of, {KEY}, round(smaller_share, 6) AS smaller_share FROM pe")
def M19_smaller_side(spark: SparkSession, d: str) -> DataFrame:
    rows = studies.periods(studies.judged(_compared(spark, d)), ["window", "least_matches", "as_of"], ["error"])
    return rows.select("window", "least_matches", "as_of", *studies.KEY, r6(F.col("smaller_share")).alias("smaller_share"))


_Q = "list_sort(list(need))[least(count(*), ceil(0.95 * (count(*) + 1)))::INT]"
PROCESS = FIVE + f""", ca AS (SELECT {CONFIG}, as_of + 1 AS as_of, tour, side, category, greatest(0, power(error / 1.96, 2) - base) AS need FROM jd),
l1 AS (SELECT {CONFIG}, as_of, tour, side, category, count(*) AS n, {_Q} AS v FROM ca GROUP BY ALL), l2 AS (SELECT {CONFIG}, as_of, side, category, count(*) AS n, {_Q} AS v FROM ca GROUP BY ALL), l3 AS (SELECT {CONFIG}, as_of, count(*) AS n, {_Q} AS v FROM ca GROUP BY ALL),
es AS (SELECT t.{CONFIG.replace(', ', ', t.')}, t.as_of, t.tour, l2.side, l2.category, CASE WHEN l1.n >= 30 THEN l1.v WHEN l2.n >= 30 THEN l2.v ELSE l3.v END AS variance, CASE WHEN l1.n >= 30 THEN 'tour_component' WHEN l2.n >= 30 THEN 'pooled_component' ELSE 'global' END AS source, CASE WHEN l1.n >= 30 THEN l1.n WHEN l2.n >= 30 THEN l2.n ELSE l3.n END AS cases
  FROM (SELECT DISTINCT {CONFIG}, as_of, tour FROM ca) t JOIN l2 USING ({CONFIG}, as_of) JOIN l3 USING ({CONFIG}, as_of) LEFT JOIN l1 ON l1."window" = t."window" AND l1.least_matches = t.least_matches AND l1.as_of = t.as_of AND l1.tour = t.tour AND l1.side = l2.side AND l1.category = l2.category),
pr AS (SELECT *, 1.96 * sqrt(base) AS base_radius, 1.96 * sqrt(base + variance) AS process_radius, (error <= 1.96 * sqrt(base + variance))::INT AS process_covered, sqrt(variance) AS deviation FROM jd JOIN es USING ({CONFIG}, as_of, tour, side, category))"""


def _process(spark: SparkSession, d: str) -> DataFrame:
    compared = written(_compared(spark, d))  # estimates and rows are read from it
    return studies.process_rows(compared, studies.process_estimates(compared))


@registered(PROCESS + f" SELECT {CONFIG}, as_of, tour, side, category, round(variance, 6) AS variance, source, cases FROM es")
def M15_process_estimates(spark: SparkSession, d: str) -> DataFrame:
    e = studies.process_estimates(_compared(spark, d))
    return e.select("window", "least_matches", "as_of", "tour", "side", "category", r6(F.col("variance")).alias("variance"), "source", "cases")


MEANS = ("clustered_covered", "process_covered", "base_radius", "process_radius")
PPERIODS = f", pe AS (SELECT {CONFIG}, as_of, {KEY}, " + ", ".join(f"avg({c}) AS {c}" for c in MEANS) + " FROM pr GROUP BY ALL), pc AS (SELECT 'overall' AS dimension, 'all' AS value, * FROM pe UNION ALL SELECT 'tour', tour, * FROM pe UNION ALL SELECT 'surface', tour || '|' || surface, * FROM pe UNION ALL SELECT 'as_of', as_of::VARCHAR, * FROM pe)"


@registered(PROCESS + PPERIODS + f" SELECT {CONFIG}, dimension, value, count(*) AS periods, count(DISTINCT tour || player) AS players, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in MEANS) + " FROM pc GROUP BY ALL")
def E6_process(spark: SparkSession, d: str) -> DataFrame:
    """Coverage with a process variance learnt one season earlier, every configuration and season that has both."""
    rows = studies.periods(_process(spark, d), ["window", "least_matches", "as_of"], list(MEANS))
    return _cut(rows).groupBy("window", "least_matches", "dimension", "value").agg(F.count(F.lit(1)).alias("periods"), F.count_distinct("tour", "player").alias("players"), *[F.round(F.avg(c), 6).alias(c) for c in MEANS])


@registered(PROCESS + f" SELECT {CONFIG}, side, category, round(avg(clustered_covered), 6) AS base_coverage, round(avg(process_covered), 6) AS process_coverage, round(avg(base_radius), 6) AS base_radius, round(avg(process_radius), 6) AS process_radius, " + five_sql("deviation", "deviation") + " FROM pr GROUP BY ALL")
def M18_process_coverage(spark: SparkSession, d: str) -> DataFrame:
    group = ["window", "least_matches", "side", "category"]
    a = lambda c, n: F.round(F.avg(c), 6).alias(n)
    rows = written(_process(spark, d))
    told = rows.groupBy(*group).agg(a("clustered_covered", "base_coverage"), a("process_covered", "process_coverage"), a("base_radius", "base_radius"), a("process_radius", "process_radius"))
    return selection.beside(told, selection.five_numbers(rows, group, {"deviation": "deviation"}), group)


@registered(PROCESS + f" SELECT {CONFIG}, source, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY {CONFIG}), 6) AS share FROM pr GROUP BY {CONFIG}, source")
def G23_process_sources(spark: SparkSession, d: str) -> DataFrame:
    n = _process(spark, d).groupBy("window", "least_matches", "source").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("window", "least_matches")), 6))


# Shrinkage

GRAIN = "phase, test_year, target, side, tour, surface, band, player"


def _prior_sql(names: list[str], i: int) -> str:
    cases = " ".join(f"WHEN {n}1 + {n}2 + {n}3 > 0 THEN ({n}{i} + 0.5) / ({n}1 + {n}2 + {n}3 + 0.5 * k)" for n in names)
    return f"CASE {cases} ELSE 1.0 / k END::DOUBLE"


def _sums(prefix: str) -> str:
    return ", ".join(f"sum(c{i}) AS {prefix}{i}" for i in (1, 2, 3))


_LEVELS = {"e": "phase, test_year, target, side, tour, surface, band", "s": "phase, test_year, target, side, tour, surface", "t": "phase, test_year, target, side, tour"}
PRIORS = "WITH " + OBSERVED + YEARS + f""", yrs AS (SELECT unnest(range(lo + {studies.SEASONS + 1}, hi + 1)) AS t FROM yr), ph AS (SELECT 'validation' AS phase, 1 AS back UNION ALL SELECT 'test', 0),
hs AS MATERIALIZED (SELECT phase, t AS test_year, obs.* FROM obs, yrs, ph WHERE season >= t - back - {studies.SEASONS} AND season < t - back), sc AS (SELECT phase, t AS test_year, obs.* FROM obs, yrs, ph WHERE season = t - back),
ho AS (SELECT {GRAIN}, {_sums('oe')} FROM hs GROUP BY ALL), hp AS (SELECT {_LEVELS['s']}, player, {_sums('os')} FROM hs GROUP BY ALL), hq AS (SELECT {_LEVELS['t']}, player, {_sums('ot')} FROM hs GROUP BY ALL),
""" + ", ".join(f"lv_{n} AS (SELECT {keys}, {_sums('a' + n)} FROM hs GROUP BY ALL)" for n, keys in _LEVELS.items()) + f""",
r0 AS (SELECT sc.*, coalesce(os1, 0) AS p1, coalesce(os2, 0) AS p2, coalesce(os3, 0) AS p3, """ + ", ".join(f"coalesce(a{n}{i}, 0) - coalesce(o{n}{i}, 0) AS {n}{i}" for n in "est" for i in (1, 2, 3)) + f""" FROM sc LEFT JOIN ho USING ({GRAIN}) LEFT JOIN hp USING ({_LEVELS['s']}, player) LEFT JOIN hq USING ({_LEVELS['t']}, player) {' '.join(f'LEFT JOIN lv_{n} USING ({keys})' for n, keys in _LEVELS.items())}),
told AS MATERIALIZED (SELECT *, CASE WHEN e1 + e2 + e3 > 0 THEN 'exact' WHEN s1 + s2 + s3 > 0 THEN 'surface' WHEN t1 + t2 + t3 > 0 THEN 'tour' ELSE 'uniform' END AS source, """ + ", ".join([f"{_prior_sql(['e', 's', 't'], i)} AS x{i}" for i in (1, 2, 3)] + [f"{_prior_sql(['t'], i)} AS u{i}" for i in (1, 2, 3)]) + " FROM r0)"


def scores_sql(name: str, source: str, strength: str) -> str:
    """CTEs up to ``name``: score rows of ``source`` at ``strength``."""
    post = lambda s, i: f"(p{i} + {s} * x{i} + 0.5) / (p1 + p2 + p3 + {s} + 0.5 * k)"
    q = {"tour": "u{i}", "context": "x{i}"}
    qs = ", ".join([f"{v.format(i=i)} AS q{i}_{n}" for n, v in q.items() for i in (1, 2, 3)] + [f"{post('0.0', i)} AS q{i}_raw_player, {post(strength, i)} AS q{i}_shrunk_player" for i in (1, 2, 3)])
    clip = lambda e: f"ln(least(greatest({e}, 1e-12), 1 - 1e-12))"
    rate = lambda i: f"(c{i} / (c1 + c2 + c3)::DOUBLE)"
    out = []
    for n in studies.MODELS:
        out.append(f"-({rate(1)} * {clip(f'q1_{n}')} + {rate(2)} * {clip(f'q2_{n}')} + CASE WHEN k = 3 THEN {rate(3)} * {clip(f'q3_{n}')} ELSE 0 END) AS loss_{n}")
        out.append(f"power({rate(1)} - q1_{n}, 2) + CASE WHEN k = 3 THEN power({rate(2)} - q2_{n}, 2) + power({rate(3)} - q3_{n}, 2) ELSE 0 END AS brier_{n}")
    sd = lambda i: f"sqrt(q{i}_shrunk_player * (1 - q{i}_shrunk_player) / (p1 + p2 + p3 + {strength} + 0.5 * k + 1))"
    return f"{name}0 AS (SELECT *, {qs} FROM {source} WHERE p1 + p2 + p3 > 0), {name} AS (SELECT *, {rate(1)} AS observed, {', '.join(out)}, CASE WHEN k = 3 THEN ({sd(1)} + {sd(2)} + {sd(3)}) / 3 ELSE {sd(1)} END AS posterior_sd FROM {name}0)"


ELIGIBLE = f""", ms AS MATERIALIZED (SELECT DISTINCT target, {KEY}, season, match_id FROM obs), pr AS MATERIALIZED (SELECT DISTINCT target, {KEY}, season FROM ms),
hn AS (SELECT t AS test_year, target, {KEY}, count(DISTINCT match_id) AS n FROM ms, yrs WHERE season >= t - 1 - {studies.SEASONS} AND season < t - 1 GROUP BY ALL),
ob AS (SELECT hn.* FROM hn JOIN (SELECT *, season + 1 AS test_year FROM pr) v USING (test_year, target, {KEY}) JOIN (SELECT *, season AS test_year FROM pr) w USING (test_year, target, {KEY})),
el AS MATERIALIZED (SELECT ob.* EXCLUDE (n), least_matches FROM ob, (SELECT unnest([{', '.join(map(str, studies.LEAST_MATCHES))}])::INT AS least_matches) WHERE n >= least_matches)"""
SHRUNK = PRIORS + ELIGIBLE + f""", va AS (SELECT told.*, least_matches, strength FROM told JOIN el USING (test_year, target, {KEY}), (SELECT unnest([{', '.join(map(str, studies.STRENGTHS))}])::DOUBLE AS strength) WHERE phase = 'validation'), {scores_sql('vs', 'va', 'strength')},
vm AS (SELECT test_year, target, least_matches, strength, match_id, avg(loss_shrunk_player) AS loss FROM vs GROUP BY ALL), vl AS (SELECT test_year, target, least_matches, strength, avg(loss) AS loss FROM vm GROUP BY ALL),
best AS (SELECT test_year, target, least_matches, arg_min(strength, (round(loss, 12), strength)) AS strength FROM vl GROUP BY ALL),
te AS (SELECT told.*, least_matches, strength FROM told JOIN el USING (test_year, target, {KEY}) JOIN best USING (test_year, target, least_matches) WHERE phase = 'test'), {scores_sql('ts', 'te', 'strength')}"""


def _first_last(spark: SparkSession, d: str) -> tuple[DataFrame, int, int]:
    r = written(records(spark, d))
    low, high = studies.years(r)
    return r, low + studies.SEASONS + 1, high


def _shrunk(spark: SparkSession, d: str, least: tuple = studies.LEAST_MATCHES) -> DataFrame:
    return studies.shrinkage(*_first_last(spark, d), least)


@registered(PRIORS + f" SELECT DISTINCT {GRAIN}, source, round(x1, 6) AS prior_1, round(x2, 6) AS prior_2, round(u1, 6) AS tour_1 FROM told")
def M4_backoff_prior(spark: SparkSession, d: str) -> DataFrame:
    """Leave-player-out priors of every scored case, the level that each rests on, and the tour's prior."""
    r, first, last = _first_last(spark, d)
    told = studies.long_priors(studies.wide_priors(studies.wide_observations(r), first, last), ["phase", "test_year", *studies.KEY, "band"], False)
    return told.select(*[c.strip() for c in GRAIN.split(",")], "source", r6(F.col("x1")).alias("prior_1"), r6(F.col("x2")).alias("prior_2"), r6(F.col("u1")).alias("tour_1"))


@registered(PRIORS + f" SELECT {GRAIN}, oe1::BIGINT AS c1, oe2::BIGINT AS c2, oe3::BIGINT AS c3, os1::BIGINT AS surface_c1, ot1::BIGINT AS tour_c1 FROM ho JOIN hp USING ({_LEVELS['s']}, player) JOIN hq USING ({_LEVELS['t']}, player)")
def G17_history_counts(spark: SparkSession, d: str) -> DataFrame:
    """A player's counts at each level of every history: its band and surface, its surface, its tour."""
    r, first, last = _first_last(spark, d)
    history, _ = studies.phased(studies.observations(r), first, last)
    grain = [*studies.CASE, "surface", "band", "player"]
    g = history.groupBy(*grain).agg(*[F.sum(c).alias(c) for c in studies.COUNTS])
    return g.withColumns({"surface_c1": F.sum("c1").over(W.partitionBy(*studies.CASE, "player", "surface")), "tour_c1": F.sum("c1").over(W.partitionBy(*studies.CASE, "player"))})


@registered(SHRUNK + f""", fm AS (SELECT target, least_matches, test_year, strength, match_id, {', '.join(f'avg(loss_{n}) AS {n}' for n in studies.MODELS)} FROM ts GROUP BY ALL), ec AS (SELECT target, least_matches, test_year, count(*) AS eligible FROM el GROUP BY ALL),
sd AS (SELECT target, least_matches, test_year, count(DISTINCT tour || player) AS players, round(median(posterior_sd), 6) AS median_posterior_sd FROM ts GROUP BY ALL)
SELECT target, least_matches, test_year, eligible, any_value(strength)::INT AS strength, count(*) AS test_matches, any_value(players) AS players, any_value(median_posterior_sd) AS median_posterior_sd, {', '.join(f'round(avg({n}), 6) AS {n}' for n in studies.MODELS)},
round(avg(shrunk_player) - avg(context), 6) AS shrunk_minus_context, round(avg(shrunk_player) - avg(raw_player), 6) AS shrunk_minus_raw FROM fm JOIN ec USING (target, least_matches, test_year) JOIN sd USING (target, least_matches, test_year) GROUP BY target, least_matches, test_year, eligible""")
def E3_shrinkage(spark: SparkSession, d: str) -> DataFrame:
    """Five targets by four thresholds by test season: the strength that validation chose and the four models' losses."""
    r, first, last = _first_last(spark, d)
    rows = studies.shrinkage(r, first, last)
    rows = written(rows.select("target", "least_matches", "test_year", "strength", "match_id", "tour", "player", "posterior_sd", *[f"loss_{n}" for n in studies.MODELS]))
    fold = ["target", "least_matches", "test_year"]
    match = rows.groupBy(*fold, "strength", "match_id").agg(*[F.avg(f"loss_{n}").alias(n) for n in studies.MODELS])
    m = lambda n: F.avg(n)
    g = match.groupBy(*fold).agg(F.max("strength").cast("int").alias("strength"), F.count(F.lit(1)).alias("test_matches"), *[F.round(m(n), 6).alias(n) for n in studies.MODELS], F.round(m("shrunk_player") - m("context"), 6).alias("shrunk_minus_context"), F.round(m("shrunk_player") - m("raw_player"), 6).alias("shrunk_minus_raw"))
    sd = rows.groupBy(*fold).agg(F.count_distinct("tour", "player").alias("players"))
    sd = sd.join(selection.medians(rows, fold, "posterior_sd", "m").select(*fold, F.round("m", 6).alias("median_posterior_sd")), fold)
    many = studies.wide_eligible(r, first, last, studies.LEAST_MATCHES).groupBy(*fold).agg(F.count(F.lit(1)).alias("eligible"))
    return g.join(sd, fold).join(many, fold)


def _summary_sql(keys: str) -> str:
    long = " UNION ALL ".join(f"SELECT target, least_matches, tour, match_id, k, observed, '{n}' AS model, loss_{n} AS loss, brier_{n} AS brier, q1_{n} AS p FROM ts" for n in studies.MODELS)
    return f""", lo0 AS ({long}), lm AS (SELECT {keys}, model, match_id, avg(loss) AS loss, avg(brier) AS brier FROM lo0 GROUP BY ALL), ls AS (SELECT {keys}, model, count(*) AS matches, round(avg(loss), 6) AS log_loss, round(avg(brier), 6) AS brier FROM lm GROUP BY ALL),
bi AS (SELECT {keys}, model, least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(p) AS mp, avg(observed) AS my FROM lo0 WHERE k = 2 GROUP BY ALL), be AS (SELECT {keys}, model, round(sum(n * abs(mp - my)) / sum(n), 6) AS calibration_error FROM bi GROUP BY ALL) SELECT ls.*, calibration_error FROM ls LEFT JOIN be USING ({keys}, model)"""


@registered(SHRUNK + _summary_sql("target, least_matches"))
def G31_score_summary(spark: SparkSession, d: str) -> DataFrame:
    return studies.score_summary(_shrunk(spark, d), ["target", "least_matches"])


@registered(SHRUNK + _summary_sql("target, least_matches, tour"))
def G31_score_summary_by_tour(spark: SparkSession, d: str) -> DataFrame:
    return studies.score_summary(_shrunk(spark, d), ["target", "least_matches", "tour"])


SCORED = [f"{c}_{n}" for n in studies.MODELS for c in ("loss", "brier", "q1")]


@registered(SHRUNK + f" SELECT target, test_year, tour, player, match_id, side, strength::INT AS strength, {', '.join(f'round({c}, 6) AS {c}' for c in SCORED)} FROM ts WHERE least_matches = 5")
def M23_score_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = _shrunk(spark, d, (5,))
    return rows.select("target", "test_year", "tour", "player", "match_id", "side", F.col("strength").cast("int").alias("strength"), *[r6(F.col(c)).alias(c) for c in SCORED])


@registered(PRIORS + f", x AS (SELECT *, 100.0 AS strength FROM told WHERE phase = 'test'), {scores_sql('po', 'x', 'strength')} SELECT target, match_id, side, round(q1_shrunk_player, 6) AS q1, round(q2_shrunk_player, 6) AS q2, round(posterior_sd, 6) AS posterior_sd FROM po")
def M22_posterior_prediction(spark: SparkSession, d: str) -> DataFrame:
    told = studies.scored_priors(*_first_last(spark, d), ["test"])
    return studies.scores(told, F.lit(100.0)).select("target", "match_id", "side", r6(F.col("q1_shrunk_player")).alias("q1"), r6(F.col("q2_shrunk_player")).alias("q2"), r6(F.col("posterior_sd")).alias("posterior_sd"))


_AGAINST = {"context": "loss_shrunk_player - loss_context", "raw_player": "loss_shrunk_player - loss_raw_player"}


@registered(SHRUNK + ", v AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT target || '|{n}|' || least_matches AS grp, match_id, avg({v}) AS v FROM ts GROUP BY ALL" for n, v in _AGAINST.items()) + f"""), {resampling.bootstrap_sql()}
SELECT split_part(grp, '|', 1) AS target, split_part(grp, '|', 2) AS against, split_part(grp, '|', 3)::INT AS least_matches, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN high < 0 THEN 'favors left' WHEN low > 0 THEN 'favors right' ELSE 'inconclusive' END AS verdict FROM i""")
def M21_shrinkage_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Shrunk against context and raw losses at all four thresholds: match means resampled 200 times."""
    rows = _shrunk(spark, d)
    parts = F.explode(F.array(*[F.struct(F.concat_ws("|", "target", F.lit(n), "least_matches").alias("grp"), F.expr(v).alias("v")) for n, v in _AGAINST.items()]))
    match = rows.select("match_id", parts.alias("x")).groupBy("x.grp", "match_id").agg(F.avg("x.v").alias("v"))
    i = resampling.paired_bootstrap(match, "grp", "match_id", "v")
    name = lambda k: F.get(F.split("grp", "[|]"), F.lit(k))
    return i.select(name(0).alias("target"), name(1).alias("against"), name(2).cast("int").alias("least_matches"), r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), resampling.comparison(F.col("low"), F.col("high")).alias("verdict"))
