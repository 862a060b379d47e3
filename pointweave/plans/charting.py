"""Registered queries on notation and scores: parse results, counters, metrics, simulated and damaged tapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions import notation
from pointweave.functions.metrics import DIRECTIONS
from pointweave.operators import charting, scoring
from pointweave.plans.registry import CELL, read, registered

SECOND = "CASE WHEN l_quantity > 25 THEN " + CELL.replace("l_orderkey", "(l_orderkey + l_linenumber)").replace("l_partkey", "(l_partkey + l_suppkey)") + " ELSE '' END"
FIRST = f"CASE WHEN l_orderkey % 50 = 7 THEN substr('SRPQV', cast(l_partkey % 5 as int) + 1, 1) WHEN l_orderkey % 50 = 8 THEN '' WHEN l_orderkey % 50 = 9 THEN concat('~', {CELL}) ELSE {CELL} END"
LABEL = "substr('0-0  15-0 30-3040-ADbad  7-6  ', cast(l_linenumber % 6 as int) * 5 + 1, 5)"
N = notation


def parse_sql(cells: str) -> str:
    """CTEs on a table ``cells`` of distinct cells, the last one ``parsed``."""
    rest = f"regexp_replace(cell, '{N.HEAD}', '')"
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.EXCEPTIONAL.items())
    marks = f"regexp_extract(found[doubled], '^.([{N.MODIFIERS}]*)', 1)"
    return f"""cells AS ({cells}),
q1 AS (SELECT *, cell IN ('S', 'R', 'P', 'Q', 'V') AS special, regexp_extract(cell, '{N.HEAD}') AS head, {rest} AS rest FROM cells),
q2 AS (SELECT *, NOT special AND head <> '' AS served, regexp_matches(rest, '^[{N.FAULTS}]') AS hasf, regexp_matches(rest, '^[*#]') AS hase, regexp_extract(rest, '{N.RALLY}') AS prefix FROM q1),
q3 AS (SELECT *, served AND hasf AS isf, served AND hase AS ise, served AND NOT hasf AND NOT hase AND rest <> '' AS rally, regexp_extract_all(prefix, '{N.PIECE}') AS found, substr(rest, length(prefix) + 1) AS tail FROM q2),
q4 AS (SELECT *, CASE WHEN rally THEN coalesce(list_position(list_transform(found, lambda s: regexp_matches(s, '{N.TWICE}')), true), 0) END AS doubled FROM q3),
q5 AS (SELECT *, CASE WHEN rally THEN CASE WHEN doubled > 0 THEN found[1:doubled - 1] ELSE found END ELSE [] END AS kept, CASE WHEN rally AND doubled = 0 AND prefix <> '' THEN regexp_extract(tail, '^{N.ENDING}') ELSE '' END AS ending FROM q4),
q6 AS (SELECT *, list_transform(kept, lambda s: regexp_replace(substr(s, 2), '[{N.MODIFIERS}]', '', 'g')) AS digits,
  CASE WHEN cell = '' THEN 'empty_cell' WHEN special THEN NULL WHEN NOT served THEN 'expected_serve_direction' WHEN isf AND length(rest) > 1 THEN 'trailing_after_serve_fault' WHEN ise AND length(rest) > 1 THEN 'trailing_after_serve_outcome'
  WHEN NOT rally THEN NULL WHEN doubled > 0 THEN 'duplicate_modifier' WHEN ending <> '' AND length(tail) > length(ending) THEN 'trailing_after_rally_outcome' WHEN ending <> '' THEN NULL WHEN tail <> '' THEN 'expected_shot_type' ELSE 'missing_point_ending' END AS issue FROM q5),
parsed AS (SELECT cell, issue IS NULL AS valid, special, served, CASE WHEN served THEN regexp_extract(cell, '{N.HEAD}', 2) END AS direction, CASE WHEN served THEN ends_with(head, '+') END AS volley, (CASE WHEN served THEN length(head) - length(replace(head, 'c', '')) ELSE 0 END)::INT AS lets,
  len(kept)::INT AS shots, issue, CASE WHEN special THEN CASE cell {names} END END AS exceptional,
  CASE WHEN isf THEN 'serve_fault' WHEN ise AND starts_with(rest, '*') THEN 'ace' WHEN ise THEN 'unreturnable' WHEN rally THEN CASE right(ending, 1) WHEN '*' THEN 'winner' WHEN '@' THEN 'unforced_error' WHEN '#' THEN 'forced_error' WHEN 'C' THEN 'incorrect_challenge' END WHEN served THEN 'incomplete' END AS outcome,
  (CASE WHEN cell = '' THEN 0 WHEN issue IS NULL THEN NULL WHEN NOT served THEN length(regexp_extract(cell, '^c*')) WHEN isf OR ise THEN length(head) + 1
   WHEN doubled > 0 THEN length(head) + length(array_to_string(kept, '')) + list_filter(range(2, length({marks}) + 1), lambda i: instr(substr({marks}, 1, i - 1), substr({marks}, i, 1)) > 0)[1]
   WHEN ending <> '' THEN length(head) + length(prefix) + length(ending) ELSE length(head) + length(prefix) END)::INT AS issue_at,
  CASE WHEN special THEN 'not_applicable' WHEN NOT served THEN 'invalid' WHEN contains(head, '0') THEN 'unknown' ELSE 'observed' END AS direction_state,
  CASE WHEN special THEN 'not_applicable' WHEN NOT served THEN 'invalid' WHEN ends_with(head, '+') THEN 'observed' ELSE 'absent' END AS volley_state,
  CASE WHEN special THEN 'not_applicable' WHEN NOT served THEN 'invalid' WHEN isf OR ise THEN 'not_applicable' WHEN NOT rally THEN 'absent' WHEN issue IN ('duplicate_modifier', 'expected_shot_type') THEN CASE WHEN len(kept) > 0 THEN 'partial' ELSE 'invalid' END ELSE 'observed' END AS rally_state,
  CASE WHEN special THEN 'not_applicable' WHEN NOT served THEN 'invalid' WHEN isf OR ise THEN 'observed' WHEN NOT rally THEN 'absent' WHEN issue IN ('duplicate_modifier', 'expected_shot_type') THEN 'invalid' WHEN issue = 'missing_point_ending' THEN 'absent' ELSE 'observed' END AS outcome_state,
  len(list_filter(digits, lambda d: regexp_matches(d, '^[123]')))::INT AS aimed, coalesce(regexp_matches(digits[1], '^[123]'), false) AS return_aimed,
  coalesce(regexp_matches(digits[1], '^[0-3]?[789]'), false) AS return_deep, array_to_string(list_transform(kept, lambda s: left(s, 1)), '') AS types FROM q6)"""


POINTS_SQL = f"points AS (SELECT *, {FIRST} AS a, {SECOND} AS b, trim({LABEL}) AS label FROM lineitem)"


def charted(spark: SparkSession, d: str) -> DataFrame:
    """Line items as charted points: an order is a match, the part's parity its server."""
    return read(spark, d, "lineitem").select("*", F.expr(FIRST).alias("a"), F.expr(SECOND).alias("b"), F.trim(F.expr(LABEL)).alias("label"))


@registered(f"WITH {POINTS_SQL}, " + parse_sql("SELECT a AS cell, count(*) AS n FROM points GROUP BY 1") + """ SELECT cell, n, valid, lets, volley, shots, types, exceptional, issue, issue_at, direction_state, volley_state, rally_state, outcome_state, aimed, return_aimed, return_deep FROM parsed JOIN cells USING (cell)""")
def P12_states(spark: SparkSession, d: str) -> DataFrame:
    """The whole parse result: component states, issue and its place, shots with direction and depth."""
    cells = charted(spark, d).groupBy(F.col("a").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    p = cells.select("cell", "n", notation.parse_notation(F.col("cell")).alias("p"))
    shots = F.col("p.rally")
    first = F.get(shots, F.lit(0))
    types = F.array_join(F.transform(shots, lambda s: s["type"]), "")
    aimed = F.size(F.filter(shots, lambda s: charting.known(s["direction"])))
    kept = ("valid", "lets", "volley", "shots", "exceptional", "issue", "issue_at", *notation.STATES)
    return p.select("cell", "n", *[f"p.{k}" for k in kept], types.alias("types"), aimed.alias("aimed"), charting.known(first["direction"]).alias("return_aimed"), charting.known(first["depth"]).alias("return_deep"))


_ATTRIBUTES = {"regular_serve_cells": "served::INT", "known_serve_direction": "(direction <> '0')::INT", "serve_and_volley_attempts": "volley::INT", "parsed_shots": "shots", "shots_with_known_direction": "aimed", "parsed_returns": "(shots > 0)::INT", "returns_with_known_direction": "return_aimed::INT", "returns_with_known_depth": "return_deep::INT"}
_LISTED = {"cells": "'all'", "validity": "CASE WHEN valid THEN 'valid' ELSE 'invalid' END", "issue": "issue", "issue character": "issue || ':' || CASE WHEN issue_at < length(cell) THEN substr(cell, issue_at + 1, 1) ELSE '<end>' END", "outcome": "coalesce(outcome, exceptional)", **{s: s for s in N.STATES}}
COUNTERS = f"WITH {POINTS_SQL}, f AS (SELECT '1st' AS field, a AS cell, count(*) AS n FROM points WHERE a <> '' GROUP BY ALL UNION ALL SELECT '2nd', b, count(*) FROM points WHERE b <> '' GROUP BY ALL), " + parse_sql("SELECT DISTINCT cell FROM f") + ", e AS (SELECT * FROM f JOIN parsed USING (cell)), u AS (" + " UNION ALL ".join(
    [f"SELECT field, '{k}' AS kind, {v} AS name, n FROM e" for k, v in _LISTED.items()]
    + [f"SELECT field, 'attribute', '{k}', n * {v} FROM e" for k, v in _ATTRIBUTES.items()]
    + ["SELECT field, 'character', unnest(string_split(cell, '')), n FROM e", f"SELECT field, 'undocumented', 'cells', n * (translate(cell, '{charting.DOCUMENTED}', '') <> '')::INT FROM e"]
) + ") SELECT field, kind, name, sum(n)::BIGINT AS n FROM u WHERE name IS NOT NULL AND n > 0 GROUP BY ALL"


@registered(COUNTERS)
def G3_notation_counters(spark: SparkSession, d: str) -> DataFrame:
    return charting.notation_counters(charted(spark, d), {"1st": "a", "2nd": "b"})


def _metric_sql() -> str:
    """The decision table of a point as SQL, over points joined with the parse of both cells (p_ and s_ columns)."""
    def side(c: str) -> str:
        labels = "['0', '15', '30', '40', 'AD']"
        a, b = f"upper(split_part({c}, '-', 1))", f"upper(split_part({c}, '-', 2))"
        total = f"CASE WHEN list_contains({labels}, {a}) AND list_contains({labels}, {b}) THEN list_position({labels}, {a}) + list_position({labels}, {b}) WHEN regexp_matches({a}, '^[0-9]+$') AND regexp_matches({b}, '^[0-9]+$') THEN {a}::BIGINT + {b}::BIGINT END"
        return f"CASE WHEN len(string_split({c}, '-')) = 2 THEN CASE ({total}) % 2 WHEN 0 THEN 'deuce' WHEN 1 THEN 'ad' END END"

    ends = lambda p: f"({p}.shots > 0 OR coalesce({p}.outcome IN ('ace', 'unreturnable', 'serve_fault'), false))"
    into = "CASE WHEN a = 'V' AND b <> '' THEN false WHEN p.outcome = 'serve_fault' THEN false WHEN p.outcome IN ('ace', 'unreturnable') OR p.shots > 0 THEN true END"
    found = f"""m1 AS (SELECT points.*, {side('label')} AS side, p.special AND NOT (a = 'V' AND b <> '') AS out, {into} AS started, p.direction AS d1, s.direction AS d2, {ends('p')} AS end1, {ends('s')} AS end2,
  coalesce(p.outcome = 'ace', false) AS ace1, coalesce(s.outcome = 'ace', false) AS ace2, coalesce(s.outcome = 'serve_fault', false) AS fault2 FROM points JOIN parsed p ON p.cell = a JOIN parsed s ON s.cell = b),
m2 AS (SELECT *, NOT out AND coalesce(started, false) AS i, NOT out AND coalesce(NOT started, false) AND b <> '' AS t, NOT out AND coalesce(NOT started, false) AND b = '' AS o, NOT out AND started IS NULL AS u, coalesce(d1 IN ('4', '5', '6'), false) AND side IS NOT NULL AS k1, coalesce(d2 IN ('4', '5', '6'), false) AND side IS NOT NULL AS k2 FROM m1)"""
    counters = {
        "serve_pts": "NOT out", "first_in": "i", "second_in": "t", "aces": "(i AND end1 AND ace1) OR (t AND end2 AND ace2)", "dfs": "t AND end2 AND fault2", "resolved_first_serve_status": "i OR t OR o", "resolved_ace_status": "(i AND end1) OR (t AND end2)",
        "resolved_double_fault_status": "t AND end2", "excluded_exceptional_point": "out", "unresolved_first_in": "u", "unresolved_second_in": "o", "unresolved_ace": "u OR o OR (i AND NOT end1) OR (t AND NOT end2)", "unresolved_df": "u OR o OR (t AND NOT end2)",
        "unresolved_direction": "(i AND NOT k1) OR (t AND NOT k2) OR o", "unresolved_direction_1": "i AND NOT k1", "unresolved_direction_2": "(t AND NOT k2) OR o",
        **{f"direction_{n}_{court}_{name}": f"{here} AND side = '{court}' AND d{n} = '{digit}'" for n, here in ((1, "i"), (2, "t")) for court in ("deuce", "ad") for digit, name in DIRECTIONS.items()},
    }
    return f"{found}, metrics AS (SELECT {{keys}}, " + ", ".join(f"count(*) FILTER ({c}) AS {k}" for k, c in counters.items()) + " FROM m2 GROUP BY {group})"


METRICS = f"WITH {POINTS_SQL}, " + parse_sql("SELECT a AS cell FROM points UNION SELECT b FROM points") + ", " + _metric_sql()


@registered(METRICS.format(keys="l_suppkey", group="l_suppkey") + " SELECT * FROM metrics")
def G1_serve_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The 28 counters per supplier; the first cell decides whether the second one counts."""
    return charting.server_metrics(charted(spark, d), ["l_suppkey"], F.col("a"), F.col("b"), F.col("label"))


WINNERS = "w AS (SELECT l_suppkey AS m, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn, ((l_partkey + l_linenumber) % 2)::INT AS win FROM lineitem)"


def run_sql(name: str, winners: str) -> str:
    """Recursive simulation of states from a table (m, rn, win)."""
    return f"""{name} AS (SELECT DISTINCT m, 1::BIGINT AS rn, 0 AS s0, 0 AS s1, 0 AS g0, 0 AS g1, 0 AS p0, 0 AS p1, (m % 2)::INT AS srv, false AS tb, NULL::INT AS fs, false AS done FROM {winners}
UNION ALL SELECT m, rn + 1, s0 + (won AND win = 0)::INT, s1 + (won AND win = 1)::INT, CASE WHEN won AND NOT fin THEN 0 ELSE a0 END, CASE WHEN won AND NOT fin THEN 0 ELSE a1 END, CASE WHEN going THEN x ELSE 0 END, CASE WHEN going THEN y ELSE 0 END,
  CASE WHEN going THEN CASE WHEN tb AND (x + y) % 2 = 1 THEN 1 - srv ELSE srv END WHEN tb THEN 1 - fs ELSE 1 - srv END, CASE WHEN going THEN tb ELSE opens END, CASE WHEN going THEN fs WHEN opens THEN 1 - srv END, fin
FROM (SELECT *, won AND (CASE WHEN win = 0 THEN s0 ELSE s1 END) + 1 >= 2 AS fin FROM (SELECT *, NOT going AND NOT tb AND a0 = 6 AND a1 = 6 AS opens, NOT going AND (tb OR ((CASE WHEN win = 0 THEN a0 ELSE a1 END) >= 6 AND (CASE WHEN win = 0 THEN a0 - a1 ELSE a1 - a0 END) >= 2)) AS won
FROM (SELECT *, g0 + (NOT going AND win = 0)::INT AS a0, g1 + (NOT going AND win = 1)::INT AS a1 FROM (SELECT *, (CASE WHEN win = 0 THEN x ELSE y END) < CASE WHEN tb THEN 7 ELSE 4 END OR (CASE WHEN win = 0 THEN x - y ELSE y - x END) < 2 AS going
FROM (SELECT r.*, win, p0 + (win = 0)::INT AS x, p1 + (win = 1)::INT AS y FROM {name} r JOIN {winners} v ON v.m = r.m AND v.rn = r.rn WHERE NOT done))))))"""


def label_sql(own: str, other: str) -> str:
    name = lambda n: f"['0', '15', '30', '40'][least({n}, 3) + 1]"
    return f"CASE WHEN tb THEN {own} || '-' || {other} WHEN {own} >= 3 AND {other} >= 3 THEN CASE WHEN {own} = {other} THEN '40-40' WHEN {own} > {other} THEN 'AD-40' ELSE '40-AD' END ELSE {name(own)} || '-' || {name(other)} END"


OWN, OTHER = "(CASE WHEN srv = 0 THEN p0 ELSE p1 END)", "(CASE WHEN srv = 0 THEN p1 ELSE p0 END)"
STATES_SQL = f"WITH RECURSIVE {WINNERS}, {run_sql('r', 'w')}, states AS (SELECT r.*, win, {label_sql(OWN, OTHER)} AS label, {label_sql('p0', 'p1')} AS player_label FROM r JOIN w ON w.m = r.m AND w.rn = r.rn WHERE NOT done)"


def _states(spark: SparkSession, d: str) -> DataFrame:
    """A supplier's line items as the points of a match, played until it is decided."""
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("m"), "l_orderkey", "l_linenumber", "l_partkey", F.expr("cast((l_partkey + l_linenumber) % 2 as int)").alias("win"))
    return scoring.simulate(rows, "m", ["l_orderkey", "l_linenumber", "l_partkey"], "win", (F.col("m") % 2).cast("int"))


@registered(STATES_SQL + " SELECT m, rn::INT AS point, s0 AS sets_0, s1 AS sets_1, g0 AS games_0, g1 AS games_1, srv AS server, label, player_label, tb AS tiebreak, win AS winner FROM states")
def R1_simulation(spark: SparkSession, d: str) -> DataFrame:
    """States before each point, by the transition folded over a match's winners, and both forms of the label."""
    s = _states(spark, d)
    kept = [F.col(f"state.{k}") for k in ("sets_0", "sets_1", "games_0", "games_1", "server", "tiebreak")]
    return s.select("m", "point", *kept, scoring.label(F.col("state")).alias("label"), scoring.label(F.col("state"), False).alias("player_label"), "winner")


@registered(STATES_SQL + " SELECT m, max(s0) AS sets_0, max(s1) AS sets_1, count(DISTINCT s0 || '-' || s1 || '-' || g0 || '-' || g1) AS games, count(*) FILTER (tb) AS tiebreak_points, count(*) FILTER (label IN ('AD-40', '40-AD')) AS advantages FROM states GROUP BY 1")
def R2_set_summary(spark: SparkSession, d: str) -> DataFrame:
    """Sets, games, tiebreak points and advantages of each simulated match: what the end of a set does to the state."""
    s = _states(spark, d).withColumn("label", scoring.label(F.col("state")))
    return s.groupBy("m").agg(F.max("state.sets_0").alias("sets_0"), F.max("state.sets_1").alias("sets_1"), F.count_distinct("state.sets_0", "state.sets_1", "state.games_0", "state.games_1").alias("games"), F.count_if("state.tiebreak").alias("tiebreak_points"), F.count_if(F.col("label").isin("AD-40", "40-AD")).alias("advantages"))


#: A damaged tape: what happens to the row at point 20 + m % 30, by m % 8.
AT = "point = 20 + m % 30"
DAMAGE = {"label": f"CASE WHEN m % 8 = 1 AND {AT} THEN '30-15' ELSE label END", "server": f"CASE WHEN m % 8 = 2 AND {AT} THEN 1 - server ELSE server END", "games_0": f"CASE WHEN m % 8 = 3 AND {AT} THEN games_0 + 1 ELSE games_0 END", "winner": f"CASE WHEN m % 8 = 5 AND {AT} THEN 1 - winner ELSE winner END"}
KEPT = f"NOT (m % 8 = 4 AND {AT})"
TAPE_SQL = STATES_SQL + f", t0 AS (SELECT m, rn::INT AS point, s0 AS sets_0, s1 AS sets_1, g0 AS games_0, g1 AS games_1, srv AS server, label, win AS winner FROM states), tape AS (SELECT m, point, sets_0, sets_1, games_1, " + ", ".join(f"{v} AS {k}" for k, v in DAMAGE.items()) + f" FROM t0 WHERE {KEPT}), v AS (SELECT m, point::BIGINT AS rn, winner AS win FROM tape), " + run_sql("z", "v") + f""",
due AS (SELECT *, {label_sql(OWN, OTHER)} AS due_label FROM z),
judged AS (SELECT t.*, lag(point) OVER q AS before, lag(concat_ws(' ', sets_0, sets_1, games_0, games_1, label, server)) OVER q AS shown_before, CASE WHEN lag(point) OVER q IS NOT NULL AND point <> lag(point) OVER q + 1 THEN 'point gap' WHEN (sets_0, sets_1, games_0, games_1) IS DISTINCT FROM (s0, s1, g0, g1) THEN 'set/game score mismatch'
  WHEN server IS DISTINCT FROM srv THEN 'server mismatch' WHEN label IS DISTINCT FROM due_label THEN 'point-score mismatch' WHEN done THEN 'after completion' END AS code FROM tape t LEFT JOIN due ON due.m = t.m AND due.rn = t.point WINDOW q AS (PARTITION BY t.m ORDER BY point)),
verdicts AS (SELECT m, count(*) AS points, arg_min(code, point) FILTER (code IS NOT NULL) AS code, min(point) FILTER (code IS NOT NULL) AS failed_at, max(point) AS last FROM judged GROUP BY 1)"""


def _tape(spark: SparkSession, d: str) -> DataFrame:
    t = scoring.tape(_states(spark, d), "m")
    return t.where(KEPT).withColumns({k: F.expr(v).cast("int") if k != "label" else F.expr(v) for k, v in DAMAGE.items()})


@registered(TAPE_SQL + " SELECT v.m, points, coalesce(code, CASE WHEN z.done THEN 'complete' ELSE 'incomplete' END) AS verdict, failed_at FROM verdicts v LEFT JOIN z ON z.m = v.m AND z.rn = v.last + 1")
def R3_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    """Strict reconstruction of a damaged tape, each row held against the transition of the row before it."""
    return scoring.reconstruct(_tape(spark, d), "m", "point")


@registered(TAPE_SQL + ", f AS (SELECT j.code, j.m, j.point, j.shown_before, concat_ws(' ', sets_0, sets_1, games_0, games_1, label, server) AS now FROM judged j JOIN verdicts v ON v.m = j.m AND v.failed_at = j.point) SELECT code, count(*) AS matches, min(m) AS example, arg_min(point, m) AS ordinal, arg_min(shown_before, m) AS before, arg_min(now, m) AS now FROM f GROUP BY 1")
def R4_failure_profile(spark: SparkSession, d: str) -> DataFrame:
    return scoring.failure_examples(_tape(spark, d), "m", "point")


@registered(f"WITH x AS (SELECT l_orderkey, l_linenumber, (l_partkey % 4 - 1)::INT AS s0, (l_suppkey % 8)::INT AS g0, (l_linenumber % 8)::INT AS g1, l_quantity > 40 AS tb, CASE WHEN l_tax > 0.04 THEN 1 END AS fs FROM lineitem) SELECT l_orderkey, l_linenumber, concat_ws(', ', CASE WHEN s0 < 0 THEN 'negative score' END, CASE WHEN tb AND NOT (g0 = 6 AND g1 = 6) THEN 'tiebreak away from six all' END, CASE WHEN NOT tb AND fs IS NOT NULL THEN 'first server without tiebreak' END, CASE WHEN tb AND fs IS NULL THEN 'tiebreak without first server' END) AS broken FROM x")
def F13_state_invariants(spark: SparkSession, d: str) -> DataFrame:
    zero = F.lit(0)
    s = scoring.state(F.col("l_partkey") % 4 - 1, zero, F.col("l_suppkey") % 8, F.col("l_linenumber") % 8, zero, zero, zero, F.col("l_quantity") > 40, F.when(F.col("l_tax") > 0.04, 1), F.lit(False))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.alias("s"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join(scoring.violations(F.col("s")), ", ").alias("broken"))


