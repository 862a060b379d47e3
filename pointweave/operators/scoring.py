"""Score states: the transition of a point, simulation, and validation of a tape by its neighbours.

A state is a struct of sets_0, sets_1, games_0, games_1, points_0, points_1, server, tiebreak, first_server (of the
tiebreak, else null) and completed. Sides are 0 and 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.functions.notation import bound
from pointweave.functions.text import LABELS

STATE = "struct<sets_0:int,sets_1:int,games_0:int,games_1:int,points_0:int,points_1:int,server:int,tiebreak:boolean,first_server:int,completed:boolean>"
#: Points of a tiebreak and games of a set that win it, with a margin of two.
TIEBREAK_POINTS, SET_GAMES, GAME_POINTS, MARGIN = 7, 6, 4, 2
#: Verdicts of a tape's first wrong row, in the order in which they are judged.
FAILURES = ("point gap", "set/game score mismatch", "server mismatch", "point-score mismatch", "after completion")


def state(sets_0: Column, sets_1: Column, games_0: Column, games_1: Column, points_0: Column, points_1: Column, server: Column, tiebreak: Column, first_server: Column, completed: Column) -> Column:
    names = [f.split(":")[0] for f in STATE.removeprefix("struct<").removesuffix(">").split(",")]
    kinds = [f.split(":")[1] for f in STATE.removeprefix("struct<").removesuffix(">").split(",")]
    values = (sets_0, sets_1, games_0, games_1, points_0, points_1, server, tiebreak, first_server, completed)
    return F.struct(*(v.cast(k).alias(n) for v, n, k in zip(values, names, kinds, strict=True)))


def start(server: Column) -> Column:
    zero, no = F.lit(0), F.lit(False)
    return state(zero, zero, zero, zero, zero, zero, server, no, F.lit(None), no)


def sets_to_win(best_of: int) -> int:
    if best_of not in (3, 5):
        raise ValueError(f"best_of is 3 or 5, not {best_of}")
    return best_of // 2 + 1


def advance(s: Column, winner: Column, best_of: int = 3, tiebreak_at_six_all: bool = True) -> Column:
    """The state after a point that ``winner`` (0 or 1) won; a completed state stays as it is.

    Games go to four points and sets to six games, both by two; at six all a tiebreak to seven by two, whose serve
    changes after each odd point and after which the side serves that did not begin it.
    """
    needed = sets_to_win(best_of)
    zero, no = F.lit(0), F.lit(False)
    one_of = [(winner == side).cast("int") for side in (0, 1)]

    def pointed(x: Column) -> Column:
        p0, p1 = x["p0"], x["p1"]
        margin = F.when(winner == 0, p0 - p1).otherwise(p1 - p0)
        most = F.when(winner == 0, p0).otherwise(p1)
        goal = F.when(s["tiebreak"], TIEBREAK_POINTS).otherwise(GAME_POINTS)
        going = (most < goal) | (margin < MARGIN)
        serving = F.when(s["tiebreak"] & ((p0 + p1) % 2 == 1), 1 - s["server"]).otherwise(s["server"])
        same = state(s["sets_0"], s["sets_1"], s["games_0"], s["games_1"], p0, p1, serving, s["tiebreak"], s["first_server"], no)
        return F.when(going, same).otherwise(bound(F.struct((s["games_0"] + one_of[0]).alias("g0"), (s["games_1"] + one_of[1]).alias("g1")), gamed))

    def gamed(g: Column) -> Column:
        g0, g1 = g["g0"], g["g1"]
        ahead = F.when(winner == 0, g0 - g1).otherwise(g1 - g0)
        own = F.when(winner == 0, g0).otherwise(g1)
        server = F.when(s["tiebreak"], 1 - s["first_server"]).otherwise(1 - s["server"])
        opens = F.lit(tiebreak_at_six_all) & ~s["tiebreak"] & (g0 == SET_GAMES) & (g1 == SET_GAMES)
        won = s["tiebreak"] | ((own >= SET_GAMES) & (ahead >= MARGIN))
        done = won & (F.when(winner == 0, s["sets_0"]).otherwise(s["sets_1"]) + 1 >= needed)
        sets = [s[f"sets_{k}"] + F.when(won, one_of[k]).otherwise(0) for k in (0, 1)]
        games = [F.when(won & ~done, 0).otherwise(g) for g in (g0, g1)]
        return state(*sets, *games, zero, zero, server, opens, F.when(opens, server), done)

    points = F.struct((s["points_0"] + one_of[0]).alias("p0"), (s["points_1"] + one_of[1]).alias("p1"))
    return F.when(s["completed"], s).otherwise(bound(points, pointed))


def label(s: Column, server_first: bool = True) -> Column:
    """The score of the game that is played: tiebreak points as numbers, else 0, 15, 30, 40, 40-40, AD-40 or 40-AD."""
    swap = (s["server"] == 1) if server_first else F.lit(False)
    own, other = F.when(swap, s["points_1"]).otherwise(s["points_0"]), F.when(swap, s["points_0"]).otherwise(s["points_1"])
    names = F.array(*map(F.lit, LABELS))
    name = lambda n: F.get(names, F.least(n, F.lit(3)))
    even = F.when(own == other, "40-40").when(own > other, "AD-40").otherwise("40-AD")
    ordinary = F.when((own >= 3) & (other >= 3), even).otherwise(F.concat_ws("-", name(own), name(other)))
    return F.when(s["tiebreak"], F.concat_ws("-", own.cast("string"), other.cast("string"))).otherwise(ordinary)


def violations(s: Column) -> Column:
    """The invariants that a state breaks, as an array of names."""
    numbers = [s[f"{k}_{side}"] for k in ("sets", "games", "points") for side in (0, 1)]
    negative = F.lit(False)
    for n in numbers:
        negative = negative | (n < 0)
    tied = (s["games_0"] == SET_GAMES) & (s["games_1"] == SET_GAMES)
    broken = {"negative score": negative, "tiebreak away from six all": s["tiebreak"] & ~tied, "first server without tiebreak": ~s["tiebreak"] & s["first_server"].isNotNull(), "tiebreak without first server": s["tiebreak"] & s["first_server"].isNull()}
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in broken.items()]))


def simulate(points: DataFrame, match: str, order: list[str], winner: str, server: Column, best_of: int = 3, tiebreak_at_six_all: bool = True) -> DataFrame:
    """(match, point, state before it, winner) for each match's winners in order, up to the point that completes it.

    One match's points meet in one row: a match is short whatever the size of the table.
    """
    rows = points.groupBy(match).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(winner).cast("int").alias("pw_w")))).alias("all"), F.min(server).alias("first"))
    winners = F.transform("all", lambda x: x["pw_w"])
    states = F.aggregate(
        F.slice(winners, 1, F.greatest(F.size(winners) - 1, F.lit(0))),
        F.array(start(F.col("first"))),
        lambda acc, w: F.concat(acc, F.array(advance(F.element_at(acc, -1), w, best_of, tiebreak_at_six_all))),
    )
    told = rows.select(match, F.posexplode(F.arrays_zip(states.alias("state"), winners.alias("winner"))).alias("at", "x"))
    return told.where("not x.state.completed").select(match, (F.col("at") + 1).alias("point"), "x.state", "x.winner")


def tape(states: DataFrame, match: str) -> DataFrame:
    """States as a source has them: numbers, the server-first label, server and winner."""
    s = {k: F.col(f"state.{k}") for k in ("sets_0", "sets_1", "games_0", "games_1", "server")}
    return states.select(match, "point", *[c.alias(k) for k, c in s.items()], label(F.col("state")).alias("label"), "winner")


def read_state(row: DataFrame, match: str, ordinal: str) -> DataFrame:
    """Add ``state`` to tape rows. A label tells all that the rules need of a game's points; who began a tiebreak is the
    server of its first row."""
    tied = (F.col("games_0") == SET_GAMES) & (F.col("games_1") == SET_GAMES)
    first = F.first("server").over(W.partitionBy(match, "sets_0", "sets_1", "games_0", "games_1").orderBy(ordinal))
    parts = F.split("label", "-")
    names = F.array(*map(F.lit, LABELS))
    own, other = ((F.array_position(names, F.get(parts, F.lit(k))) - 1).cast("int") for k in (0, 1))
    raw = [F.get(parts, F.lit(k)).try_cast("int") for k in (0, 1)]
    mine, theirs = F.when(tied, raw[0]).otherwise(own), F.when(tied, raw[1]).otherwise(other)
    swap = F.col("server") == 1
    zero, one = F.when(swap, theirs).otherwise(mine), F.when(swap, mine).otherwise(theirs)
    whole = state(F.col("sets_0"), F.col("sets_1"), F.col("games_0"), F.col("games_1"), zero, one, F.col("server"), tied, F.when(tied, first), F.lit(False))
    return row.withColumn("state", whole)


def judged(rows: DataFrame, match: str, ordinal: str, best_of: int = 3) -> DataFrame:
    """Add ``code``: null where a row follows from the one before it, else the first of FAILURES that it shows.

    By induction a match is sound up to its first code, so nothing is carried from row to row. The first row is held
    against the start with its own server; a row behind a complete match is wrong whatever it says.
    """
    w = W.partitionBy(match).orderBy(ordinal)
    seen = read_state(rows, match, ordinal)
    told = [F.lag(c).over(w) for c in ("state", "winner", "point")]
    seen = seen.withColumns({"pw_state": told[0], "pw_winner": told[1], "pw_point": told[2], "pw_first": F.row_number().over(w) == 1})
    due = F.when(F.col("pw_first"), start(F.col("server"))).otherwise(advance(F.col("pw_state"), F.col("pw_winner"), best_of))
    seen = seen.withColumn("pw_due", due)
    differs = lambda *names: ~F.array(*[F.col(n) for n in names]).eqNullSafe(F.array(*[F.col(f"pw_due.{n}") for n in names]))
    code = (
        F.when(~F.col("pw_first") & ~F.col("point").eqNullSafe(F.col("pw_point") + 1), FAILURES[0])
        .when(differs("sets_0", "sets_1", "games_0", "games_1"), FAILURES[1])
        .when(differs("server"), FAILURES[2])
        .when(~F.col("label").eqNullSafe(label(F.col("pw_due"))), FAILURES[3])
        .when(F.col("pw_due.completed"), FAILURES[4])
    )
    return seen.withColumn("code", code).drop("pw_state", "pw_winner", "pw_point", "pw_first")


def reconstruct(rows: DataFrame, match: str, ordinal: str, best_of: int = 3) -> DataFrame:
    """One row per match: points, verdict (complete, incomplete or a failure) and the ordinal of its first wrong row."""
    after = advance(F.col("pw_due"), F.col("winner"), best_of)
    told = judged(rows, match, ordinal, best_of).withColumn("pw_done", after["completed"])
    g = told.groupBy(match).agg(
        F.count(F.lit(1)).alias("points"),
        F.min(F.when(F.col("code").isNotNull(), F.struct(ordinal, "code"))).alias("bad"),
        F.max_by("pw_done", ordinal).alias("done"),
    )
    verdict = F.coalesce(F.col("bad.code"), F.when(F.col("done"), "complete").otherwise("incomplete"))
    return g.select(match, "points", verdict.alias("verdict"), F.col(f"bad.{ordinal}").alias("failed_at"))


def failure_examples(rows: DataFrame, match: str, ordinal: str, best_of: int = 3) -> DataFrame:
    """Per kind of failure how many matches have it, and of the least such match the wrong row and the one before."""
    w = W.partitionBy(match).orderBy(ordinal)
    shown = F.concat_ws(" ", "sets_0", "sets_1", "games_0", "games_1", "label", "server")
    told = judged(rows, match, ordinal, best_of).withColumns({"now": shown, "before": F.lag(shown).over(w)})
    first = told.where("code is not null").groupBy(match).agg(F.min_by(F.struct("code", F.col(ordinal).alias("ordinal"), "before", "now"), ordinal).alias("f"))
    return first.groupBy("f.code").agg(F.count(F.lit(1)).alias("matches"), F.min_by(F.struct(match, "f.ordinal", "f.before", "f.now"), match).alias("e")).select("code", "matches", F.col(f"e.{match}").alias("example"), "e.ordinal", "e.before", "e.now")
