import random

import pytest
from pyspark.sql import functions as F

from pointweave.operators import scoring

SCHEMA = "m string, point int, sets_0 int, sets_1 int, games_0 int, games_1 int, server int, label string, winner int"


def played(spark, winners, best_of=3, tiebreak=True, server=0):
    rows = spark.createDataFrame([("m", i, w) for i, w in enumerate(winners)], "m string, i int, w int")
    return scoring.simulate(rows, "m", ["i"], "w", F.lit(server), best_of, tiebreak)


def last(spark, winners, **k):
    """The state after all winners: that before one point more."""
    return played(spark, [*winners, 0], **k).orderBy(F.desc("point")).first()["state"]


def test_a_game_and_its_labels(spark):
    s = last(spark, [0] * 4)
    assert (s["games_0"], s["games_1"], s["points_0"], s["points_1"], s["server"]) == (1, 0, 0, 0, 1)
    labels = [r["label"] for r in scoring.tape(played(spark, [0, 1, 0, 1, 0, 1, 0, 1, 1, 0]), "m").orderBy("point").collect()]
    assert labels == ["0-0", "15-0", "15-15", "30-15", "30-30", "40-30", "40-40", "AD-40", "40-40", "40-AD"]


def test_sets_and_the_end(spark):
    s = last(spark, [0] * 24)
    assert (s["sets_0"], s["games_0"], s["completed"]) == (1, 0, False)
    assert played(spark, [0] * 60).count() == 48  # a completed match has no more points
    assert played(spark, [0] * 90, best_of=5).count() == 72
    with pytest.raises(ValueError, match="best_of"):
        played(spark, [0], best_of=4)


def games(*winners):
    return [w for g in winners for w in [g] * 4]


def test_tiebreak(spark):
    six_all = games(*[0, 1] * 6)
    s = last(spark, six_all)
    assert (s["games_0"], s["games_1"], s["tiebreak"], s["first_server"], s["server"]) == (6, 6, True, 0, 0)
    assert last(spark, [*six_all, *[0] * 6])["tiebreak"]
    s = last(spark, [*six_all, *[0] * 7])
    assert (s["sets_0"], s["games_0"], s["games_1"], s["tiebreak"], s["server"]) == (1, 0, 0, False, 1)
    s = last(spark, [*six_all, *[0, 1] * 6, 0])
    assert (s["points_0"], s["points_1"], s["tiebreak"]) == (7, 6, True)
    s = last(spark, six_all, tiebreak=False)
    assert (s["games_0"], s["tiebreak"], s["points_0"]) == (6, False, 0)
    servers = [r["state"]["server"] for r in played(spark, [*six_all, 0, 1, 0, 1, 0]).orderBy("point").collect()][-5:]
    assert servers == [0, 1, 1, 0, 0]


def verdict(spark, rows):
    r = scoring.reconstruct(spark.createDataFrame(rows, SCHEMA), "m", "point").first()
    return r["verdict"], r["failed_at"]


def test_strict_reconstruction(spark):
    rng = random.Random(4)
    rows = [tuple(r) for r in scoring.tape(played(spark, [rng.randrange(2) for _ in range(400)]), "m").orderBy("point").collect()]
    assert verdict(spark, rows) == ("complete", None) and verdict(spark, rows[:30]) == ("incomplete", None)
    assert verdict(spark, rows[:10] + rows[11:]) == ("point gap", 12)

    def with_row(k, **new):
        names = [f.split(" ")[0] for f in SCHEMA.split(", ")]
        changed = dict(zip(names, rows[k], strict=True)) | new
        return [*rows[:k], tuple(changed.values()), *rows[k + 1 :]]

    assert verdict(spark, with_row(20, games_0=9)) == ("set/game score mismatch", 21)
    assert verdict(spark, with_row(20, sets_1=1, server=1 - rows[20][6])) == ("set/game score mismatch", 21)
    assert verdict(spark, with_row(20, server=1 - rows[20][6], label="x"))[0] == "server mismatch"
    assert verdict(spark, with_row(20, label=None)) == ("point-score mismatch", 21)
    assert verdict(spark, with_row(0, label="15-0")) == ("point-score mismatch", 1)
    done = scoring.judged(spark.createDataFrame(rows, SCHEMA), "m", "point").select(scoring.advance(F.col("pw_due"), F.col("winner")).alias("s"), "point").orderBy(F.desc("point")).first()["s"]
    more = ("m", len(rows) + 1, done["sets_0"], done["sets_1"], done["games_0"], done["games_1"], done["server"], "0-0", 0)
    assert verdict(spark, [*rows, more]) == ("after completion", len(rows) + 1)


def test_invariants(spark):
    s = scoring.state(F.col("a"), F.lit(0), F.col("g"), F.lit(6), F.lit(0), F.lit(0), F.lit(0), F.col("t"), F.col("f"), F.lit(False))
    rows = spark.createDataFrame([(0, 6, True, 1), (-1, 6, False, None), (0, 5, True, 0), (0, 6, True, None), (0, 0, False, 1)], "a int, g int, t boolean, f int")
    got = [r[0] for r in rows.select(scoring.violations(s)).collect()]
    assert got == [[], ["negative score"], ["tiebreak away from six all"], ["tiebreak without first server"], ["first server without tiebreak"]]
