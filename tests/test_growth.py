"""What a step costs as its input grows: rows that are dealt, draws that are worked out where their values are."""

import random
import re
import statistics

import numpy as np
from pyspark.sql import functions as F

from pointweave.functions import metrics, notation, text
from pointweave.operators import charting, counting, pairs, resampling, studies
from pointweave.plans import registry


def test_equal_profiles_meet_once(spark):
    """Forty times as many members of the same profiles deal the same rows; medians are those of all pairs."""
    rng = random.Random(4)
    kinds = [([rng.random(), rng.random()], [rng.random(), rng.random()]) for _ in range(6)]
    schema = "g string, who int, n int, left_a array<double>, right_a array<double>"
    dealt = []
    for copies in (1, 40):
        rows = [("x", c * 6 + k, 3, *kinds[k]) for c in range(copies) for k in range(6)]
        members = spark.createDataFrame(rows, schema)
        dealt.append(pairs.dealt(members, ["g"], "n", ["a"], [2]).select(F.sum(F.size("left_m") * F.size("right_m"))).first()[0])
        far = [sum(abs(x - y) for x, y in zip(a[3], b[4], strict=True)) / 2 for a in rows for b in rows if a[1] != b[1]]
        got = pairs.pair_medians(members, ["g"], ["g"], "who", "n", {"a": (2, 2.0)}, [2]).first()
        assert (got["pairs"], got["median"]) == (len(far), statistics.median(far))
    assert dealt == [36, 36]


def test_draws_on_arrays_are_those_of_columns(spark):
    rows = [(random.Random(i).randrange(1 << 28), i % 7, i + 1, i % 11 + 1) for i in range(300)]
    df = spark.createDataFrame(rows, "g long, rep long, slot long, n long")
    want = [r[0] for r in df.select(resampling.draw(F.col("g"), F.col("rep"), F.col("slot"), F.col("n"))).collect()]
    got = [int(resampling.drawn(np.array([g]), rep, np.array([slot]), np.array([n]))[0]) for g, rep, slot, n in rows]
    assert got == want


def test_redrawn_medians(spark, monkeypatch):
    """Tasks that hold a few matches at once, against drawing one player after another."""
    monkeypatch.setattr(studies, "REDRAWN_AT_ONCE", 20)
    rng = random.Random(8)
    rows = []
    for i in range(30):
        halves = [[[rng.randrange(1, 9) for _ in studies.COUNTERS] for _ in range(rng.randrange(2, 7))] for _ in range(2)]
        rows.append((rng.choice(["x", "y", None]), min(map(len, halves)), *[v for h in halves for v in (rng.randrange(1 << 28), len(h), [c for m in h for c in m])]))
    df = spark.createDataFrame(rows, "cell string, n int, left_number long, left_n long, left array<long>, right_number long, right_n long, right array<long>").repartition(3)
    want = {}
    for cell, n, *halves in rows:
        for rep in range(3):
            sums = {}
            for h, (number, size, flat) in zip(("left", "right"), (halves[:3], halves[3:]), strict=True):
                picks = [int(resampling.drawn(np.array([number]), rep, np.array([j + 1]), size)[0]) - 1 for j in range(size)]
                sums[h] = np.array(flat).reshape(size, -1)[picks].sum(axis=0).reshape(-1, 1)
            for f, t in studies.family_distances(sums).items():
                for least in (2, 4):
                    if n >= least:
                        want.setdefault((cell, f, rep, least), []).append(float(t[0]))
    got = studies.redrawn_medians(df, ["cell"], (2, 4), 3).collect()
    assert {(r["cell"], r["family"], r["rep"], r["least_matches"]): r["median"] for r in got} == {k: statistics.median(v) for k, v in want.items()}


def test_a_task_counts_equal_values_once(monkeypatch):
    monkeypatch.setattr(counting, "HELD", 10)
    tally = counting.Tally({("k",): [(0, 0, True)]}, 9)
    for _ in range(50):
        tally.add(("k",), 1, np.array([0.25, 0.5, 0.5]))
    told = next(tally.frames(["key"]))
    assert list(zip(told["at"], told["c"], strict=True)) == [(0.25, 50), (0.5, 100)] and len(tally.values[("k",), 1, 0, 0, True]) < 10


def test_draws_go_by_spans_of_slots(spark, monkeypatch):
    """Spans, not rows, are what draws are worked out from, and every slot of every span draws once per replicate."""
    monkeypatch.setattr(resampling, "SPAN", 300)
    rows = spark.range(1000).select(F.lit("g").alias("g"), F.col("id").alias("place"), F.lit(1000).cast("long").alias("n"), F.lit(77).cast("long").alias("number"))
    counts = resampling.block_counts(rows, "g", 5)
    assert "MapInPandas" in counts._jdf.queryExecution().executedPlan().toString()
    want = {}
    for b in range(5):
        for at in (resampling.drawn(np.int64(77), b, np.arange(1, 1001), 1000) - 1) // resampling.BLOCK:
            want[b, int(at)] = want.get((b, int(at)), 0) + 1
    assert {(r["b"], r["block"]): r["m"] for r in counts.collect()} == want


def test_many_small_ranges_share_a_frame(monkeypatch):
    """Each frame costs more than its rows: 300 keys of one task, null ones too, are not 300 frames, nor is a frame endless."""
    tally = counting.Tally(None, 9)
    keys = [(k, rep) for k in ("x", None) for rep in range(150)]
    for key in keys:
        tally.add(key, 1, np.array([0.25, 0.5, 0.5]))
    one, *more = tally.frames(["key", "rep"])
    assert not more and one["c"].tolist() == [1, 2] * 300 and one["at"].tolist() == [128.0, 256.0] * 300
    assert list(zip(one["key"], one["rep"], strict=True)) == [k for k in keys for _ in range(2)]
    monkeypatch.setattr(counting, "FRAME", 100)
    frames = list(tally.frames(["key", "rep"]))
    assert len(frames) == 6 and sum(map(len, frames)) == 600


def test_wide_stages_are_compiled(spark):
    """No generated method of the notation metrics is too long for the JVM's compiler, which leaves longer ones interpreted."""
    registry.queries()["G1_serve_metrics"](spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_brief_parse(spark):
    """The fields that counters read are those of the whole parse, without a lambda over shots in the plan."""
    rng = random.Random(5)
    shot = lambda: rng.choice(notation.TYPES) + "".join(rng.choice(notation.MODIFIERS) for _ in range(rng.choice((0, 0, 1, 2, 3)))) + rng.choice(("", "1", "07", "3"))
    cells = ["", None, *notation.EXCEPTIONAL, "4*", "c6+#", "5nx", "0", "4f--1@", "5f1b--2f*"]
    cells += [rng.choice(("", "c", "~")) + rng.choice(notation.SERVES) + rng.choice(("", "+")) + "".join(shot() for _ in range(rng.randrange(5))) + rng.choice(("", "n@", "*", "#", "C", "d", "w", "@x")) for _ in range(500)]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    kept = ("direction", "shots", "outcome", "exceptional")
    whole = df.withColumn("p", notation.parse_notation(F.col("c"))).select("c", *[f"p.{k}" for k in kept])
    brief = notation.parse_briefly(df, "c", "p").select("c", *[f"p.{k}" for k in kept])
    assert whole.collect() == brief.collect()
    assert "lambda" not in metrics.parsed_cells(df, F.col("c"), F.col("c"), F.lit("0-0"))._jdf.queryExecution().optimizedPlan().toString()


def test_identities_look_characters_up(spark):
    """No pattern of an identity's expression lists the characters beyond ASCII."""
    df = spark.createDataFrame([("Ćirić ½ ﬁn  ŉ",), ("plain",), (None,)], "name string")
    told = df.select(text.normalise_identity(F.col("name")).alias("x"))
    assert [r["x"] for r in told.collect()] == ["ciric 12 fin n", "plain", None]
    patterns = re.findall(r"RLIKE\(name#\d+, ([^)]*)\)|name#\d+ RLIKE (\S+)", told._jdf.queryExecution().optimizedPlan().toString(), re.I)
    assert patterns and max(len(x) for p in patterns for x in p) < 100


def test_reconciled_sides_are_computed_once(spark):
    """Both sides of a reconciliation read the written counters: neither parses points again."""
    for name in ("G10_reconcile_overview", "O4_examples"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_partkey" not in plan and plan.count("serve_pts") + plan.count("direction_1") > 0


def test_counted_parse(spark):
    """What counters read of a cell is what the whole parse tells, and counters' plan has no lambda, which Spark does not compile."""
    rng = random.Random(6)
    shot = lambda: rng.choice(notation.TYPES) + "".join(rng.choice(notation.MODIFIERS) for _ in range(rng.choice((0, 0, 1, 2, 3, 5)))) + rng.choice(("", "1", "07", "3", "0"))
    cells = ["", None, *notation.EXCEPTIONAL, "4*", "c6+#", "5nx", "0", "cc", "4f--1@", "5f1b--2f*", "6f-+=+-1", "4f^^"]
    cells += [rng.choice(("", "c", "~")) + rng.choice(notation.SERVES) + rng.choice(("", "+")) + "".join(shot() for _ in range(rng.randrange(5))) + rng.choice(("", "n@", "*", "#", "C", "d", "w", "@x")) for _ in range(800)]
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    kept = ("direction", "shots", "outcome", "exceptional", "issue", "issue_at", "volley", *notation.STATES)
    whole = df.withColumn("p", notation.parse_notation(F.col("c"))).select("c", *[f"p.{k}" for k in kept], "p.rally").collect()
    for w, b in zip(whole, notation.parse_counted(df, "c").collect(), strict=True):
        aimed = [s["direction"] not in (None, "0") for s in w["rally"]]
        deep = bool(w["rally"]) and w["rally"][0]["depth"] not in (None, "0")
        assert ([w[k] for k in kept], sum(aimed), aimed[:1] == [True], deep) == ([b[k] for k in kept], b["aimed"], b["return_aimed"], b["return_deep"]), w["c"]
    plan = charting.notation_counters(df, {"1st": "c"})._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan


def test_draws_of_a_grid():
    """Groups of one size at once draw what each of them draws alone."""
    for n, reps in ((1, 3), (5, 4), (700, 2)):
        numbers = np.array([0, 77, (1 << 28) - 1])
        got = resampling.drawn_grid(numbers, np.arange(reps), n).reshape(3, reps, n)
        for g, number in enumerate(numbers):
            for rep in range(reps):
                assert (got[g, rep] + 1 == resampling.drawn(number, rep, np.arange(1, n + 1), n)).all()


def test_redraws_leave_tasks_near_the_median_only(spark, monkeypatch):
    """one pass over all replicates, whose distances become rows only where the median should lie; a median that lies
    beside the span that a part of the players told is found all the same."""
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        halves = [[[rng.randrange(1, 30) for _ in studies.COUNTERS] for _ in range(3)] for _ in range(2)]
        rows.append(("x", 3, *[v for h in halves for v in (rng.randrange(1 << 28), 3, [c for m in h for c in m])]))
    df = spark.createDataFrame(rows, "cell string, n int, left_number long, left_n long, left array<long>, right_number long, right_n long, right array<long>").repartition(2).cache()
    seen, real = [], counting.written
    monkeypatch.setattr(counting, "written", lambda df: seen.append(out := real(df)) or out)
    want = sorted(map(tuple, studies.redrawn_medians(df, ["cell"], (2,), 2).collect()))
    assert seen[0].where("at is not null").count() < 1200 * 3 * 2 / 2 and seen[0].agg(F.sum("c")).first()[0] == 1200 * 3 * 2
    monkeypatch.setattr(counting, "SURE", 0)
    assert sorted(map(tuple, studies.redrawn_medians(df, ["cell"], (2,), 2).collect())) == want


def test_contexts_are_not_rows(spark):
    """a record is shuffled once for all seven dimensions, and halves are those of records that stand in a row per dimension."""
    d = "/root/testdata/sf0.001"
    from pointweave.plans import studies as plans

    groups, r = ["tour", "dimension", "stratum", "player"], plans.records(spark, d)
    one = studies.halved_records(r, groups, studies.contexts(), ["chronological", "alternating"], 1, True)
    assert "explode" not in one._jdf.queryExecution().optimizedPlan().toString().lower()
    many = studies.halved_records(studies.strata(r), groups, {}, ["chronological", "alternating"], 1, True)
    assert one.count() > 50 and sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_rounded_distances_tell_most_pairs_apart():
    """counts and values of two blocks are those of all distances in doubles, with spans that touch, are empty or
    open, equal profiles and few of them."""
    rng = np.random.default_rng(5)
    for size, by, na, nb in ((3, 3.0, 90, 103), (6, 4.0, 70, 81), (2, 2.0, 3, 5), (3, 3.0, 100, 90)):
        one, two = (np.ascontiguousarray(rng.normal(0.4, 0.05, (size, n))) for n in (na, nb))
        if na == 100:
            one, two = np.round(one, 2), np.round(two, 2)
        far = pairs.distances(one, two, by).ravel()
        a, b, c = np.quantile(far, [0.3, 0.5, 0.5001])
        for spans in ([(b, c)], [(0.0, a), (a, b), (c, np.inf)], [(b, b)], [(5.0, 6.0)]):
            for most in (1, 3):
                left, right = (rng.integers(1, most + 1, n) for n in (na, nb))
                told = []
                for parts in (0, 64) if spans[-1][1] < np.inf else (0,):
                    got, want = (counting.Spanned({("k",): spans}, parts) for _ in range(2))
                    pairs.counted_apart(got, ("k",), 1, one, two, left, right, by)
                    want.add(("k",), 1, far, np.multiply.outer(left, right).ravel().astype(float))
                    told = [sorted((r.segment, -1.0 if r.at != r.at else r.at, r.c) for f in x.frames(["key"]) for r in f.itertuples() if r.segment >= 0) for x in (got, want)]
                    assert told[0] == told[1]
