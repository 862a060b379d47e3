"""Selection by counting and medians of all pairs, against sorting everything, with few rows and parts a pass."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from pointweave.operators import pairs, selection


def by_sorting(rows):
    groups = {}
    for g, v in rows:
        if v is not None and v == v:
            groups.setdefault(g, []).append(v)
    out = {}
    for g, v in groups.items():
        v.sort()
        at = lambda p: v[round(p * (len(v) - 1))]  # noqa: B023, E731
        out[g] = (len(v), v[0], at(0.25), statistics.median(v), at(0.75), v[-1])
    return out


@pytest.mark.parametrize(("last", "bins"), [(100_000, 1024), (50, 8), (1, 2)])
def test_order_statistics(spark, monkeypatch, last, bins):
    """One group with nearly all rows, ties, far outliers, null and NaN values and null groups; a few rows a task."""
    monkeypatch.setattr(selection, "LAST_ROWS", last)
    monkeypatch.setattr(selection, "BINS", bins)
    rng = random.Random(last)
    rows = [("hot", rng.choice([rng.random(), rng.gauss(5, 2), 3.0, -1e6, 1e-9 * rng.random()])) for _ in range(2500)]
    rows += [(rng.choice(["a", None]), rng.choice([1.0, 2.0, None, float("nan")])) for _ in range(60)] + [("one", -7.5), ("none", None), ("same", 4.0), ("same", 4.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = selection.order_statistics(df, ["g"], "v", selection.FIVE)
    want = by_sorting(rows)
    assert {r["g"]: (r["n"], r["least"], r["p25"], (r["low"] + r["high"]) / 2, r["p75"], r["most"]) for r in got.collect()} == want
    fives = selection.five_numbers(df.withColumn("w", F.col("v") * 2), ["g"], {"x": "v", "y": "w"})
    told = selection.beside(df.groupBy("g").agg(F.count("v").alias("n")), fives, ["g"])
    for r in told.collect():
        if r["g"] in want:
            assert (r["x_median"], r["y_most"]) == (round(want[r["g"]][3], 6), round(2 * want[r["g"]][5], 6))


def test_no_window_over_a_whole_group(spark, monkeypatch):
    """The largest window partition of a selection has LAST_ROWS rows or a row per part."""
    monkeypatch.setattr(selection, "LAST_ROWS", 100)
    seen = []
    real = selection.inside
    monkeypatch.setattr(selection, "inside", lambda rows, ranges: seen.append((out := real(rows, ranges)).groupBy("lo", "hi").count().agg(F.max("count")).first()[0]) or out)
    df = spark.range(20_000).select(F.lit("all").alias("g"), F.sqrt("id").alias("v"))
    got = selection.order_statistics(df, ["g"], "v", selection.MIDDLE).first()
    assert got["low"] == 9999**0.5 and got["high"] == 10_000**0.5 and seen[-1] <= 100 < seen[0]


def test_probabilities_are_checked():
    with pytest.raises(ValueError):
        selection.finite(1.0)


@pytest.mark.parametrize(("block", "last"), [(512, 100_000), (7, 3)])
def test_pair_medians(spark, monkeypatch, block, last):
    monkeypatch.setattr(pairs, "BLOCK", block)
    monkeypatch.setattr(selection, "LAST_ROWS", last)
    rng = random.Random(block)
    vector = lambda k: None if rng.random() < 0.1 else [rng.choice([0.0, 0.5, rng.random()]) for _ in range(k)]
    rows = [(rng.choice(["x", "x", "y", None]), rng.choice(["p", "q"]), k % 40, rng.randrange(1, 9), vector(2), vector(2), vector(3), vector(3)) for k in range(90)]
    members = spark.createDataFrame(rows, "cell string, stratum string, who int, n int, left_a array<double>, right_a array<double>, left_b array<double>, right_b array<double>")
    want = {}
    for r in rows:
        for s in rows:
            if r[:2] == s[:2] and r[2] != s[2]:
                for name, k, size, by in (("a", 4, 2, 2.0), ("b", 6, 3, 4.0)):
                    if r[k] is not None and s[k + 1] is not None:
                        far = sum(abs(x - y) for x, y in zip(r[k], s[k + 1], strict=True)) / by
                        for least in (1, 5):
                            if min(r[3], s[3]) >= least:
                                want.setdefault((r[0], name, least), []).append(far)
    got = pairs.pair_medians(members, ["cell", "stratum"], ["cell"], "who", "n", {"a": (2, 2.0), "b": (3, 4.0)}, [1, 5])
    assert {(r["cell"], r["family"], r["least"]): (r["pairs"], r["median"]) for r in got.collect()} == {k: (len(v), statistics.median(v)) for k, v in want.items()}
    assert pairs.pair_medians(members.limit(0), ["cell", "stratum"], ["cell"], "who", "n", {"a": (2, 2.0)}, [1]).collect() == []
