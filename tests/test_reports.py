import json
import random

import pytest
from pyspark.sql import functions as F

from pointweave import cli
from pointweave.operators import resampling
from pointweave.operators.resampling import comparison, paired_bootstrap
from pointweave.plans import registry
from pointweave.sources import reports
from pointweave.sources.readers import fingerprints

SF = "/root/testdata/sf0.001"


def test_cli_renders_what_it_saved(spark, tmp_path):
    saved, report, again = tmp_path / "r.json", tmp_path / "r.md", tmp_path / "again.md"
    assert cli.main(["query", "O6_sorted_counters", "--source", SF, "--json", str(saved), "--report", str(report)], spark) == 0
    assert cli.main(["query", "O6_sorted_counters", "--render-existing", "--json", str(saved), "--report", str(again)]) == 0
    assert report.read_text() == again.read_text()
    assert json.loads(saved.read_text())["columns"][0] == "value"
    with pytest.raises(FileExistsError):
        cli.main(["query", "O6_sorted_counters", "--source", SF, "--json", str(saved)], spark)


def test_named_report(spark, tmp_path):
    saved, report, again = tmp_path / "r.json", tmp_path / "r.md", tmp_path / "again.md"
    assert cli.main(["report", "review", "--source", SF, "--snapshot", "s1", "--json", str(saved), "--report", str(report)], spark) == 0
    assert cli.main(["report", "review", "--render-existing", "--snapshot", "s1", "--json", str(saved), "--report", str(again)]) == 0
    assert report.read_text() == again.read_text() and "## Precision" in again.read_text()
    with pytest.raises(ValueError, match="s1"):
        cli.main(["report", "review", "--render-existing", "--snapshot", "s2", "--json", str(saved), "--report", str(again)])
    assert {q for _, _, sections in reports.REPORTS.values() for q in sections.values()} <= set(registry.queries())


def test_cli_reads_files(spark, tmp_path, capsys):
    head = "match_id,Pt,Set1,Set2,Gm1,Gm2,Pts,Svr,PtWinner\n"
    (tmp_path / "charting-m-points-a.csv").write_text(head + "m,1,0,0,0,0,0-0,1,1\nm,1,0,0,0,0,0-0,1,1\n")
    (tmp_path / "charting-m-points-b.csv").write_text(head + "m,2,0,0,0,0,15-0,1,1\nm,3,0,0,0,0,30-0,1,1\nm,3,0,0,0,0,40-0,1,1\nm,4,0,0,0,0,0-0,3,1\n")
    assert cli.main(["points", "--points", f"{tmp_path}/charting-*.csv", "--expected", "2"], spark) == 0
    assert "| ok | 2 |" in capsys.readouterr().out
    with pytest.raises(ValueError, match="not 3"):
        cli.main(["points", "--points", f"{tmp_path}/charting-*.csv", "--expected", "3"], spark)
    auto, human = tmp_path / "a.csv", tmp_path / "h.csv"
    auto.write_text("mcp_match_id,mcp_date,status,surface_agrees,review_status\nx,2017-07-14,matched,true,\n")
    human.write_text("mcp_match_id;mcp_date;status;surface_agrees;review_status\nx;14/07/2017;matched;VERDADEIRO;Same\n")
    assert cli.main(["review", "--automated", str(auto), "--human", str(human)], spark) == 0
    assert "| matched | same | 1 |" in capsys.readouterr().out
    human.write_text("mcp_match_id;mcp_date;status;surface_agrees;review_status\nx;15/07/2017;matched;VERDADEIRO;Same\n")
    with pytest.raises(ValueError, match="changed evidence"):
        cli.main(["review", "--automated", str(auto), "--human", str(human)], spark)


def test_pinned_inputs(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x")
    good = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in fingerprints(spark, str(tmp_path)).collect()}
    reports.pinned(spark, str(tmp_path), good)
    with pytest.raises(ValueError, match="a.csv"):
        reports.pinned(spark, str(tmp_path), {"a.csv": "0"})


def test_cells_and_bound(spark):
    assert [reports.shown(v) for v in (None, "", "a|b", 0.5, 3)] == ["NA", "(blank)", "a\\|b", "0.5", "3"]
    with pytest.raises(ValueError, match="Parquet"):
        reports.collected(spark.range(5), 4)


def test_bootstrap(spark):
    draw = random.Random(3)
    rows = [("p", i, 1 + draw.random()) for i in range(60)] + [("n", i, -1 - draw.random()) for i in range(60)] + [("one", 0, 0.25)]
    i = paired_bootstrap(spark.createDataFrame(rows, "g string, k int, v double"), "g", "k", "v")
    got = {r["g"]: r for r in i.withColumn("verdict", comparison(F.col("low"), F.col("high"))).collect()}
    assert (got["p"]["verdict"], got["n"]["verdict"]) == ("favors right", "favors left")
    assert (got["one"]["low"], got["one"]["high"]) == (0.25, 0.25)
    mean = sum(r[2] for r in rows[:60]) / 60
    assert got["p"]["low"] < mean < got["p"]["high"]


def test_resampled_counts_are_multinomial(spark, monkeypatch):
    """How often each place is drawn over all replicates, and the counts of a block, against n draws of equal chance."""
    monkeypatch.setattr(resampling, "BLOCK", 16)
    n, reps = 100, 400
    rows = spark.createDataFrame([("g", i, float(i)) for i in range(n)], "g string, k int, v double")
    told = resampling.placed(rows, "g", "k", "v", 7).cache()
    assert sorted(r["place"] for r in told.collect()) == list(range(n))
    counts = resampling.block_counts(told, "g", reps)
    per = {(r["b"], r["block"]): r["m"] for r in counts.collect()}
    assert all(sum(m for (b, _), m in per.items() if b == k) == n for k in range(reps))
    first = [per.get((b, 0), 0) for b in range(reps)]  # binomial(100, 0.16)
    mean = sum(first) / reps
    assert abs(mean - 16) < 0.75 and 10 < sum((x - mean) ** 2 for x in first) / reps < 17.5
    sizes = F.when(F.col("block") == 6, 4).otherwise(16).cast("long")
    drawn = counts.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m")))).select((F.col("block") * 16 + resampling.inner_draw(F.col("i"), sizes)).alias("place"))
    times = {r["place"]: r["count"] for r in drawn.groupBy("place").count().collect()}
    chi = sum((times.get(k, 0) - reps) ** 2 / reps for k in range(1, n + 1))
    assert set(times) == set(range(1, n + 1)) and 55 < chi < 160  # 99 degrees of freedom
