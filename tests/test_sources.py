import gzip

import pytest
from pyspark.sql import functions as F

from pointweave.functions import text
from pointweave.sources import readers

HEAD = ",".join(readers.POINTS)


def test_points_of_shards(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text(f"{HEAD}\nm,1,0,0,0,0,0-0,1,1\nm,1,0,0,0,0,0-0,1,1\nm,0,0,0,0,0,0-0,1,1\n")
    b.write_text(f"{HEAD}\nm,2,0,0,0,0,15-0,1,2\nm,3,0,0,0,0,0-0,1,2\nm,3,0,0,0,0,0-0,2,2\n,4,0,0,0,0,0-0,1,2\nm,5,0,0,0,0,\"a \"\"b\"\"\nc\",3,2\n")
    got = {r["point"]: r for r in readers.read_points(spark, [str(a), str(b)]).collect()}
    assert {k: r["error"] for k, r in got.items()} == {0: "point", 1: None, 2: None, 4: "match_id", 5: "server"}
    assert got[5]["label"] == 'a "b"\nc' and (got[2]["server"], got[2]["winner"]) == (0, 1)
    with pytest.raises(ValueError, match="conflict"):
        readers.read_points(spark, [str(b)], reject_conflicts=True)
    (tmp_path / "c.csv").write_text("match_id,Pt\nm,1\n")
    with pytest.raises(ValueError, match="headers differ"):
        readers.read_shards(spark, [str(a), str(tmp_path / "c.csv")])
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_shards(spark, [str(tmp_path / "c.csv")])


def test_metadata(spark, tmp_path):
    rows = ["a,P,Q,20200101,T,F,Hard,3", "b,P,Q,20200101,T,F,Hard,3", "b,P,Q,20200102,T,F,Hard,3", "c,P,Q,20200101,T,F,Unknown,3", "d,P,Q,2020011,T,F,Clay,7"]
    (tmp_path / "m.csv").write_text(",".join(readers.MATCHES) + "\n" + "\n".join(rows) + "\n")
    got = {r["match_id"]: r for r in readers.read_matches(spark, [str(tmp_path / "m.csv")]).collect()}
    assert {k: r["safe"] for k, r in got.items()} == {"a": True, "b": False, "c": False, "d": False}
    assert got["b"]["conflicting"] and got["c"]["invalid_surface"] and got["d"]["invalid_date"] and got["d"]["invalid_best_of"]


def test_aggregates(spark, tmp_path):
    (tmp_path / "o.csv").write_text("match_id,player,set,serve_pts\nm1,A,Total,04\nm1,A,Total,4\nm2,A,Total,5\nm2,A,Total,6\nm3,A,Total,x\nm3,A,1,7\n")
    rows, counts = readers.read_aggregate_rows(spark, [str(tmp_path / "o.csv")], "set", ["Total"], ["serve_pts"])
    assert [tuple(r) for r in rows.collect()] == [("m1", "A", "Total", 4)]
    assert counts.first().asDict() == {"accepted_rows": 5, "invalid_rows": 1, "groups": 2, "safe": 1, "duplicate_groups": 2, "conflicting_groups": 1}
    ids = spark.createDataFrame([("m1",)], "match_id string")
    p = readers.profile_aggregate(spark, str(tmp_path / "o.csv"), ids, ids).first()
    assert (p["rows"], p["duplicate_rows"], p["conflicting_groups"], p["invalid_numbers"], p["orphan_ids"], p["charted_covered"]) == (6, 2, 2, 1, 2, 1)
    assert readers.grain(["row", "x", "match_id", "server"]) == ["match_id", "server", "row"]


def test_context_archive(spark, tmp_path):
    head = ",".join(readers.CONTEXT) + "\n"
    row = "2020-1,T,Hard,20200106,{n},{w},A B,20,C D,3,F,1,2\n"
    for name, body in {"atp/atp_matches_2020.csv": row.format(n=1, w=10) * 2 + row.format(n=2, w=10) + row.format(n=2, w=11) + ",T,Hard,20200106,3,1,A,2,B,3,F,,\n", "wta/wta_matches_qual_itf_2020.csv": row.format(n=1, w=10), "atp/atp_rankings.csv": row.format(n=9, w=9)}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(head + body)
    rows = readers.read_context(spark, str(tmp_path))
    assert rows.count() == 6 and rows.where("not valid").count() == 1
    safe = {r["canonical_id"]: r["source_file"] for r in readers.safe_context(rows).collect()}
    assert safe == {"context:atp:tour:2020-1:1": "atp/atp_matches_2020.csv", "context:wta:qual_itf:2020-1:1": "wta/wta_matches_qual_itf_2020.csv"}


def test_live_states(spark, tmp_path):
    states = [("1", "0", "1", "[6, 3]", "[4, 5]", "A", "40", "2", "True", "t"), ("2", "0", "0", "[]", "[]", "", "", "", "False", "t"), ("x", "0", "0", "[]", "[]", "", "", "", "False", "t"), ("4", "0", "0", "[-1]", "[0]", "", "", "", "False", "t"), ("5", "0", "0", "[", "[]", "", "", "", "False", "t"), ("6", "0", "0", "[]", "[]", "x", "", "", "False", "t"), ("7", "0", "0", "[]", "[]", "", "", "9", "False", "t")]
    lines = [",".join(readers.STATES)] + [",".join(f'"{v}"' for v in s) for s in states]
    with gzip.open(tmp_path / "s.csv.gz", "wt") as f:
        f.write("\n".join(lines) + "\n")
    got = readers.read_states(spark, str(tmp_path / "s.csv.gz")).collect()
    assert {r["match_id"]: r["error"] for r in got} == {1: None, 2: None, None: "match_id", 4: "games", 5: "games", 6: "points", 7: "server"}
    one = next(r for r in got if r["match_id"] == 1)
    assert (one["now_1"], one["now_2"], one["server"], one["tiebreak"], one["games_1"]) == (3, 5, 1, True, [6, 3])


def test_files(spark, tmp_path):
    (tmp_path / "x.csv").write_text('"a;b",c,d\n1,2,3\n')
    (tmp_path / "y.csv").write_text("a;b;c\n")
    assert readers.sniffed(spark, str(tmp_path / "x.csv")) == "," and readers.sniffed(spark, str(tmp_path / "y.csv")) == ";"
    assert [p.rsplit("/", 1)[-1] for p in readers.discover(spark, f"{tmp_path}/*.csv", 2)] == ["x.csv", "y.csv"]
    with pytest.raises(ValueError, match="not 1"):
        readers.discover(spark, f"{tmp_path}/*.csv", 1)
    path = readers.write_csv(spark.range(2).withColumn("e", F.lit("")), f"{tmp_path}/out", ";")
    assert readers.read_csv(spark, path, ["id", "e"], ";").drop("source_file").collect()[0]["e"] == ""
    with pytest.raises(Exception, match="exists"):
        readers.write_csv(spark.range(1), path)


def test_scalars(spark):
    df = spark.createDataFrame([("2000-M-x", "20200230", "2017-07-14", "VERDADEIRO"), ("charting-w-points.csv", "20200229", "14/07/2017", " falso"), ("2000-m-x", "2020229", "", ""), ("x", None, "7/2017", "ja")], "n string, d string, i string, b string")
    got = [tuple(r) for r in df.select(text.tour_of(F.col("n")), text.compact_date(F.col("d")).cast("string"), text.iso_date(F.col("i")), text.plain_boolean(F.col("b"))).collect()]
    assert got == [("ATP", None, "2017-07-14", "true"), ("WTA", "2020-02-29", "2017-07-14", "false"), ("Unknown", None, "", ""), ("Unknown", None, None, None)]
    values = spark.createDataFrame([("Pt", "12"), ("Svr", "3"), ("TbSet", "True"), ("Notes", " ")], "f string, v string")
    assert [values.where(F.col("f") == f).select(text.valid_value(f, F.col("v"))).first()[0] for f in ("Pt", "Svr", "TbSet", "Notes")] == [True, False, True, False]
    c = text.context_values(F.lit("1-W-2"), F.lit("20x0"), F.lit(" CLAY "), F.lit(None).cast("string"))
    assert spark.range(1).select(*c.values()).first()[:] == ("WTA", "invalid-date", "clay", "(blank)")


@pytest.mark.parametrize(("column", "value", "error"), [("match_id", "-1", "match_id"), ("match_id", "m", "match_id"), ("sets_p1", "-1", "sets"), ("sets_p1", "x", "sets"), ("sets_p2", "", "sets"), ("games_p1", "[-2]", "games"), ("server", "3", "server"), ("points_p2", "B", "points"), ("sets_p2", "2", None)])
def test_states_that_cannot_be_read(spark, column, value, error):
    good = {"match_id": "7", "sets_p1": "1", "sets_p2": "0", "games_p1": "[6, 2]", "games_p2": "[4, 1]", "points_p1": "40", "points_p2": "A", "server": "1", "is_tiebreak": "False", "timestamp_utc": "t"}
    row = readers.parsed_states(spark.createDataFrame([good | {column: value}])).first()
    assert row["error"] == error and (error or (row["sets_1"], row["sets_2"]) == (1, 2))


def test_aggregates_are_not_sorted(spark, tmp_path):
    """Tasks hash the keys of an aggregate file's rows: no sort holds what a task reads."""
    (tmp_path / "o.csv").write_text("match_id,player,set,serve_pts\nm1,A,Total,04\nm1,A,Total,4\nm2,A,Total,5\nm2,A,Total,6\n")
    for df in readers.read_aggregate_rows(spark, [str(tmp_path / "o.csv")], "set", ["Total"], ["serve_pts"]):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "HashAggregate" in plan
