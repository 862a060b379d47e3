"""Files with quoted line breaks, cut into ranges at any place, against Python's csv module."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from pointweave.sources import readers, records


def made(path, seed, n, bom=False, end="\n"):
    rng = random.Random(seed)
    cell = lambda: rng.choice(["", "x", "a,b", 'say "so"', "two" + end + "lines", end, '""', "é日", "y" * rng.randrange(80), end.join("abc" * rng.randrange(40))])
    rows = [[str(i), cell(), cell()] for i in range(n)]
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write("\ufeff" if bom else "")
        writer = csv.writer(f, lineterminator=end)
        writer.writerow(["k", "one", "two 2"])
        writer.writerows(rows)
    return rows


@pytest.mark.parametrize("size", ["64b", "700b", "1m"])
def test_ranges_cut_records_anywhere(spark, tmp_path, size):
    want = {}
    for k, (bom, end) in enumerate(((False, "\n"), (True, "\n"), (False, "\r\n"))):
        for r in made(tmp_path / f"f{k}.csv", k, 60 if size == "64b" else 300, bom, end):
            want[f"f{k}.csv", r[0]] = tuple(r)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = readers.read_csv(spark, str(tmp_path), ["k", "one"], ordinal=True)
        rows = df.select("*", F.spark_partition_id().alias("task")).collect()
        tasks = records.lines(spark, str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = {(r["source_file"].rsplit("/", 1)[-1], r["k"]): (r["k"], r["one"], r["two 2"]) for r in rows}
    assert got == want and len(rows) == len(want) and (tasks > 20 or size == "1m")
    for k in range(3):
        own = sorted((r for r in rows if r["source_file"].endswith(f"f{k}.csv")), key=lambda r: r["ordinal"])
        assert [int(r["k"]) for r in own] == list(range(len(own)))


def test_one_record_in_many_ranges(spark, tmp_path):
    """A record of 100 lines and more than a range is read by as many tasks as ranges, and put together."""
    text = "\n".join(f"line {i}" for i in range(400))
    (tmp_path / "x.csv").write_text(f'k,v\n1,"{text}"\n2,"{text}"\n3,end\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256b")
    try:
        got = {r["k"]: r["v"] for r in readers.read_csv(spark, str(tmp_path / "x.csv"), ["k"]).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {"1": text, "2": text, "3": "end"}


def test_first_seen_in_file_order(spark, tmp_path):
    (tmp_path / "b.csv").write_text("k,v\n1,late\n2,second\n1,later\n")
    (tmp_path / "a.csv").write_text("k,v\n3,x\n1,other\n2,third\n")
    paths = [str(tmp_path / "b.csv"), str(tmp_path / "a.csv")]
    rows = readers.read_csv(spark, paths, ["k"], ordinal=True)
    assert {(r["k"], r["v"]) for r in readers.first_seen(rows, ["k"], paths).collect()} == {("1", "late"), ("2", "second"), ("3", "x")}
    assert {(r["k"], r["v"]) for r in readers.first_seen(rows, ["k"], paths[::-1]).collect()} == {("1", "other"), ("2", "third"), ("3", "x")}


def test_headers_differ(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n")
    (tmp_path / "b.csv").write_text("k,w\n1,2\n")
    with pytest.raises(ValueError, match="headers differ"):
        readers.read_csv(spark, str(tmp_path), ["k"])


def test_plain_ranges_are_parsed_as_they_are_read(spark, tmp_path, monkeypatch):
    """No task puts lines together that are records, whether or not they have quotes."""
    (tmp_path / "x.csv").write_text('k,v,w\n1, a ,\n2,"b, ""c""",d\n3\n\n4,,,e\n')
    monkeypatch.setattr(records, "pieces", None)
    got = {tuple(r) for r in readers.read_csv(spark, str(tmp_path / "x.csv"), ["k"]).select("k", "v", "w").collect()}
    assert got == {("1", " a ", ""), ("2", 'b, "c"', "d"), ("3", "", ""), ("4", "", "")}
