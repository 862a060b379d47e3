from pyspark.sql import functions as F

from pointweave.operators.integrity import collapse
from pointweave.streaming import live


def drained(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def test_copies_collapse_across_files(spark, tmp_path):
    for k, rows in enumerate(([(1, "2026-01-01 00:00:00"), (1, "2026-01-01 00:00:00"), (2, "2026-01-01 00:01:00")], [(2, "2026-01-01 00:01:00"), (3, "2026-01-01 00:02:00")])):
        spark.createDataFrame(rows, "event_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("event_id int, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    assert sorted(r["event_id"] for r in drained(spark, live.distinct_events(stream), "distinct_events")) == [1, 2, 3]


def test_sessions_close_with_the_watermark(spark, tmp_path):
    times = ["00:00", "00:10", "02:00", "02:05", "02:40", "09:00"]
    df = spark.createDataFrame([(7, f"2026-01-01 {t}:00") for t in times], "user_id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.where("ts < '2026-01-01 08:00:00'").coalesce(1).write.parquet(f"{tmp_path}/in/a")
    stream = lambda: spark.readStream.schema("user_id int, ts timestamp").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = live.sessions(stream()).writeStream.format("memory").queryName("user_sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    df.where("ts > '2026-01-01 08:00:00'").coalesce(1).write.parquet(f"{tmp_path}/in/b")
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("user_sessions").collect()) == [1, 2, 2]


def test_conflicts_are_taken_back(spark, tmp_path):
    """The sum of the changes after all files is what the batch policy keeps."""
    files = [[("m", 1, "a"), ("m", 2, "a"), ("m", 2, "a")], [("m", 1, "b"), ("n", 1, "c")], [("m", 1, "a"), ("n", 1, "c"), ("n", 2, "x"), ("n", 2, "y")]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, "m string, p int, v string").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("m string, p int, v string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    changes = drained(spark, live.usable_changes(stream, ["m", "p"], ["v"]), "usable_changes")
    kept = {}
    for r in changes:
        kept[r["m"], int(r["p"])] = kept.get((r["m"], int(r["p"])), 0) + r["change"]
    every = spark.createDataFrame([r for f in files for r in f], "m string, p int, v string")
    assert {k for k, n in kept.items() if n} == {(r["m"], r["p"]) for r in collapse(every, ["m", "p"], ["v"]).collect()}
    assert all(n in (0, 1) for n in kept.values())


def test_state_expires_and_survives_restarts(spark, tmp_path):
    """Started anew for each batch on one checkpoint: changes add up to the batch policy, and old keys leave the state."""
    batches = [
        [("a", 1, "x", "2026-01-01 00:00:00"), ("b", 1, "x", "2026-01-01 00:00:00")],
        [("a", 1, "x", "2026-01-02 00:00:00"), ("b", 1, "y", "2026-01-02 00:00:00"), ("c", 1, "z", "2026-01-02 00:00:00")],
        [("a", 1, "w", "2026-01-03 00:00:00")],
        [("d", 1, "x", "2026-03-01 00:00:00")],
        [("e", 1, "x", "2026-05-01 00:00:00")],
    ]
    kept = []
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "m string, p int, v string, at string").withColumn("at", F.col("at").cast("timestamp"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        source = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        changes = live.usable_changes(source, ["m", "p"], ["v"], "at", keep_ms=10 * 86_400_000)
        query = changes.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start()
        query.awaitTermination()
        kept.append([p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress][-1])
    sums = {r["m"]: r["s"] for r in spark.read.parquet(f"{tmp_path}/out").groupBy("m").agg(F.sum("change").alias("s")).collect()}
    assert sums == {"a": 0, "b": 0, "c": 1, "d": 1, "e": 1}
    assert kept[:3] == [2, 3, 3] and kept[-1] == 1  # a, b and c went with March, d with May
