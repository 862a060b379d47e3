"""CSV and JSON sources under explicit contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.functions import text
from pointweave.operators.integrity import collapse, grouped, require
from pointweave.operators.store import written
from pointweave.sources.records import read_records
from pointweave.sources.shared import shared_dir

__all__ = ["shared_dir"]

#: Columns that the sources must have.
POINTS = ["match_id", "Pt", "Set1", "Set2", "Gm1", "Gm2", "Pts", "Svr", "PtWinner"]
MATCHES = ["match_id", "Player 1", "Player 2", "Date", "Tournament", "Round", "Surface", "Best of"]
CONTEXT = ["tourney_id", "tourney_name", "surface", "tourney_date", "match_num", "winner_id", "winner_name", "loser_id", "loser_name", "best_of", "round", "winner_rank", "loser_rank"]
#: What a match may be played on and over, file names of the context archive, columns that make a grain.
SURFACES, BEST_OF = ("Hard", "Clay", "Grass", "Carpet"), ("3", "5")
ARCHIVE = r"/(atp|wta)/(?:atp|wta)_matches_(?:(qual_chall|futures|qual_itf)_)?[0-9]{4}[.]csv$"
GRAIN = ("match_id", "player", "server", "returner", "set", "row")
STATES = ["match_id", "sets_p1", "sets_p2", "games_p1", "games_p2", "points_p1", "points_p2", "server", "is_tiebreak", "timestamp_utc"]


def read_csv(spark: SparkSession, path: str | list[str], required: list[str], sep: str = ",", ordinal: bool = False) -> DataFrame:
    """All columns as strings, empty cells as empty strings, with the file each row came from, and with ``ordinal`` its
    place in the file. Headers must agree; files are read in byte ranges, gzip files whole."""
    df = read_records(spark, path, sep)
    require(df, required)
    return df if ordinal else df.drop("ordinal")


def first_seen(rows: DataFrame, keys: list[str], paths: list[str]) -> DataFrame:
    """The row of each key that stands first, in the order of ``paths`` and in the file, of rows read with ``ordinal``.

    The place travels with the row, so nothing depends on how tasks are scheduled; copies are reduced before the shuffle.
    """
    names = F.array(*[F.lit(p.rstrip("/").split("://")[-1].lstrip("/")) for p in paths])
    turn = F.array_position(F.transform(names, lambda n: F.contains("source_file", n)), True)
    first = F.min_by(F.struct(*rows.columns), F.struct(turn.alias("turn"), F.col("source_file"), F.col("ordinal")))
    return rows.groupBy(*keys).agg(first.alias("r")).select("r.*").drop("ordinal")


def parsed_points(raw: DataFrame) -> DataFrame:
    """Typed points; error names the first rule that a row breaks."""
    n = lambda c: F.col(c).try_cast("int")
    rows = raw.select("match_id", n("Pt").alias("point"), n("Set1").alias("set1"), n("Set2").alias("set2"), n("Gm1").alias("gm1"), n("Gm2").alias("gm2"), F.col("Pts").alias("label"), (n("Svr") - 1).alias("server"), (n("PtWinner") - 1).alias("winner"))
    error = F.when(F.col("match_id") == "", "match_id").when(F.coalesce(F.col("point") < 1, F.lit(True)), "point").when(~F.coalesce(F.col("server").isin(0, 1), F.lit(False)), "server").when(~F.coalesce(F.col("winner").isin(0, 1), F.lit(False)), "winner")
    return rows.withColumn("error", error)


def read_points(spark: SparkSession, paths: list[str], reject_conflicts: bool = False) -> DataFrame:
    """Typed points of all shards: headers must agree, equal copies of (match_id, Pt) collapse, conflicting ones go.

    With ``reject_conflicts`` a conflict fails the read instead.
    """
    raw = read_shards(spark, paths)
    values = [c for c in raw.columns if c not in ("match_id", "Pt", "source_file")]
    if reject_conflicts and not grouped(raw, ["match_id", "Pt"], values).where("conflicting").isEmpty():
        raise ValueError("points conflict")
    return parsed_points(collapse(raw, ["match_id", "Pt"], values))


def read_shards(spark: SparkSession, paths: list[str], required: list[str] = POINTS) -> DataFrame:
    """All shards in one scan after a check of their first lines; source_file is the name of a row's shard."""
    return read_csv(spark, paths, required).withColumn("source_file", F.element_at(F.split("source_file", "/"), -1))


def read_matches(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per match id: copies, whether they conflict, which anomalies any of them shows, safe, and the least row.

    The date has eight digits and exists, the surface is one of SURFACES, the best-of one of BEST_OF.
    """
    raw = read_csv(spark, paths, MATCHES).drop("source_file")
    values = [c for c in raw.columns if c != "match_id"]
    bad = {"invalid_date": text.compact_date(F.col("Date")).isNull(), "invalid_surface": ~F.col("Surface").isin(*SURFACES), "invalid_best_of": ~F.col("`Best of`").isin(*BEST_OF)}
    flags = [F.bool_or(c).alias(n) for n, c in bad.items()]
    row = F.struct(*[F.col(f"`{c}`") for c in values])
    g = raw.groupBy("match_id").agg(F.count(F.lit(1)).alias("copies"), F.min(row).alias("row"), F.max(row).alias("last"), *flags)
    g = g.withColumn("conflicting", ~F.col("row").eqNullSafe(F.col("last"))).drop("last")
    return g.withColumn("safe", ~F.col("conflicting") & ~F.col("invalid_date") & ~F.col("invalid_surface") & ~F.col("invalid_best_of"))


def grain(columns: list[str]) -> list[str]:
    """The columns that tell the rows of an aggregate file apart, of those that it has."""
    return [c for c in GRAIN if c in columns]


def read_aggregate_rows(spark: SparkSession, paths: list[str], row_field: str, accepted: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(safe rows, counters) of the rows whose ``row_field`` is accepted, values as numbers.

    Numbers are parsed before rows are compared (04 equals 4); rows with an unreadable value are counted and left out,
    and so are all rows of a conflicting (match_id, player, row).
    """
    raw = read_csv(spark, paths, ["match_id", "player", row_field, *values]).where(F.col(row_field).isin(*accepted))
    keys = ["match_id", "player", row_field]
    typed = raw.select(*keys, *[F.col(v).try_cast("int").alias(v) for v in values])
    good = F.lit(True)
    for v in values:
        good = good & F.col(v).isNotNull()
    told = typed.withColumn("pw_good", good)
    g = grouped(told.where("pw_good"), keys, values)
    counts = told.agg(F.count(F.lit(1)).alias("accepted_rows"), F.count_if(~F.col("pw_good")).alias("invalid_rows"))
    groups = g.agg(F.count(F.lit(1)).alias("groups"), F.count_if(~F.col("conflicting")).alias("safe"), F.count_if(F.col("copies") > 1).alias("duplicate_groups"), F.count_if("conflicting").alias("conflicting_groups"))
    return g.where(~F.col("conflicting")).select(*keys, "row.*"), counts.crossJoin(F.broadcast(groups))  # one row each


def profile_aggregate(spark: SparkSession, path: str, safe_ids: DataFrame, charted_ids: DataFrame) -> DataFrame:
    """One row on an aggregate file, whatever its columns: rows, ids, players, duplicates of its grain and numbers.

    The file is parsed once; ids and players are columns of the grain and are read from its groups, which are written.
    Copies are compared by two hashes of all columns.
    """
    raw = read_csv(spark, [path], ["match_id"]).drop("source_file")
    keys = grain(raw.columns)
    numbers = [c for c in raw.columns if c not in keys]
    players = [c for c in ("player", "server", "returner") if c in raw.columns]
    many_of = lambda f: sum((f(F.trim(F.col(c))).cast("int") for c in numbers), F.lit(0))
    told = raw.withColumns({"pw_filled": many_of(lambda x: x != ""), "pw_bad": many_of(lambda x: (x != "") & x.try_cast("int").isNull()), "pw_low": many_of(lambda x: F.coalesce(x.try_cast("int") < 0, F.lit(False)))})
    told = told.withColumns({"pw_first": F.xxhash64(*raw.columns), "pw_second": F.xxhash64(F.lit(1), *raw.columns)})
    differ = (F.min("pw_first") != F.max("pw_first")) | (F.min("pw_second") != F.max("pw_second"))
    g = written(told.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), differ.alias("conflicting"), *[F.sum(c).alias(c) for c in ("pw_filled", "pw_bad", "pw_low")]))
    many = F.col("copies") > 1
    counts = g.agg(
        F.sum("copies").alias("rows"), F.sum(F.col("copies") - 1).alias("duplicate_rows"), F.count_if(many).alias("duplicate_groups"), F.count_if(many & ~F.col("conflicting")).alias("exact_groups"), F.count_if("conflicting").alias("conflicting_groups"),
        F.count_distinct(F.when(F.col("conflicting"), F.col("match_id"))).alias("conflicting_matches"), F.sum("pw_filled").alias("numbers"), F.sum("pw_bad").alias("invalid_numbers"), F.sum("pw_low").alias("negative_numbers"),
    )
    ids = g.select("match_id").distinct().join(safe_ids.select("match_id", F.lit(True).alias("is_safe")), "match_id", "left").join(charted_ids.select("match_id", F.lit(True).alias("is_charted")), "match_id", "left")
    met = ids.agg(F.count(F.lit(1)).alias("matches"), F.count_if(F.col("is_safe").isNull()).alias("orphan_ids"), F.count_if("is_charted").alias("charted_covered"))
    names = g.select(F.explode(F.array(*[F.nullif(F.col(c), F.lit("")) for c in players])).alias("name")) if players else g.select(F.lit(None).cast("string").alias("name"))
    who = names.agg(F.count_distinct("name").alias("players"))
    return counts.crossJoin(F.broadcast(met)).crossJoin(F.broadcast(who))  # one row each


def canonical_id(namespace: str, tour: Column, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(namespace), F.lower(tour), *parts)


def read_context(spark: SparkSession, root: str, namespace: str = "context") -> DataFrame:
    """Rows of the archive's files under atp/ and wta/ whose names are those of matches: tour from the folder, family from
    the name, canonical id, typed date, and whether the row is valid (a date and no blank identity)."""
    raw = read_records(spark, root, name=ARCHIVE, recursiveFileLookup="true", pathGlobFilter="*.csv")
    require(raw, CONTEXT)
    raw = raw.select(*CONTEXT, F.col("source_file").alias("path"))
    family = F.regexp_extract("path", ARCHIVE, 2)
    rows = raw.withColumns({"tour": F.upper(F.regexp_extract("path", ARCHIVE, 1)), "family": F.when(family == "", "tour").otherwise(family), "source_file": F.array_join(F.slice(F.split("path", "/"), -2, 2), "/"), "date": text.compact_date(F.col("tourney_date"))})
    valid = F.col("date").isNotNull()
    for c in ("tourney_id", "match_num", "winner_id", "winner_name", "loser_id", "loser_name"):
        valid = valid & (F.trim(F.col(c)) != "")
    return rows.select(canonical_id(namespace, F.col("tour"), F.col("family"), F.col("tourney_id"), F.col("match_num")).alias("canonical_id"), "tour", "family", *CONTEXT, "date", "source_file", valid.alias("valid"))


def safe_context(context: DataFrame) -> DataFrame:
    """A row per valid canonical id whose copies are equal in everything, their file included."""
    values = [c for c in context.columns if c not in ("canonical_id", "valid")]
    return collapse(context.where("valid"), ["canonical_id"], values)


def parsed_states(raw: DataFrame) -> DataFrame:
    """Scoreboard states with won sets, ragged games as arrays and the current set's games; error names the first of id,
    sets, games, server and points that cannot be read or is negative."""
    games = [F.from_json(F.col(c), "array<int>") for c in ("games_p1", "games_p2")]
    server = F.when(F.col("server") == "", None).otherwise(F.col("server").try_cast("int") - 1)
    unread = lambda g: g.isNull() | F.exists(g, lambda x: x.isNull() | (x < 0))
    label = "^(|[0-9]+|A|AD)$"
    count = lambda c: F.col(c).try_cast("int")
    bad = (
        F.when(F.coalesce(count("match_id") < 0, F.lit(True)), "match_id")
        .when(F.coalesce(count("sets_p1") < 0, F.lit(True)) | F.coalesce(count("sets_p2") < 0, F.lit(True)), "sets")
        .when(unread(games[0]) | unread(games[1]), "games")
        .when((F.col("server") != "") & ~F.coalesce(server.isin(0, 1), F.lit(False)), "server")
        .when(~F.col("points_p1").rlike(label) | ~F.col("points_p2").rlike(label), "points")
    )
    current = lambda g: F.coalesce(F.try_element_at(g, F.lit(-1)), F.lit(0))
    return raw.select(count("match_id").alias("match_id"), count("sets_p1").alias("sets_1"), count("sets_p2").alias("sets_2"), games[0].alias("games_1"), games[1].alias("games_2"), current(games[0]).alias("now_1"), current(games[1]).alias("now_2"), server.alias("server"), (F.lower("is_tiebreak") == "true").alias("tiebreak"), "timestamp_utc", bad.alias("error"))


def read_states(spark: SparkSession, path: str) -> DataFrame:
    """States of gzip files, which no task can split; they are dealt out after reading."""
    return parsed_states(read_csv(spark, path, STATES).repartition(spark.sparkContext.defaultParallelism))


def discover(spark: SparkSession, pattern: str, expected: int | None = None) -> list[str]:
    """Sorted paths that a pattern of the shared store names; another number than ``expected`` fails."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    paths = sorted(f.getPath().toString() for f in found or [])
    if expected is not None and len(paths) != expected:
        raise ValueError(f"{pattern}: {len(paths)} files, not {expected}")
    return paths


def sniffed(spark: SparkSession, path: str, delimiters: str = ",;") -> str:
    """The delimiter that a file's first line has oftenest outside quotes; only that line is read."""
    line = spark.read.text(path).first()[0]
    bare = "".join(line.split('"')[::2])
    return max(delimiters, key=lambda c: (bare.count(c), -delimiters.index(c)))


def write_csv(df: DataFrame, path: str, sep: str = ",", compression: str = "none") -> str:
    """All columns with a header; refuses to overwrite."""
    df.write.mode("errorifexists").csv(path, header=True, sep=sep, compression=compression, escape='"', emptyValue="")
    return path


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.upper(F.sha2("content", 256)).alias("sha256"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_review_csv(df: DataFrame, path: str) -> None:
    """A small review queue as one file."""
    df.coalesce(1).write.mode("errorifexists").csv(path, header=True)


STATE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in STATES])
