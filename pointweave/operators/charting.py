"""Counters over notation cells: what was parsed, what was not and why, and the additive metrics of servers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.functions.metrics import parsed_cells, serve_metrics
from pointweave.functions.notation import DETAILS, EXCEPTIONAL, FAULTS, MODIFIERS, SERVES, STATES, TYPES, parse_counted

#: Characters that the notation knows: its alphabets, digits, endings, lets and whole-point codes.
DOCUMENTED = "".join(sorted({*TYPES, *MODIFIERS, *SERVES, *FAULTS, *DETAILS, *"0123789", *"@#*Cc", *EXCEPTIONAL}))


def undocumented(cell: Column) -> Column:
    """Whether a cell has a character outside DOCUMENTED."""
    return F.translate(cell, DOCUMENTED, "") != ""


def known(direction: Column) -> Column:
    return F.coalesce(direction != "0", F.lit(False))


def notation_counters(points: DataFrame, cells: dict[str, str]) -> DataFrame:
    """(field, kind, name, n) of the non-empty cells: cells, validity, issues, the character at each issue, outcomes,
    whole-point codes, component states, characters and attributes; counts of 0 are left out.

    Equal cells are counted first, so each different cell is parsed once and characters are exploded from distinct
    cells only. Of cells that are alike in all names, numbers are added up before names become rows; these are few.
    """
    pairs = F.array(*[F.struct(F.lit(name).alias("field"), F.col(c).alias("cell")) for name, c in cells.items()])
    rows = points.select(F.explode(pairs).alias("x")).select("x.*").where("cell <> ''").groupBy("field", "cell").agg(F.count(F.lit(1)).alias("n"))
    parsed = parse_counted(rows, "cell")
    at = F.col("issue_at")
    mark = F.when(at < F.length("cell"), F.substring("cell", at + 1, F.lit(1))).otherwise("<end>")
    served = F.col("direction").isNotNull()
    numbers = {
        "undocumented": undocumented(F.col("cell")),
        "regular_serve_cells": served,
        "known_serve_direction": known(F.col("direction")),
        "serve_and_volley_attempts": F.coalesce(F.col("volley"), F.lit(False)),
        "parsed_shots": F.col("shots"),
        "shots_with_known_direction": F.col("aimed"),
        "parsed_returns": F.col("shots") > 0,
        "returns_with_known_direction": F.col("return_aimed"),
        "returns_with_known_depth": F.col("return_deep"),
    }
    names = ["issue", "mark", "outcome", "exceptional", *STATES]
    alike = parsed.withColumn("mark", F.when(F.col("issue").isNotNull(), mark)).groupBy("field", *names).agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * v.cast("long")).alias(k) for k, v in numbers.items()])
    one = lambda kind, name, times=F.col("n"): F.struct(F.lit(kind).alias("kind"), name.alias("name"), times.alias("n"))
    counted = [
        one("cells", F.lit("all")),
        one("validity", F.when(F.col("issue").isNull(), "valid").otherwise("invalid")),
        one("issue", F.col("issue")),
        one("issue character", F.concat(F.col("issue"), F.lit(":"), F.col("mark"))),
        one("outcome", F.col("outcome")),
        one("outcome", F.col("exceptional")),
        *[one(s, F.col(s)) for s in STATES],
        one("undocumented", F.lit("cells"), F.col("undocumented")),
        *[one("attribute", F.lit(k), F.col(k)) for k in numbers if k != "undocumented"],
    ]
    told = alike.select("field", F.explode(F.array(*counted)).alias("c")).select("field", "c.*")
    letters = rows.select("field", F.explode(F.split("cell", "")).alias("name"), "n").groupBy("field", "name").agg(F.sum("n").alias("n"))
    every = told.unionByName(letters.select("field", F.lit("character").alias("kind"), "name", "n"))
    return every.where("name is not null and n > 0").groupBy("field", "kind", "name").agg(F.sum("n").alias("n"))


def metric_name(counter: str) -> str:
    return counter.replace(":", "_").lstrip("_")


def server_metrics(points: DataFrame, keys: list[str], first: Column, second: Column, label: Column) -> DataFrame:
    """The 28 additive counters per ``keys``."""
    rows = parsed_cells(points, first, second, label)
    return rows.groupBy(*keys).agg(*[F.sum(c).alias(metric_name(k)) for k, c in serve_metrics().items()])


def named_records(metrics: DataFrame, matches: DataFrame, match: str, server: str) -> DataFrame:
    """Counters of (match, server) with the names of server and opponent: server 1 is player_1, 2 is player_2.

    Other servers and matches without metadata are left out; a wide row each, so nothing is pivoted.
    """
    both = metrics.where(F.col(server).isin(1, 2)).join(matches, match)
    own = F.when(F.col(server) == 1, F.col("player_1")).otherwise(F.col("player_2"))
    other = F.when(F.col(server) == 1, F.col("player_2")).otherwise(F.col("player_1"))
    return both.withColumns({"player": own, "opponent": other}).drop("player_1", "player_2", server)
