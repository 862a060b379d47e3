import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pointweave.functions.metrics import parsed_cells, serve_metrics
from pointweave.functions.notation import parse_notation
from pointweave.functions.stats import beta_posterior, finite_quantile, nearest_rank
from pointweave.functions.text import court_side, normalise_identity, parse_rank, rank_band
from pointweave.operators.integrity import collapse, conflict_counts, require
from pointweave.plans import registry

CELLS = [
    ("5*", True, "5", 0, "ace", None), ("6#", True, "6", 0, "unreturnable", None), ("cc4e", True, "4", 0, "serve_fault", None), ("4+w", True, "4", 0, "serve_fault", None),
    ("5f2f1f1v2n@", True, "5", 4, "unforced_error", None), ("4+b27v1*", True, "4", 2, "winner", None), ("6f;1b-2z^2*", True, "6", 3, "winner", None), ("6b29C", True, "6", 1, "incorrect_challenge", None),
    ("S", True, None, 0, None, None), (" 6f2*", False, None, 0, None, "expected_serve_direction"), ("6f2b1", False, "6", 2, None, "missing_point_ending"), ("6b39f28*", False, "6", 2, None, "expected_shot_type"),
    ("4n;", False, "4", 0, "serve_fault", "trailing_after_serve_fault"), ("4", True, "4", 0, "incomplete", None), ("", False, None, 0, None, "empty_cell"), ("5f2*x", False, "5", 1, "winner", "trailing_after_rally_outcome"),
    ("5f++1*", False, "5", 0, None, "duplicate_modifier"), ("5*x", False, "5", 0, "ace", "trailing_after_serve_outcome"), ("5fn1@", False, "5", 1, None, "expected_shot_type"),
]


def test_notation(spark):
    p = parse_notation(F.col("c"))
    rows = spark.createDataFrame([(c[0],) for c in CELLS], "c string").select("c", *[p[k].alias(k) for k in ("valid", "direction", "shots", "outcome", "issue")]).collect()
    assert {r["c"]: tuple(r) for r in rows} == {c[0]: c for c in CELLS}


@pytest.mark.parametrize(("first", "second", "label", "wanted"), [
    ("4*", "", "0-0", {"serve_pts", "first_in", "aces", "resolved_first_serve_status", "resolved_ace_status", "direction:1:deuce:wide"}),
    ("n", "4*", "bad", {"serve_pts", "_unresolved_first_in", "_unresolved_ace", "_unresolved_df"}),
    ("S", "", "0-0", {"_excluded_exceptional_point"}),
])
def test_serve_metrics(spark, first, second, label, wanted):
    df = parsed_cells(spark.createDataFrame([(first, second, label)], "a string, b string, c string"), F.col("a"), F.col("b"), F.col("c"))
    row = df.select(*[c.alias(k.replace(":", "|")) for k, c in serve_metrics().items()]).first().asDict()
    assert {k.replace("|", ":") for k, v in row.items() if v} == wanted


def test_text(spark):
    df = spark.createDataFrame([("40-0", " João_Fonseca ", "10.0"), ("6-6", "O'Connor", "10.5"), ("x", "Łuk", "NR")], "l string, n string, r string")
    rank = parse_rank(F.col("r"))
    got = [tuple(r) for r in df.select(court_side(F.col("l")), normalise_identity(F.col("n")), rank, rank_band(rank)).collect()]
    assert got == [("ad", "joao fonseca", 10, "1-10"), ("deuce", "o connor", None, "missing"), (None, "uk", None, "missing")]


def test_conflicts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert collapse(df, ["k"], ["v"]).collect() == [(1, "a")]
    c = conflict_counts(df, ["k"], ["v"]).first()
    assert (c["raw_rows"], c["unique_keys"], c["usable_rows"], c["exact_groups"], c["conflicting_groups"], c["conflicting_rows"]) == (4, 2, 1, 1, 1, 2)
    with pytest.raises(ValueError, match="missing"):
        require(df, ["k", "w"])


def test_stats(spark):
    v = F.array(*map(F.lit, range(100)))
    b = beta_posterior(F.lit(11), F.lit(10), F.lit(0.5), 1)
    row = spark.range(1).select(finite_quantile(v, 0.95), nearest_rank(v, 0.5), b["mean"]).first()
    assert tuple(row) == (95, 50, None)


def test_names_are_normalised_whole(spark, tmp_path):
    rows = [(1, "Zoë O'Connor  of New-York"), (2, "Zoë O'Connor  of New-York"), (3, "Zoë O'Connor")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["name"]: r["identity"] for r in registry.P2_normalize(spark, str(tmp_path)).collect()}
    assert got == {rows[0][1]: "zoe o connor of new york", rows[2][1]: "zoe o connor"}


def test_identity_of_every_character(spark):
    """Each assigned code point between letters, against the decomposition by the library; no Python worker in the plan."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn" and c < 0x20000 or c in (0x2F800, 0x2F9FF)]
    df = spark.createDataFrame([(c, f"a{chr(c)}B") for c in points], "c int, name string").repartition(4)
    out = df.select("c", normalise_identity(F.col("name")).alias("identity"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
    want = lambda t: " ".join(re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower()).split(" ")).strip(" ")
    wrong = [(r["c"], r["identity"]) for r in out.collect() if r["identity"] != want(f"a{chr(r['c'])}B")]
    assert wrong == [] and len(points) > 80_000
