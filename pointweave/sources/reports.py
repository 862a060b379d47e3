"""Small results on the driver: JSON that can be read again, Markdown tables, pinned inputs."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

from pointweave.sources.readers import fingerprints

#: Rows of a result that may come to the driver; larger ones belong in Parquet.
MOST_ROWS = 10_000


def collected(df: DataFrame, most: int = MOST_ROWS) -> list[dict]:
    """All rows as dicts in the order of their columns' text; more than ``most`` rows are refused, never cut."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write the result as Parquet")
    return sorted(rows, key=lambda r: json.dumps(r, default=str))


def save_json(result: dict, path: str | Path) -> None:
    """Two spaces, sorted keys, one line feed at the end; an existing file is not overwritten."""
    with open(path, "x", encoding="utf-8") as out:
        out.write(json.dumps(result, indent=2, sort_keys=True, default=str) + "\n")


def load_json(path: str | Path) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def shown(value: object) -> str:
    """A cell's text: NA for missing, (blank) for empty, pipes escaped."""
    if value is None:
        return "NA"
    text = f"{value:.6g}" if isinstance(value, float) else str(value)
    return text.replace("|", "\\|").replace("\n", " ") if text.strip() else "(blank)"


def markdown(result: dict) -> str:
    """A report of {"title", "source", "columns", "rows"}: equal results give equal text."""
    columns = result["columns"]
    lines = [f"# {result['title']}", "", f"Source: `{result['source']}`. Rows: {len(result['rows'])}.", "", "| " + " | ".join(columns) + " |", "|" + "-|" * len(columns)]
    lines += ["| " + " | ".join(shown(r[c]) for c in columns) + " |" for r in result["rows"]]
    return "\n".join(lines) + "\n"


#: Each report: its title, what it tells, and its sections by the query that fills them.
REPORTS: dict[str, tuple[str, str, dict[str, str]]] = {
    "dataset": ("Dataset profile", "Rows, duplicates, conflicts and values of the whole snapshot. Conflicting keys are left out whole.", {"Figures": "E7_snapshot_profile", "Field values": "P7_valid_values", "Aggregate files": "G26_aggregate_files"}),
    "shard": ("Single-shard profile", "The same figures of one shard, read from its file.", {"Figures": "E8_shard_profile", "Coverage of the largest groups": "G29_field_coverage"}),
    "feasibility": ("Feasibility", "How much each player is seen, and how evenly.", {"Exposure by quartile": "G6_five_number", "Eras": "O7_eras"}),
    "bias": ("Selection", "How coverage differs by tour and season.", {"Coverage": "G4_coverage_sets", "Strata": "P10_strata"}),
    "parser": ("Notation parser", "What cells say and where they stop being readable; nothing is guessed.", {"Counters": "G3_notation_counters"}),
    "reconciliation": ("Reconciliation", "Computed against published counters, over records without an unresolved counter.", {"Totals": "G10_reconcile_overview", "Directions": "G11_reconcile_directions", "Mismatches by context": "G12_mismatch_rates", "First mismatches": "O4_examples"}),
    "context-join": ("Context join", "Statuses of the conservative resolution, with the evidence for review.", {"Counts": "G13_join_counts", "Coverage": "G13_join_coverage", "Agreement": "G13_agreement", "Figures": "E9_join_audit", "Review queue": "K3_review_queue"}),
    "review": ("Human review", "Decisions on the reviewed rows; the interval is Wilson's.", {"Decisions": "G25_review_decisions", "Precision": "E10_review_summary", "Changed evidence": "F14_review_evidence"}),
    "reconstruction": ("Score reconstruction", "Matches whose rows follow from each other, and the first failure of those that do not.", {"Failures": "R4_failure_profile"}),
    "stability": ("Split stability", "Distances within players against those between players; matches are resampled, not points.", {"Cells": "E1_stability", "By tour": "E1_stability_by_tour"}),
    "context-stability": ("Stability within contexts", "The same within strata of seven dimensions.", {"Cells": "E2_context_stability"}),
    "shrinkage": ("Temporal shrinkage", "Strengths are chosen on validation seasons, losses are of test seasons.", {"Folds": "E3_shrinkage", "Models": "G31_score_summary", "By tour": "G31_score_summary_by_tour", "Intervals": "M21_shrinkage_intervals"}),
    "readiness": ("Publication readiness", "What histories rest on; no player is named.", {"Histories": "E4_readiness", "Thresholds": "G20_threshold_grids", "Uncertainty": "G32_uncertainty"}),
    "robustness": ("Robustness of directions", "Errors and coverage over windows and least matches; the last, partial season is no test.", {"Configurations": "E5_robustness", "Components": "G22_component_coverage", "Court sides": "G21_court_sides"}),
    "process": ("Process uncertainty", "Radii widened by what the season before needed.", {"Configurations": "E6_process", "Components": "M18_process_coverage", "Sources": "G23_process_sources"}),
    "live": ("Live scoreboard sample", "States as they were read; outcomes are not inferred.", {"States": "E11_live_inspection"}),
}


def report(name: str, source: str, tables: dict[str, dict]) -> str:
    """The Markdown of a named report from its sections' {"columns", "rows"}."""
    title, tells, sections = REPORTS[name]
    lines = [f"# {title}", "", tells, "", f"Source: `{source}`.", ""]
    for heading in sections:
        t = tables[heading]
        lines += [f"## {heading}", "", f"{len(t['rows'])} rows.", "", "| " + " | ".join(t["columns"]) + " |", "|" + "-|" * len(t["columns"])]
        lines += ["| " + " | ".join(shown(r[c]) for c in t["columns"]) + " |" for r in t["rows"]]
        lines.append("")
    return "\n".join(lines)


def require_snapshot(result: dict, snapshot: str) -> dict:
    """Fail unless a saved result is of the named snapshot."""
    if result.get("snapshot") != snapshot:
        raise ValueError(f"the result is of {result.get('snapshot')!r}, not of {snapshot!r}")
    return result


def require_pinned(files: DataFrame, manifest: dict[str, str]) -> None:
    """Fail unless (path, sha256) rows, as ``fingerprints`` makes them, hold just the manifest's file names and hashes."""
    found = {r["path"].rsplit("/", 1)[-1]: r["sha256"] for r in collected(files)}
    wrong = sorted(k for k in found.keys() | manifest.keys() if found.get(k) != manifest.get(k))
    if wrong:
        raise ValueError(f"inputs differ from the manifest: {wrong}")


def pinned(spark, path: str, manifest: dict[str, str]) -> None:
    require_pinned(fingerprints(spark, path), manifest)
