"""Additive serve counters of one point, from the parsed notation of its two cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointweave.functions.notation import parse_briefly
from pointweave.functions.text import court_side

#: Serve directions by digit.
DIRECTIONS = {"4": "wide", "5": "middle", "6": "t"}
PARSED = ("direction", "shots", "outcome", "exceptional")


def serve_in(p: dict[str, Column]) -> Column:
    """False after a fault, true after any return of serve or outcome of it, null when the cell does not tell."""
    return F.when(p["outcome"] == "serve_fault", False).when(p["outcome"].isin("ace", "unreturnable") | (p["shots"] > 0), True)


def terminal(p: dict[str, Column]) -> Column:
    return F.coalesce((p["shots"] > 0) | p["outcome"].isin("ace", "unreturnable", "serve_fault"), F.lit(False))


def parsed_cells(df: DataFrame, first: Column, second: Column, points: Column) -> DataFrame:
    """Add what serve_metrics reads. Each cell is parsed once however many counters use it, for PARSED only; a second
    cell is not parsed where the first one decides, as no counter reads it there."""
    cells = df.withColumns({"pw_first": F.coalesce(first, F.lit("")), "pw_second": F.coalesce(second, F.lit("")), "pw_side": court_side(points)})
    cells = parse_briefly(cells, "pw_first", "pw_one")
    open_ = ((F.col("pw_first") == "V") | (F.col("pw_one.outcome") == "serve_fault")) & (F.col("pw_second") != "")
    cells = cells.withColumn("pw_asked", F.when(open_, F.col("pw_second")).otherwise(""))
    return parse_briefly(cells, "pw_asked", "pw_two").drop("pw_asked")


def serve_metrics() -> dict[str, Column]:
    """0/1 columns over parsed_cells, to be summed; a counter that cannot be resolved has one of its own."""
    first, second, side = F.col("pw_first"), F.col("pw_second"), F.col("pw_side")
    one, two = ({k: F.col(f"pw_{n}.{k}") for k in PARSED} for n in ("one", "two"))
    has_two = second != ""
    violation = (first == "V") & has_two
    out = one["exceptional"].isNotNull() & ~violation
    live = ~out
    into = F.when(violation, False).otherwise(serve_in(one))
    is_in, is_out, unknown = live & F.coalesce(into, F.lit(False)), live & F.coalesce(~into, F.lit(False)), live & into.isNull()
    tried, open_two = is_out & has_two, is_out & ~has_two
    settled = is_in | tried
    last_end = F.when(is_in, terminal(one)).when(tried, terminal(two))
    last_ace = F.when(is_in, F.coalesce(one["outcome"] == "ace", F.lit(False))).when(tried, F.coalesce(two["outcome"] == "ace", F.lit(False)))
    two_end = tried & terminal(two)
    one_dir, two_dir = F.coalesce(one["direction"].isin(*DIRECTIONS), F.lit(False)) & side.isNotNull(), F.coalesce(two["direction"].isin(*DIRECTIONS), F.lit(False)) & side.isNotNull()
    got = {
        "serve_pts": live,
        "first_in": is_in,
        "second_in": tried,
        "aces": settled & last_end & last_ace,
        "dfs": two_end & F.coalesce(two["outcome"] == "serve_fault", F.lit(False)),
        "resolved_first_serve_status": is_in | is_out,
        "resolved_ace_status": settled & last_end,
        "resolved_double_fault_status": two_end,
        "_excluded_exceptional_point": out,
        "_unresolved_first_in": unknown,
        "_unresolved_second_in": open_two,
        "_unresolved_ace": unknown | open_two | (settled & ~last_end),
        "_unresolved_df": unknown | open_two | (tried & ~terminal(two)),
        "_unresolved_direction": (is_in & ~one_dir) | (tried & ~two_dir) | open_two,
        "_unresolved_direction_1": is_in & ~one_dir,
        "_unresolved_direction_2": (tried & ~two_dir) | open_two,
    }
    for number, parsed, here in ((1, one, is_in), (2, two, tried)):
        for court in ("deuce", "ad"):
            for digit, name in DIRECTIONS.items():
                got[f"direction:{number}:{court}:{name}"] = here & (side == court) & (parsed["direction"] == digit)
    return {k: F.coalesce(v, F.lit(False)).cast("int") for k, v in got.items()}
