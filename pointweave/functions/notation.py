"""Shot notation cells parsed by regular expressions that Spark and RE2 read alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The alphabets of the notation.
TYPES, MODIFIERS, SERVES, FAULTS, DETAILS = "fbrsvzopuylmhijktq", "-+=;^", "0456", "nwdxge!", "nwdxe!"
EXCEPTIONAL = {"S": "server_awarded_unobserved", "R": "returner_awarded_unobserved", "P": "penalty_against_server", "Q": "penalty_against_returner", "V": "first_serve_lost_time_violation"}

SHOT = f"[{TYPES}][{MODIFIERS}]*[0-3]?"
FIRST = SHOT + "[0789]?"
ENDING = f"(?:[{DETAILS}]?[@#]|[*C])"
HEAD = f"^(c*)([{SERVES}])(\\+?)"
RALLY = f"^{FIRST}(?:{SHOT})*"
TWICE = "|".join(f"[{c}][{MODIFIERS}]*[{c}]" if c != "^" else f"\\^[{MODIFIERS}]*\\^" for c in MODIFIERS)


#: One shot in a rally: its type and all up to the next type.
PIECE = f"[{TYPES}][^{TYPES}]*"
STATES = ("direction_state", "volley_state", "rally_state", "outcome_state")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with ``value`` worked out once, however often ``then`` uses it: a lambda's variable is not inlined."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def shot(piece: Column, first: Column) -> Column:
    """struct(type, direction, depth, modifiers) of a piece; only a rally's first shot has a depth."""
    after = F.substring(piece, 2, 99)
    marks = F.translate(after, "0123456789", "")
    digits = F.translate(after, MODIFIERS, "")
    lead = F.substring(digits, 1, 1)
    aimed = lead.isin(*"0123")
    depth = F.when(aimed, F.substring(digits, 2, 1)).otherwise(lead)
    return F.struct(
        F.substring(piece, 1, 1).alias("type"),
        F.when(aimed, lead).alias("direction"),
        F.when(first & (depth != ""), depth).alias("depth"),
        F.when(marks == "", F.array().cast("array<string>")).otherwise(F.split(marks, "")).alias("modifiers"),
    )


def repeat_at(piece: Column) -> Column:
    """Characters of a piece up to its first repeated modifier; the piece has one."""
    marks = F.regexp_extract(piece, f"^.([{MODIFIERS}]*)", 1)
    places = F.filter(F.sequence(F.lit(2), F.length(marks)), lambda i: F.instr(F.substring(marks, F.lit(1), i - 1), F.substring(marks, i, F.lit(1))) > 0)
    return F.get(places, F.lit(0))


def _rally(rest: Column, start: Column) -> Column:
    """The rally struct of a cell's text behind the serve, which starts at ``start``."""

    def judged(x: Column) -> Column:
        pieces, tail, doubled = x["pieces"], x["tail"], x["doubled"]
        ending = F.when((doubled == 0) & (F.size(pieces) > 0), F.regexp_extract(tail, f"^{ENDING}", 0)).otherwise("")

        def closed(end: Column) -> Column:
            kept = F.when(doubled > 0, F.slice(pieces, 1, F.greatest(doubled - 1, F.lit(0)))).otherwise(pieces)
            shots = F.transform(kept, lambda s, k: shot(s, k == 0))
            detail = F.when(F.length(end) == 2, F.substring(end, 1, 1))
            mark = F.when(end != "", F.substring(end, -1, 1))
            before = F.length(F.array_join(kept, ""))
            code = (
                F.when(doubled > 0, "duplicate_modifier")
                .when((end != "") & (F.length(tail) > F.length(end)), "trailing_after_rally_outcome")
                .when(end != "", None)
                .when(F.length(tail) > 0, "expected_shot_type")
                .otherwise("missing_point_ending")
            )
            at = F.when(doubled > 0, before + repeat_at(F.get(pieces, doubled.cast("int") - 1))).when(end != "", F.length(rest) - F.length(tail) + F.length(end)).otherwise(F.length(rest) - F.length(tail))
            some = F.size(kept) > 0
            rally = F.when(code.isin("duplicate_modifier", "expected_shot_type"), F.when(some, "partial").otherwise("invalid")).otherwise("observed")
            outcome_state = F.when(code.isin("duplicate_modifier", "expected_shot_type"), "invalid").when(code == "missing_point_ending", "absent").otherwise("observed")
            outcome = F.when(mark == "*", "winner").when(mark == "@", "unforced_error").when(mark == "#", "forced_error").when(mark == "C", "incorrect_challenge")
            return F.struct(
                shots.alias("shots"), detail.alias("detail"), mark.alias("ending"), outcome.alias("outcome"), code.alias("issue"),
                F.when(code.isNotNull(), start + at).cast("int").alias("at"), rally.alias("rally"), outcome_state.alias("outcome_state"),
            )

        return bound(ending, closed)

    def parts(prefix: Column) -> Column:
        pieces = F.regexp_extract_all(prefix, F.lit(PIECE), F.lit(0))
        return bound(pieces, lambda p: F.struct(p.alias("pieces"), F.substring(rest, F.length(prefix) + 1, F.length(rest)).alias("tail"), F.array_position(F.transform(p, lambda s: s.rlike(TWICE)), F.lit(True)).alias("doubled")))

    return bound(bound(F.regexp_extract(rest, RALLY, 0), parts), judged)


NO_RALLY = "cast(null as struct<shots:array<struct<type:string,direction:string,depth:string,modifiers:array<string>>>,detail:string,ending:string,outcome:string,issue:string,at:int,rally:string,outcome_state:string>)"


def parse_notation(cell: Column) -> Column:
    """One struct of a cell: valid, direction, volley, fault, lets, shots (their number), outcome, exceptional, issue,
    issue_at (0-based place), rally (array of type, direction, depth, modifiers), detail and ending of the last shot, and
    the four component STATES. Null and empty cells are invalid. Read the fields from a selected column: every mention
    of the expression parses the cell again.
    """

    def whole(c: Column) -> Column:
        special = c.isin(*EXCEPTIONAL)

        def headed(head: Column) -> Column:
            served = head != ""
            rest = F.substring(c, F.length(head) + 1, F.length(c))

            def opened(x: Column) -> Column:
                rest, first = x["rest"], F.substring(x["rest"], 1, 1)
                is_fault = served & (first != "") & (F.instr(F.lit(FAULTS), first) > 0)
                is_end = served & first.isin("*", "#")
                is_rally = served & (first != "") & ~is_fault & ~is_end
                rally = F.when(is_rally, _rally(rest, F.length(head))).otherwise(F.expr(NO_RALLY))
                return bound(rally, lambda r: _named(c, head, rest, special, served, is_fault, is_end, is_rally, r))

            return bound(F.struct(rest.alias("rest")), opened)

        return bound(F.when(special, "").otherwise(F.regexp_extract(c, HEAD, 0)), headed)

    return bound(F.coalesce(cell, F.lit("")), whole)


def _named(cell: Column, head: Column, rest: Column, special: Column, served: Column, is_fault: Column, is_end: Column, is_rally: Column, rally: Column) -> Column:
    digit = F.when(served, F.translate(head, "c+", ""))
    lets = F.when(served, F.length(head) - F.length(F.translate(head, "c", ""))).otherwise(0)
    volley = F.when(served, head.endswith("+"))
    long = F.length(rest) > 1
    issue = F.when(cell == "", "empty_cell").when(special, None).when(~served, "expected_serve_direction").when(is_fault & long, "trailing_after_serve_fault").when(is_end & long, "trailing_after_serve_outcome").when(is_rally, rally["issue"])
    unserved = F.length(F.regexp_extract(cell, "^c*", 0))
    at = F.when(cell == "", 0).when(special, None).when(~served, unserved).when((is_fault | is_end) & long, F.length(head) + 1).when(is_rally, rally["at"])
    outcome = F.when(is_fault, "serve_fault").when(is_end & rest.startswith("*"), "ace").when(is_end, "unreturnable").when(is_rally, rally["outcome"]).when(served, "incomplete")
    names = F.create_map(*[F.lit(x) for kv in EXCEPTIONAL.items() for x in kv])
    none = F.when(special, "not_applicable").when(~served, "invalid")
    return F.struct(
        issue.isNull().alias("valid"), digit.alias("direction"), volley.alias("volley"), F.when(is_fault, F.substring(rest, 1, 1)).alias("fault"), lets.cast("int").alias("lets"),
        F.when(is_rally, F.size(rally["shots"])).otherwise(0).cast("int").alias("shots"), outcome.alias("outcome"), F.when(special, F.element_at(names, cell)).alias("exceptional"),
        issue.alias("issue"), at.cast("int").alias("issue_at"), F.when(is_rally, rally["shots"]).otherwise(F.expr("cast(array() as array<struct<type:string,direction:string,depth:string,modifiers:array<string>>>)")).alias("rally"),
        rally["detail"].alias("detail"), rally["ending"].alias("ending"),
        F.coalesce(none, F.when(digit == "0", "unknown").otherwise("observed")).alias("direction_state"),
        F.coalesce(none, F.when(volley, "observed").otherwise("absent")).alias("volley_state"),
        F.coalesce(none, F.when(is_rally, rally["rally"]).when(is_fault | is_end, "not_applicable").otherwise("absent")).alias("rally_state"),
        F.coalesce(none, F.when(is_rally, rally["outcome_state"]).when(is_fault | is_end, "observed").otherwise("absent")).alias("outcome_state"),
    )


def _stepped(df: DataFrame, cell: str) -> tuple[DataFrame, dict[str, Column]]:
    """A column of cells taken apart into columns in place of lambdas, which Spark does not compile: no shot is taken apart.

    A rally has a repeated modifier where its text has, as types and digits part the shots' modifiers; the shots before it
    (``kept``) are the types before it, but one. ``marked`` is the ending that counts.
    """
    names = ("c", "head", "rest", "prefix", "twice", "kept", "marked")
    c, head, rest, prefix, twice, _, _ = (F.col(f"pw_cell_{k}") for k in names)
    step = lambda d, k, v: d.withColumn(f"pw_cell_{k}", v)
    out = step(df, "c", F.coalesce(F.col(cell), F.lit("")))
    special, served, first = c.isin(*EXCEPTIONAL), head != "", F.substring(rest, 1, 1)
    fault, end = served & first.isin(*FAULTS), served & first.isin("*", "#")
    rally = served & (first != "") & ~fault & ~end
    out = step(out, "head", F.when(special | (c == ""), "").otherwise(F.regexp_extract(c, HEAD, 0)))
    out = step(out, "rest", F.substring(c, F.length(head) + 1, F.length(c)))
    out = step(out, "prefix", F.when(rally, F.regexp_extract(rest, RALLY, 0)).otherwise(""))
    out = step(out, "twice", (prefix != "") & prefix.rlike(TWICE))
    before = F.regexp_extract(prefix, f"^(.*?)(?:{TWICE})", 1)
    out = step(out, "kept", F.when(twice, F.regexp_extract(before, f"^(.*)[{TYPES}][^{TYPES}]*$", 1)).otherwise(prefix))
    tail = F.substring(rest, F.length(prefix) + 1, F.length(rest))
    out = step(out, "marked", F.when((prefix != "") & ~twice, F.regexp_extract(tail, f"^{ENDING}", 0)).otherwise(""))
    return out, {k: F.col(f"pw_cell_{k}") for k in names} | {"special": special, "served": served, "first": first, "fault": fault, "end": end, "rally": rally, "tail": tail}


def _brief(p: dict[str, Column]) -> list[Column]:
    """direction, shots, outcome and exceptional of a cell taken apart."""
    mark = F.substring(p["marked"], -1, 1)
    rally = F.when(mark == "*", "winner").when(mark == "@", "unforced_error").when(mark == "#", "forced_error").when(mark == "C", "incorrect_challenge")
    outcome = F.when(p["fault"], "serve_fault").when(p["end"] & (p["first"] == "*"), "ace").when(p["end"], "unreturnable").when(p["rally"], rally).when(p["served"], "incomplete")
    shots = F.length(p["kept"]) - F.length(F.translate(p["kept"], TYPES, ""))
    names = F.create_map(*[F.lit(x) for kv in EXCEPTIONAL.items() for x in kv])
    return [F.when(p["served"], F.translate(p["head"], "c+", "")).alias("direction"), shots.cast("int").alias("shots"), outcome.alias("outcome"), F.when(p["special"], F.element_at(names, p["c"])).alias("exceptional")]


def parse_briefly(df: DataFrame, cell: str, name: str) -> DataFrame:
    """Add ``name``: struct(direction, shots, outcome, exceptional) of a column of cells, as in ``parse_notation``."""
    out, p = _stepped(df, cell)
    return out.select(*df.columns, F.struct(*_brief(p)).alias(name))


def parse_counted(df: DataFrame, cell: str) -> DataFrame:
    """Add what counters read, as ``parse_notation`` gives it: direction, shots, outcome, exceptional, issue, issue_at, volley
    and STATES; and of the shots how many have a known direction (``aimed``), and whether the return has one
    (``return_aimed``) and a known depth (``return_deep``)."""
    out, p = _stepped(df, cell)
    c, head, rest, prefix, twice, kept, marked, tail = (p[k] for k in ("c", "head", "rest", "prefix", "twice", "kept", "marked", "tail"))
    special, served, fault, end, rally = (p[k] for k in ("special", "served", "fault", "end", "rally"))
    code = F.when(twice, "duplicate_modifier").when((marked != "") & (F.length(tail) > F.length(marked)), "trailing_after_rally_outcome").when(marked != "", None).when(F.length(tail) > 0, "expected_shot_type").otherwise("missing_point_ending")
    long = F.length(rest) > 1
    issue = F.when(c == "", "empty_cell").when(special, None).when(~served, "expected_serve_direction").when(fault & long, "trailing_after_serve_fault").when(end & long, "trailing_after_serve_outcome").when(rally, code)
    out = out.withColumn("pw_cell_issue", issue)
    issue = F.col("pw_cell_issue")
    marks = F.regexp_extract(F.substring(prefix, F.length(kept) + 2, F.length(prefix)), f"^[{MODIFIERS}]*", 0)
    twice_in = lambda m: F.regexp_extract(marks, f"^[^{m}]*{m}[^{m}]*{m}", 0)
    again = [F.nullif(F.length(twice_in(f"\\{m}")), F.lit(0)) for m in MODIFIERS]  # characters up to a modifier's second place
    ended = F.when(twice, F.length(kept) + F.least(*again)).otherwise(F.length(prefix) + F.length(marked))
    at = F.when(c == "", 0).when(issue.isNull(), None).when(~served, F.length(F.regexp_extract(c, "^c*", 0))).when(fault | end, F.length(head) + 1).otherwise(F.length(head) + ended)
    none = F.when(special, "not_applicable").when(~served, "invalid")
    unread = issue.isin("duplicate_modifier", "expected_shot_type")
    digit, volley = F.translate(head, "c+", ""), F.when(served, head.endswith("+"))
    states = [
        F.when(digit == "0", "unknown").otherwise("observed"),
        F.when(volley, "observed").otherwise("absent"),
        F.when(rally & unread, F.when(kept != "", "partial").otherwise("invalid")).when(rally, "observed").when(fault | end, "not_applicable").otherwise("absent"),
        F.when(rally & unread, "invalid").when(rally & (issue == "missing_point_ending"), "absent").when(rally | fault | end, "observed").otherwise("absent"),
    ]
    opening = f"^[{TYPES}][{MODIFIERS}]*"
    return out.select(
        *df.columns, *_brief(p), issue.alias("issue"), at.cast("int").alias("issue_at"), volley.alias("volley"), *[F.coalesce(none, v).alias(n) for n, v in zip(STATES, states, strict=True)],
        (F.length(kept) - F.length(F.translate(kept, "123", ""))).alias("aimed"), kept.rlike(f"{opening}[123]").alias("return_aimed"), kept.rlike(f"{opening}[0-3]?[789]").alias("return_deep"),
    )
