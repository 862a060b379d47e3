"""Identity, date, rank and score expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper ends of the rank bands, their names, ordinary score labels in order.
BANDS = ((10, "1-10"), (25, "11-25"), (50, "26-50"), (100, "51-100"), (200, "101-200"))
LABELS = ("0", "15", "30", "40", "AD")


@functools.cache
def ascii_parts() -> tuple[dict[str, str], dict[str, str]]:
    """Characters beyond ASCII whose compatibility decomposition has ASCII characters: those with one, those with several.

    Decomposing goes character by character, and reordering moves combining marks only, which are dropped.
    """
    found = {}
    for point in range(0x80, 0x110000):
        part = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if part:
            found[chr(point)] = part
    return {c: x for c, x in found.items() if len(x) == 1}, {c: x for c, x in found.items() if len(x) > 1}


def normalise_identity(name: Column) -> Column:
    """Compatibility-decomposed, non-ASCII dropped, lowered, tokens of letters and digits joined by one space.

    Expressions only: a translation for characters with one ASCII part, a map, looked up for texts that have such
    characters, for those with several.
    """
    one, several = ascii_parts()
    parts = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])
    spelled = F.array_join(F.transform(F.split(name, ""), lambda c: F.coalesce(F.try_element_at(parts, c), c)), "")
    # a class of a thousand characters would be tried one by one for each character of a text; a translation looks it up
    wide = F.when(F.translate(name, "".join(several), "") != name, spelled).otherwise(name)
    plain = F.regexp_replace(F.translate(wide, "".join(one), "".join(one.values())), r"[^\x00-\x7F]", "")
    ascii_only = F.when(name.rlike(r"[^\x00-\x7F]"), plain).otherwise(name)
    return F.trim(F.regexp_replace(F.lower(ascii_only), "[^a-z0-9]+", " "))


def pair(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def compact_date(s: Column) -> Column:
    """yyyyMMdd in exactly eight digits, else null."""
    return F.when(s.rlike("^[0-9]{8}$"), F.try_to_timestamp(s, F.lit("yyyyMMdd")).cast("date"))


def parse_rank(s: Column) -> Column:
    value = F.trim(s).try_cast("double")
    return F.when((value > 0) & (value == F.floor(value)), value.cast("int"))


def rank_band(rank: Column) -> Column:
    out = F.when(rank.isNull(), "missing")
    for most, name in BANDS:
        out = out.when(rank <= most, name)
    return out.otherwise("201+")


def decade(year: Column) -> Column:
    return F.concat((F.floor(year / 10) * 10).cast("string"), F.lit("s"))


def court_side(points: Column) -> Column:
    """deuce or ad from a score label: ordinary labels first, then digits; null otherwise."""
    parts = F.split(F.upper(points), "-")
    a, b = F.get(parts, 0), F.get(parts, 1)
    places = F.array(*map(F.lit, LABELS))
    known = a.isin(*LABELS) & b.isin(*LABELS)
    total = F.when(known, F.array_position(places, a) + F.array_position(places, b)).when(a.rlike("^[0-9]+$") & b.rlike("^[0-9]+$"), a.try_cast("long") + b.try_cast("long"))
    return F.when(F.size(parts) == 2, F.when(total % 2 == 0, "deuce").when(total % 2 == 1, "ad"))


def point_label(own: Column, other: Column) -> Column:
    """A game score as labels, from points won."""
    label = lambda n: F.element_at(F.array(*map(F.lit, LABELS)), F.least(n, F.lit(3)) + 1)
    even = F.when(own == other, "40-40").when(own > other, "AD-40").otherwise("40-AD")
    return F.when((own >= 3) & (other >= 3), even).otherwise(F.concat_ws("-", label(own), label(other)))


def tour_of(name: Column) -> Column:
    """From a match id, or the prefix of a shard's name; case counts."""
    men, women = name.contains("-M-") | name.startswith("charting-m-"), name.contains("-W-") | name.startswith("charting-w-")
    return F.when(men, "ATP").when(women, "WTA").otherwise("Unknown")


#: Columns whose values are digits, 1 or 2, or booleans; any other column only has to be filled.
DIGITS = ("Pt", "Set1", "Set2", "Gm1", "Gm2")
ONE_OR_TWO, FLAGS = ("Svr", "PtWinner"), ("TbSet", "TB?")


def valid_value(field: str, value: Column) -> Column:
    """Whether a cell has a value that its column allows; blanks never do."""
    v = F.trim(value)
    if field in DIGITS:
        return v.rlike("^[0-9]+$")
    if field in ONE_OR_TWO:
        return v.isin("1", "2")
    if field in FLAGS:
        return F.lower(v).isin("true", "false", "0", "1")
    return v != ""


def context_values(match_id: Column, date: Column, surface: Column, author: Column) -> dict[str, Column]:
    """Tour, season, surface and author of a record; missing ones are values of their own."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    blank = lambda c: F.when(c == "", "(blank)").otherwise(c)
    season = F.substring(F.coalesce(date, F.lit("")), 1, 4)
    return {"tour": tour_of(match_id), "season": F.when(season.rlike("^[0-9]{4}$"), season).otherwise("invalid-date"), "surface": blank(F.lower(text(surface))), "chart_author": blank(text(author))}


def iso_date(value: Column) -> Column:
    """2017-07-14 of either 2017-07-14 or 14/07/2017; blank stays blank, anything else is null."""
    v = F.trim(value)
    read = F.coalesce(F.when(v.rlike("^[0-9]{4}-"), F.try_to_timestamp(v, F.lit("yyyy-MM-dd"))), F.when(v.rlike("/"), F.try_to_timestamp(v, F.lit("dd/MM/yyyy"))))
    return F.when(v == "", "").otherwise(F.date_format(read, "yyyy-MM-dd"))


def plain_boolean(value: Column) -> Column:
    """true or false of either language of the reviews; blank stays blank, anything else is null."""
    v = F.lower(F.trim(value))
    return F.when(v == "", "").when(v.isin("true", "verdadeiro"), "true").when(v.isin("false", "falso"), "false")


def era(year: Column) -> Column:
    """The eras that coverage is told by."""
    return F.when(year <= 2009, "through 2009").when(year <= 2018, "2010-18").when(year <= 2019, "2019").when(year <= 2023, "2020-23").otherwise("2024-26")
