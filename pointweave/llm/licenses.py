"""Operator 13: licence notices and tags by Aho-Corasick, and licence expressions by a shunting-yard parser."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.llm.common import in_batches, named

#: Base phrases of the contract and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases of the method, in words, and their labels.
NOTICES = {
    "mit license": "mit", "permission is hereby granted free of charge": "mit",
    "apache license": "apache", "bsd license": "bsd", "redistribution and use in source and binary forms": "bsd",
    "isc license": "isc", "mozilla public license": "mpl", "eclipse public license": "epl",
    "lesser general public license": "lgpl", "affero general public license": "agpl",
    "creative commons attribution": "cc-by", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc", "cc by nc nd": "cc-by-nc", "cc0": "cc0", "public domain": "public-domain", "the unlicense": "public-domain",
    "proprietary and confidential": "reserved",
}
#: Tags before an expression, lower-cased; after the strict ones any identifier is a licence.
TAGS = {"spdx-license-identifier": True, "license-expression": True, "license": False, "licence": False, "lizenz": False, "licencia": False}
#: Identifiers of expressions by their beginning, the longest that fits, and what it is labelled.
IDENTIFIERS = {
    "mit": "mit", "apache": "apache", "bsd": "bsd", "0bsd": "bsd", "isc": "isc", "mpl": "mpl", "epl": "epl", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl",
    "cc-by": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "cc0": "cc0", "unlicense": "public-domain",
    "publicdomain": "public-domain", "proprietary": "reserved", "unlicensed": "reserved",
}
#: What a licence lets be done with a text, 0 (nothing) to 1 (anything); a statement of another licence counts UNKNOWN,
#: and a document without a statement SILENT.
PERMISSION = {"public-domain": 1.0, "cc0": 1.0, "mit": 0.9, "bsd": 0.9, "isc": 0.9, "apache": 0.9, "cc-by": 0.8, "mpl": 0.6, "epl": 0.6, "lgpl": 0.6, "cc-by-sa": 0.5, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "reserved": 0.0}
UNKNOWN, SILENT, OTHER = 0.5, 0.5, "other"
#: An exception after WITH takes back a part of what its licence withholds.
EXCEPTION = 0.5

LEVELS = {"or": 1, "and": 2, "with": 3}
#: ASCII letters lower-cased; every other ASCII character that is no digit parts words.
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
PARTED = bytes(x if x >= 128 or 48 <= x <= 57 or 97 <= x <= 122 else 32 for x in LOWERED)
SPACES = re.compile(rb"  +")
BEFORE = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?")
TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)")

PLACE = "word long, label string, base boolean"
STATEMENT = "start long, end long, expression string, labels array<string>, permission double"


@dataclass(frozen=True)
class Value:
    """What an expression says: the labels of its licences, and the permission that they give together."""

    labels: frozenset[str]
    permission: float


@functools.lru_cache(10_000)
def licence(token: str) -> Value | None:
    """The value of an identifier (with or without version), None if no licence is known by it."""
    begin = next((k for k in sorted(IDENTIFIERS, key=len, reverse=True) if re.fullmatch(rf"{re.escape(k)}(?![a-z]).*", token)), None)
    return Value(frozenset([IDENTIFIERS[begin]]), PERMISSION[IDENTIFIERS[begin]]) if begin else None


def applied(operator: str, left: Value, right: Value | None) -> Value:
    """AND holds to both licences, OR to the more generous one, WITH eases the one before it."""
    if operator == "with":
        return Value(left.labels, left.permission + (1 - left.permission) * EXCEPTION)
    both = left.labels | right.labels
    return Value(both, min(left.permission, right.permission) if operator == "and" else max(left.permission, right.permission))


def expression(text: str, at: int, strict: bool) -> tuple[int, Value] | None:
    """End and value of the licence expression that begins at ``at`` of a lower-cased text, or None.

    Shunting-yard: operands and operators go on two stacks, WITH binds closer than AND, AND closer than OR. The longest
    beginning of the line that is an expression counts; brackets left open are closed at its end. Unless ``strict``, the
    first identifier must be a known licence; later unknown ones count UNKNOWN.
    """
    values: list[Value | None] = []
    operators: list[str] = []
    operand, end, open_at = True, at, 0

    def reduce(level: int) -> None:
        while operators and operators[-1] != "(" and LEVELS[operators[-1]] >= level:
            right, left = values.pop(), values.pop()
            values.append(applied(operators.pop(), left, right))

    pending = None  # an operator counts once its right side is there
    while token := TOKEN.match(text, at):
        word, at = token[1], token.end()
        if operand:
            if word == "(":
                if pending == "with":
                    break
                if pending:
                    reduce(LEVELS[pending])
                    operators.append(pending)
                    pending = None
                operators.append("(")
                open_at += 1
                continue
            if word == ")" or word in LEVELS:
                break
            word = word.rstrip(".-")
            value = licence(word)
            if value is None and not values and not strict and pending is None:
                return None
            if pending:
                reduce(LEVELS[pending])
                operators.append(pending)
                pending = None
            values.append(value or Value(frozenset([OTHER]), UNKNOWN))
            operand, end = False, token.start(1) + len(word)
            if len(word) < len(token[1]):
                break  # a full stop ends the expression
        elif word == ")":
            if not open_at:
                break
            reduce(1)
            operators.pop()
            open_at, end = open_at - 1, at
        elif word in LEVELS:
            pending, operand = word, True
        else:
            break
    if not values:
        return None
    while operators:
        if operators[-1] == "(":
            operators.pop()
            # an operator whose bracket never got an operand has no right side
            while operators and operators[-1] != "(" and len(values) <= sum(o != "(" for o in operators):
                operators.pop()
        else:
            reduce(1)
    return end, values[0]


@functools.cache
def automaton(words: bool) -> ahocorasick.Automaton:
    """Of the phrases, as words between spaces, or of the tags."""
    out = ahocorasick.Automaton()
    for phrase in [*BASE, *NOTICES] if words else TAGS:
        out.add_word(f" {phrase} " if words else phrase, phrase)
    out.make_automaton()
    return out


def scanned(text: bytes) -> tuple[int, list[tuple], list[tuple]]:
    """Words, places (word, label, base) and statements (start, end, expression, labels, permission) of a text."""
    words = b" " + SPACES.sub(b" ", text.translate(PARTED)).strip(b" ") + b" "
    n = words.count(b" ") - 1 if len(words) > 2 else 0
    hits = [(end - len(p) - 1, p) for end, p in automaton(True).iter(words.decode("latin-1"))]
    places = []
    if hits:
        begins = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
        at = np.searchsorted(begins, [b for b, _ in hits])
        places = sorted((int(w), *((BASE[p], True) if p in BASE else (NOTICES[p], False))) for w, (_, p) in zip(at, hits, strict=True))
    low = text.translate(LOWERED).decode("latin-1")
    statements, upto = [], 0
    for end, tag in automaton(False).iter(low):
        begin = end + 1 - len(tag)
        if begin < upto or begin and (low[begin - 1].isalnum() or low[begin - 1] in "-_") or not (gap := BEFORE.match(low, end + 1)):
            continue
        if got := expression(low, gap.end(), TAGS[tag]):
            upto, value = got
            raw = text[gap.end() : upto].decode(errors="replace")
            start = len(text[: gap.end()].decode(errors="replace"))
            statements.append((start, start + len(raw), raw, sorted(value.labels), value.permission))
    return n, places, statements


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, places, statements, score) of each row of ``docs``, whole texts.

    places: where phrases stand, as (word, label, base) with words counted from 0. statements: licence expressions after
    a tag, as code points (end exclusive), text, labels and permission. score: the least permission that a place or
    statement gives, SILENT without any. Null and empty texts have no words; repeated rows give repeated results; null
    ids are handed through; an empty table gives no rows; other columns are not read; a result column that the id has
    the name of gets ``_result`` behind it.
    """
    names = named(id_col, ["n_words", "places", "statements", "score"])
    kinds = [T.LongType(), T.ArrayType(T.StructType.fromDDL(PLACE)), T.ArrayType(T.StructType.fromDDL(STATEMENT)), T.DoubleType()]
    id_field = docs.schema[id_col]
    out = T.StructType([id_field, *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.list_(pa.struct([("word", pa.int64()), ("label", pa.string()), ("base", pa.bool_())]))
        statement = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("expression", pa.string()), ("labels", pa.list_(pa.string())), ("permission", pa.float64())]))
        for b in batches:
            got = [scanned(t or b"") for t in b.column("pw_text").cast(pa.large_binary()).to_pylist()]
            places = [[dict(zip(("word", "label", "base"), p, strict=True)) for p in x[1]] for x in got]
            statements = [[dict(zip(("start", "end", "expression", "labels", "permission"), s, strict=True)) for s in x[2]] for x in got]
            score = [min([PERMISSION[p[1]] for p in x[1]] + [s[4] for s in x[2]], default=SILENT) for x in got]
            columns = [b.column("pw_id"), pa.array([x[0] for x in got], pa.int64()), pa.array(places, place), pa.array(statements, statement), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return in_batches(docs.select(F.col(id_col).alias("pw_id"), F.col(text_col).cast("string").alias("pw_text")), run, out)


def license_digest(scan: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of a license_scan."""
    words, places, statements, score = named(id_col, ["n_words", "places", "statements", "score"])
    base = F.filter(places, lambda p: p["base"])
    at = F.transform(base, lambda p: p["word"])
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    labels = F.concat(F.transform(places, lambda p: p["label"]), F.flatten(F.transform(statements, lambda s: s["labels"])))
    columns = [F.col(words), F.size(base).cast("long"), F.array_min(at), F.array_max(at), listed(F.transform(base, lambda p: p["label"])), listed(labels), F.col(score)]
    names = named(id_col, ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])
    return scan.select(id_col, *(c.alias(n) for c, n in zip(columns, names, strict=True)))
