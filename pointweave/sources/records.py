"""Delimited files with quoted line breaks, read in as many tasks as there are byte ranges.

A line tells nothing about whether it begins a record: that depends on all quotes before it. So a first pass counts the
quotes of each range of each file, and running sums of these counts tell in which state a range begins. Where a range
begins outside quotes and no line of it leaves a quote open, each line is a record and is parsed as it is read. A second
pass puts the lines of the other ranges together to records. What a range's end cuts is put together afterwards: two
pieces per range at most.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.operators.store import written

#: Ranges whose states are broadcast; more are joined by a shuffle, after which lines are put in order again.
MOST_RANGES = 500_000

PIECE = "file string, range long, line long, kind int, text string"
#: Kinds of pieces, in the order in which a range can have them: the end of a record that began before the range (which a
#: range within one record is, too), a whole record, and the beginning of one that the range cuts.
REST, WHOLE, BEGUN = 0, 1, 2


def lines(spark: SparkSession, paths: str | list[str], **options: str) -> DataFrame:
    """(file, range, line, text): the lines of each byte range that Spark reads, numbered in their order."""
    raw = spark.read.options(**options).text(paths, lineSep="\n")
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))


def range_states(rows: DataFrame) -> DataFrame:
    """(file, range, first_line, first_text, open, plain): whether a range begins inside quotes, its first line, and whether
    each of its lines is a record.

    One pass over all files adds up quotes in tasks that hash ranges and sort no lines; another takes the first line of each
    file, which headers are read from (first_text is null for later ranges). A row per range.
    """
    quotes = F.length("text") - F.length(F.replace(F.col("text"), F.lit('"')))
    per = rows.groupBy("file", "range").agg(F.sum(quotes).alias("quotes"), F.count_if(quotes % 2 == 1).alias("left_open"), F.min("line").alias("first_line"))
    per = written(per)
    begun = per.where("range = 0").select(F.col("first_line").alias("line"))
    begun = F.broadcast(begun) if begun.count() <= MOST_RANGES else begun
    heads = rows.where("range = 0").join(begun, "line").select("file", "range", F.col("text").alias("first_text"))
    per = per.join(heads, ["file", "range"], "left")
    before = F.sum("quotes").over(W.partitionBy("file").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    begins_open = F.coalesce(before, F.lit(0)) % 2 == 1
    return per.select("file", "range", "first_line", "first_text", begins_open.alias("open"), (~begins_open & (F.col("left_open") == 0)).alias("plain"))


def is_header() -> Column:
    """Whether a line, beside its range's state, is its file's header."""
    return (F.col("range") == 0) & (F.col("line") == F.col("first_line"))


def plain_records(rows: DataFrame, states: DataFrame) -> DataFrame:
    """(file, range, line, text): the lines of plain ranges but for headers."""
    told = states.where("plain").select("file", "range", "first_line")
    joined = rows.join(F.broadcast(told) if states.count() <= MOST_RANGES else told, ["file", "range"])
    return joined.where(~is_header()).select("file", "range", "line", "text")


def pieces(rows: DataFrame, states: DataFrame) -> DataFrame:
    """Lines put together to pieces of records in their range; the first line of a file is its header and left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, inside, kind, first = None, [], False, WHOLE, 0
        out: list[tuple] = []

        def closed(kind: int) -> None:
            if held:
                out.append((*at, first, kind, "\n".join(held)))
                held.clear()

        for b in batches:
            for file, start, line, text, begins_open, header in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (file, start) != at:
                    if held:
                        closed(BEGUN if kind == WHOLE else REST)
                    at, inside = (file, start), begins_open
                    kind, first = (REST, line) if begins_open else (WHOLE, line)
                if header:
                    continue
                if not held:
                    first = line
                held.append(text)
                inside ^= text.count('"') % 2 == 1
                if not inside:
                    closed(kind)
                    kind = WHOLE
            yield _batch(out)
            out.clear()
        if held:
            closed(BEGUN if kind == WHOLE else REST)
        yield _batch(out)

    told = states.select("file", "range", "open", "first_line")
    if states.count() <= MOST_RANGES:
        joined = rows.join(F.broadcast(told), ["file", "range"])
    else:
        joined = rows.join(told, ["file", "range"]).repartition("file", "range").sortWithinPartitions("file", "range", "line")
    return joined.select("file", "range", "line", "text", "open", is_header().alias("header")).mapInArrow(run, PIECE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "range", "line", "kind", "text"])


def whole_records(parts: DataFrame) -> DataFrame:
    """(file, range, line, text): a record per row, its range and line those of its beginning."""
    cut = parts.where(F.col("kind") != WHOLE)
    begun = F.sum(F.when(F.col("kind") == BEGUN, 1).otherwise(0)).over(W.partitionBy("file").orderBy("range", "kind"))  # two rows per range at most
    sorted_ = F.array_sort(F.collect_list(F.struct("range", "kind", "line", "text")))
    joined = cut.withColumn("record", begun).groupBy("file", "record").agg(sorted_.alias("x"))
    stitched = joined.select("file", F.col("x")[0]["range"].alias("range"), F.col("x")[0]["line"].alias("line"), F.array_join(F.transform("x", lambda p: p["text"]), "\n").alias("text"))
    return parts.where(F.col("kind") == WHOLE).select("file", "range", "line", "text").unionByName(stitched)


def header_of(states: DataFrame, sep: str) -> list[str]:
    """The columns that all files have; files with another header fail the read."""
    found = states.where("range = 0").groupBy(F.regexp_replace("first_text", "^\ufeff|\r$", "").alias("h")).agg(F.count(F.lit(1)).alias("files"), F.min("file").alias("file"))
    heads = found.orderBy("file").limit(3).collect()
    if len(heads) != 1:
        raise ValueError(f"headers differ: {[(r['file'], r['h'], r['files']) for r in heads]}" if heads else "no file has a header")
    return next(csv.reader([heads[0]["h"]], delimiter=sep))


def read_records(spark: SparkSession, paths: str | list[str], sep: str = ",", name: str = "", **options: str) -> DataFrame:
    """All columns as strings (an empty or missing cell is an empty string), source_file, and ordinal, which orders a file's
    rows as they stand in it.

    Records end at line breaks outside quotes, quotes are doubled inside them, blank lines are left out. The header is one
    line, and the same in all files. Only files whose path has the pattern ``name`` are
    read; ``options`` are those of Spark's text reader.
    """
    rows = lines(spark, paths, **options).where(F.col("file").rlike(name))
    states = written(range_states(rows))
    names = header_of(states, sep)
    records = plain_records(rows, states)
    quoted = states.where("NOT plain")
    if not quoted.isEmpty():
        records = records.unionByName(whole_records(written(pieces(rows, quoted))))
    schema = ", ".join(f"`c{i}` string" for i in range(len(names)))
    text, quoted = F.col("text"), F.col("text").rlike("[\"\r]")  # other lines are parted at each separator
    cells = F.from_csv(F.regexp_replace("text", "\r$", ""), F.lit(schema), {"sep": sep, "escape": '"', "quote": '"', "multiLine": "true"})
    parts = F.when(~quoted, F.split(text, "[" + ("\\" + sep if sep in "\\^]&-[" else sep) + "]")).alias("s")
    told = records.where("text NOT IN ('', '\r')").select(parts, F.when(quoted, cells).alias("c"), "file", F.struct("range", "line").alias("ordinal"))
    return told.select(*[F.coalesce(F.get("s", F.lit(i)), f"c.c{i}", F.lit("")).alias(n) for i, n in enumerate(names)], F.col("file").alias("source_file"), "ordinal")
