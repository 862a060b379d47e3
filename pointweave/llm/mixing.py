"""Operator 6: temperature mixing of sources, in native expressions only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.llm.common import WORD, cut, small
from pointweave.llm.ranking import running_sum
from pointweave.llm.sharding import numbered

#: Exponents that one pass over the source totals compares; each pass narrows the interval to one of their gaps.
SECTIONS, PASSES = 32, 5
#: Tokens of one block of the mixed stream.
BLOCK_TOKENS = 1_000_000
#: A part of an epoch below this share of a source is rounding.
LEAST_PART = 1e-9


@dataclass(frozen=True)
class Mark:
    """What one exponent gives: entropy in bits, repeats of the most repeated source, tokens emitted in all."""

    exponent: float
    entropy: float
    repeats: float
    emitted: float


def tokens_of(text: Column) -> Column:
    """Words of the whole text and one mark for its end, so that an empty text counts, too."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)) + 1).cast("long")


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source.cast("string")))


def marks(totals: DataFrame, total: int, exponents: list[float], budget: float | None) -> list[Mark]:
    """A Mark for each exponent from one aggregation over the source totals; sums are of decimals, so they do not depend
    on the order in which partitions are added."""
    share = F.col("tokens") / F.lit(float(total))
    powers = totals.select(share.alias("share"), F.explode(F.array(*map(F.lit, exponents))).alias("x")).withColumn("power", F.pow("share", "x"))
    exact = lambda c: F.sum(c.cast("decimal(38,18)")).cast("double")
    sums = powers.groupBy("x").agg(exact(F.col("power")).alias("z"), exact(F.col("power") * F.log2("power")).alias("plogp"), F.max(F.col("share") / F.col("power")).alias("scarce"), F.max(F.col("power") / F.col("share")).alias("often"))
    out = []
    for r in sums.collect():
        emitted = float(budget) if budget is not None else total * r["scarce"] * r["z"]
        out.append(Mark(r["x"], math.log2(r["z"]) - r["plogp"] / r["z"], r["often"] / r["z"] * emitted / total, emitted))
    return sorted(out, key=lambda m: m.exponent)


def bisected(judge: Callable[[list[float]], list[Mark]], holds: Callable[[Mark], bool]) -> float:
    """The least exponent in [0, 1] from which on ``holds`` is true, to within SECTIONS ** -PASSES; 1 if nowhere."""
    if holds(judge([0.0])[0]):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        seen = judge([low + (high - low) * i / SECTIONS for i in range(1, SECTIONS)])
        high = min([high, *(m.exponent for m in seen if holds(m))])
        low = max([low, *(m.exponent for m in seen if m.exponent < high)])
    return high


def solve(totals: DataFrame, max_repeats: float | None, target_entropy: float | None, budget: float | None) -> tuple[Mark, DataFrame]:
    """The mark of the solved exponent, and (pw_source, tokens, weight, full, rest) per source of ``totals``.

    A weight is the share to the exponent, normalised. ``target_entropy``: the exponent whose entropy comes down to it.
    ``max_repeats``: the flattest mixture that repeats no source more often. With both, the larger exponent; with
    neither, 1. Without ``budget``, so many tokens are emitted that each source is used whole at least once.
    ``full`` epochs of a source are emitted whole and ``rest`` tokens of one more.
    """
    total = totals.agg(F.sum("tokens")).first()[0]
    if not total:
        return Mark(1.0, 0.0, 0.0, 0.0), totals.select("pw_source", "tokens", F.lit(1.0).alias("weight"), F.lit(0).alias("full"), F.lit(0.0).alias("rest"))

    def judge(exponents: list[float]) -> list[Mark]:
        return marks(totals, total, exponents, budget)

    wanted = []
    if target_entropy is not None:
        wanted.append(bisected(judge, lambda m: m.entropy <= target_entropy))
    if max_repeats is not None:
        wanted.append(bisected(judge, lambda m: m.repeats <= max_repeats))
    mark = judge([max(wanted, default=1.0)])[0]
    power = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(mark.exponent))
    z = totals.agg(F.sum(power.cast("decimal(38,18)")).cast("double")).first()[0]
    quota = power / F.lit(z) * F.lit(mark.emitted)
    epochs = quota / F.col("tokens")
    full = F.floor(epochs + LEAST_PART)
    rest = F.when(epochs - full > LEAST_PART, quota - full * F.col("tokens")).otherwise(0.0)
    return mark, totals.select("pw_source", "tokens", (power / F.lit(z)).alias("weight"), full.cast("int").alias("full"), rest.alias("rest"))


def shuffled(epoch: Column, seed: int) -> Column:
    """The key that orders a source's documents in an epoch; equal rows have numbers, so they part like any two rows."""
    return F.xxhash64(F.lit(f"mix:{seed}"), epoch.cast("int"), F.col("pw_row"), F.col("pw_copy"))


def _plan(slim: DataFrame, rows: int, seed: int, max_repeats: float | None, target_entropy: float | None, budget: float | None) -> tuple[Mark, DataFrame]:
    """The mark, and per source what _epochs needs: weight, tokens, full and the key that ends the broken epoch."""
    totals = cut(slim.groupBy("pw_source").agg(F.sum("pw_tokens").alias("tokens")), "mix-totals")
    mark, sources = solve(totals, max_repeats, target_entropy, budget)
    sources = cut(sources, "mix-sources")
    broken = slim.join(small(sources.where("rest > 0"), 64), "pw_source").withColumn("pw_key", shuffled(F.col("full"), seed))
    broken = running_sum(broken, ["pw_source"], "pw_key", ["pw_row", "pw_copy"], "pw_tokens", rows, "pw_before")
    ends = broken.where("pw_before >= rest").groupBy("pw_source").agg(F.min("pw_key").alias("pw_end"))
    most = F.when(F.col("rest") > 0, F.lit((1 << 63) - 1)).otherwise(F.lit(-(1 << 63)))
    return mark, cut(sources.join(ends, "pw_source", "left").withColumn("pw_end", F.coalesce("pw_end", most)), "mix-plan")


def _epochs(seed: int) -> Column:
    """The epochs in which a row is emitted."""
    whole = F.when(F.col("full") > 0, F.sequence(F.lit(0), F.col("full") - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return F.when(shuffled(F.col("full"), seed) < F.col("pw_end"), F.concat(whole, F.array("full"))).otherwise(whole)


def mixed_stream(docs: DataFrame, max_repeats: float | None = 4.0, target_entropy: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per emitted document: id, source, n_tokens, epoch, block, position and the exponent.

    Tokens are words plus one per document. An epoch is a permutation of its source; the stream is cut into blocks of
    about ``block_tokens`` in which each source has its weight (to one document), and each block is permuted. Null
    sources are one source of their own; null texts have one token; rows with equal ids, sources and texts are numbered
    and are documents of their own; an empty table gives no rows. Other columns are not read; a result column that the
    id or the source has the name of gets ``_result`` behind it.
    """
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("pw_id"), F.col(source_col).alias("pw_from"), source_key(F.col(source_col)).alias("pw_source"), tokens_of(text).alias("pw_tokens"), F.xxhash64(id_col, text).alias("pw_row"))
    slim = cut(numbered(slim, "pw_copy"), "mix-rows")
    rows = slim.count()
    mark, plan = _plan(slim, rows, seed, max_repeats, target_entropy, budget)
    many = plan.count()
    copies = slim.join(small(plan, 96, many), "pw_source").withColumn("pw_epoch", F.explode(_epochs(seed)))
    copies = copies.withColumn("pw_key", shuffled(F.col("pw_epoch"), seed))
    placed = running_sum(copies, ["pw_source", "pw_epoch"], "pw_key", ["pw_row", "pw_copy"], "pw_tokens", rows, "pw_before")
    offset = F.col("pw_epoch") * F.col("tokens") + F.col("pw_before")
    placed = placed.withColumn("pw_block", F.floor(offset / (F.col("weight") * block_tokens)))
    turn = F.row_number().over(W.partitionBy("pw_block").orderBy(F.xxhash64("pw_block", "pw_key"), "pw_key", "pw_row", "pw_copy"))
    columns = [F.col("pw_tokens"), F.col("pw_epoch"), F.col("pw_block"), turn - 1, F.lit(mark.exponent)]
    names = [f"{c}_result" if c in (id_col, source_col) else c for c in ("n_tokens", "epoch", "block", "position", "exponent")]
    return placed.select(F.col("pw_id").alias(id_col), F.col("pw_from").alias(source_col), *(c.alias(n) for c, n in zip(columns, names, strict=True)))


def numbered_documents(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` under inner names with pw_row, pw_again (hashes of the whole row) and pw_copy, the row's number among
    equal ones; and the inner names.

    Texts stay where they are, but for rows that are repeated: these are counted and made anew from their counts. The
    hashes of repeated rows are broadcast while they are few, else Spark shuffles both sides.
    """
    inner = [f"pw_doc_{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*inner)
    rows = rows.withColumns({"pw_row": F.xxhash64(*inner), "pw_again": F.xxhash64(F.lit("again"), *inner)})
    repeated = cut(rows.groupBy("pw_row", "pw_again").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeated-rows")
    many = repeated.count()
    once = rows.join(small(repeated, 32, many), ["pw_row", "pw_again"], "left_anti") if many else rows
    once = once.withColumn("pw_copy", F.lit(0).cast("long"))
    if not many:
        return once, inner
    copies = numbered(rows.join(small(repeated, 32, many), ["pw_row", "pw_again"], "left_semi").select(*inner, "pw_row", "pw_again"), "pw_copy")
    return once.unionByName(copies), inner


def mixed_documents(docs: DataFrame, max_repeats: float | None = 2.0, target_entropy: float | None = None, budget: float | None = None, seed: int = 17, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, all columns as they are, each as often as its place in the epochs says.

    Epochs, weights and quotas are those of mixed_stream, rows equal in all columns have numbers and are documents of
    their own; texts are not shuffled, but for repeated rows.
    """
    rows, inner = numbered_documents(docs)
    named = dict(zip(docs.columns, inner, strict=True))
    rows = rows.withColumn("pw_source", source_key(F.col(named[source_col])))
    slim = cut(rows.select("pw_source", tokens_of(F.col(named[text_col]).cast("string")).alias("pw_tokens"), "pw_row", "pw_copy"), "mix-rows")
    _, plan = _plan(slim, slim.count(), seed, max_repeats, target_entropy, budget)
    emitted = rows.join(small(plan, 96), "pw_source").withColumn("pw_epoch", F.explode(_epochs(seed)))
    return emitted.select(*[F.col(n).alias(c) for c, n in named.items()])
