"""Operator 3: a uniform shuffle into shards of exact sizes by a hypergeometric communication matrix."""

from __future__ import annotations

import random
from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.llm.common import cut, named, small
from pointweave.llm.ranking import running_sum

#: Rows that a block should hold, and blocks at least and at most; the matrix has blocks x shards cells.
BLOCK_ROWS, LEAST_BLOCKS, MOST_BLOCKS = 100_000, 64, 1 << 16
#: Equal rows that one task numbers.
COPIES = 100_000


def hypergeometric(good: int, bad: int, draws: int, u: float) -> int:
    """The number of good ones among ``draws`` without replacement, by inversion at ``u`` in [0, 1).

    Weights run outward from the mode by the ratios of neighbours until they no longer count, so neither factorials
    nor the size of the population matter.
    """
    low, high = max(0, draws - bad), min(draws, good)
    if low >= high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))
    up, w, k = [1.0], 1.0, mode
    while k < high and w > 1e-18:
        w *= (good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1))
        k += 1
        up.append(w)
    down, w, k = [], 1.0, mode
    while k > low and w > 1e-18:
        w *= k * (bad - draws + k) / ((good - k + 1) * (draws - k + 1))
        k -= 1
        down.append(w)
    first, sums = mode - len(down), list(accumulate([*reversed(down), *up]))
    return first + min(bisect_left(sums, u * sums[-1]), len(sums) - 1)


def communication_matrix(counts: dict[int, int], shards: int, seed: int) -> dict[int, list[int]]:
    """Rows that each block sends to each shard: row sums are ``counts``, column sums differ by one at most."""
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = {}
    for block in sorted(counts):
        dice = random.Random(f"{seed}:{block}")
        left, space, row = counts[block], sum(room), []
        for s in range(shards):
            sent = hypergeometric(room[s], space - room[s], left, dice.random())
            space -= room[s]
            room[s] -= sent
            left -= sent
            row.append(sent)
        matrix[block] = row
    return matrix


def numbered(rows: DataFrame, out: str) -> DataFrame:
    """The rows with ``out``: 0, 1, … among equal ones, which are told apart by nothing else.

    Equal rows are counted (before the shuffle) and made anew from their counts, COPIES of them at a time, so a row
    that is a third of the table is no single task.
    """
    names = rows.columns
    counts = cut(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("pw_n")), "equal-rows")
    whole = counts.withColumn("pw_low", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pw_n") - 1, F.lit(COPIES).cast("long"))))
    if (counts.agg(F.max("pw_n")).first()[0] or 0) > COPIES:
        whole = whole.repartition(*names, "pw_low")
    return whole.withColumn(out, F.explode(F.sequence("pw_low", F.least("pw_n", F.col("pw_low") + COPIES) - 1))).select(*names, out)


def shuffle_into_shards(docs: DataFrame, shards: int = 40, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes of the text, null 0, plus 16), text_crc32, shard and slot.

    Blocks are cut by a hash of the row and its number among equal ones, so copies part like any two rows. Their counts
    (MOST_BLOCKS numbers at most) decide the communication matrix on the driver; each block then deals its rows, in
    random order, in exactly these numbers, and each shard orders what it got anew. Counts of shards differ by one at
    most, slots run from 0 without gaps. A null text has size 16 and the checksum 0; null or repeated ids and repeated
    rows are rows like any other; an empty table gives no rows. Other columns are not read; a result column that the id
    has the name of gets ``_result`` behind it.
    """
    text = F.col(text_col).cast("string")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")
    crc = F.crc32(F.coalesce(text, F.lit("")))
    same = ["pw_id", "pw_size", "pw_crc", "pw_copy"]
    slim = numbered(docs.select(F.col(id_col).alias("pw_id"), size.alias("pw_size"), crc.alias("pw_crc")), "pw_copy")
    hashes = [F.xxhash64(F.lit(f"{seed}:{part}"), *same).alias(name) for part, name in enumerate(("pw_place", "pw_deal", "pw_order"))]
    slim = cut(slim.select("*", *hashes), "shard-rows")
    rows = slim.count()
    blocks = min(MOST_BLOCKS, max(LEAST_BLOCKS, rows // BLOCK_ROWS))
    placed = slim.withColumn("pw_block", F.pmod("pw_place", F.lit(blocks)).cast("int"))
    counts = {r["pw_block"]: r["count"] for r in placed.groupBy("pw_block").count().collect()}
    matrix = [(b, list(accumulate(row))) for b, row in communication_matrix(counts, shards, seed).items()]
    upto = docs.sparkSession.createDataFrame(matrix, "pw_block int, pw_upto array<long>")
    turn = F.row_number().over(W.partitionBy("pw_block").orderBy("pw_deal", *same)) - 1
    dealt = placed.withColumn("pw_turn", turn).join(small(upto, 8 * shards, len(matrix)), "pw_block")
    dealt = dealt.withColumn("pw_shard", F.size(F.filter("pw_upto", lambda n: n <= F.col("pw_turn"))))
    dealt = cut(dealt.select(*same, "pw_shard", "pw_order", F.lit(1).cast("long").alias("pw_one")), "shard-deal")
    out = running_sum(dealt, ["pw_shard"], "pw_order", same, "pw_one", rows // shards, "pw_slot")
    names = [id_col, *named(id_col, ["size", "text_crc32", "shard", "slot"])]
    return out.select(*(F.col(c).alias(n) for c, n in zip(("pw_id", "pw_size", "pw_crc", "pw_shard", "pw_slot"), names, strict=True)))


def shard_digest(dealt: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns of shuffle_into_shards."""
    size, crc, shard, slot = named(id_col, ["size", "text_crc32", "shard", "slot"])
    law, grown = named(id_col, ["law", "grown_shard"])
    return dealt.select(id_col, size, crc, F.lit("rows").alias(law), F.col(shard).cast("int").alias(shard), slot, F.lit(None).cast("int").alias(grown))
