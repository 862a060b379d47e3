"""Running sums over groups of any size: no group is ever one task."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.llm.common import cut, small

#: Rows that one window partition should hold.
SPAN_ROWS = 100_000


def key_bits(rows: int) -> int:
    """Leading bits of a random 64-bit key that cut ``rows`` into spans of about SPAN_ROWS; 4 spans at least."""
    return max(2, math.ceil(math.log2(max(rows, 1) / SPAN_ROWS))) if rows > SPAN_ROWS else 2


def running_sum(df: DataFrame, group: list[str], key: str, ties: list[str], weight: str, rows: int, out: str) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the group's rows before this one, ordered by ``key`` then ``ties``.

    ``key`` is a random long. Its leading bits cut each group into spans, the spans' sums are added up in one small
    table, and each span adds up its own rows. ``df`` is read twice, so it should be a written table.
    """
    spans = df.withColumn("pw_span", F.shiftright(key, 64 - key_bits(rows)))
    names = [*group, "pw_span"]
    sums = spans.groupBy(*names).agg(F.sum(weight).alias("pw_sum"))
    before = F.sum("pw_sum").over(W.partitionBy(*group).orderBy("pw_span").rowsBetween(W.unboundedPreceding, -1))
    base = cut(sums.select(*names, F.coalesce(before, F.lit(0)).alias("pw_base")), "span-bases")
    inside = F.sum(weight).over(W.partitionBy(*names).orderBy(key, *ties).rowsBetween(W.unboundedPreceding, -1))
    joined = spans.join(small(base, 64), names)
    return joined.withColumn(out, F.col("pw_base") + F.coalesce(inside, F.lit(0))).drop("pw_base", "pw_span")
