"""Intermediate tables and checked broadcasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.sources.shared import shared_dir

#: A side is broadcast only when its measured rows times its widest row stay below this.
BROADCAST_BYTES = 32 << 20


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: what follows reads it instead of working it out again, and
    lost executors re-read it."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fitting(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its rows, as text, are measured to fit; else as it is, and Spark shuffles both sides."""
    rows, width = df.agg(F.count(F.lit(1)), F.max(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if rows * ((width or 0) + 32) <= BROADCAST_BYTES else df
