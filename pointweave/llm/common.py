"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Word separators of every word rule here: space, tab, newline, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

#: A side is broadcast only when its measured rows times width stay below this.
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch on its way to a worker, which the executor buffers outside its heap, and of one that the
#: worker has put together.
SENT_BYTES, BATCH_BYTES = 256 << 10, 2 << 20
#: A key is hot from this share of all rows on, so there are HOT_SHARE hot keys at most.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir. An own one serves where that is unset and all is local."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        base = "file://" + tempfile.mkdtemp(prefix="pointweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/pointweave/{uuid.uuid4().hex}/{name}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here, and lost executors re-read it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """Broadcast ``df`` if its counted size is below BROADCAST_BYTES; beyond it Spark shuffles both sides.

    ``row_bytes`` is the width of a row without its texts; the longest text of each column is measured and added.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    if rows is None or texts:
        rows, *longest = df.agg(F.count(F.lit(1)), *[F.max(F.octet_length(c)) for c in texts]).first()
        row_bytes += sum(n or 0 for n in longest)
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def hot_join(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Inner join of ``rows`` with ``keys``, one row per ``on`` and ``n``, its rows in ``rows``; ``n`` is left out.

    Hot keys, HOT_SHARE of them at most, are broadcast, so their rows stay where they are; the others are shuffled.
    Both sides are read twice and should be written tables.
    """
    least = -(-rows.count() // HOT_SHARE)
    hot = F.broadcast(keys.where(F.col("n") > least).drop("n"))
    rest = rows.join(hot.select(on), on, "left_anti").join(keys.where(F.col("n") <= least).drop("n"), on)
    return rest.unionByName(rows.join(hot, on))


def rebatched(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows``, or fewer once they hold BATCH_BYTES."""
    held: list[pa.RecordBatch] = []
    many = size = 0
    for b in batches:
        while b.num_rows:
            part, b = b.slice(0, rows - many), b.slice(min(rows - many, b.num_rows))
            held.append(part)
            many, size = many + part.num_rows, size + part.nbytes
            if many == rows or size >= BATCH_BYTES:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
                held, many, size = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, rows: int = 1024) -> DataFrame:
    """``run`` over Arrow batches of ``rows`` rows and BATCH_BYTES at most.

    The session's byte bound is set to the same number by every operator, whatever its rows: they are counted in the
    worker, so plans that run later than they were built do not get each other's batches.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SENT_BYTES))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(rebatched(batches, rows))

    return df.mapInArrow(cut_up, schema)


def named(id_col: str, columns: list[str]) -> list[str]:
    """Result names beside the id's: one that the id has gets ``_result`` behind it."""
    return [f"{c}_result" if c == id_col else c for c in columns]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
