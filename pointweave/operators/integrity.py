"""Duplicate, conflict and completeness policies: equal copies collapse, conflicting ones are excluded whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Types whose least and greatest values are kept in place while tasks hash keys.
FIXED = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp")


def grouped(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per key: copies, whether they conflict, and the values of its copies where they agree. One shuffle, combined before it.

    Values of fixed width are compared column by column, so that tasks hash the keys instead of sorting their rows.
    """
    types = dict(df.dtypes)
    if values and all(types.get(c, "") in FIXED for c in values):
        same = F.lit(True)
        for c in values:
            same = same & F.col(f"pw_low_{c}").eqNullSafe(F.col(f"pw_high_{c}")) & F.col(f"pw_n_{c}").isin(0, F.col("copies"))
        parts = [x for c in values for x in (F.min(c).alias(f"pw_low_{c}"), F.max(c).alias(f"pw_high_{c}"), F.count(c).alias(f"pw_n_{c}"))]
        g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), *parts)
        return g.select(*keys, "copies", F.struct(*[F.col(f"pw_low_{c}").alias(c) for c in values]).alias("row"), (~same).alias("conflicting"))
    row = F.struct(*values)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"), F.min(row).alias("row"), F.max(row).alias("last")).withColumn("conflicting", ~F.col("row").eqNullSafe(F.col("last"))).drop("last")


def collapse(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A row per key whose copies agree."""
    return grouped(df, keys, values).where(~F.col("conflicting")).select(*keys, "row.*")


def conflict_counts(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    many, bad = F.col("copies") > 1, F.col("conflicting")
    n = lambda c: F.count_if(c)
    g = grouped(df, keys, values)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return g.agg(total("copies").alias("raw_rows"), F.count(F.lit(1)).alias("unique_keys"), n(~bad).alias("usable_rows"), n(many).alias("duplicate_groups"), n(many & ~bad).alias("exact_groups"), n(bad).alias("conflicting_groups"), total(F.col("copies") - 1).alias("excess_rows"), total(F.when(bad, F.col("copies"))).alias("conflicting_rows"))


def signature(columns: list[str]) -> Column:
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def conflict_diff(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per conflicting key the names of the columns in which its first two rows differ, rows in order of their values."""
    turn = F.row_number().over(W.partitionBy(*keys).orderBy(*values))
    two = df.withColumn("turn", turn).where("turn <= 2").groupBy(*keys).agg(F.min_by(F.struct(*values), "turn").alias("a"), F.max_by(F.struct(*values), "turn").alias("b"))
    names = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in values]))
    return two.select(*keys, F.array_join(names, ",").alias("differing")).where("differing <> ''")


def poison(df: DataFrame, key: str, flags: dict[str, Column]) -> DataFrame:
    """Per key which anomalies any of its rows shows, and whether it is safe of all."""
    per = df.groupBy(key).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in flags.items()])
    safe = ~F.lit(False)
    for n in flags:
        safe = safe & ~F.col(n)
    return per.withColumn("safe", safe)


def completeness(df: DataFrame, valid: dict[str, Column]) -> DataFrame:
    """(field, rows, non_empty, valid) of each column from one pass."""
    stats = [F.struct(F.lit(c).alias("field"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.trim(F.col(c).cast("string")) != "").alias("non_empty"), F.count_if(ok).alias("n_valid")) for c, ok in valid.items()]
    return df.agg(F.array(*stats).alias("s")).select(F.explode("s").alias("s")).select("s.*")


def evidence_changes(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Ids on one side only, and fields that differ: no rows when the evidence is unchanged."""
    a, b = left.select(key, F.struct(*fields).alias("a")), right.select(key, F.struct(*fields).alias("b"))
    names = F.array_compact(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in fields]))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise(F.array_join(names, ","))
    return a.join(b, key, "full").select(key, change.alias("change")).where("change <> ''")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted({*columns} - {*df.columns})
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
