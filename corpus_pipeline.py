"""A corpus pipeline: quality rules, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; stages but the last return the columns of docs.
Rows with a null id are documents like any other; null and empty texts fail the quality rules; rows that repeat an id
are one document to near_duplicates and several to the other stages; an empty table passes through all of them. Extra
columns of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.llm.common import cut, small, table
from pointweave.llm.decontamination import keep_unleaked
from pointweave.llm.jaccard import jaccard_components
from pointweave.llm.mixing import mixed_documents
from pointweave.llm.quality_rules import keep_quality
from pointweave.llm.sharding import shard_digest, shuffle_into_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and fertility bands keep."""
    return keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group (five-word shingles, Jaccard 0.8); null ids stay.

    The ids that go are joined, not the texts: broadcast while they are few, else Spark shuffles both sides. Rows that
    repeat a doc_id are one document and stay or go together. Exact at that similarity: a copy edited beyond it is
    another document.
    """
    groups = jaccard_components(docs)
    gone = cut(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("pw_gone")).distinct(), "gone-ids")
    return docs.join(small(gone, 16), docs["doc_id"] == gone["pw_gone"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy no benchmark item."""
    return keep_unleaked(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of small sources up to twice, at temperature-mixed weights."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place in it of each row; the copies that mixing made part like any two rows."""
    return shard_digest(shuffle_into_shards(docs))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Fertility bands, alignments and drawn matrices have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
