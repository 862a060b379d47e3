"""Ids that have the name of a result or inner column."""

import pytest

from pointweave.llm import secrets, sharding


@pytest.mark.parametrize("name", ["base_spans", "linked_spans", "weak_spans", "scope_key", "spans", "n_hex", "base_sha256"])
def test_secrets(spark, name):
    text = "login: someone\npwd = hunter2 password: abcdefghijkl12 0123456789abcdef01"
    docs = spark.createDataFrame([(1, text), (2, None), (None, "x")], f"{name} long, text string")
    scan = secrets.secret_scan(docs, name)
    got = secrets.secret_digest(scan, name)
    assert len(set(got.columns)) == 6 and sorted(str(r[name]) for r in got.collect()) == ["1", "2", "None"]
    assert secrets.secret_digest(secrets.secret_scan(docs.limit(0), name), name).collect() == []


@pytest.mark.parametrize("name", ["size", "text_crc32", "law", "shard", "slot", "grown_shard"])
def test_shards(spark, name):
    docs = spark.createDataFrame([(i, "t") for i in range(90)], f"{name} long, text string")
    got = sharding.shard_digest(sharding.shuffle_into_shards(docs, id_col=name), name)
    assert len(set(got.columns)) == 7 and sorted(r[name] for r in got.collect()) == list(range(90))
