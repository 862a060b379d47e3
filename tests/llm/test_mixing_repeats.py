"""Operator 6 with repeated rows: quotas are met, copies part like any two rows, and nothing is lost."""

from collections import Counter

import pytest

from pointweave.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def tables(spark):
    same = [(0, "nine words of a text that comes back often", "b")] * 600
    rows = [*same, *((i, f"w{i} " * 9, "b") for i in range(1, 401)), *((i, f"v{i} " * 9, "a") for i in range(1000, 2000))]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(6)


def test_quotas_of_sources_with_copies(spark):
    rows, docs = tables(spark)
    got = mixing.mixed_stream(docs, max_repeats=None, budget=11_000.0).collect()
    spent = Counter()
    for r in got:
        spent[r["source"]] += r["n_tokens"]
    assert all(abs(spent[s] - 5500) <= 10 for s in "ab")
    hot = sum(r["doc_id"] == 0 for r in got)
    assert 250 < hot < 400  # 600 of 1000 documents of b, half of which are emitted
    places = {}
    for r in got:
        places.setdefault((r["block"],), []).append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_documents_are_emitted_as_often_as_the_quotas_say(spark):
    rows, docs = tables(spark)
    out = [tuple(r) for r in mixing.mixed_documents(docs, max_repeats=None, budget=30_000.0).collect()]
    emitted, there = Counter(out), Counter(rows)
    for s in "ab":
        tokens = sum(len(r[1].split()) + 1 for r in out if r[2] == s)
        assert abs(tokens - 15_000) <= 10
    # one and a half epochs: each row once or twice, as many in all as its copies allow
    assert all(there[r] <= emitted[r] <= 2 * there[r] for r in there)


def test_rows_that_differ_in_another_column_only(spark):
    rows = [(1, "a b c", "s", k % 3) for k in range(90)] + [(2, None, None, None)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, full int")
    out = Counter(tuple(r) for r in mixing.mixed_documents(docs, max_repeats=None).collect())
    assert out == Counter(rows)


@pytest.mark.parametrize("name", ["tokens", "weight", "full", "rest", "pw_end", "pw_row", "pw_id", "epoch", "n_tokens", "exponent"])
def test_ids_with_names_of_inner_columns(spark, name):
    rows = [(i, f"word{i} " * (i % 5), "xyz"[i % 3]) for i in range(60)]
    docs = spark.createDataFrame(rows, f"{name} long, text string, source string")
    got = mixing.mixed_stream(docs, id_col=name, max_repeats=1.0)
    assert len(got.columns) == len(set(got.columns)) == 7
    assert sorted(r[name] for r in got.collect()) == [r[0] for r in rows]
    assert Counter(tuple(r) for r in mixing.mixed_documents(docs, max_repeats=1.0).collect()) == Counter(rows)
