"""Each stage of the pipeline on a small corpus, held against a plain version of what it does."""

import random

import corpus_pipeline
import numpy as np
import pytest

from pointweave.llm import decontamination, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents of the table's first rows with copies, near copies, passages of the benchmark, junk and nulls."""
    folder = tmp_path_factory.mktemp("corpus")
    some = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").limit(60).collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").collect()]
    rng = random.Random(2)
    rows, at = list(some), 10_000
    for r in some[:20]:
        near = r[1].split(" ")
        if len(near) > 80:
            near[rng.randrange(len(near))] = "changed"
        rows += [(at, r[1], r[2], r[3], r[4]), (at + 1, " ".join(near), r[2], "rare", r[4])]
        at += 2
    rows += [(at + k, f"{some[45 + k][1]} {items[k][1]} {items[k + 20][1]}", some[45 + k][2], "a", 1) for k in range(10)]
    rows += [(at + 10, None, "en", "a", 0), (at + 11, "", None, None, 0), (at + 12, "# $ %" * 30, "en", "a", 1), (None, some[40][1], "en", "rare", 1), rows[3]]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_stages(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]

    kept = corpus_pipeline.quality(spark, docs, folder)
    measured = quality_rules.measure([r[1] and r[1].encode() for r in rows], [r[2] for r in rows], quality_rules.VOCABULARY, quality_rules.BANDS)["kept"]
    want = [r for r, k in zip(rows, measured, strict=True) if k]
    assert as_rows(kept) == sorted(want, key=str) and kept.columns == docs.columns and 20 < len(want) < len(rows)

    sets = [(lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})((r[1] or "").encode().lower().split()) for r in want]
    named = [(r, s) for r, s in zip(want, sets, strict=True) if r[0] is not None]
    least = {r[0]: r[0] for r, _ in named}
    for _ in range(len(least)):
        before = dict(least)
        for a, s in named:
            for b, t in named:
                if 5 * len(s & t) >= 4 * len(s | t):
                    least[a[0]] = least[b[0]] = min(least[a[0]], least[b[0]])
        if before == least:
            break
    single = [r for r in want if r[0] is None or least[r[0]] == r[0]]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(want, DOCS), folder)
    assert as_rows(kept) == sorted(single, key=str) and len(single) < len(want)

    numbers = {}
    to = lambda t: np.array([numbers.setdefault(w, len(numbers) + 1) for w in t.encode().lower().translate(decontamination.PARTS).split()], np.int64)
    known = [to(t) for _, t in items]
    known = [w for w in known if len(w) >= decontamination.LEAST_WORDS]

    def copied(text):
        words = to(text)
        scores = decontamination.align(known, [words] * len(known))[0] if len(words) else np.zeros(0)
        return any(s >= len(w) for s, w in zip(scores, known, strict=False))

    clean = [r for r in single if not copied(r[1])]
    kept = corpus_pipeline.decontamination(spark, spark.createDataFrame(single, DOCS), folder)
    assert as_rows(kept) == sorted(clean, key=str) and len(clean) <= len(single) - 3

    mixed = as_rows(corpus_pipeline.mixing(spark, spark.createDataFrame(clean, DOCS), folder))
    assert {str(r) for r in mixed} == {str(r) for r in clean}
    # a row that stands there twice is two documents, each of which is emitted up to twice
    there = [str(r) for r in clean]
    assert all([str(x) for x in mixed].count(str(r)) <= 2 * there.count(str(r)) for r in mixed) and len(mixed) > len(clean)

    dealt = corpus_pipeline.sharding(spark, spark.createDataFrame(mixed, DOCS), folder).collect()
    counts = np.bincount([r["shard"] for r in dealt], minlength=40)
    assert len(dealt) == len(mixed) and counts.max() - counts.min() <= 1
    assert sorted(str(r["doc_id"]) for r in dealt) == sorted(str(r[0]) for r in mixed)


def test_repeats_of_the_mixture_are_spread(spark, tmp_path):
    """A small source is emitted twice; its copies meet in a shard no oftener than chance has them."""
    rows = [(i, f"text {i} of the large source", "en", "large", 1) for i in range(3000)] + [(5000 + i, f"text {i} of the small one", "en", "small", 1) for i in range(1000)]
    mixed = corpus_pipeline.mixing(spark, spark.createDataFrame(rows, DOCS), str(tmp_path))
    dealt = corpus_pipeline.sharding(spark, mixed, str(tmp_path)).collect()
    at = {}
    for r in dealt:
        at.setdefault(r["doc_id"], []).append((r["shard"], r["slot"]))
    pairs = [x for x in at.values() if len(x) == 2]
    together = [x for x in pairs if x[0][0] == x[1][0]]
    assert len(pairs) > 900 and len(together) < 2.2 * len(pairs) / 40
    assert sum(abs(a[1] - b[1]) == 1 for a, b in together) <= 5


def test_run_of_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
