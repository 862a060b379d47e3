"""Operators 11 and 13 against brute force, with nulls, empty and repeated rows, ties and clashing names."""

import random
import re
from collections import Counter, defaultdict

import pytest

from pointweave.llm import divergence, licenses

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_divergence(rows):
    per, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        words = re.findall(TERM, lowered(text))
        groups.add((lang or "", source or ""))
        per[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    kept = {lang: [t for t, n in c.items() if n >= 3] for lang, c in docs.items()}
    share = lambda n, total: 1 + 10**9 * (n + 1) // total
    out = set()
    for lang, source in groups:
        terms = kept.get(lang, [])
        total = {s: sum(per[lang, s][t] for t in terms) + len(terms) for a, s in groups if a == lang}
        whole = {t: sum(per[lang, s][t] for s in total) for t in terms}
        p = {t: share(per[lang, source][t], total[source]) for t in terms}
        pairs = []
        for other in total:
            if other != source:
                q = {t: share(per[lang, other][t], total[other]) for t in terms}
                pairs.append((-sum((p[t] - q[t]) ** 2 // q[t] for t in terms), other))
        q = {t: share(whole[t], sum(whole.values()) + len(terms)) for t in terms}
        best = [(-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in terms if per[lang, source][t] and p[t] > q[t]]
        out |= {(lang, source, "pair", item, -v, k + 1) for k, (v, item) in enumerate(sorted(pairs))}
        out |= {(lang, source, "term", item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(best)[:200])}
    return out


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["Été", "日本", "x"]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words[: rng.choice([20, 300, 303])]) + rng.choice(["", "9", ".", "'s"]) for _ in range(rng.randrange(80)))
        rows.append((rng.choice([i, 7, None]), rng.choice([text, text, text.upper(), "", None]), rng.choice(["en", "en", "fr", None, "de"]), rng.choice(["a", "a", "b", "c", None, "Ö"])))
    return [*rows, *rows[:20], (1, "only one", "xx", "a"), (2, None, "xx", "b"), (3, "the " * 5000, "en", "a")]


@pytest.mark.parametrize(("seed", "held", "cells"), [(1, 300_000, 1_000_000), (2, 50, 20)])
def test_divergence(spark, monkeypatch, seed, held, cells):
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "SUMS", cells)
    rows = corpus(seed)
    docs = spark.createDataFrame([(*r, 1, "z", 2) for r in rows], "doc_id long, text string, lang string, source string, n int, term string, k int").repartition(5)
    got = divergence.source_divergence(docs).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert {tuple(r) for r in got} == brute_divergence(rows)


def test_divergence_of_clashing_names_and_empty_tables(spark):
    rows = corpus(5, 60)
    docs = spark.createDataFrame(rows, "term long, document string, n string, docs string")
    got = divergence.source_divergence(docs, "term", "document", "n", "docs").collect()
    assert {tuple(r) for r in got} == brute_divergence(rows)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.source_divergence(empty).collect() == []


def test_shares_beyond_a_long(spark):
    row = spark.sql("SELECT 90000000000L AS n, 400000000000L AS total").select(divergence._share("n", "total").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (90000000000 + 1) // 400000000000


def test_runs_cut_by_partitions_add_up(spark):
    """A hot term: its pieces lie in several ranges, and each range gives a part of the run."""
    docs = spark.createDataFrame([("en", "a", i, "hot hot") for i in range(4000)], "lang string, source string, document long, text string").repartition(40)
    counted = divergence.pieces(docs).cache()
    order = ["key", "source", "document"]
    runs = divergence.run_lengths(counted.repartitionByRange(8, *order).sortWithinPartitions(*order)).collect()
    assert counted.count() > 8 and 1 < len(runs) <= 8 and all(r["edge"] for r in runs)
    assert (sum(sum(r["docs"]) for r in runs), sum(sum(r["n"]) for r in runs)) == (4000, 8000)
    (got,) = divergence.kept_terms(spark.createDataFrame(runs)).collect()
    assert (got["lang"], got["term"], got["n"], [tuple(x) for x in got["sources"]]) == ("en", "hot", 8000, [("a", 8000)])


WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_places(text):
    words = re.findall(WORDS, lowered(text))
    found = []
    for phrase, label in [*((p, x) for p, x in licenses.BASE.items()), *((p, x) for p, x in licenses.NOTICES.items())]:
        parts = phrase.split()
        found += [(i, label, phrase in licenses.BASE) for i in range(len(words)) if words[i : i + len(parts)] == parts]
    return len(words), sorted(found)


def test_license_places(spark):
    rng = random.Random(4)
    pool = [*licenses.BASE, *licenses.NOTICES, "cc", "by", "all", "rights", "ÉCC by", "nc", "\n", "cc.by", "license"]
    texts = [None, "", " \n", "cc by cc by", "All Rights\tReserved.", "CC  BY-NC 4.0", "cc byé", "a" * 200_000 + " cc by", *(" ".join(rng.choice([x, x.upper()]) for x in rng.choices(pool, k=rng.randrange(60))) for _ in range(200))]
    rows = [(i if i % 9 else None, t, 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, *rows[:8]], "score long, text string, n_words int")
    got = licenses.license_scan(docs, "score")
    assert got.columns == ["score", "n_words", "places", "statements", "score_result"]
    found = got.collect()
    assert sorted((r["n_words"], [tuple(p) for p in r["places"]]) for r in found) == sorted(brute_places(t) for _, t, _ in [*rows, *rows[:8]])
    digest = {r["score"]: r for r in licenses.license_digest(got, "score").collect() if r["score"] is not None}
    for i, t, _ in rows:
        if i is None:
            continue
        n, places = brute_places(t)
        base = [p for p in places if p[2]]
        r = digest[i]
        assert (r["n_words"], r["n_base"]) == (n, len(base))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({p[1] for p in base}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score_result"] <= 1
    assert licenses.license_digest(licenses.license_scan(docs.limit(0), "score"), "score").collect() == []


def recursive(tokens):
    """Value of a well-formed expression by recursive descent, the check of the shunting-yard."""

    def atom():
        if tokens[0] == "(":
            tokens.pop(0)
            v = choice()
            tokens.pop(0)
            return v
        return licenses.licence(tokens.pop(0)) or licenses.Value(frozenset(["other"]), licenses.UNKNOWN)

    def eased():
        v = atom()
        while tokens and tokens[0] == "with":
            tokens.pop(0)
            tokens.pop(0)
            v = licenses.Value(v.labels, v.permission + (1 - v.permission) * licenses.EXCEPTION)
        return v

    def both():
        v = eased()
        while tokens and tokens[0] == "and":
            tokens.pop(0)
            w = eased()
            v = licenses.Value(v.labels | w.labels, min(v.permission, w.permission))
        return v

    def choice():
        v = both()
        while tokens and tokens[0] == "or":
            tokens.pop(0)
            w = both()
            v = licenses.Value(v.labels | w.labels, max(v.permission, w.permission))
        return v

    return choice()


def made(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return [rng.choice(["mit", "gpl-2.0+", "apache-2.0", "lgpl-2.1-only", "cc-by-nc-4.0", "cc0-1.0", "bsd-3-clause", "proprietary"])]
    kind = rng.choice(["and", "or", "with", "()"])
    if kind == "()":
        return ["(", *made(rng, depth - 1), ")"]
    if kind == "with":
        left = made(rng, depth - 1)
        return [*(left if len(left) == 1 else ["(", *left, ")"]), "with", "classpath-exception-2.0"]
    return [*made(rng, depth - 1), kind, *made(rng, depth - 1)]


def test_expressions_against_recursive_descent():
    rng = random.Random(8)
    for _ in range(3000):
        tokens = made(rng, 5)
        text = " ".join(tokens)
        end, value = licenses.expression(text + rng.choice(["", "\nmore", " )", " mit", " and", " or (", ". or mit"]), 0, True)
        want = recursive(list(tokens))
        assert end == len(text) and value.labels == want.labels and value.permission == pytest.approx(want.permission), text


@pytest.mark.parametrize(("text", "strict", "want"), [("(mit and (", True, 4), ("and mit", True, None), (")", True, None), ("((((", True, None), ("hello or mit", False, None), ("mit with", True, 3), ("(mit", True, 4), ("", True, None)])
def test_broken_expressions(text, strict, want):
    got = licenses.expression(text, 0, strict)
    assert (got and got[0]) == want


def test_statements(spark):
    text = "é # SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND X\nlicense: see below\nlicense = 'Apache-2.0'\nmylicense: mit"
    row = licenses.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    got = [(text[s["start"] : s["end"]], s["expression"], s["labels"], s["permission"]) for s in row["statements"]]
    assert got == [("(MIT OR GPL-2.0-only) AND X",) * 2 + (["gpl", "mit", "other"], 0.5), ("Apache-2.0",) * 2 + (["apache"], 0.9)]
    assert row["score"] == 0.5
