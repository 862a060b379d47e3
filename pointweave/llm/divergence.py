"""Operator 11: how far the sources of a language lie apart, term by term, from one sorted stream of term counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointweave.llm.common import cut, in_batches, small

#: Documents of its language that a kept term is in, at least; shares are counted in parts of SCALE.
LEAST_DOCS, SCALE = 3, 1_000_000_000
#: Terms that a group reports, by their divergence from the language.
TOP_TERMS = 200
#: (lang, source, term) counts that a task holds before it hands them on.
HELD = 800_000
#: Cells (terms x sources) that one step of the pair sums holds, and pair sums that a task holds before it hands them on.
CELLS, SUMS = 1_000_000, 1_000_000

#: Bytes of terms: ASCII letters, lower-cased, and every byte of other characters.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: Parts a language from a term in a sort key; no byte of UTF-8 is like it.
PART = b"\xff"


def pieces(docs: DataFrame) -> DataFrame:
    """(key, source, document, docs, n): documents of a source with a term of a language, and occurrences in them.

    ``docs`` has lang, source, document and text. A task adds up what it has read, HELD counts at a time; ``document`` is
    the least id (as a hash) among the source's documents in a piece and orders the pieces of a run. ``key`` is language and term.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}
        many = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (document, docs, n) in held.items():
                k, begin = len(n), lang.encode() + PART
                columns = [pa.array([begin + t for t in n], pa.binary()), pa.array([source]).take(pa.array(np.zeros(k, np.int32))), pa.array(np.full(k, document, np.int64))]
                counts = [pa.array([docs[t] for t in n], pa.int64()), pa.array(n.values(), pa.int64())]
                yield from pa.Table.from_arrays([*columns, *counts], names=["key", "source", "document", "docs", "n"]).to_batches(10_000)
            held.clear()

        for b in batches:
            for lang, source, document, text in zip(*(b.column(i).to_pylist() for i in range(3)), b.column(3).cast(pa.large_binary()).to_pylist(), strict=True):
                words = text.translate(TERM_BYTES).split()
                if not words:
                    continue
                group = held.setdefault((lang, source), [document, Counter(), Counter()])
                many -= len(group[2])
                group[0] = min(group[0], document)
                group[1].update(set(words))
                group[2].update(words)
                many += len(group[2])
                if many >= HELD:
                    yield from flushed()
                    many = 0
        yield from flushed()

    return in_batches(docs, run, "key binary, source string, document long, docs long, n long")


def changes(*columns: pa.Array) -> np.ndarray:
    """Where a row differs from the one before in any column; the first row does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def run_lengths(sorted_pieces: DataFrame) -> DataFrame:
    """(lang, term, sources, docs, n, edge) for each run of a key in each partition of sorted pieces.

    sources, docs and n are lists, an entry per run of a source in the key's run. The first and last key of a partition
    may go on in another: they are ``edge``. Of the others only those in LEAST_DOCS documents are handed on. The scan
    holds one open run, a row per source.
    """
    schema = "lang string, term string, sources array<string>, docs array<long>, n array<long>, edge boolean"

    def closed(key: pa.Array, source: pa.Array, docs: np.ndarray, n: np.ndarray, first: bool, last: bool) -> pa.RecordBatch:
        """Rows of whole runs; the first or last of them is an edge."""
        begin = np.flatnonzero(changes(key)) if len(key) else np.zeros(0, np.int64)
        edge = np.zeros(len(begin), bool)
        edge[:1] |= first
        edge[len(begin) - 1 :] |= last
        keep = edge | ((np.add.reduceat(docs, begin) if len(begin) else docs) >= LEAST_DOCS)
        offsets = pa.array(np.append(begin, len(key)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, x).filter(pa.array(keep)) for x in (source, pa.array(docs), pa.array(n))]
        names = [k.partition(PART) for k in key.take(pa.array(begin[keep])).to_pylist()]
        parts = [pa.array([x[i].decode() for x in names], pa.string()) for i in (0, 2)]
        return pa.RecordBatch.from_arrays([*parts, *lists, pa.array(edge[keep])], names=["lang", "term", "sources", "docs", "n", "edge"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for b in batches:
            whole = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks().to_batches()[0]
            begin = np.flatnonzero(changes(whole.column(0), whole.column(1)))
            at = pa.array(begin)
            key, source = whole.column(0).take(at), whole.column(1).take(at)
            docs, n = (np.add.reduceat(whole.column(i).to_numpy(), begin) for i in (2, 3))
            upto = int(np.flatnonzero(changes(key))[-1])
            if upto:
                yield closed(key[:upto], source[:upto], docs[:upto], n[:upto], first, False)
                first = False
            held = pa.RecordBatch.from_arrays([key[upto:], source[upto:], pa.array(docs[upto:]), pa.array(n[upto:])], names=b.schema.names)
        if held is not None:
            yield closed(held.column(0), held.column(1), held.column(2).to_numpy(), held.column(3).to_numpy(), first, True)

    return in_batches(sorted_pieces.select("key", "source", "docs", "n"), run, schema, 65_536)


def kept_terms(runs: DataFrame) -> DataFrame:
    """(lang, term, n, sources) of terms in LEAST_DOCS documents; what partitions cut is put together first."""
    zipped = F.arrays_zip(F.col("sources").alias("source"), F.col("docs").alias("docs"), F.col("n").alias("n"))
    parts = runs.where("edge").select("lang", "term", F.explode(zipped).alias("x")).groupBy("lang", "term", "x.source").agg(F.sum("x.docs").alias("docs"), F.sum("x.n").alias("n"))
    edges = parts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("sources")).where(F.col("docs") >= LEAST_DOCS)
    inner = runs.where("NOT edge").select("lang", "term", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"), F.arrays_zip(F.col("sources").alias("source"), F.col("n").alias("n")).alias("sources"))
    return inner.unionByName(edges.select(*inner.columns))


def _share(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + 1) / total) in whole numbers, exact beyond what a long holds."""
    return F.expr(f"1L + CAST({count} + 1 AS DECIMAL(20,0)) * CAST({SCALE} AS DECIMAL(10,0)) div CAST({total} AS DECIMAL(20,0))")


def _divergence(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); shares are SCALE + 1 at most, so the square fits a long."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def group_totals(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """Per (lang, source) of ``groups``: its place k in the language, the V kept terms of the language, what shares are
    counted against (total, lang_total) and the share of a term that the group does not have (absent); total and absent
    are null in languages without kept terms."""
    own = kept.select("lang", F.explode("sources").alias("x")).groupBy("lang", F.col("x.source").alias("source")).agg(F.sum("x.n").alias("own_n"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_n"))
    out = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)).cast("long"))
    out = out.withColumn("total", F.expr("if(v > 0, coalesce(own_n, 0) + v, null)")).withColumn("lang_total", F.expr("if(v > 0, lang_n + v, null)"))
    k = (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).alias("k")
    return out.select("lang", "source", k, "v", "total", "lang_total", _share("0", "total").alias("absent"))


def pair_sums(terms: DataFrame) -> DataFrame:
    """(lang, i, j, added): what the kept terms add to the pair sums of a language in which no source had any term.

    ``terms`` has lang, absent (the shares of an absent term, by source) and entries (k, p). Work and memory go with the
    sources that a term is in, times all sources. Sums leave a task as partial rows and are added up by pair.
    """

    def squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def added(absent: np.ndarray, entries: list[list[dict]]) -> np.ndarray:
        """Over a block of terms, by [group, other]."""
        have = np.zeros((len(entries), len(absent)), bool)
        shares = np.tile(absent, (len(entries), 1))
        for t, xs in enumerate(entries):
            for x in xs:
                have[t, x["k"]], shares[t, x["k"]] = True, x["p"]
        out = np.zeros((len(absent), len(absent)), np.int64)
        for k in np.flatnonzero(have.any(0)):
            rows = np.flatnonzero(have[:, k])
            own, others, none = shares[rows, k, None], shares[rows], ~have[rows]
            out[k] += (squares(own, others) - squares(absent[k], absent)).sum(0)
            out[:, k] += ((squares(others, own) - squares(absent, absent[k])) * none).sum(0)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, sums in held.items():
                n = len(sums)
                columns = [pa.array([lang] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(sums.tolist(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "i", "sums"])
            held.clear()

        for b in batches:
            langs = b.column(0).to_pylist()
            for lang in dict.fromkeys(langs):
                at = [t for t, x in enumerate(langs) if x == lang]
                absent = np.array(b.column(1)[at[0]].as_py(), np.int64)
                step = max(1, CELLS // len(absent))
                for s in range(0, len(at), step):
                    sums = added(absent, b.column(2).take(pa.array(at[s : s + step])).to_pylist())
                    held[lang] = held[lang] + sums if lang in held else sums
                    if sum(x.size for x in held.values()) > SUMS:
                        yield from flushed()
        yield from flushed()

    partial = in_batches(terms.select("lang", "absent", "entries"), run, "lang string, i int, sums array<long>")
    return partial.select("lang", "i", F.posexplode("sums").alias("j", "x")).groupBy("lang", "i", "j").agg(F.sum("x").alias("added"))


def source_divergence(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source lies from the others of its language, and by what.

    Part pair: item is another source, value the divergence over all kept terms. Part term: item is a kept term that the
    source has oftener than its language, value its divergence, TOP_TERMS at most. Term counts are written, dealt by
    ranges of (lang, term, source, document), sorted, and scanned for runs; a range may begin inside a run, so a term in
    a third of all documents is no single task, and the parts of its run are added up afterwards. Each row is a document.
    Null languages, sources and texts count as empty ones; null and repeated ids and repeated rows are documents like any
    other; a language without kept terms has pairs of value 0 and no terms; an empty table gives no rows. Other columns
    are not read. The result has a row per two sources of a language, so that is what its size grows with.
    """
    filled = lambda c, n: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
    slim = docs.select(filled(lang_col, "lang"), filled(source_col, "source"), F.xxhash64(id_col).alias("document"), filled(text_col, "text"))
    # by a hash of the language and term first: eight bytes then settle nearly every comparison of the sort
    order = ["hashed", "key", "source", "document"]
    counted = cut(pieces(slim).withColumn("hashed", F.xxhash64("key")), "term-pieces")
    runs = cut(run_lengths(counted.repartitionByRange(*order).sortWithinPartitions(*order)), "term-runs")
    kept = cut(kept_terms(runs), "kept-terms")
    groups = cut(group_totals(slim.select("lang", "source").distinct(), kept), "term-groups")
    known = small(groups, 64)

    each = kept.select("lang", "term", F.col("n").alias("lang_n"), F.explode("sources").alias("x")).select("lang", "term", "lang_n", "x.source", "x.n")
    shares = each.join(known, ["lang", "source"]).select("lang", "source", "k", "term", _share("n", "total").alias("p"), _share("lang_n", "lang_total").alias("q"))
    shares = cut(shares, "term-shares")

    best = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _divergence("p", "q").alias("value"))
    placed = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    best = best.withColumn("rank", placed).where(F.col("rank") <= TOP_TERMS)

    absent = groups.where("v > 0").groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "absent"))), lambda x: x["absent"]).alias("absent"))
    absent = cut(absent, "absent-shares")
    longest = absent.agg(F.max(F.size("absent"))).first()[0] or 0
    rows = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("k", "p")).alias("entries")).join(small(absent, 64 + 8 * longest), "lang")
    sums = cut(pair_sums(rows), "pair-sums")

    names = ["lang", "source", "k", "v", "absent"]
    both = groups.select(*names).join(groups.select("lang", *(F.col(c).alias(f"other_{c}") for c in ("source", "k", "absent"))), "lang").where("source <> other_source")
    both = both.join(sums, [both["lang"] == sums["lang"], both["k"] == sums["i"], both["other_k"] == sums["j"]], "left").drop(sums["lang"])
    value = F.when(F.col("v") > 0, F.col("v") * _divergence("absent", "other_absent") + F.coalesce("added", F.lit(0))).otherwise(0)
    pairs = both.select("lang", "source", F.lit("pair").alias("part"), F.col("other_source").alias("item"), value.cast("long").alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return pairs.unionByName(best).withColumn("rank", F.col("rank").cast("int"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, unnest(w) AS term FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n, count(DISTINCT r) AS docs FROM t GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
o AS (SELECT c.lang, c.source, sum(c.n)::HUGEINT AS n FROM c JOIN k USING (lang, term) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(o.n, 0) + v.v) AS p, 1 + (1000000000 * (k.n + 1)) // (v.n + v.v) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN o ON o.lang = g.lang AND o.source = g.source),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, value, rank::INT AS rank FROM z WHERE part = 'pair' OR rank <= 200"""
