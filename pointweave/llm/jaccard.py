"""Operator 9: exact Jaccard links of shingle sets and their components.

Prefix index with the two skips of the set-relation method. Sets are ordered by token hash, frequent tokens last; two
sets that link share a token of their prefixes. Index level: a token's list is sorted by set size and cut into blocks
of equal size and position, and pairs of blocks whose sizes or positions rule a link out are skipped whole. Answer
level: equal sets have one answer; each set is first held against one near set; pairs that the answers so far put into
one component need none of their own; and where both sets of a pair were held against the same third one, the two
overlaps bound theirs, which often settles the pair without reading either set again.

A token with more than LONG_LIST sets makes no pairs; such tokens are counted before their rows are dealt out, so no
task gets a list that grows with the corpus. Where the links so far do not join a token's sets, they are indexed again
among themselves with such tokens moved to the end of the order; in the last round the sets that still share one (near
copies in bulk) are held against one of them and, if that does not join them, compared in dense blocks. All of it is
exact, up to equal 64-bit hashes of different shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.llm.common import cut, in_batches, partitions, small
from pointweave.llm.components import components
from pointweave.llm.shingles import shingle_sets

#: Sets in a token's list beyond which the token counts as frequent.
LONG_LIST = 48
#: Times that sets are indexed again, and frequent tokens that are handed to every executor, at most.
ROUNDS, MOST_TOKENS = 3, 4_000_000
#: Bits of the least parity sketch (they grow with the set), and sets in a dense block.
SKETCH_BITS, DENSE = 512, 512

SETS = "id long, n int, sig_a long, sig_b long, sketch binary, prefix array<long>"


def prefix_length(n, num: int, den: int):
    """Tokens of which two linking sets must share one: n - ceil(n * num / den) + 1."""
    return n - (n * num + den - 1) // den + 1


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by hash bucket, two buckets or more a token, in a power of two."""
    bits = max(SKETCH_BITS, 1 << (2 * len(tokens) - 1).bit_length()) if len(tokens) else SKETCH_BITS
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """Tokens that two sets differ in, at least: the bits that do, the longer sketch folded to the shorter one."""
    p, q = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(p) != len(q):
        p, q = (p, q) if len(p) < len(q) else (q, p)
        q = np.bitwise_xor.reduce(q.reshape(-1, len(p)), 0)
    return int(np.bitwise_count(p ^ q).sum())


def signed(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def ordered_prefix(tokens: np.ndarray, late: np.ndarray, num: int, den: int) -> np.ndarray:
    """The prefix under: tokens not in ``late`` by hash, then the others by hash."""
    p = prefix_length(len(tokens), num, den)
    if not len(late) or p >= len(tokens):
        return tokens[:p]
    at = np.searchsorted(late, tokens)
    is_late = late[np.minimum(at, len(late) - 1)] == tokens
    return np.concatenate([tokens[~is_late], tokens[is_late]])[:p]


def _texts(b: pa.RecordBatch, name: str) -> list:
    return b.column(name).cast(pa.large_binary()).to_pylist()


def describe(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """SETS for (id, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(_texts(b, "text"), width)
            prefixes = [s[: prefix_length(len(s), num, den)] if len(s) else s for s in sets]
            with np.errstate(over="ignore"):
                sigs = [(s.sum(dtype=np.uint64), (s * (s >> np.uint64(7) | np.uint64(1))).sum(dtype=np.uint64)) for s in sets]
            columns = [b.column("id"), pa.array([len(s) for s in sets], pa.int32()), *(pa.array(signed(np.array([x[k] for x in sigs], np.uint64))) for k in (0, 1)), pa.array(map(sketch, sets), pa.binary()), pa.array(map(signed, prefixes), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "sig_a", "sig_b", "sketch", "prefix"])

    return in_batches(docs, run, SETS)


def entries(rows: DataFrame) -> DataFrame:
    return rows.select("id", "n", F.posexplode("prefix").alias("pos", "token"))


def list_pairs(ids: np.ndarray, n: np.ndarray, pos: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pairs (rows of two ids, the lesser first) of one list that sizes and positions do not rule out.

    Rows of equal size and position make a block; bounds are worked out once per pair of blocks.
    """
    order = np.lexsort((pos, n))
    ids, n, pos = ids[order], n[order], pos[order]
    edge = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (pos[1:] != pos[:-1])]))
    bn, bp = n[edge].astype(np.int64), pos[edge].astype(np.int64)
    need = -(-num * (bn[:, None] + bn[None, :]) // (num + den))
    room = np.minimum(bp[:, None], bp[None, :]) + 1 + np.minimum((bn - bp)[:, None], (bn - bp)[None, :]) - 1
    open_blocks = (room >= need) & (den * np.minimum(bn[:, None], bn[None, :]) >= num * np.maximum(bn[:, None], bn[None, :]))
    block = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(ids))))
    i, j = np.nonzero(np.triu(open_blocks[np.ix_(block, block)], 1))
    a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
    return np.stack([a, b], 1)[a != b]


def two_pairs(a, n, p, b, m, q, num: int, den: int) -> np.ndarray:
    """list_pairs of many lists of two."""
    need = -(-num * (n + m) // (num + den))
    room = np.minimum(p, q) + np.minimum(n - p, m - q)
    good = (room >= need) & (den * np.minimum(n, m) >= num * np.maximum(n, m)) & (a != b)
    return np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[good]


def index(rows: DataFrame, num: int, den: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(a, b) pairs from short lists, and (token, id, n) rows of the long ones, for (id, n, prefix) rows.

    Tokens are counted first, before the shuffle. Those of long lists are told by a join that leaves their rows where
    they are while the tokens are few, and splits them where it is skewed; only short lists are brought together.
    """
    every = entries(rows)
    frequent = cut(every.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > LONG_LIST).select("token"), f"frequent-{name}")
    frequent = small(frequent, 16)
    hot = every.join(frequent, "token", "left_semi").select("token", "id", "n")
    spark = rows.sparkSession
    rest = every.join(frequent, "token", "left_anti")
    dealt = rest.select("token", "id", "n", "pos").repartition(partitions(spark), "token").sortWithinPartitions("token")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = set(), [np.zeros(0, np.int64)] * 4

        def made(pairs: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal seen
            new = []
            if pairs:
                both = np.unique(np.concatenate(pairs), axis=0)
                new = [p for p in map(tuple, both.tolist()) if p not in seen]
                seen = seen if len(seen) < 300_000 else set()
                seen.update(new)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in new], pa.int64()), pa.array([p[1] for p in new], pa.int64())], names=["a", "b"])

        def lists(columns: list[np.ndarray], last: bool) -> tuple[list, list]:
            """Pairs of the lists that are complete; hand back the rest."""
            token = columns[0]
            if not len(token):
                return [], columns
            starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            ends = np.append(starts[1:], len(token))
            keep = len(token) if last else int(starts[-1])
            whole = ends <= keep
            twos = starts[whole & (ends - starts == 2)]
            pairs = [two_pairs(*(c[twos] for c in columns[1:]), *(c[twos + 1] for c in columns[1:]), num, den)]
            many = whole & (ends - starts > 2)
            pairs += [list_pairs(*(c[s:e] for c in columns[1:]), num, den) for s, e in zip(starts[many].tolist(), ends[many].tolist(), strict=True)]
            return pairs, [c[keep:] for c in columns]

        for b in batches:
            new = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("token", "id", "n", "pos")]
            pairs, held = lists([np.concatenate([h, c]) for h, c in zip(held, new, strict=True)], False)
            yield made(pairs)
        yield made(lists(held, True)[0])

    out = cut(in_batches(dealt, run, "a long, b long", 50_000), name)
    return out.distinct(), hot


def linked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(a, b, n_a, n_b, both) of the pairs that sketches do not rule out: sizes of the sets, made anew from the texts, and
    of what they share. ``links`` keeps those that link."""
    spark = docs.sparkSession
    light = sets.select("id", "n", "sketch")
    two = pairs.join(light.toDF("a", "n_a", "sketch_a"), "a").join(light.toDF("b", "n_b", "sketch_b"), "b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(b.column("sketch_a").to_pylist(), b.column("sketch_b").to_pylist(), strict=True)
            differ = np.fromiter((least_difference(x, y) for x, y in both), np.int64, b.num_rows)
            n = b.column("n_a").to_numpy().astype(np.int64) + b.column("n_b").to_numpy()
            yield b.select(["a", "b"]).filter(pa.array(differ <= n - 2 * (-(-num * n // (num + den)))))

    close = cut(in_batches(two, near, "a long, b long", 2048).distinct(), "close-pairs")
    wanted = cut(close.select(F.col("a").alias("id")).union(close.select("b")).distinct(), "close-ids")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([s.tobytes() for s in shingle_sets(_texts(b, "text"), width)], pa.binary())], names=["id", "tokens"])

    full = cut(in_batches(docs.join(small(wanted, 16), "id", "left_semi"), whole, "id long, tokens binary", 512), "close-sets")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told = []
            for x, y in zip(b.column("tokens_a").to_pylist(), b.column("tokens_b").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                told.append((len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))))
            sizes = np.array(told, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), *(pa.array(sizes[:, k]) for k in range(3))], names=["a", "b", "n_a", "n_b", "both"])

    met = close.join(full.toDF("a", "tokens_a"), "a").join(full.toDF("b", "tokens_b"), "b")
    return cut(in_batches(met, exact, "a long, b long, n_a long, n_b long, both long", 128), "overlaps")


def links_of(told: DataFrame, num: int, den: int) -> DataFrame:
    return told.where(den * F.col("both") >= num * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def derived(pairs: DataFrame, told: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(pairs that link, pairs still open) of ``pairs``, from ``told``: each b's overlap with the one a it was held against.

    Of two sets held against the same third one x, what they share is at least both overlaps together less the size of
    x, and at most the smaller overlap and the smaller rest. Pairs that cannot link by that are left out.
    """
    of = lambda c: told.select(F.col("b").alias(c), F.col("a").alias(f"x_{c}"), F.col("n_a").alias(f"nx_{c}"), F.col("n_b").alias(f"n_{c}"), F.col("both").alias(f"o_{c}"))
    met = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    same = F.coalesce(F.col("x_a") == F.col("x_b"), F.lit(False))
    need = F.ceil(num * (F.col("n_a") + F.col("n_b")) / (num + den))
    low = F.col("o_a") + F.col("o_b") - F.col("nx_a")
    high = F.least("o_a", "o_b") + F.least(F.col("n_a") - F.col("o_a"), F.col("n_b") - F.col("o_b"))
    answer = F.when(same & (low >= need), "yes").when(same & (high < need), "no").otherwise("open")
    met = cut(met.select("a", "b", answer.alias("answer")).where("answer <> 'no'"), "derived")
    return met.where("answer = 'yes'").select("a", "b"), met.where("answer = 'open'").select("a", "b")


def dense_links(family: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Links inside (family, id) groups of near copies, as edges that join what links, from blocks of DENSE sets.

    Each pair of blocks is one group of 2 * DENSE sets at most; its intersections are one product of 0/1 matrices over
    the tokens that two of its sets share.
    """
    spark = docs.sparkSession
    blocks = family.groupBy("family").agg(F.ceil(F.count(F.lit(1)) / DENSE).cast("int").alias("blocks"))
    placed = family.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([s.tobytes() for s in shingle_sets(_texts(b, "text"), width)], pa.binary())], names=["id", "tokens"])

    wanted = family.select("id").distinct()
    full = cut(in_batches(docs.join(small(wanted, 16), "id", "left_semi"), whole, "id long, tokens binary", 512), "dense-sets")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    met = placed.join(full, "id").withColumn("other", F.explode(others))
    met = met.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", "tokens")

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ids = np.array(table["id"].to_pylist(), np.int64)
        sets = [np.frombuffer(t, np.uint64) for t in table["tokens"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        _, name, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        shared = times[name] > 1
        row, name = row[shared], np.unique(name[shared], return_inverse=True)[1]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int(name.max(initial=-1)) + 1, 8192):
            part = np.zeros((len(sets), 8192), np.float32)
            here = (name >= low) & (name < low + 8192)
            part[row[here], name[here] - low] = 1
            both += part @ part.T
        hit = den * both >= num * (sizes[:, None] + sizes[None, :] - both)
        np.fill_diagonal(hit, True)
        least = np.arange(len(ids))
        order = np.argsort(ids, kind="stable")
        hit = hit[np.ix_(order, order)]
        while True:
            new = np.where(hit, least[None, :], len(ids)).min(1)
            new = new[new]
            if (new == least).all():
                break
            least = new
        a, b = ids[order][least], ids[order]
        return pa.table({"a": a[a != b], "b": b[a != b]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return cut(met.groupBy("family", "i", "j").applyInArrow(run, "a long, b long"), "dense-links")


def _named(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(…, id) rows with the label of the id, itself without links."""
    if labels is None:
        return rows.withColumn("label", F.col("id"))
    return rows.join(labels.toDF("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))


def component_links(sets: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame | None:
    """(node, component) of the links among ``sets``, one row of SETS per distinct set; None without links."""
    rows, links, labels, before = sets, [], None, None
    done = []
    for turn in range(ROUNDS):
        pairs, long_lists = index(rows, num, den, f"lists-{turn}")
        long_lists = cut(long_lists, f"long-lists-{turn}")
        for tested in done:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut(pairs, f"pairs-{turn}")
        done.append(pairs)
        open_rows = long_lists
        first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        if turn + 1 == ROUNDS:  # the sets that are left are nearly all frequent tokens: near copies, one of which joins most
            band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num)))
            heads = long_lists.withColumn("band", band).groupBy("token", "band").agg(F.min("id").alias("a"))
            stars = long_lists.withColumn("band", band).join(heads, ["token", "band"]).where("a <> id").select("a", F.col("id").alias("b"))
            first = first.union(stars).distinct()
        first = cut(first, f"first-{turn}")
        told = linked(first, sets, docs, width, num, den)
        links.append(links_of(told, num, den))
        labels = components(reduce(DataFrame.union, links))
        named = labels.toDF("id", "label")
        left = pairs.join(first, ["a", "b"], "left_anti")
        left = left.join(named.toDF("a", "label_a"), "a", "left").join(named.toDF("b", "label_b"), "b", "left")
        left = cut(left.where("coalesce(label_a, a) <> coalesce(label_b, b)").select("a", "b"), f"left-{turn}")
        if not left.isEmpty():
            sure, left = derived(left, told.groupBy("b").agg(F.min_by(F.struct("a", "n_a", "n_b", "both"), "a").alias("x")).select("b", "x.*"), num, den)
            links += [sure, links_of(linked(left, sets, docs, width, num, den), num, den)]
            labels = components(reduce(DataFrame.union, links))
        open_rows = _named(long_lists, labels)
        open_tokens = open_rows.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
        open_tokens = cut(open_tokens, f"open-tokens-{turn}")
        tokens = open_tokens.count()
        if not tokens:
            return labels
        open_rows = long_lists.join(small(open_tokens, 16, tokens), "token", "left_semi")
        known = open_tokens if before is None else before.union(open_tokens).distinct()
        known = cut(known, f"late-{turn}")
        many = known.count()
        if turn + 1 == ROUNDS or many > MOST_TOKENS or (before is not None and many == before.count()):
            break
        before = known
        again = cut(open_rows.select("id").distinct(), f"again-{turn}")
        moved = np.sort(np.array([r[0] for r in known.toLocalIterator()], np.int64).view(np.uint64))

        def lead(batches: Iterator[pa.RecordBatch], moved: np.ndarray = moved) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = shingle_sets(_texts(b, "text"), width)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(s) for s in got], pa.int32()), pa.array([signed(ordered_prefix(s, moved, num, den)) for s in got], pa.list_(pa.int64()))], names=["id", "n", "prefix"])

        rows = cut(in_batches(docs.join(small(again, 16), "id", "left_semi"), lead, "id long, n int, prefix array<long>"), f"led-{turn}")
    heads = open_rows.groupBy("token").agg(F.min("id").alias("a"))
    joined = components(open_rows.join(heads, "token").select("a", F.col("id").alias("b")).distinct())
    links.append(dense_links(joined.select(F.col("component").alias("family"), F.col("node").alias("id")), docs, width, num, den))
    return components(reduce(DataFrame.union, links))


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles and component_id, the least id reachable by links.

    Two documents link when den * |intersection| >= num * |union| of their sets of ``width``-word shingles, A-Z
    lowered; a text of fewer words is one shingle. Null, empty and wordless texts have no shingles and are alone.
    Ids are integers; rows that repeat an id are one node that links as any of them does; a row with a null id has no
    component (null). Equal sets are compared once. An empty table gives no rows; other columns are not read.
    """
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = cut(describe(whole, width, num, den), "sets")
    same = ["n", "sig_a", "sig_b"]
    classes = cut(sets.where("n > 0 and id is not null").groupBy(*same).agg(F.min("id").alias("rep")), "classes")
    heads = small(classes.withColumnRenamed("rep", "id"), 48)
    distinct = sets.join(heads, [*same, "id"], "left_semi")
    nodes = whole.where("id is not null")
    labels = component_links(distinct, nodes, width, num, den)
    placed = sets.select("id", *same).join(small(classes, 48), same, "left")
    twice = placed.where("rep is not null").groupBy("id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x <> y")
    if not twice.isEmpty():
        several = placed.join(twice.select("id", "x"), "id").select(F.col("x").alias("a"), F.col("rep").alias("b"))
        labels = components(several if labels is None else several.union(labels.select(F.col("component").alias("a"), F.col("node").alias("b"))))
    named = placed.select("id", "n", F.coalesce("rep", "id").alias("rep")).join(labels.toDF("rep", "label"), "rep", "left")
    kind = docs.schema[id_col].dataType
    return named.select(F.col("id").cast(kind).alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("label", "rep")).cast(kind).alias("component_id"))
