"""Operator 8: line deduplication by patience alignment of overlapping documents."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointweave.llm.common import WORD, cut, hot_join, in_batches, named, small

#: Words of an aligned block of lines, at least, for it to be deleted.
BLOCK_WORDS = 5
#: Equal lines of two stretches without anchors, up to which their longest common subsequence is worked out. Beyond it
#: ``deleted`` aligns the shared stretches by themselves, as it does for all that whole alignments leave.
MOST_MATCHES = 1_000_000

#: Times that what is left of a text is aligned anew.
ALIGNMENTS = 8
#: Texts that meet one first text in a part of the join.
PARTNERS = 1000


def patience(left: list[int], right: list[int]) -> list[tuple[int, int]]:
    """Aligned index pairs of two sequences by patience diff.

    Items that occur once in both are ordered by the longest increasing run of their places; between two of them the
    same is done again, and runs of equal items next to them are taken in. A stretch without such items is aligned by
    its longest common subsequence.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(left), 0, len(right))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and left[a] == right[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        here: dict[int, int] = {}
        for j in range(c, d):
            here[right[j]] = -1 if right[j] in here else j
        once: dict[int, int] = {}
        for i in range(a, b):
            once[left[i]] = -1 if left[i] in once else i
        places = sorted((i, here[x]) for x, i in once.items() if i >= 0 and here.get(x, -1) >= 0)
        if not places:
            out.extend(common(left, right, a, b, c, d))
            continue
        tops: list[int] = []
        piles: list[int] = []
        before = [-1] * len(places)
        for k, (_, j) in enumerate(places):
            p = bisect_left(tops, j)
            before[k] = piles[p - 1] if p else -1
            tops[p:], piles[p:] = [j, *tops[p + 1 :]], [k, *piles[p + 1 :]]
        chain, k = [], piles[-1]
        while k >= 0:
            chain.append(places[k])
            k = before[k]
        edges = [(a - 1, c - 1), *reversed(chain), (b, d)]
        out.extend(chain)
        todo.extend((x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:], strict=False))
    return sorted(out)


def common(left: list[int], right: list[int], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence of left[a:b] and right[c:d] (Hunt and Szymanski)."""
    at = defaultdict(list)
    for j in range(d - 1, c - 1, -1):
        at[right[j]].append(j)
    if sum(len(at[x]) for x in left[a:b] if x in at) > MOST_MATCHES:
        return []
    tops: list[int] = []
    ends: list[tuple] = []
    for i in range(a, b):
        for j in at.get(left[i], ()):
            p = bisect_left(tops, j)
            if p < len(tops) and tops[p] == j:
                continue
            tops[p : p + 1], ends[p : p + 1] = [j], [(i, j, ends[p - 1] if p else None)]
    out, end = [], ends[-1] if ends else None
    while end:
        out.append(end[:2])
        end = end[2]
    return out


def blocks(first: list[dict], later: list[dict], pairs: list[tuple[int, int]], block_words: int) -> set[int]:
    """Indices of the later text's lines in blocks of aligned pairs that are adjacent in both texts, of ``block_words`` or more."""
    out: set[int] = set()
    block: list[int] = []
    for k, (i, j) in enumerate(pairs):
        if k and (first[i]["pos"] != first[pairs[k - 1][0]]["pos"] + 1 or later[j]["pos"] != later[pairs[k - 1][1]]["pos"] + 1):
            out.update(block if sum(later[x]["words"] for x in block) >= block_words else ())
            block = []
        block.append(j)
    out.update(block if sum(later[x]["words"] for x in block) >= block_words else ())
    return out


def deleted(first: list[dict], later: list[dict], block_words: int) -> list[int]:
    """Places of the later text's lines that stand in aligned blocks of ``block_words`` words or more.

    The texts are aligned by patience diff, aligned blocks are taken out of the later text, and what is left of it is
    aligned with the first again, ALIGNMENTS times at most or until no block is found: moved blocks come up once those
    that they crossed are gone. Stretches of lines that both texts have and that still stand then, as other lines drew
    the alignment away from them, are aligned by themselves. So every line of a common block goes, and each through an
    alignment.
    """
    left, right = [x["hash"] for x in first], [x["hash"] for x in later]
    gone: set[int] = set()
    rest = list(range(len(later)))
    for _ in range(ALIGNMENTS):
        pairs = [(i, rest[j]) for i, j in patience(left, [right[j] for j in rest])]
        found = blocks(first, later, pairs, block_words)
        if not found:
            break
        gone |= found
        rest = [j for j in rest if j not in gone]
    if rest:
        known = {tuple(left[s : e + 1]): (s, e) for s, e in spans(first, block_words)}
        for s, e in sorted(spans(later, block_words)):
            if not gone.issuperset(range(s, e + 1)) and (at := known.get(tuple(right[s : e + 1]))):
                pairs = [(at[0] + i, s + j) for i, j in patience(left[at[0] : at[1] + 1], right[s : e + 1])]
                gone |= blocks(first, later, pairs, block_words)
    return sorted(later[j]["pos"] for j in gone)


def packed_lines(docs: DataFrame) -> DataFrame:
    """(id, sha, n_lines, lines) of (id, text) rows, rows that repeat an id as one: what is read after this is no text.

    lines: place, hash and words of the lines that are not blank.
    """
    line = lambda x, k: F.struct(k.alias("pos"), F.xxhash64(x).alias("hash"), F.regexp_count(x, F.lit(WORD)).cast("int").alias("words"))
    split = F.split("text", "\n", -1)
    rows = docs.select("id", F.sha2("text", 256).alias("sha"), F.size(split).alias("n_lines"), F.filter(F.transform(split, line), lambda x: x["words"] > 0).alias("lines"))
    return cut(rows, "packed-lines")


def shared_lines(packed: DataFrame) -> DataFrame:
    """(id, pos, hash, words): the lines of packed rows that several ids have."""
    lines = cut(packed.select("id", F.inline("lines")), "lines")
    per = cut(lines.groupBy("hash").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last"), "lines-of-several")
    return cut(hot_join(lines, per.select("hash", "n"), "hash"), "shared-lines")


def spans(lines: list[dict], block_words: int) -> set[tuple[int, int]]:
    """First and last index of the shortest runs of adjacent lines with ``block_words`` words from each line on, and up
    to each line: together they cover every block."""
    sums = [0]
    for x in lines:
        sums.append(sums[-1] + x["words"])
    found, begin = set(), 0
    for stop in range(1, len(lines) + 1):
        if stop < len(lines) and lines[stop]["pos"] == lines[stop - 1]["pos"] + 1:
            continue
        for k in range(begin, stop):
            start, end = bisect_right(sums, sums[k + 1] - block_words) - 1, bisect_left(sums, sums[k] + block_words) - 1
            found |= ({(start, k)} if start >= begin else set()) | ({(k, end)} if end < stop else set())
        begin = stop
    return found


def runs(lines: list[dict], block_words: int) -> Iterator[tuple[bytes, int, int]]:
    """(hash, first place, last place) of the spans: each run of a block is in both texts of an alignment that has it."""
    for start, end in spans(lines, block_words):
        digest = blake2b(b"".join(x["hash"].to_bytes(8, "big", signed=True) for x in lines[start : end + 1]), digest_size=16).digest()
        yield digest, lines[start]["pos"], lines[end]["pos"]


def all_runs(rows: DataFrame, block_words: int) -> DataFrame:
    """(run, id, start, end, first, texts): the rows' runs that several ids have, the least of them and how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(r["id"], *x) for r in batch.to_pylist() for x in runs(r["lines"], block_words)]
            columns = list(zip(*got, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "run", "start", "end"])

    every = cut(in_batches(rows.select("id", "lines"), run, "id long, run binary, start int, end int"), "line-runs")
    per = every.groupBy("run").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    per = cut(per.select("run", "first", F.col("n").alias("texts"), "n"), "runs-of-several")
    return cut(hot_join(every, per, "run"), "shared-runs")


def rare_partners(shared: list[tuple[int, int, int, int]]) -> set[int]:
    """The first texts of a text's rarest shared runs (texts, start, end, first) that together cover all of them."""
    covered: set[int] = set()
    out = set()
    for _, start, end, first in sorted(shared):
        if not covered.issuperset(range(start, end + 1)):
            covered.update(range(start, end + 1))
            out.add(first)
    return out


def partners(shared: DataFrame) -> DataFrame:
    """(a, b): for each text b the earlier texts that it is aligned with."""
    per = shared.where("id > first").groupBy("id").agg(F.collect_list(F.struct("texts", "start", "end", "first")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(a, r["id"]) for r in batch.to_pylist() for a in sorted(rare_partners([tuple(x.values()) for x in r["runs"]]))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in got], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return cut(in_batches(per, run, "a long, b long"), "line-pairs")


def met(pairs: DataFrame, heads: DataFrame) -> DataFrame:
    """(b, lines_a, lines_b) of pairs; a text that is the first of many meets them in parts of PARTNERS each."""
    many = cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).select("a", F.ceil(F.col("n") / PARTNERS).cast("int").alias("parts")), "line-firsts")
    dealt = pairs.join(small(many.where("parts > 1"), 16), "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    firsts = heads.toDF("a", "lines_a").join(many, "a").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return dealt.join(firsts, ["a", "part"]).join(heads.toDF("b", "lines_b"), "b").select("b", "lines_a", "lines_b")


def duplicate_lines(docs: DataFrame, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, removed): for each id with lines to delete, their sorted places in its text.

    Equal texts keep all lines in the least id and lose them in the others. Of two different texts that share lines,
    the one with the greater id loses the aligned blocks; the first text that has a line keeps it, so a line's last
    copy is never deleted. A text's partners are the first texts of the rarest shared runs of its lines, as many as
    cover all that it shares; these alignments delete what aligning it with every earlier text would (tests compare
    both), from pairs that grow with the lines only. Texts whose shared lines are the same in the same order and
    adjacency align alike, so each such class has one text to align with. Ids are whole numbers. Lines are told apart by
    64-bit hashes. Null and empty texts and rows with a null id lose nothing; rows that repeat an id are one text (the
    least hash); an empty table gives no rows; other columns are not read; an id called ``removed`` gives
    ``removed_result``.
    """
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    packed = packed_lines(whole)
    texts = cut(packed.groupBy("id").agg(F.min("sha").alias("sha"), F.min_by("n_lines", "sha").alias("n_lines")), "line-texts")
    heads = cut(texts.groupBy("sha").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "line-heads")
    copies = texts.join(small(heads.where("copies > 1"), 32), "sha").where("id <> rep")
    reps = heads.select(F.col("rep").alias("id"), F.col("sha"))
    distinct = packed.select("id", "sha", "lines").join(small(reps, 32), ["id", "sha"], "left_semi").dropDuplicates(["id"])
    lines = shared_lines(distinct)
    rows = lines.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "words"))).alias("lines"))
    steps = F.transform("lines", lambda x, k: F.struct(x["hash"], (k > 0) & (x["pos"] == F.get("lines", k - 1)["pos"] + 1)))
    rows = cut(rows.withColumn("like", F.xxhash64(steps)), "line-rows")
    alike = cut(rows.groupBy("like").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "line-likes")
    rows = cut(hot_join(rows, alike, "like").drop("like"), "line-classes")
    heads_only = rows.where("id = rep").select("id", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = [], []
            for r in batch.to_pylist():
                got = deleted(r["lines_a"], r["lines_b"], block_words)
                ids += [r["b"]] * len(got)
                places += got
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32())], names=["id", "pos"])

    pairs = partners(all_runs(heads_only, block_words))
    found = cut(in_batches(met(pairs, heads_only), run, "id long, pos int", 256), "line-deletions")
    same = rows.where("id > rep").select(F.col("id").alias("b"), F.col("lines").alias("lines_a"), F.col("lines").alias("lines_b"))
    found = found.unionByName(cut(in_batches(same, run, "id long, pos int", 256), "like-deletions"))
    found = found.groupBy("id").agg(F.array_sort(F.collect_set("pos")).alias("removed"))
    again = copies.select("id", F.sequence(F.lit(0), F.col("n_lines") - 1).alias("removed"))
    return found.unionByName(again).select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), F.col("removed").alias(named(id_col, ["removed"])[0]))


def without_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with their ``removed`` lines taken out of the text."""
    kept = removed.select(F.col(id_col).alias("pw_id"), F.col("removed").alias("pw_removed"))
    lines = F.filter(F.split(text_col, "\n", -1), lambda _, k: ~F.array_contains("pw_removed", k))
    joined = docs.join(kept, docs[id_col] == F.col("pw_id"), "left")
    return joined.withColumn(text_col, F.when(F.col("pw_removed").isNull(), F.col(text_col)).otherwise(F.array_join(lines, "\n"))).select(*docs.columns)
