"""Operator 10: rare seeds of benchmark items, joined to passages, and Smith-Waterman alignment of what they find."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pointweave.llm.common import cut, in_batches, named, small
from pointweave.llm.shingles import word_hashes

MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's own score from which a document counts as a copy of it, and the least words of an item.
LEAST_SCORE, LEAST_WORDS = 0.5, 5
#: Seeds of an item of m words are its RARE places, rarest first, of which a copy holds NEEDED: LEAST_SCORE takes half of
#: the m words (two points each, nothing else adds), so a copy misses m div 2 places at most. Those beyond that and one
#: more, m div 8, ask for as many more seeds at once.
RARE, NEEDED = "{m} div 2 + 1 + {m} div 8", "1 + {m} div 8"
#: Words of a document that the copy of an item of m words spans, in m: each word put in costs a point, and m are left.
SPAN = 2
#: Bits of the filters of words: of one size whatever the benchmark's; words that share a bit with one are joined away.
BITS = 1 << 23
#: Counts that a task holds, and bytes of a text whose words are hashed in one go.
HELD, PIECE = 500_000, 4 << 20
#: Cells of one row of a batch of alignments.
ROW_CELLS = 200_000

#: Every ASCII character that is no letter or digit parts words.
PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def hashed(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts on end, and the words of each text; a long text is hashed in pieces."""
    texts = [(t or b"").translate(PARTS) for t in texts]
    if sum(map(len, texts)) <= PIECE or len(texts) > 1 and max(map(len, texts)) <= PIECE:
        hashes, counts = word_hashes(texts)
        return hashes.view(np.int64), counts
    parts, counts = [], []
    for t in texts:
        at, n = 0, 0
        while at < len(t):
            end = t.find(b" ", at + PIECE) if at + PIECE < len(t) else len(t)
            end = len(t) if end < 0 else end
            got = word_hashes([t[at:end]])[0].view(np.int64)
            parts.append(got)
            at, n = end, n + len(got)
        counts.append(n)
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.array(counts, np.int64)


def align(items: list[np.ndarray], windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman for each (item, window): best score, and first and last word of it in the window.

    All pairs advance together, a row of the item at a time. A cell holds its score above its start, so one maximum
    carries both; gaps along the window are a running maximum of score plus column.
    """
    b, m, n = len(items), max(map(len, items)), max(map(len, windows))
    bits = n.bit_length() + 1
    left, right = np.full((b, m), -1, np.int64), np.full((b, n), -2, np.int64)
    for k, (x, y) in enumerate(zip(items, windows, strict=True)):
        left[k, : len(x)], right[k, : len(y)] = x, np.where(y > 0, y, -2)
    unit, column = 1 << bits, np.arange(n)
    fresh = np.broadcast_to(column, (b, n))  # score 0, starting here
    row, best, end = fresh.copy(), np.zeros(b, np.int64), np.zeros(b, np.int64)
    for i in range(m):
        step = np.where(left[:, i, None] == right, MATCH, MISMATCH) * unit
        diagonal = np.concatenate([fresh[:, :1], np.where(row[:, :-1] < unit, fresh[:, 1:], row[:, :-1])], 1) + step
        new = np.maximum(np.maximum(diagonal, row + GAP * unit), fresh)
        new = np.maximum.accumulate(new - column * GAP * unit, 1) + column * GAP * unit
        row = np.where(new < unit, fresh, new)
        top = row.argmax(1)
        value = row[np.arange(b), top]
        better = value >> bits > best >> bits
        best, end = np.where(better, value, best), np.where(better, top, end)
    return best >> bits, best & (unit - 1), end


def coded(item: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as numbers from 1 on for the item's words; other words are 0."""
    known, own = np.unique(item, return_inverse=True)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return own + 1, np.where(known[at] == words, at + 1, 0)


def stretches(words: np.ndarray, order: np.ndarray, item: np.ndarray, blocks: list[int]) -> list[list[int]]:
    """The parts of a text, of ``blocks`` put together, that may hold a copy of an item; ``order`` sorts the text's words.

    A score is at most MATCH for each word of the item that a block has: blocks with fewer than LEAST_SCORE asks for are
    left out.
    """
    m = len(item)
    known, places = np.unique(item, return_counts=True)
    low, high = (np.searchsorted(words, known, side, sorter=order) for side in ("left", "right"))
    many = high - low
    word = np.repeat(np.arange(len(known)), many)
    pos = order[np.repeat(low - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
    base = pos // (SPAN * m)
    top = int(len(words) // (SPAN * m)) + 1
    code = np.unique(np.concatenate([(base + 1) * len(known) + word, base * len(known) + word]))
    held = np.bincount(code // len(known), places[code % len(known)], top + 1)  # of block b at b + 1
    out: list[list[int]] = []
    for b in sorted(set(blocks)):
        if held[b + 1] < LEAST_SCORE * m:
            continue
        first, last = b * SPAN * m, min(len(words), (b + 2) * SPAN * m)
        if out and first <= out[-1][1]:
            out[-1][1] = max(last, out[-1][1])
        else:
            out.append([first, last])
    return out


def best_copies(texts: list[tuple[np.ndarray, list[tuple[np.ndarray, list[int]]]]]) -> list[tuple[int, int, float, int, int, int]]:
    """(text, item, score, seeds, first word, last word) of the items that texts copy, all texts aligned together.

    Each text comes with its items, and each item with the blocks of the text in which its seeds are; a copy lies whole in
    one of them. seeds: words of the item in the aligned stretch.
    """
    jobs = []
    for t, (words, items) in enumerate(texts):
        order = np.argsort(words, kind="stable")
        jobs += [(t, k, s, e) for k, (item, blocks) in enumerate(items) for s, e in stretches(words, order, item, blocks)]
    jobs.sort(key=lambda j: (j[3] - j[2], len(texts[j[0]][1][j[1]][0])))
    best: dict[tuple[int, int], tuple] = {}
    while jobs:
        step = max(1, ROW_CELLS // (jobs[-1][3] - jobs[-1][2]))
        part, jobs = jobs[-step:], jobs[:-step]
        scores, begin, end = align(*zip(*(coded(texts[t][1][k][0], texts[t][0][s:e]) for t, k, s, e in part), strict=True))
        for (t, k, s, _), score, x, y in zip(part, scores, begin, end, strict=True):
            words, item = texts[t][0], texts[t][1][k][0]
            share = float(score) / (MATCH * len(item))
            if share >= LEAST_SCORE:
                got = (share, int(np.isin(item, words[s + x : s + y + 1]).sum()), int(x + s), int(y + s))
                best[t, k] = max(best.get((t, k), (0.0,)), got)
    return [(t, k, *best[t, k]) for t, k in sorted(best)]


def word_filter(hashes: DataFrame) -> bytes:
    """BITS bits, those of the ``hash`` values set: one aggregation, of which the driver gets BITS / 8 bytes at most."""
    slots = hashes.select(F.pmod("hash", F.lit(BITS)).alias("slot")).distinct()
    rows = slots.groupBy(F.expr("slot div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.expr("slot % 32768")).alias("bits")).collect()
    out = bytearray(BITS // 8)
    for r in rows:
        out[r["bucket"] * 4096 : (r["bucket"] + 1) * 4096] = r["bits"]
    return bytes(out)


def passing(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    return bits[hashes % len(bits)]


def item_words(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_id, words): the different items of LEAST_WORDS words or more, their words as hashes."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hashes, counts = hashed(b.column("text").cast(pa.large_binary()).to_pylist())
            words = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(hashes, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("item"), b.column("item_id"), words], names=["item", "item_id", "words"])

    found = in_batches(rows.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text"), run, "item long, item_id string, words array<long>")
    return cut(found.where(F.size("words") >= LEAST_WORDS), "item-words")


def document_counts(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(hash, docs): in how many documents each word of the benchmark is."""
    wanted = cut(items.select(F.explode("words").alias("hash")).distinct(), "benchmark-words")
    packed = word_filter(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def added() -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held[0][0], pa.int64()), pa.array(held[0][1], pa.int64())], names=["hash", "docs"])

        for b in batches:
            hashes, counts = hashed(b.column(0).cast(pa.large_binary()).to_pylist())
            there = passing(hashes, bits)
            owner, hashes = np.repeat(np.arange(len(counts)), counts)[there], hashes[there]
            order = np.lexsort((hashes, owner))
            owner, hashes = owner[order], hashes[order]
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(owner) != 0) | (hashes[1:] != hashes[:-1])
            held.append(np.unique(hashes[new], return_counts=True))
            if sum(len(k) for k, _ in held) > HELD:
                held = [added()]
                if len(held[0][0]) > HELD // 2:
                    yield flushed()
                    held = []
        if held:
            held = [added()]
            yield flushed()

    counted = in_batches(texts.select("text"), run, "hash long, docs long").groupBy("hash").agg(F.sum("docs").alias("docs"))
    return cut(counted.join(wanted, "hash", "left_semi"), "word-documents")


def rare_seeds(items: DataFrame, counts: DataFrame) -> DataFrame:
    """(hash, item, m, places): the RARE places of each item, those first whose word is in the fewest documents, by word."""
    places = items.select("item", F.size("words").alias("m"), F.posexplode("words").alias("place", "hash")).join(counts, "hash", "left")
    turn = F.row_number().over(W.partitionBy("item").orderBy(F.coalesce("docs", F.lit(0)), "hash", "place"))
    return cut(places.withColumn("turn", turn).where("turn <= " + RARE.format(m="m")).groupBy("hash", "item", "m").agg(F.count(F.lit(1)).alias("places")), "seeds")


def seed_hits(texts: DataFrame, seeds: DataFrame) -> DataFrame:
    """(key, hash, pos): where words of (key, text) rows are seeds, or share their bit of the filter with one."""
    packed = word_filter(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little").astype(bool)
        for b in batches:
            hashes, counts = hashed(b.column("text").cast(pa.large_binary()).to_pylist())
            at = np.flatnonzero(passing(hashes, bits))
            begin = np.append(0, np.cumsum(counts))
            owner = np.searchsorted(begin, at, side="right") - 1
            yield pa.RecordBatch.from_arrays([b.column("key").take(pa.array(owner)), pa.array(hashes[at], pa.int64()), pa.array(at - begin[owner], pa.int64())], names=["key", "hash", "pos"])

    return in_batches(texts.select("key", "text"), run, "key long, hash long, pos long")


def counted(keys: np.ndarray, items: np.ndarray, m: np.ndarray, places: np.ndarray, hashes: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, item, m, block) of the blocks whose words have NEEDED seeds of an item, of all hits of some texts.

    A word counts once in a block, for as many seeds as it stands for. Texts and items are told apart by mixed 64-bit
    codes; two that met would add a block in vain.
    """
    rows = (keys, items, m, places, hashes, pos)

    def enough(code: np.ndarray, rows: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
        """Which rows are the first of their word under a code, and whether the code has the seeds that it needs."""
        _, once = np.unique(code * np.int64(-3335678366873096957) ^ rows[4], return_index=True)
        groups, place = np.unique(code, return_inverse=True)
        seeds = np.bincount(place[once], rows[3][once], len(groups))
        return seeds[place] >= 1 + rows[2] // 8

    with np.errstate(over="ignore"):
        both = keys * np.int64(-7046029254386353131) ^ items * np.int64(-4417276706812531889)
        kept = enough(both, rows)
        *rows, both = (x[kept] for x in (*rows, both))
        block = rows[5] // (SPAN * rows[2])
        rows = [np.concatenate([x, x]) for x in rows]
        block = np.concatenate([block, block - 1])
        code = np.concatenate([both, both]) * np.int64(-8796714831421723037) + block
        kept = enough(code, rows) & (block >= 0)
        _, first = np.unique(code[kept], return_index=True)
    return tuple(x[kept][first] for x in (*rows[:3], block))


def seeded_blocks(pairs: DataFrame) -> DataFrame:
    """(key, item, m, block) of (key, item, m, places, hash, pos) rows in which the hits of a text stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 6
        for b in batches:
            rows = [np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip(held, b.columns, strict=True)]
            if not len(rows[0]):
                continue
            others = np.flatnonzero(rows[0] != rows[0][-1])
            upto = int(others[-1]) + 1 if len(others) else 0
            held = [x[upto:] for x in rows]
            yield batch(counted(*(x[:upto] for x in rows)))
        yield batch(counted(*held))

    def batch(columns: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "item", "m", "block"])

    return in_batches(pairs, run, "key long, item long, m long, block long", 65_536)


def candidates(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(key, found): the items whose seeds a text may hold often enough, as (item_id, words, blocks).

    Blocks are SPAN * m words apart and twice as long, so what an item spans lies whole in one of them. While seeds are
    few they are broadcast; the hits of a text then stand together and are counted where they are. Else both sides are
    shuffled, and counts once more.
    """
    seeds = rare_seeds(items, document_counts(texts, items))
    joined = small(seeds, 32, seeds.count())
    pairs = seed_hits(texts, seeds).join(joined, "hash").select("key", "item", "m", "places", "hash", "pos")
    if joined is not seeds:
        blocks = seeded_blocks(pairs)
    else:
        block = F.expr(f"pos div ({SPAN} * m)")
        placed = pairs.select("key", "item", "m", "places", "hash", F.explode(F.array(block, block - 1)).alias("block")).where("block >= 0").distinct()
        blocks = placed.groupBy("key", "item", "m", "block").agg(F.sum("places").alias("n")).where("n >= " + NEEDED.format(m="m"))
    met = cut(blocks.groupBy("key", "item").agg(F.collect_set("block").alias("blocks")), "seeded-items")
    longest = items.agg(F.max(F.size("words"))).first()[0] or 0
    return cut(met.join(small(items, 64 + 8 * longest), "item").groupBy("key").agg(F.collect_list(F.struct("item_id", "words", "blocks")).alias("found")), "candidates")


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row (id, item_id, score, n_seeds, first_word, last_word) for each document that copies a benchmark item.

    score is the alignment's as a share of the item's own (1: whole and unchanged), LEAST_SCORE at least: every document
    that reaches it is found, however its words were edited. n_seeds: words of the item in the aligned stretch. Whole
    texts are searched, in two passes whatever the benchmark's size: one counts in how many documents each benchmark
    word is, one finds seeds. Null and empty texts hold nothing; items that are null or shorter than LEAST_WORDS words are
    not looked for; repeated items are one, of texts that share an item's id the best counts; repeated rows give repeated
    results; a null document id is handed through. Empty tables give empty results; other columns are not read; a result
    column that the id has the name of gets ``_result`` behind it. Words are told apart by 64-bit hashes.
    """
    text = F.col(text_col).cast("string")
    texts = docs.select(F.xxhash64(F.col(id_col), text).alias("key"), F.col(id_col).alias("id"), text.alias("text")).where("text IS NOT NULL")
    items = item_words(benchmark, item_id_col, item_text_col)
    met = candidates(texts, items)
    names = named(id_col, ["item_id", "score", "n_seeds", "first_word", "last_word"])
    inner = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL("item_id string, score double, n_seeds long, first_word long, last_word long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b.column("found").to_pylist()
            hashes, counts = hashed(b.column("text").cast(pa.large_binary()).to_pylist())
            words = np.split(hashes, np.cumsum(counts)[:-1]) if len(counts) else []
            texts = [(w, [(np.array(x["words"], np.int64), x["blocks"]) for x in f]) for w, f in zip(words, found, strict=True)]
            best: dict[tuple[int, str], tuple] = {}
            for t, k, *rest in best_copies(texts):
                best[t, found[t][k]["item_id"]] = max(best.get((t, found[t][k]["item_id"]), (0.0,)), tuple(rest))
            at, rows = [t for t, _ in best], [(item, *x) for (_, item), x in best.items()]
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=inner.names)

    width = met.agg(F.max(F.aggregate("found", F.lit(0), lambda n, x: n + 8 * F.size(x["words"]) + 8 * F.size(x["blocks"]) + F.octet_length(x["item_id"])))).first()[0] or 0
    hit = texts.join(small(met, 32 + width, met.count()), "key").select("id", "text", "found")
    out = in_batches(hit, run, inner)
    kind = benchmark.schema[item_id_col].dataType
    return out.select(F.col("id").alias(id_col), F.col("item_id").cast(kind).alias(names[0]), *(F.col(c).alias(n) for c, n in zip(inner.names[2:], names[1:], strict=True)))


def keep_unleaked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which benchmark_leaks finds no item.

    A leaked row is known by a hash of its columns. The hashes are broadcast while they are few, else Spark shuffles both
    sides.
    """
    mark = F.xxhash64(F.col(text_col).cast("string"), *(c for c, kind in docs.dtypes if "map<" not in kind and c != text_col))
    known = docs.select(mark.alias("pw_mark"), F.col(text_col).cast("string").alias("pw_text"))
    leaked = cut(benchmark_leaks(known, benchmark, "pw_mark", "pw_text", item_id_col, item_text_col).select("pw_mark").distinct(), "leaked-rows")
    return docs.join(small(leaked.toDF("pw_leaked"), 16), mark == F.col("pw_leaked"), "left_anti")
