"""Operator 12: a change feed of top boards from a stream, by a tournament tree in the stream's state.

Leaves are buckets of items and hold every nation's revenue by item; nodes keep the best of the nodes below them. A batch
updates the leaves that it has items of, these hand on the boards that changed, and a nation's tree recomputes the paths
from those leaves to its root, whose board is compared with the one before, day by day.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pointweave.llm.common import cut, in_batches, scratch_path

#: Items of a board, days that a line may be behind the latest of earlier batches, and children of a node.
BOARD, LATE_DAYS, FAN = 10, 8, 8
#: Items that a leaf should hold; leaves at least and at most.
LEAF_ITEMS, LEAST_LEAVES, MOST_LEAVES = 4000, 16, 4096
#: Lines that a task combines in one go.
COMBINED = 500_000
#: The first day of the contract's calendar, its days and its batches.
FIRST_DAY, DAYS, BATCHES = 19723, 180, 12

#: What a stream is fed with: lines (nation_id may be null) and, where price is not null, items.
FED = "item_id long, nation_id int, day int, event_day int, cents long, units long, price long"
COMBINED_ROWS = "leaf int, item array<long>, nation array<int>, day array<int>, cents array<long>, units array<long>, price array<long>"
LEAF_STATE = "ids binary, prices binary, nations binary, revenue binary, boards binary"
LEAF_ROWS = "nation int, day int, leaf int, items array<long>, cents array<long>, out_items array<long>, out_cents array<long>"
CHANGES = "nation_id int, arrival_day long, item_id long, batch int, change string, old_rank int, new_rank int, revenue long"
#: What a step of the trees writes: changes, and a row per nation with its tree for the next step.
STEPPED = f"{CHANGES}, tree_items binary, tree_cents binary"


def packed(values: np.ndarray) -> bytes:
    """Compressed bytes of a long array, the eight bytes of its values apart."""
    return zlib.compress(np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(bytes(data)), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view("<i8").reshape(-1).copy()


def batch_of(day: Column) -> Column:
    """The batch of an arrival day, 1 to BATCHES; earlier days are in the first."""
    return F.greatest(F.lit(1), F.least(F.lit(BATCHES), F.lit(1) + F.floor((day - FIRST_DAY) * BATCHES / DAYS))).cast("int")


@dataclass
class Leaf:
    """Revenue of each nation and item of a bucket, and the board of each nation as it was handed on last."""

    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    prices: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    nations: list[int] = field(default_factory=list)
    revenue: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    boards: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    @classmethod
    def of(cls, state: GroupState) -> Leaf:
        if not state.exists:
            return cls()
        ids, prices, nations, revenue, flat = map(unpacked, state.get)
        boards: dict[int, list] = {}
        for nation, at, cents in flat.reshape(-1, 3).tolist():
            boards.setdefault(nation, []).append((at, cents))
        return cls(ids, prices, nations.tolist(), revenue.reshape(len(nations), len(ids)), boards)

    def saved(self) -> tuple:
        flat = [(nation, *x) for nation, board in self.boards.items() for x in board]
        return tuple(map(packed, (self.ids, self.prices, np.array(self.nations, np.int64), self.revenue.ravel(), np.array(flat, np.int64).ravel())))

    def add_items(self, ids: np.ndarray, prices: np.ndarray) -> None:
        """Takes items in; of several prices of one the largest counts."""
        every, place = np.unique(np.concatenate([self.ids, ids]), return_inverse=True)
        most = np.zeros(len(every), np.int64)
        np.maximum.at(most, place, np.concatenate([self.prices, prices]))
        wider = np.zeros((len(self.nations), len(every)), np.int64)
        wider[:, place[: len(self.ids)]] = self.revenue
        moved = place[: len(self.ids)]
        self.boards = {n: [(int(moved[at]), c) for at, c in b] for n, b in self.boards.items()}
        self.ids, self.prices, self.revenue = every, most, wider

    def row(self, nation: int) -> np.ndarray:
        if nation not in self.nations:
            self.nations.append(nation)
            self.revenue = np.vstack([self.revenue, np.zeros((1, len(self.ids)), np.int64)])
        return self.revenue[self.nations.index(nation)]

    def best(self, revenue: np.ndarray, places: np.ndarray) -> list[tuple[int, int]]:
        """(place, revenue) of the BOARD highest positive ones among ``places``, ties to the smaller item."""
        places = places[revenue[places] > 0]
        if len(places) > 4 * BOARD:
            least = np.partition(revenue[places], -BOARD)[-BOARD]
            places = places[revenue[places] >= least]
        order = np.lexsort((places, -revenue[places]))[:BOARD]
        return [(int(p), int(revenue[p])) for p in places[order]]

    def updated(self, nation: int, places: np.ndarray, added: np.ndarray) -> tuple[list, list] | None:
        """The board after a day's updates and what left it, or None if it is as before.

        What is neither on the board nor updated ranks below the board's last; so unless the last place got worse, the
        old board and the updated items hold the new one.
        """
        revenue = self.row(nation)
        np.add.at(revenue, places, added)
        old = self.boards.get(nation, [])
        known = np.unique(np.concatenate([np.array([p for p, _ in old], np.int64), places]))
        new = self.best(revenue, known)
        if len(old) == BOARD and (len(new) < BOARD or (-new[-1][1], new[-1][0]) > (-old[-1][1], old[-1][0])):
            new = self.best(revenue, np.flatnonzero(revenue > 0))
        if new == old:
            return None
        self.boards[nation] = new
        there = {p for p, _ in new}
        return new, [(p, int(revenue[p])) for p, _ in old if p not in there]


def combined(fed: DataFrame, leaves: int) -> DataFrame:
    """Lines added up by (leaf, nation, item, day) in the tasks that read them, a row of arrays per leaf."""

    def summed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = ["leaf", "item_id", "nation_id", "day", "price"]
        columns = {c: table.column(c).fill_null(-1).to_numpy() for c in names} | {c: table.column(c).fill_null(0).to_numpy() for c in ("cents", "units")}
        order = np.lexsort([columns[c] for c in reversed(names)])
        columns = {c: x[order] for c, x in columns.items()}
        new = np.zeros(len(order), bool)
        for c in names:
            new[1:] |= np.diff(columns[c]) != 0
        new[:1] = True
        first = np.flatnonzero(new)
        sums = {c: np.add.reduceat(columns[c], first) for c in ("cents", "units")}
        keys = {c: columns[c][first] for c in names}
        edges = np.append(np.flatnonzero(np.diff(keys["leaf"], prepend=-1)), len(first))
        kinds = (("item", "item_id", pa.int64()), ("nation", "nation_id", pa.int32()), ("day", "day", pa.int32()), ("cents", "cents", pa.int64()), ("units", "units", pa.int64()), ("price", "price", pa.int64()))
        offsets = pa.array(edges, pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array((keys | sums)[c], kind)) for _, c, kind in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(keys["leaf"][edges[:-1]], pa.int32()), *lists], names=["leaf", *(n for n, _, _ in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        many = 0
        for b in batches:
            held.append(b)
            many += b.num_rows
            if many >= COMBINED:
                yield from summed(pa.Table.from_batches(held))
                held, many = [], 0
        if many:
            yield from summed(pa.Table.from_batches(held))

    return in_batches(fed.withColumn("leaf", F.pmod(F.xxhash64("item_id"), F.lit(leaves)).cast("int")), run, COMBINED_ROWS, 16_384)


def leaf_step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Updates a leaf with a batch; a row for each nation and day after which its board in the leaf has changed."""
    leaf = Leaf.of(state)
    rows = pd.concat(list(frames))
    item, nation, day, cents, units, price = (np.concatenate([*rows[c], []]).astype(np.int64) for c in ("item", "nation", "day", "cents", "units", "price"))
    if (offered := price >= 0).any():
        leaf.add_items(item[offered], price[offered])
    place = np.searchsorted(leaf.ids, item)
    known = ~offered & (place < len(leaf.ids))
    known[known] = leaf.ids[place[known]] == item[known]
    nation, day, place = nation[known], day[known], place[known]
    added = cents[known] + units[known] * leaf.prices[place]
    order = np.lexsort((nation, day))
    nation, day, place, added = nation[order], day[order], place[order], added[order]
    edges = [0, *(np.flatnonzero((np.diff(day) != 0) | (np.diff(nation) != 0)) + 1), len(day)] if len(day) else [0]
    out = []
    for s, e in zip(edges, edges[1:], strict=False):
        if got := leaf.updated(int(nation[s]), place[s:e], added[s:e]):
            board, left = got
            out.append((int(nation[s]), int(day[s]), int(key[0]), *([f(x) for x in xs] for xs in (board, left) for f in (lambda x: int(leaf.ids[x[0]]), lambda x: x[1]))))
    state.update(leaf.saved())
    if out:
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LEAF_ROWS.split(", ")])


def level_sizes(leaves: int) -> list[int]:
    """Nodes of each level, leaves first, the root last."""
    sizes = [leaves]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FAN))
    return sizes


def merged(items: np.ndarray, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The board of a node from its children's; empty places have revenue 0."""
    items, cents = items.ravel(), cents.ravel()
    order = np.lexsort((items, -cents))[:BOARD]
    return items[order], cents[order]


def tree_step(leaves: int):
    sizes = level_sizes(leaves)
    base = np.concatenate([[0], np.cumsum(sizes)])
    columns = [c.split()[0] for c in STEPPED.split(", ")]

    def run(key: tuple, rows: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        """Recomputes the paths above changed leaves day by day; a row for each item whose rank at the root changes, and the tree."""
        shape = (int(base[-1]), BOARD)
        items, cents = (unpacked(tree[c].iloc[0]).reshape(shape) for c in ("tree_items", "tree_cents")) if len(tree) else (np.zeros(shape, np.int64), np.zeros(shape, np.int64))
        out = []
        for day, changed in rows.groupby("day", sort=True):
            old = [(int(i), int(c)) for i, c in zip(items[-1], cents[-1], strict=True) if c > 0]
            now = dict(old)
            for r in changed.itertuples():
                now.update(zip(r.items, r.cents, strict=True))
                now.update(zip(r.out_items, r.out_cents, strict=True))
                items[r.leaf], cents[r.leaf] = 0, 0
                items[r.leaf, : len(r.items)], cents[r.leaf, : len(r.items)] = r.items, r.cents
            nodes = np.unique(changed["leaf"].to_numpy())
            for level in range(1, len(sizes)):
                nodes = np.unique(nodes // FAN)
                for n in nodes:
                    below = slice(int(base[level - 1] + n * FAN), int(min(base[level - 1] + (n + 1) * FAN, base[level])))
                    items[base[level] + n], cents[base[level] + n] = merged(items[below], cents[below])
            ranks = {int(i): k + 1 for k, (i, c) in enumerate(zip(items[-1], cents[-1], strict=True)) if c > 0}
            before = {i: k + 1 for k, (i, _) in enumerate(old)}
            for i in sorted(ranks.keys() | before.keys()):
                a, b = before.get(i), ranks.get(i)
                if a != b:
                    out.append((int(key[0]), int(day), i, None, "enter" if a is None else "exit" if b is None else "move", a, b, int(now.get(i, cents[-1][b - 1] if b else 0)), None, None))
        out.append((int(key[0]), *[None] * 7, packed(items.ravel()), packed(cents.ravel())))
        return pd.DataFrame(out, columns=columns).astype({c: "Int64" for c in ("arrival_day", "item_id", "batch", "old_rank", "new_rank", "revenue")})

    return run


def board_changes(lines: DataFrame, items: DataFrame, folder: str) -> DataFrame:
    """The changes (CHANGES) of each nation's board of the BOARD highest positive revenues, ties to the smaller item.

    ``lines`` has batch and the columns of FED but price: item, nation, arrival day, the day of the event, cents, and
    units that are worth the item's price each. ``items`` has item_id and price in cents. The batches are written under
    ``folder``, and for each a streaming query is started on one checkpoint, after its files have been moved into the
    folder that the query reads; the items come with the first. Leaves are the query's state; trees, which are small,
    are written by its micro-batches and read by the next. Lines whose event is more than LATE_DAYS before the
    latest of all earlier batches are dropped; so are lines without nation or item. Arrival days of later batches must
    not come before those of earlier ones.

    What grows with the input stays in the leaves, whose number grows with the items; a tree gets a board per changed
    leaf and day at most. Lines are added up by leaf before they are shuffled, so a hot item or nation is no hot task.
    """
    spark = lines.sparkSession
    lines.withColumn("price", F.lit(None).cast("long")).write.partitionBy("batch").option("compression", "zstd").parquet(f"{folder}/batches")
    dictionary = items.select("item_id", *(F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in FED.split(", ")[1:-1])), F.greatest(F.coalesce("price", F.lit(0)), F.lit(0)).cast("long").alias("price"))
    dictionary.write.option("compression", "zstd").parquet(f"{folder}/items")
    many = spark.read.parquet(f"{folder}/items").count()
    leaves = min(MOST_LEAVES, max(LEAST_LEAVES, 1 << max(0, (many - 1) // LEAF_ITEMS).bit_length()))
    # a row per batch, BATCHES at most
    latest = {r["batch"]: r["latest"] for r in written(spark, folder).groupBy("batch").agg(F.max("event_day").alias("latest")).collect()}
    bound, bounds = None, {}
    for k in sorted(latest):
        bounds[k] = bound
        bound = max(x for x in (bound, latest[k]) if x is not None) if (bound, latest[k]) != (None, None) else None
        move(spark, f"{folder}/batches/batch={k}", f"{folder}/fed/batch-{k}")
        if len(bounds) == 1:
            move(spark, f"{folder}/items", f"{folder}/fed/items")
        start(spark, folder, leaves, bounds)
    if not latest:
        return spark.createDataFrame([], CHANGES)
    return spark.read.schema(STEPPED).parquet(f"{folder}/trees").where("tree_items IS NULL").select(*(c.split()[0] for c in CHANGES.split(", ")))


def written(spark: SparkSession, folder: str) -> DataFrame:
    """The batches as written, none if there are no lines."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batches")
    there = [f.getPath().getName() for f in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    if not any(n.startswith("batch=") for n in there):
        return spark.createDataFrame([], f"{FED}, batch int")
    return spark.read.schema(f"{FED}, batch int").parquet(f"{folder}/batches")


def move(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder of the shared file system, so that a stream sees its files all at once."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(source).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(target).getParent())
    if not files.rename(path(source), path(target)):
        raise OSError(f"{source} cannot be moved to {target}")


def start(spark: SparkSession, folder: str, leaves: int, bounds: dict[int, int | None]) -> None:
    """One start of the query: it takes what has been moved into fed since the last, then ends."""
    fed = spark.readStream.schema(FED).option("recursiveFileLookup", "true").parquet(f"{folder}/fed")
    least = F.coalesce(*(F.when(batch_of(F.col("day")) == k, F.lit(v - LATE_DAYS)) for k, v in bounds.items() if v is not None), F.lit(None).cast("int"))
    fed = fed.where(F.coalesce(F.col("event_day") >= least, F.lit(True))).where("item_id IS NOT NULL AND (price IS NOT NULL OR nation_id IS NOT NULL)")
    boards = combined(fed, leaves).groupBy("leaf").applyInPandasWithState(leaf_step, LEAF_ROWS, LEAF_STATE, "append", GroupStateTimeout.NoTimeout)

    def step(changed: DataFrame, number: int) -> None:
        """The trees after a micro-batch, from those after the one before; a step that is run again writes the same."""
        before = changed.sparkSession.read.schema(STEPPED).parquet(f"{folder}/trees/step={number - 1}").where("tree_items IS NOT NULL") if number else changed.sparkSession.createDataFrame([], STEPPED)
        trees = before.select(F.col("nation_id").alias("nation"), "tree_items", "tree_cents").groupBy("nation")
        stepped = changed.groupBy("nation").cogroup(trees).applyInPandas(tree_step(leaves), STEPPED)
        stepped.withColumn("batch", batch_of(F.col("arrival_day"))).write.mode("overwrite").parquet(f"{folder}/trees/step={number}")

    boards.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def arriving_lines(sale_lines: DataFrame, vendors: DataFrame) -> DataFrame:
    """The lines as board_changes takes them, by the contract's calendar.

    A crc32 of the line's keys stands in for a missing day and for the delay until it arrives. Vendors are joined by a
    shuffle, as they grow with the input; rows that repeat a vendor are one (the least nation).
    """
    text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")))
    rows = sale_lines.withColumn("h", F.crc32(text))
    rows = rows.withColumn("event_day", F.coalesce(F.unix_date(F.col("shipped_at").cast("date")), F.lit(FIRST_DAY) + F.col("h") % 150).cast("int"))
    rows = rows.withColumn("day", (F.col("event_day") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)).cast("int"))
    sign = F.when(F.col("flag") == "returned", -1).otherwise(1)
    cents = F.coalesce(F.floor(F.lit(100.0) * F.col("amount") + 0.5), F.lit(0)).cast("long") * sign
    units = F.when(F.col("amount").isNull(), F.coalesce(F.col("quantity"), F.lit(0)) * sign).otherwise(0).cast("long")
    lines = rows.select(F.col("item_id").cast("long").alias("item_id"), "day", "event_day", cents.alias("cents"), units.alias("units"), F.col("vendor_id").cast("long").alias("vendor"))
    # written, so that the join has plain shuffles on both sides and Spark can split a hot vendor
    nations = vendors.where("vendor_id IS NOT NULL").groupBy(F.col("vendor_id").cast("long").alias("vendor")).agg(F.min(F.col("nation_id").cast("int")).alias("nation_id"))
    nations = cut(nations, "vendor-nations")
    joined = lines.join(nations.hint("merge"), "vendor", "left")
    return joined.select("item_id", "nation_id", "day", "event_day", "cents", "units", batch_of(F.col("day")).alias("batch"))


def leaderboard_changes(sale_lines: DataFrame, vendors: DataFrame, items: DataFrame) -> DataFrame:
    """The change feed of the shop's lines: nation_id, arrival_day, item_id, batch, change, old_rank, new_rank, revenue.

    Nulls: see arriving_lines; a missing amount is quantity times the item's price, missing ones 0; lines without nation
    or item row are ignored, but count for what is late. Items that repeat an id are one (the highest price). Repeated
    lines add up. Empty lines give no rows. Other columns are not read.
    """
    prices = items.where("item_id IS NOT NULL").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.max(F.floor(F.lit(100.0) * F.col("price") + 0.5).cast("long")).alias("price"))
    return board_changes(arriving_lines(sale_lines, vendors), prices, scratch_path(sale_lines.sparkSession, "leaderboard"))


#: The crc32 is folded over the digits' codes; boards are ranked from the intervals in which an item's revenue holds.
SQL = """
WITH t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
  lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
k AS (SELECT *, concat(coalesce(sale_id::VARCHAR, ''), ',', coalesce(item_id::VARCHAR, ''), ',', coalesce(vendor_id::VARCHAR, ''), ',', coalesce(line_no::VARCHAR, '')) AS key FROM sale_lines),
h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, x: xor(c >> 8, list_extract(crc, (xor(c, x) & 255) + 1))), 4294967295) AS h FROM k, t),
s AS (SELECT *, coalesce(date_diff('day', DATE '1970-01-01', shipped_at::DATE), 19723 + h % 150)::BIGINT AS s FROM h),
a AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM s),
b AS (SELECT *, greatest(1, least(12, 1 + floor((a - 19723) * 12 / 180)))::INT AS batch FROM a),
m AS (SELECT batch, max(max(s)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bound FROM b GROUP BY batch),
v AS (SELECT vendor_id, min(nation_id) AS nation_id FROM vendors GROUP BY ALL),
i AS (SELECT item_id, max(floor(100 * price + 0.5)) AS cents FROM items GROUP BY ALL),
d AS (SELECT v.nation_id, b.item_id, b.a, b.batch, sum(coalesce(floor(100 * amount + 0.5), quantity * i.cents, 0)::BIGINT * CASE WHEN flag = 'returned' THEN -1 ELSE 1 END)::BIGINT AS cents
  FROM b JOIN m USING (batch) JOIN v ON v.vendor_id = b.vendor_id AND v.nation_id IS NOT NULL JOIN i ON i.item_id = b.item_id WHERE b.s + 8 >= coalesce(bound, b.s) GROUP BY ALL),
c AS (SELECT nation_id, item_id, a, sum(cents) OVER w AS revenue, lead(a) OVER w AS upto FROM d WINDOW w AS (PARTITION BY nation_id, item_id ORDER BY a)),
y AS (SELECT nation_id, a, batch, row_number() OVER (PARTITION BY nation_id ORDER BY a) AS turn FROM (SELECT DISTINCT nation_id, a, batch FROM d)),
e AS (SELECT y.nation_id, y.a, y.batch, y.turn, c.item_id, c.revenue, row_number() OVER (PARTITION BY y.nation_id, y.a ORDER BY c.revenue DESC, c.item_id) AS rank
  FROM y JOIN c ON c.nation_id = y.nation_id AND c.a <= y.a AND (c.upto IS NULL OR c.upto > y.a) WHERE c.revenue > 0),
o AS (SELECT * FROM e WHERE rank <= 10),
f AS (SELECT coalesce(n.nation_id, p.nation_id) AS nation_id, coalesce(n.turn, p.turn + 1) AS turn, coalesce(n.item_id, p.item_id) AS item_id, p.rank AS old_rank, n.rank AS new_rank
  FROM o n FULL JOIN o p ON n.nation_id = p.nation_id AND n.item_id = p.item_id AND n.turn = p.turn + 1 WHERE n.rank IS DISTINCT FROM p.rank)
SELECT f.nation_id::INT AS nation_id, y.a::BIGINT AS arrival_day, f.item_id, y.batch, CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change,
  old_rank::INT AS old_rank, new_rank::INT AS new_rank, c.revenue::BIGINT AS revenue FROM f JOIN y ON y.nation_id = f.nation_id AND y.turn = f.turn
  JOIN c ON c.nation_id = f.nation_id AND c.item_id = f.item_id AND c.a <= y.a AND (c.upto IS NULL OR c.upto > y.a)"""
