"""Operator 12 against a plain recount of the whole board after every arrival day."""

import random
import zlib
from collections import defaultdict
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest

from pointweave.llm import leaderboard

LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp, day string, nation_id int, price double"
VENDORS = "vendor_id long, name string, nation_id int, day int"
ITEMS = "item_id long, name string, price double, nation_id int"


def ranked(revenue):
    return {i: k + 1 for k, (c, i) in enumerate(sorted((-c, i) for i, c in revenue.items() if c > 0)[:10])}


def brute(lines, vendors, items):
    nations, prices = defaultdict(list), defaultdict(list)
    for v, _, n, _ in vendors:
        nations[v].append(n)
    for i, _, p, _ in items:
        prices[i].append(p)
    rows = []
    for r in lines:
        sale, line, item, vendor, quantity, amount, _, flag, shipped = r[:9]
        h = zlib.crc32(",".join("" if x is None else str(x) for x in (sale, item, vendor, line)).encode())
        s = (shipped - datetime(1970, 1, 1)).days if shipped else 19723 + h % 150
        a = s + h % 7 + (20 if h % 5 == 0 else 0)
        batch = max(1, min(12, 1 + (a - 19723) * 12 // 180))
        nation = min((n for n in nations.get(vendor, []) if n is not None and vendor is not None), default=None)
        price = max((p for p in prices.get(item, []) if p is not None), default=None)
        if amount is not None:
            cents = int(np.floor(100 * amount + 0.5))
        else:
            cents = 0 if quantity is None or price is None else quantity * int(np.floor(100 * price + 0.5))
        rows.append((batch, a, s, nation, item if item in prices and item is not None else None, -cents if flag == "returned" else cents))
    bound, kept = None, []
    for k in range(1, 13):
        kept += [r for r in rows if r[0] == k and r[3] is not None and r[4] is not None and (bound is None or r[2] + 8 >= bound)]
        bound = max([r[2] for r in rows if r[0] == k] + ([] if bound is None else [bound]), default=bound)
    out = []
    for nation in {r[3] for r in kept}:
        revenue, board = defaultdict(int), {}
        for day in sorted({r[1] for r in kept if r[3] == nation}):
            for r in kept:
                if r[3] == nation and r[1] == day:
                    revenue[r[4]] += r[5]
            new = ranked(revenue)
            for i in new.keys() | board.keys():
                if new.get(i) != board.get(i):
                    change = "enter" if i not in board else "exit" if i not in new else "move"
                    out.append((nation, day, i, max(1, min(12, 1 + (day - 19723) * 12 // 180)), change, board.get(i), new.get(i), revenue[i]))
            board = new
    return sorted(out, key=repr)


def shop(seed, n, n_items=60):
    rng = random.Random(seed)
    vendors = [(v, "v", rng.choice([0, 1, 2, None]), 1) for v in range(12)] + [(3, "again", 2, 1), (None, "x", 1, 1)]
    items = [(i, "i", rng.choice([None, 3.005, 10.0, 7.25]), 1) for i in range(n_items)] + [(5, "again", 99.0, 1), (None, "x", 1.0, 1)]
    lines = []
    for k in range(n):
        item = rng.choice([0, rng.randrange(n_items + 5), rng.randrange(n_items), None if rng.random() < 0.1 else 1])
        shipped = None if rng.random() < 0.05 else datetime(2024, 1, 1) + timedelta(days=min(148, max(0, int(rng.gauss(k * 148 / n, 12)))))
        amount = rng.choice([None, 10.0, 10.0, 2.675, round(rng.random() * 50, 2)])
        lines.append((rng.choice([k, None]), rng.choice([1, 2, None]), item, rng.choice([0, rng.randrange(14), None]), rng.choice([None, 1, 5]), amount, 0.1, rng.choice(["kept", "returned", "kept", None]), shipped, "x", 9, 1.0))
    return [*lines, *lines[:30]], vendors, items


@pytest.mark.parametrize("seed", [1, 2])
def test_changes(spark, seed):
    lines, vendors, items = shop(seed, 900)
    frames = [spark.createDataFrame(*x) for x in ((lines, LINES), (vendors, VENDORS), (items, ITEMS))]
    got = sorted((tuple(r) for r in leaderboard.leaderboard_changes(frames[0].repartition(3), *frames[1:]).collect()), key=repr)
    want = brute(lines, vendors, items)
    assert got == want and {"enter", "exit", "move"} == {r[4] for r in got}


def test_empty_tables(spark):
    empty = [spark.createDataFrame([], x) for x in (LINES, VENDORS, ITEMS)]
    assert leaderboard.leaderboard_changes(*empty).collect() == []
    lines = spark.createDataFrame(shop(3, 5)[0][:2], LINES)
    assert leaderboard.leaderboard_changes(lines, *empty[1:]).collect() == []


class State:
    """What a group's state offers to the steps."""

    def __init__(self):
        self.value = None

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def test_leaves_and_trees_against_whole_boards():
    """Many days of updates, up and down, over leaves whose boards overflow: every change of the root, and revenues."""
    rng = random.Random(6)
    leaves, n_items = 20, 400
    states, step, tree = [State() for _ in range(leaves)], leaderboard.tree_step(leaves), pd.DataFrame()
    revenue, board, out = defaultdict(int), {}, []
    columns = ["item", "nation", "day", "cents", "units", "price"]
    for batch in range(12):
        rows = [(i, 0, 0, 0, 0, 2 + i % 3) for i in range(n_items)] if batch == 0 else []
        days = range(batch * 5, batch * 5 + 5)
        updates = [(rng.randrange(n_items + 20), 7, d, rng.choice([100, 5, -60, 3000 if rng.random() < 0.1 else 1, -5000 if rng.random() < 0.05 else 0]), rng.choice([0, 1, -2])) for d in days for _ in range(rng.choice([0, 3, 40]))]
        made = []
        for leaf in range(leaves):
            own = [r for r in rows if r[0] % leaves == leaf] + [(*u, -1) for u in updates if u[0] % leaves == leaf]
            if own:
                frame = pd.DataFrame({c: [np.array([r[k] for r in part]) for part in (own[: len(own) // 2], own[len(own) // 2 :])] for k, c in enumerate(columns)})
                made += list(leaderboard.leaf_step((leaf,), iter([frame[:1], frame[1:]]), states[leaf]))
        if made:
            got = step((7,), pd.concat(made), tree)
            tree = got[got["tree_items"].notna()]
            rows_ = got[got["tree_items"].isna()].drop(columns=["batch", "tree_items", "tree_cents"])
            out += [tuple(None if pd.isna(x) else x for x in r) for r in rows_.itertuples(index=False)]
        for d in days:
            for i, _, day, cents, units in updates:
                if day == d and i < n_items:
                    revenue[i] += cents + units * (2 + i % 3)
            new = ranked(revenue)
            want = {(7, d, i, "enter" if i not in board else "exit" if i not in new else "move", board.get(i), new.get(i), revenue[i]) for i in new.keys() | board.keys() if new.get(i) != board.get(i)}
            assert {r for r in out if r[1] == d} == want
            board = new
    assert len(out) > 100 and {"exit", "move"} <= {r[3] for r in out}


def test_a_days_updates_take_the_paths_of_their_leaves(monkeypatch):
    merged, seen = leaderboard.merged, []
    monkeypatch.setattr(leaderboard, "merged", lambda *x: seen.append(1) or merged(*x))
    rows = pd.DataFrame([(1, 3, 17, [4], [50], [], [])], columns=["nation", "day", "leaf", "items", "cents", "out_items", "out_cents"])
    assert leaderboard.level_sizes(512) == [512, 64, 8, 1]
    got = leaderboard.tree_step(512)((1,), rows, pd.DataFrame())
    assert len(seen) == 3 and got["item_id"].dropna().tolist() == [4]


def test_packed_arrays():
    values = np.array([0, 1, -1, 2**62, -(2**62)])
    assert leaderboard.unpacked(leaderboard.packed(values)).tolist() == values.tolist()
    assert leaderboard.unpacked(leaderboard.packed(values[:0])).tolist() == []
