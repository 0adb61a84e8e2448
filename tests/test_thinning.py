import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.functions import coordinates as C
from copse.operators import thinning as THN
from tests import trees_by_hand as hand

f32 = np.float32


def placed_tree(seed, n_tips, flat=False):
    rnd = random.Random(seed)
    tree = hand.random_tree(seed, n_tips)
    x, top = hand.layout(tree), max(t for _, t in tree.values()) or 1.0
    kids = hand.children(tree)
    return {n: dict(parent=up, x=f32(1.0 if flat and n not in kids else x[n]),
                    y=f32(1 - t / top + 0 * rnd.random()), kids=len(kids.get(n, [])))
            for n, (up, t) in tree.items()}


def resolution(n):
    per_cell = max(10.0, min(1000.0, 10 * math.sqrt(n / 100)))
    size = 1.0 / max(5, min(1000, int(math.sqrt(max(1, n / per_cell)))))
    return size


def thin_by_hand(tree, cell=None, multiplier=1.0, box=None, keep_inside=False):
    """Winners, forced nodes, closure, collapse: one tree, nodes in id order."""
    base = cell or resolution(len(tree))
    size = min(0.002, max(0.0004, base * (1 if box else multiplier)))
    outside = int(1 / size)
    inside = int(1 / max(0.0004, min(0.002, size * max(min(multiplier, 0.95), 0.0004 / size))))
    tips = [v["x"] for v in tree.values() if not v["kids"]]
    flat = bool(tips) and all(x > 0.999999 for x in tips)
    seen, keep = set(), {n for n, v in tree.items() if v["parent"] is None}
    for n in sorted(tree):
        v = tree[n]
        if v["parent"] is None:
            continue
        p = tree[v["parent"]]
        mx, my = float(f32(v["x"] + p["x"])) / 2, float(f32(v["y"] + p["y"])) / 2
        zone = box is not None and box[0] <= mx <= box[1] and box[2] <= my <= box[3]
        if zone and keep_inside:
            keep.add(n)
            continue
        res = inside if zone else outside
        dx, dy = p["x"] - v["x"], p["y"] - v["y"]
        way = (dx >= 0) + 2 * (dy >= 0) + 4 * (abs(dy) > abs(dx)) if flat else None
        key = (zone, min(int(mx * res), res - 1), min(int(my * res), res - 1), way)
        if key not in seen:
            seen.add(key)
            keep.add(n)
    unary = {n for n, v in tree.items() if v["kids"] == 1 and v["parent"] is not None}
    forced = unary | {n for n, v in tree.items() if v["parent"] in unary}
    for n in list(keep | forced):
        while n is not None:
            keep.add(n)
            n = tree[n]["parent"]
    count = {}
    for n in keep:
        count[tree[n]["parent"]] = count.get(tree[n]["parent"], 0) + 1
    gone = {n for n in keep if count.get(n) == 1 and tree[n]["parent"] is not None and n not in forced}
    out = {}
    for n in keep - gone:
        up = tree[n]["parent"]
        while up in gone:
            up = tree[up]["parent"]
        out[n] = up
    return out


def frame(spark, trees):
    rows = [(i, n, v["parent"], float(v["x"]), float(v["y"]), v["kids"], v["kids"] == 0)
            for i, tree in trees.items() for n, v in tree.items()]
    return spark.createDataFrame(rows, "tree_index long, node_id long, parent_id long, x float, "
                                       "y float, n_children long, is_tip boolean").cache()


@pytest.fixture(scope="module")
def trees():
    # Positions squeezed so that grids of 500 cells and more collide.
    out = {i: placed_tree(i, 20 + 25 * i) for i in range(4)}
    out[4] = placed_tree(9, 60, flat=True)
    for i in (1, 2, 3, 4):
        for v in out[i].values():
            v["y"] = f32(f32(0.99) + v["y"] * f32(0.005))
            if i != 4:
                v["x"] = f32(v["x"] * f32(0.03))
    return out


CASES = {
    "plain": dict(),
    "multiplier": dict(multiplier=0.4),
    "fixed": dict(cell=0.001),
}


@pytest.mark.parametrize("case", CASES)
def test_matches_the_sequential_rule(spark, trees, case):
    kw = CASES[case]
    got = {(r.tree_index, r.node_id): r.parent_id
           for r in THN.thin_nodes(frame(spark, trees), **kw).collect()}
    want = {(i, n): up for i, t in trees.items() for n, up in thin_by_hand(t, **kw).items()}
    assert got == want
    assert len(got) < sum(map(len, trees.values()))


@pytest.mark.parametrize("multiplier", [0.6, 0.35])
def test_focus_box(spark, trees, multiplier):
    box = THN.Box(2, 0.0, 0.02, 0.9, 1.0)
    got = {(r.tree_index, r.node_id): r.parent_id for r in THN.thin_nodes(
        frame(spark, trees), multiplier=multiplier, box=box).collect()}
    want = {}
    for i, tree in trees.items():
        kw = dict(box=(0.0, 0.02, 0.9, 1.0), multiplier=multiplier,
                  keep_inside=multiplier == 0.35) if i == 2 else {}
        want |= {(i, n): up for n, up in thin_by_hand(tree, **kw).items()}
    assert got == want


def test_tips_can_be_kept(spark, trees):
    out = THN.thin_nodes(frame(spark, trees), keep_tips=True)
    tips = sum(1 for t in trees.values() for v in t.values() if not v["kids"])
    assert out.where("is_tip").count() == tips


def test_mutation_grid(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(2), m, float(f32(rnd.random() * 0.02)), float(f32(rnd.random() * 0.02)))
            for m in range(400)]
    df = spark.createDataFrame(rows, "tree_index long, mutation_id long, x float, y float")
    box = THN.Box(1, 0.0, 0.01, 0.0, 0.02)

    def by_hand(focus, keep):
        seen, out = set(), set()
        for t, m, x, y in sorted(rows, key=lambda r: r[1]):
            zone = focus and t == 1 and x <= f32(0.01) and x <= 0.01 and y <= 0.02
            res = 2000 if zone else 500
            key = (t, zone, min(int(x * res), res - 1), min(int(y * res), res - 1))
            if (zone and keep) or key not in seen:
                out.add(m)
            if not (zone and keep):
                seen.add(key)
        return out

    ids = lambda d: {r.mutation_id for r in d.collect()}
    assert ids(THN.thin_mutations(df, 500)) == by_hand(False, False)
    assert ids(THN.thin_mutations(df, 500, 2000, box)) == by_hand(True, False)
    assert ids(THN.thin_mutations(df, 500, 2000, box, keep_inside=True)) == by_hand(True, True)


def test_cell_sizes(spark):
    df = spark.createDataFrame([(0,), (50,), (1000,), (300_000,), (10 ** 9,)], "n long")
    got = {r.n: r.s for r in df.select("n", C.cell_size_for_nodes(F.col("n")).alias("s")).collect()}
    assert got[0] == 0.002
    for n in (50, 1000, 300_000, 10 ** 9):
        assert got[n] == pytest.approx(resolution(n))
    held = df.select(C.cell_size(F.col("n"), None, float("nan")).alias("a"),
                     C.inside_cell_size(F.col("n"), F.lit(0.0004), 2.0).alias("b")).collect()
    assert all(0.0004 <= r.a <= 0.002 and r.b == 0.0004 for r in held)
