"""Plain-Python trees to compare the plans with."""

import random


def random_tree(seed: int, n_tips: int, unary: float = 0.2, chain: bool = False):
    """{node: (parent, time)} with ids in random order and a few unary nodes."""
    rnd = random.Random(seed)
    ids = rnd.sample(range(1000), 6 * n_tips + 10)
    tree, clock = {}, 0.0
    live = []
    for _ in range(n_tips):
        live.append(ids.pop())
        tree[live[-1]] = [None, 0.0]
    target = rnd.choice([1, 1, 2])
    while len(live) > target:
        clock += rnd.random() + 0.01
        k = 1 if rnd.random() < unary else min(len(live), rnd.choice([2, 2, 3]))
        picked = [live.pop() for _ in range(k)] if chain else [
            live.pop(rnd.randrange(len(live))) for _ in range(k)]
        up = ids.pop()
        tree[up] = [None, clock]
        for node in picked:
            tree[node][0] = up
        live.append(up)
    return {node: tuple(row) for node, row in tree.items()}


def children(tree):
    out = {}
    for node, (up, _) in tree.items():
        if up is not None:
            out.setdefault(up, []).append(node)
    return out


def layout(tree):
    """x by a recursive walk: roots ascending, children from the last id to the first."""
    kids, x, count = children(tree), {}, [0]

    def walk(node):
        below = sorted(kids.get(node, []), reverse=True)
        for child in below:
            walk(child)
        if below:
            x[node] = (min(x[c] for c in below) + max(x[c] for c in below)) / 2
        else:
            x[node] = float(count[0])
            count[0] += 1

    for root in sorted(n for n, (up, _) in tree.items() if up is None):
        walk(root)
    return {n: v / max(1, count[0] - 1) for n, v in x.items()}


def ancestors(tree, node):
    out = []
    while node is not None:
        out.append(node)
        node = tree[node][0]
    return out


def frame(spark, trees):
    """{tree_index: tree} -> tree nodes."""
    rows = []
    for index, tree in trees.items():
        kids = children(tree)
        for node, (up, time) in tree.items():
            n = len(kids.get(node, []))
            rows.append((index, node, up, time, int(n == 0), n, n == 0))
    return spark.createDataFrame(rows, "tree_index long, node_id long, parent_id long, time double, "
                                       "flags long, n_children long, is_tip boolean")
