"""Nearest neighbours by largest inner product, from small-world graphs per shard.

Vectors are dealt to bands of like length (powers of 8 of their largest
component), so that one long vector does not take the precision of the others,
and within a band to shards by a hash. Each shard has a hierarchical navigable
small-world graph, stored as one row of flat arrays: per level a table of
``M`` neighbours a node. Equal vectors are one node that lists their ids, so
copies cannot crowd out a node's neighbours. Inner product becomes distance by
one more coordinate, which brings all vectors of a shard to the same norm. A
search walks the graphs of all shards with a block of queries at once; found
ids are scored on the original vectors in double precision, and shard results
are merged. A shard of many holds few of the nearest, so the candidates that a
search keeps are shared out over the shards of a band.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from copse.session import ship, written

#: Vectors of a shard, neighbours of a node (twice as many at the bottom), queries of a block.
SHARD_ROWS = 8192
M = 16
#: Candidates kept in a search: of a band in one shard, at least in one of many, and beyond the ``k`` that are asked for.
EF, EF_LEAST, EF_SPARE = 160, 96, 16
QUERY_BLOCK = 2048


def usable(rows: DataFrame, vector: str, key: str) -> DataFrame:
    """(key, v, dim, band): vectors without null or non-finite components, and not zero."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0.0)
    largest = F.array_max(F.transform(v, F.abs))
    return rows.where(F.col(key).isNotNull() & v.isNotNull() & good).select(
        F.col(key).cast("long").alias(key), v.alias("v"), F.size(v).alias("dim"),
        F.floor(F.log2(largest) / 3).cast("int").alias("band"))


class Graph:
    """The graph of one shard. Levels are prefixes: node ``k`` is on every level with ``sizes[level] > k``."""

    def __init__(self, points: np.ndarray, sizes: list[int], neighbours: list[np.ndarray]):
        self.points, self.sizes, self.neighbours = points, sizes, neighbours

    @classmethod
    def build(cls, points: np.ndarray, m: int = M) -> Graph:
        """``points`` in an order that does not depend on their values: a prefix is a random sample.

        The candidates of a node are its nearest on the level, found in blocks
        of products; of them it keeps those nearer to itself than to one kept
        before, then fills up, and links run both ways as far as there is room.
        """
        sizes = [len(points)]
        while sizes[-1] > m:
            sizes.append(max(1, sizes[-1] // m))
        return cls(points, sizes, [_level(points[:n], 2 * m if k == 0 else m) for k, n in enumerate(sizes)])

    def search(self, queries: np.ndarray, ef: int) -> np.ndarray:
        """Per query ``ef`` nodes or all, nearest first; -1 fills up."""
        n_queries = len(queries)
        best = np.zeros(n_queries, np.int64)
        for level in range(len(self.sizes) - 1, 0, -1):
            table = self.neighbours[level]
            near = np.einsum("qd,qd->q", queries, self.points[best])
            moving = np.arange(n_queries)
            while len(moving):
                around = table[best[moving]]
                score = np.einsum("qkd,qd->qk", self.points[np.maximum(around, 0)], queries[moving])
                score[around < 0] = -np.inf
                at = score.argmax(axis=1) if around.shape[1] else np.zeros(len(moving), int)
                top = score[np.arange(len(moving)), at] if around.shape[1] else np.full(len(moving), -np.inf)
                better = top > near[moving]
                moved = moving[better]
                best[moved] = around[better, at[better]]
                near[moved] = top[better]
                moving = moved
        return self._bottom(queries, best, ef)

    def _bottom(self, queries: np.ndarray, entry: np.ndarray, ef: int) -> np.ndarray:
        table, n = self.neighbours[0], len(queries)
        ef = min(ef, self.sizes[0])
        node = np.full((n, ef), -1, np.int64)
        score = np.full((n, ef), -np.inf)
        done = np.ones((n, ef), bool)                    # nothing left to open there
        seen = np.zeros((n, self.sizes[0]), bool)
        node[:, 0], done[:, 0] = entry, False
        score[:, 0] = np.einsum("qd,qd->q", queries, self.points[entry])
        seen[np.arange(n), entry] = True
        active = np.arange(n)
        while len(active):
            waiting = np.where(done[active], -np.inf, score[active])
            at = waiting.argmax(axis=1)
            going = waiting[np.arange(len(active)), at] > -np.inf
            active, at = active[going], at[going]
            if not len(active):
                break
            done[active, at] = True
            around = table[node[active, at]]
            fresh = (around >= 0) & ~seen[active[:, None], np.maximum(around, 0)]
            seen[np.broadcast_to(active[:, None], around.shape)[fresh], around[fresh]] = True
            found = np.einsum("qkd,qd->qk", self.points[np.maximum(around, 0)], queries[active])
            found[~fresh] = -np.inf
            scores = np.concatenate([score[active], found], axis=1)
            nodes = np.concatenate([node[active], np.where(fresh, around, -1)], axis=1)
            dones = np.concatenate([done[active], ~fresh], axis=1)
            keep = np.argpartition(-scores, ef - 1, axis=1)[:, :ef]
            rows = np.arange(len(active))[:, None]
            score[active], node[active], done[active] = scores[rows, keep], nodes[rows, keep], dones[rows, keep]
        order = np.argsort(-score, axis=1, kind="stable")
        return node[np.arange(n)[:, None], order]


def _level(points: np.ndarray, m: int) -> np.ndarray:
    """Neighbour table of one level; -1 fills up."""
    n = len(points)
    table = np.full((n, m), -1, np.int32)
    if n < 2:
        return table
    wide = min(n - 1, 2 * m)
    half = min(max(1, m // 2), wide)
    for start in range(0, n, 512):
        own = points[start:start + 512]
        score = own @ points.T
        score[np.arange(len(own)), start + np.arange(len(own))] = -np.inf
        near = np.argpartition(-score, wide - 1, axis=1)[:, :wide]
        value = np.take_along_axis(score, near, 1)
        order = np.argsort(-value, axis=1)
        near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
        # All points have one norm, so a larger product is a smaller distance.
        kept = np.zeros((len(own), wide), bool)
        kept[:, 0] = True
        between = np.einsum("nad,nbd->nab", points[near], points[near])
        for c in range(1, wide):
            covered = (between[:, c, :c] > value[:, c, None]) & kept[:, :c]
            kept[:, c] = ~covered.any(axis=1) & (kept[:, :c].sum(axis=1) < half)
        rank = np.argsort(~kept, axis=1, kind="stable")[:, :half]      # spread first, then the nearest
        table[start:start + len(own), :half] = np.take_along_axis(near, rank, 1)
    # The other half: links back, the nearest first; rooms left over stay empty.
    source = np.repeat(np.arange(n), half)
    target = table[:, :half].ravel()
    ok = target >= 0
    source, target = source[ok], target[ok].astype(np.int64)
    forward = source * n + target
    back = ~np.isin(target * n + source, forward)
    source, target = source[back], target[back]
    value = np.einsum("ed,ed->e", points[source], points[target])
    order = np.lexsort((-value, target))
    source, target = source[order], target[order]
    place = np.arange(len(target)) - np.searchsorted(target, target)
    room = place < m - half
    table[target[room], half + place[room]] = source[room]
    # A chain through all nodes keeps the level in one piece; a link stands in a row once.
    if m > half:
        after = np.arange(1, n)
        linked = (table[:-1, :m - 1] == after[:, None]).any(axis=1)
        table[:-1, m - 1] = np.where(linked, -1, after)
    return table


_INDEX = ("dim int, band int, shard int, n int, ids binary, firsts binary, vectors binary, sizes array<int>, "
          "neighbours array<binary>")


def index(rows: DataFrame, key: str = "vec_id", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard of ``usable`` rows, of about ``shard_rows`` vectors: the graph in flat arrays.

    ``ids`` are sorted within a node, ``firsts`` say where a node's begin.
    """
    sizes = rows.groupBy("dim", "band").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("n_shards"))
    # One row per dimension and band; a table has few dimensions, and doubles have some 700 bands.
    sharded = rows.join(F.broadcast(sizes), ["dim", "band"]).withColumn("shard", F.pmod(F.xxhash64(key), F.col("n_shards")).cast("int"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key)
        vectors, ids = np.stack(group["v"].to_numpy()).astype(float), group[key].to_numpy(np.int64)
        unique, at = np.unique(vectors, axis=0, return_inverse=True)
        shuffle = np.random.default_rng(12345).permutation(len(unique))
        place = np.empty(len(unique), np.int64)
        place[shuffle] = np.arange(len(unique))
        unique, at = unique[shuffle], place[at.ravel()]
        both = np.unique(np.column_stack([at, ids]), axis=0)          # a row that repeats id and vector is one
        at, ids = both[:, 0], both[:, 1]
        order = np.lexsort((ids, at))
        firsts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(unique)))])
        points = _lifted(unique)
        graph = Graph.build(points)
        return pd.DataFrame([{
            **{c: int(group[c].iloc[0]) for c in ("dim", "band", "shard")}, "n": len(unique),
            "ids": ids[order].tobytes(), "firsts": firsts.tobytes(), "vectors": unique.tobytes(),
            "sizes": graph.sizes, "neighbours": [t.tobytes() for t in graph.neighbours]}])
    return sharded.groupBy("dim", "band", "shard").applyInPandas(build, _INDEX)


def _lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with a coordinate that brings all to one norm, which is taken as 1, as single floats."""
    vectors = vectors / np.abs(vectors).max()
    norms = np.einsum("nd,nd->n", vectors, vectors)
    high = norms.max()
    return (np.column_stack([vectors, np.sqrt(np.maximum(0.0, high - norms))]) * high ** -0.5).astype(np.float32)


def _opened(row) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    vectors = np.frombuffer(row["vectors"], float).reshape(row["n"], -1)
    points = _lifted(vectors)
    sizes = [int(s) for s in row["sizes"]]
    tables = [np.frombuffer(t, np.int32).reshape(s, -1) for t, s in zip(row["neighbours"], sizes)]
    return Graph(points, sizes, tables), vectors, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["firsts"], np.int64)


def kept_candidates(k: int, n_shards: int, ef: int = EF) -> int:
    """Candidates that the search of one of ``n_shards`` random shards keeps."""
    return max(k + EF_SPARE, min(ef, EF_LEAST), -(-2 * ef // (n_shards + 1)))


def search(built: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", ef: int = EF,
           block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, key, score): the ``k`` nearest found of each query but itself, ties to the smaller id.

    ``queries`` are usable rows. Blocks of queries meet every shard's graph;
    a shard returns ``k`` ids of each query at most.
    """
    ship(built.sparkSession)
    shards = built.groupBy("dim", "band").agg(F.max("shard").alias("last"))
    blocks = queries.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("n_blocks"))
    per_band = shards.join(blocks, "dim")                # one row per dimension and band
    left = built.join(F.broadcast(per_band), ["dim", "band"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    right = queries.drop("band").join(F.broadcast(per_band), "dim").select(
        "dim", (F.col("band") + 0).alias("band"), (F.col("last") + 1).alias("n_shards"), F.col(key).alias("query_id"), "v",
        F.pmod(F.xxhash64(F.lit(3), key), F.col("n_blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("last"))).alias("shard"))

    def look(graphs: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(graphs) or not len(asked):
            return pd.DataFrame({"query_id": [], key: [], "score": []})
        graph, vectors, ids, firsts = _opened(graphs.iloc[0])
        wanted = np.stack(asked["v"].to_numpy()).astype(float)
        names = asked["query_id"].to_numpy(np.int64)
        wide = kept_candidates(k, int(asked["n_shards"].iloc[0]), ef)
        lifted = np.column_stack([wanted / np.abs(wanted).max(axis=1, keepdims=True), np.zeros(len(wanted))])
        norms = np.sqrt(np.einsum("nd,nd->n", lifted, lifted))
        out = []
        for start in range(0, len(wanted), 256):
            part = slice(start, start + 256)
            nodes = graph.search((lifted[part] / norms[part, None]).astype(np.float32), wide)
            for name, query, row in zip(names[part], wanted[part], nodes):
                row = row[row >= 0]
                # Summed the same way for every vector: equal vectors have equal scores.
                score = (vectors[row] * query).sum(axis=1)
                found = np.concatenate([ids[firsts[x]:firsts[x + 1]][:k + 1] for x in row.tolist()])
                value = np.repeat(score, np.minimum(firsts[row + 1] - firsts[row], k + 1))
                other = found != name
                found, value = found[other], value[other]
                best = np.lexsort((found, -value))
                best = best[np.sort(np.unique(found[best], return_index=True)[1])][:k]    # an id once, at its best
                out.append((np.full(len(best), name), found[best], value[best]))
        return pd.DataFrame({"query_id": np.concatenate([o[0] for o in out]), key: np.concatenate([o[1] for o in out]),
                             "score": np.concatenate([o[2] for o in out])})
    by = ["dim", "band", "shard", "block"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(look, f"query_id long, `{key}` long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def nearest(rows: DataFrame, queries: DataFrame, k: int = 20, vector: str = "embedding", key: str = "vec_id", **how) -> DataFrame:
    """Index ``rows``, write the index, and search it for ``queries`` (rows of the same columns).

    Vectors that are null, zero, or hold null or non-finite components take no
    part, as do rows without a key; vectors meet those of their own dimension.
    Copies are found like any other row, the smaller ids first; an id that
    stands in several rows is one candidate, at its best score, and asks with
    the least of its vectors. Empty tables
    give an empty result; other columns play no part.
    """
    ship(rows.sparkSession)
    built = written(index(usable(rows, vector, key), key), "graphs")
    asked = usable(queries, vector, key).groupBy(key).agg(F.min(F.struct("dim", "v", "band")).alias("_q")).select(key, "_q.*")
    return search(built, asked, k, key, **how)
