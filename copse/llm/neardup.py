"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures.

A text's set of 5-word shingles gives a signature of ``POSITIONS`` b-bit
values. Two texts of Jaccard similarity ``s`` differ in a binomial number of
positions; ``distance`` is the bound that they keep but once in a million. The
signature is cut into so many chunks that two signatures within the bound
agree, but for one position at most, on some chunk (pigeonhole): every chunk
is therefore entered once with each of its positions left out, and all pairs
within the bound meet in a bucket. Buckets with the same members count once.

In a bucket signatures are compared, and what is within the bound is held
together by a forest of edges, never by all pairs. Inside the clusters this
gives, full sets are compared; the confirmed links make the components.
Texts with equal sets are one class from the start. Large buckets and
clusters are compared block against block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from copse.llm.batches import Index, Kernel, annotate, bounded, free_name, named, texts_of, tidy
from copse.llm.components import components
from copse.session import ship, written

WORDS = 5
POSITIONS = 96
SIMILARITY = (85, 100)                               # links: 100 * both >= 85 * either
MISS = 1e-6
#: Members that a block holds; buckets and clusters of more are compared by pairs of blocks.
BLOCK_ROWS = 1024
#: Bits of the filter that picks the texts whose sets are needed; a full filter lets all pass.
FILTER_BITS = 1 << 22

_P1, _P2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Plan:
    """Bound on differing positions, and the chunks of positions."""

    positions: int
    distance: int
    chunks: tuple[tuple[int, int], ...]


def plan(similarity: float, positions: int = POSITIONS, miss: float = MISS) -> Plan:
    p, d, rest = 1.0 - similarity, -1, 1.0
    while rest > miss and d < positions:
        d += 1
        rest -= comb(positions, d) * p ** d * (1 - p) ** (positions - d)
    # Two errors in every chunk would be more than d errors: some chunk has one at most.
    m = max(1, min(positions // 2, d // 2 + 1))
    cuts = [round(k * positions / m) for k in range(m + 1)]
    return Plan(positions, d, tuple(zip(cuts, cuts[1:])))


class Shingler:
    """Sorted distinct shingle hashes of texts; each word is hashed once per task."""

    def __init__(self, words: int = WORDS):
        self.words, self.index, self.hashes = words, Index(), np.zeros(0, np.uint64)

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        words: list[bytes] = []
        sizes = []
        for text in texts:
            own = text.lower().split() if text else []   # bytes: A-Z and ASCII white space only
            words += own
            sizes.append(len(own))
        codes, fresh, anew = self.index.codes(words)
        if anew:
            self.hashes = self.hashes[:0]
        if fresh:
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh64_intdigest, fresh), np.uint64, len(fresh))])
        word = self.hashes[codes]
        n, k = len(word), self.words
        rolled = np.zeros(max(n - k + 1, 0), np.uint64)
        for j in range(k if n >= k else 0):
            rolled = (rolled + word[j:n - k + 1 + j]) * _P1
        rolled = _mixed(rolled)
        out, at = [], 0
        for size in sizes:
            if size >= k:
                out.append(np.unique(rolled[at:at + size - k + 1]))
            elif size:
                short = np.full(1, size, np.uint64)
                for w in word[at:at + size]:
                    short = (short + w) * _P2
                out.append(_mixed(short))
            else:
                out.append(np.zeros(0, np.uint64))
            at += size
        return out


def _multipliers(n: int, seed: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def signatures(sets: list[np.ndarray], positions: int = POSITIONS) -> np.ndarray:
    """16 bits of the least value of each of ``positions`` hash functions over each set (rows of zeros if empty)."""
    out = np.zeros((len(sets), positions), np.uint16)
    some = [k for k, s in enumerate(sets) if len(s)]
    a, b = _multipliers(positions, 1), _multipliers(positions, 2)
    for first in range(0, len(some), 64):                # few sets at a time stay in the cache
        part = some[first:first + 64]
        flat = np.concatenate([sets[k] for k in part])
        starts = np.cumsum([0] + [len(sets[k]) for k in part[:-1]])
        for j in range(positions):
            least = np.minimum.reduceat(flat * a[j] + b[j], starts)
            out[part, j] = (least >> np.uint64(20)).astype(np.uint16)
    return out


def _measured(docs: DataFrame, text: str, key: str, words: int) -> DataFrame:
    """(key, n_shingles, set_hash, sig) of every document."""
    def kernel() -> Kernel:
        shingler = Shingler(words)

        def run(texts):
            sets = shingler.sets(texts)
            sig = signatures(sets)
            return {"n_shingles": [len(s) for s in sets],
                    "set_hash": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "sig": [row.tobytes() if len(s) else None for s, row in zip(sets, sig)]}
        return run
    return annotate(docs, text, kernel, "n_shingles long, set_hash binary, sig binary", [key])


def bucket_keys(sig: np.ndarray, chunks: Plan) -> np.ndarray:
    """One key per position of each signature: its chunk without that position."""
    terms = sig.astype(np.uint64) * _multipliers(chunks.positions, 3)
    out = np.empty_like(terms)
    for a, b in chunks.chunks:
        out[:, a:b] = terms[:, a:b].sum(axis=1, dtype=np.uint64)[:, None] - terms[:, a:b]
    return _mixed(out + _multipliers(chunks.positions, 4)).view(np.int64)


def _keyed(reps: DataFrame, chunks: Plan) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                keys = bucket_keys(sig, chunks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(batch.column("rep").to_numpy(), keys.shape[1])), pa.array(keys.ravel())],
                    names=["rep", "key"])
    return reps.select("rep", "sig").mapInArrow(tidy(run), "rep long, key long")


def _forest(n: int, pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the pairs that join two trees."""
    root, out = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x
    for x, y in pairs:
        a, b = find(x), find(y)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a table that comes sorted by ``by``; one that batches cut is put together."""
    held: list[pd.DataFrame] = []
    last = None
    for frame in batches:
        if not len(frame):
            continue
        names = frame[by].to_numpy()
        cuts = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1).tolist(), len(frame)]
        for a, b in zip(cuts, cuts[1:]):
            name = tuple(names[a])
            if held and name != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(frame.iloc[a:b])
            last = name
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _block_pairs(rows: DataFrame, group: str, member: str) -> DataFrame:
    """Rows of each group for every pair of its blocks that they take part in: columns ``_i <= _j``, ``_b``.

    ``rows`` have the size of their group in ``_n``. Groups of one block are not copied.
    """
    blocks = F.ceil(F.col("_n") / BLOCK_ROWS).cast("int")
    own = F.pmod(F.xxhash64(member), blocks).cast("int")
    rows = rows.withColumns({"_b": own, "_o": F.explode(F.sequence(F.lit(0), blocks - 1))})
    return rows.withColumns({"_i": F.least("_b", "_o"), "_j": F.greatest("_b", "_o")}).drop("_o", "_n")


def _near_pairs(sig: np.ndarray, block: np.ndarray, crossing: bool, distance: int, differ=None) -> Iterator[tuple[int, int]]:
    """Pairs of rows within the distance; only from one block to the other where ``crossing``."""
    n = len(sig)
    left = np.flatnonzero(block == block.min()) if crossing else np.arange(n)
    right = np.flatnonzero(block != block.min()) if crossing else None
    for x in left.tolist():
        others = right if crossing else np.arange(x + 1, n)
        if differ is not None:
            others = others[differ[others] != differ[x]]
        if len(others):
            far = np.count_nonzero(sig[others] != sig[x], axis=1)
            for y in others[far <= distance].tolist():
                yield x, y


def _bucket_edges(members: DataFrame, chunks: Plan) -> DataFrame:
    """Forests of the pairs within the distance, from every bucket."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a: list[int] = []
        b: list[int] = []
        for group in _groups(batches, ["key", "_i", "_j"]):
            if len(group) > 1:
                rep = group["rep"].to_numpy()
                sig = np.frombuffer(b"".join(group["sig"]), np.uint16).reshape(len(group), -1)
                crossing = group["_i"].iloc[0] != group["_j"].iloc[0]
                block = group["_b"].to_numpy()
                if crossing and len(np.unique(block)) < 2:
                    continue
                for x, y in _forest(len(rep), _near_pairs(sig, block, crossing, chunks.distance)):
                    a.append(int(rep[x]))
                    b.append(int(rep[y]))
            if len(a) > 50_000:
                yield pd.DataFrame({"a": a, "b": b})
                a, b = [], []
        if a:
            yield pd.DataFrame({"a": a, "b": b})
    spread = _block_pairs(members, "key", "rep")
    dealt = spread.repartition("key", "_i", "_j").sortWithinPartitions("key", "_i", "_j", "rep")
    return dealt.mapInPandas(tidy(run), "a long, b long").where("a <> b")


def _sets(docs: DataFrame, text: str, key: str, words: int, wanted: DataFrame) -> DataFrame:
    """(rep, shingles) of the documents in ``wanted`` (rep)."""
    slot = F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS))
    rows = wanted.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b"))
    words_ = np.zeros(FILTER_BITS // 64, np.int64)
    for r in rows.collect():                             # of fixed size, whatever the table holds
        words_[r["w"]] = r["b"]
    bits = words_.view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for whole in batches:
            slots = whole.column("slot").to_numpy()
            ok = (bits[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1) == 1
            for batch in bounded(whole.filter(pa.array(ok)), text):
                sets = shingler.sets(texts_of(batch, text))
                yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([s.tobytes() for s in sets], pa.binary())],
                                                 names=["rep", "shingles"])
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rep"), text)
    return rows.withColumn("slot", slot).mapInArrow(tidy(run), "rep long, shingles binary").join(wanted, "rep")


def confirmed(sets: list[np.ndarray], x: int, ys: np.ndarray, similarity=SIMILARITY) -> np.ndarray:
    """Which of the sets ``ys`` are linked with set ``x``."""
    own = sets[x]
    flat = np.concatenate([sets[y] for y in ys])
    sizes = np.array([len(sets[y]) for y in ys])
    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
    both = np.add.reduceat((own[at] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
    return similarity[1] * both >= similarity[0] * (len(own) + sizes - both)


def _cluster_edges(members: DataFrame, chunks: Plan, similarity, positions: int = POSITIONS) -> DataFrame:
    """Forests of confirmed links, from every cluster (rows: cluster, rep, shingles, _n, and ``part``,
    which two members share if they are known to be connected)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["cluster", "_i", "_j"]):
            block = group["_b"].to_numpy()
            crossing = group["_i"].iloc[0] != group["_j"].iloc[0]
            if len(group) < 2 or crossing and len(np.unique(block)) < 2:
                continue
            rep, part = group["rep"].to_numpy(), group["part"].to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
            sig, size = signatures(sets, positions), np.array([len(s) for s in sets])
            n = len(rep)
            _, root = np.unique(part, return_inverse=True)   # names of trees, merged below
            a, b = [], []
            left = np.flatnonzero(block == block.min()) if crossing else np.arange(n)
            right = np.flatnonzero(block != block.min()) if crossing else None
            for x in left.tolist():
                others = right if crossing else np.arange(x + 1, n)
                others = others[root[others] != root[x]]
                others = others[(similarity[1] * np.minimum(size[others], size[x]) >= similarity[0] * np.maximum(size[others], size[x]))]
                if not len(others):
                    continue
                others = others[np.count_nonzero(sig[others] != sig[x], axis=1) <= chunks.distance]
                if not len(others):
                    continue
                for y in others[confirmed(sets, x, others, similarity)].tolist():
                    if root[x] != root[y]:
                        root[root == root[y]] = root[x]
                        a.append(int(rep[x]))
                        b.append(int(rep[y]))
            if a:
                yield pd.DataFrame({"a": a, "b": b})
    spread = _block_pairs(members, "cluster", "rep")
    dealt = spread.repartition("cluster", "_i", "_j").sortWithinPartitions("cluster", "_i", "_j", "rep")
    return dealt.mapInPandas(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS,
                    similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row.

    Null and empty texts have no shingles and are linked with nothing; texts
    of fewer words have one. Rows of equal text are linked. Rows without a
    key are linked with nothing, have no component and are kept; rows of one
    key are one document. Other columns play no part.
    """
    ship(docs.sparkSession)
    chunks = plan(similarity[0] / similarity[1])
    rows = written(_measured(docs.select(F.col(key).cast("long").alias(key), text), text, key, words), "shingled")
    some = rows.where((F.col("n_shingles") > 0) & F.col(key).isNotNull())
    reps = written(some.groupBy("set_hash").agg(F.min(key).alias("rep"), F.first("sig").alias("sig")), "classes")

    # Bucket members, where a bucket has two; one shuffle of 16 bytes a key.
    of_key = Window.partitionBy("key")
    met = _keyed(reps, chunks).withColumn("_n", F.count("*").over(of_key)).where("_n > 1")
    met = written(met, "buckets")
    # Buckets of the same members are one: told by count and two sums of member hashes.
    same = met.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("low"),
                                  F.sum(F.xxhash64(F.lit(1), "rep").cast("decimal(38,0)")).alias("h1"),
                                  F.sum(F.xxhash64(F.lit(2), "rep").cast("decimal(38,0)")).alias("h2"))
    chosen = same.groupBy("n", "low", "h1", "h2").agg(F.min("key").alias("key")).select("key")
    members = met.join(chosen, "key").join(reps.select("rep", "sig"), "rep")
    clusters = written(components(_bucket_edges(members, chunks)), "clusters").withColumnRenamed("node", "rep") \
        .withColumnRenamed("component", "cluster")

    sets = written(_sets(docs, text, key, words, clusters.select("rep")), "sets")
    sized = clusters.groupBy("cluster").agg(F.count("*").alias("_n"))
    inside = sets.join(clusters, "rep").join(sized, "cluster").withColumn("part", F.col("rep"))
    links = components(_cluster_edges(inside, chunks, similarity))
    of_class = reps.join(links.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_hash", F.coalesce("component", "rep").alias("component_id"))
    out = rows.drop("sig").join(of_class, "set_hash", "left")
    out = out.withColumn("component_id", F.when(F.col(key).isNotNull(), F.coalesce("component_id", key)))
    return out.select(key, "n_shingles", "component_id", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """One row of each group of near duplicates, the one of the least key, in all columns of ``docs``.

    Rows of one key are one document: the one whose text comes first stays.
    Rows without a key stay.
    """
    kept = near_duplicates(docs, text, key, **how).where(F.col("kept") & F.col(key).isNotNull()).select(key).distinct()
    number = free_name(docs, "_number")
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.asc_nulls_last(text)))
    one = docs.where(F.col(key).isNotNull()).join(kept, key, "left_semi").withColumn(number, first).where(F.col(number) == 1)
    return one.select(*named(*docs.columns)).union(docs.where(F.col(key).isNull()))
