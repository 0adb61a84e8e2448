"""Packing, token files, shards, near duplicates, neighbours, the pipeline: awkward rows and brute force."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from copse.llm import components, hnsw, neardup, packing, sharding, tokens, wavelet
from copse.llm.batches import Index
from copse.session import checkpoint_dir
from awkward import crc, frame, rows, shingles


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.tokenizer_path())


ODD = ["H̱ello. Å, <|EndOfText|>. x<|endoftext|>y it's IT'S don't. a.b,c. 5. 12.,! é. É!! ×. “Q”. a!!. !!?", "", "...",
       ". ,", "'s 's. '", "A'S. 'S, 'LL.", "Σας. ΟΔΟΣ. x y. z, ß? \x0b\x1c q.. Ǆ. ﬁ. á. Å, ẖ H̱"]


def test_ids_equal_the_library(library):
    own = tokens.Encoder(tokens.tokenizer_path(), limit=50)
    texts = ODD + [r[1] for r in rows()]
    for _ in range(2):
        ids, sizes = own.encode([None if t is None else t.encode() for t in texts], 7)
        at = 0
        for text, size in zip(texts, sizes):
            assert ids[at:at + size].tolist() == library.encode(text or "", add_special_tokens=False).ids + [7]
            at += size


@given(st.text("aAé.É,! 's<|5́ß\n", max_size=25))
@settings(max_examples=300, deadline=None)
def test_ids_equal_the_library_for_any_text(text):
    own = tokens.encoder(tokens.tokenizer_path())
    assert own.encode([text.encode()], 0)[0].tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids + [0]


def check_packed(got, capacity=packing.CAPACITY):
    got = got.sort_values(["sequence_id", "offset"])
    by = got.groupby("sequence_id")["length"]
    assert (by.sum() <= capacity).all()
    assert ((by.cumsum() - got["length"]) == got["offset"]).all()


def test_packing(spark, docs, library):
    got = packing.packed(packing.pieces(docs)).toPandas()
    check_packed(got)
    want = []
    for r in rows():
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want += [(r[0], n, s, len(ids[s:s + 2048]), crc(ids[s:s + 2048])) for n, s in enumerate(range(0, len(ids), 2048))]
    seen = [(None if x[0] != x[0] else int(x[0]), *map(int, x[1:])) for x in
            got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(seen, key=repr) == sorted(want, key=repr)
    assert packing.packed(packing.pieces(docs.limit(0))).count() == 0


@pytest.mark.parametrize("block", [50, 100_000])
def test_packing_is_close_to_the_bound(spark, block):
    pick = random.Random(5)
    sizes = [pick.choice([pick.randint(1, 2048), pick.randint(1, 300)]) for _ in range(3000)]
    rows_ = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long")
    got = packing.packed(rows_, block=block).toPandas()
    check_packed(got)
    assert len(got) == len(sizes) and got["doc_id"].is_unique
    assert got["sequence_id"].nunique() <= 1.02 * sum(sizes) / 2048 + 2


def test_best_fit_takes_the_fullest_that_has_room():
    bins = packing.Bins(10)
    for item, size in enumerate([6, 8, 2, 4, 1]):
        bins.put(item, size)
    assert bins.items == [[0, 3], [1, 2], [4]]


@given(st.lists(st.integers(0, 700), min_size=1, max_size=1500))
@settings(max_examples=60, deadline=None)
def test_wavelet_matrix(values):
    ids = np.array(values)
    one = wavelet.WaveletMatrix.open(wavelet.build(ids, np.array([3, 5]), np.array([0, 1]), np.array([1, len(ids) - 1])))
    assert one.ids().tolist() == values and one.access(np.arange(len(ids))).tolist() == values
    for token in {*values[:4], 0, 701, 5000}:
        at = np.flatnonzero(ids == token).tolist()
        assert one.count(token) == len(at)
        assert [one.select(token, n) for n in range(len(at) + 1)] == at + [-1]
        for place in (0, len(ids) // 2, len(ids)):
            assert one.rank(token, place) == sum(x < place for x in at)
        assert one.counts(token, [0, len(ids) // 3, len(ids)]).tolist() == [sum(x < p for x in at) for p in (0, len(ids) // 3, len(ids))]
        assert one.count(token, len(ids) // 3, len(ids) // 2) == sum(len(ids) // 3 <= x < len(ids) // 2 for x in at)


def test_token_files(spark, docs, library, tmp_path):
    folder = f"{checkpoint_dir(spark)}/{tmp_path.name}-tokens"
    wavelet.write(docs, folder, shards=3, file_ids=300)
    got = sorted(map(tuple, wavelet.read(spark, folder).collect()), key=lambda r: r[1])
    ordered = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start, total = [], 0, 0
    for r in ordered:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], start, len(ids), crc(ids), ids[0], ids.count(2)))
        start += len(ids)
        total += ids.count(2)
    assert got == want
    assert sum(r["n"] for r in wavelet.occurrences(spark, folder, 2).collect()) == total
    empty = f"{checkpoint_dir(spark)}/{tmp_path.name}-empty"
    wavelet.write(docs.limit(0), empty)
    assert wavelet.read(spark, empty).count() == 0


def plain_shards(records, shards):
    total, before, out = sum(r[1] for r in records), 0, {}
    for k, (key, size, sum_) in enumerate(sorted(records, key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))):
        out.setdefault((2 * before + size) * shards // (2 * total), []).append((key, size, sum_))
        before += size
    return out


def test_sharding(spark, docs):
    got = sharding.sharded(sharding.sized(docs), 4, ranges=3).toPandas()
    assert len(got) == len(rows())
    for r in got.itertuples():
        assert r.text_crc32 in {zlib.crc32((x[1] or "").encode()) for x in rows()}
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])
    assert sharding.sharded(sharding.sized(docs.limit(0)), 4).count() == 0


def test_sharding_equals_plain(spark):
    pick = random.Random(1)
    texts = [(pick.choice([k, k // 3, None]), "x" * pick.randint(0, 90)) for k in range(2000)]
    got = sharding.sharded(sharding.sized(spark.createDataFrame(texts, "doc_id long, text string")), 7, ranges=40)
    records = [(k, len(t) + 16, zlib.crc32(t.encode())) for k, t in texts]
    want = plain_shards(records, 7)
    have = {}
    for r in got.collect():
        have.setdefault(r["shard"], {})[r["slot"]] = (r["doc_id"], r["size"], r["text_crc32"])
    parts = {s: sorted((v[k] for k in v), key=repr) for s, v in have.items()}
    nulls = sum(k is None for k, _ in texts)
    assert nulls and {s: len(p) for s, p in parts.items()}.keys() == want.keys()
    sizes = [sum(r[1] for r in p) for p in parts.values()]
    assert max(sizes) - min(sizes) <= 2 * 106


def test_sharding_divides_one_key(spark):
    hot = [(5 if k % 3 else k, "hot" if k % 3 else "y" * (k % 50)) for k in range(3000)]
    got = sharding.sharded(sharding.sized(spark.createDataFrame(hot, "doc_id long, text string")), 40).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 2 * 66


def test_sharding_places_every_record_as_plain(spark):
    """Different keys: record by record, and other columns whatever their names."""
    pick = random.Random(2)
    texts = [(k, "x" * pick.randint(0, 90), k % 5, -k) for k in range(1, 3001)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, _range long, `_a.b` long")
    sized = sharding.sized(docs).join(docs.select("doc_id", "_range", "`_a.b`"), "doc_id")
    got = sharding.sharded(sized, 7, ranges=40).collect()
    want = plain_shards([(k, len(t) + 16, zlib.crc32(t.encode())) for k, t, _, _ in texts], 7)
    assert {(r.shard, r.slot): (r.doc_id, r.size, r.text_crc32) for r in got} == {
        (s, i): record for s, records in want.items() for i, record in enumerate(records)}
    assert all(r["_range"] == r.doc_id % 5 and r["_a.b"] == -r.doc_id for r in got)


def test_sharding_with_very_many_overfull_keys(spark):
    """Every key overfills its range: as many parts as there are keys, and more."""
    texts = [(k % 1500, "y" * 9) for k in range(30_000)]
    rows_ = sharding.sized(spark.createDataFrame(texts, "doc_id long, text string"))
    got = sharding.sharded(rows_, 40, ranges=4000).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == 30_000 and len(sizes) == 40 and sizes.max() - sizes.min() <= 2 * 25
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])


def plain_components(texts):
    """(id, text) to the least id reachable."""
    sets = {k: shingles(t) for k, t in texts}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize("block", [6, 1024])
def test_near_duplicates_equal_plain(spark, block, monkeypatch):
    """Chains, shared passages, copies, and near copies on both sides of the threshold."""
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    pick = random.Random(3)
    word = lambda: f"w{pick.randint(0, 10 ** 6)}"
    passage = [word() for _ in range(60)]
    texts = []
    for base in range(12):
        own = [word() for _ in range(pick.choice([4, 30, 120, 400]))]
        for copy in range(pick.randint(1, 14)):
            changed = list(own)
            for _ in range(pick.choice([0, 0, 1, 2, len(own) // 60, len(own) // 40])):
                changed[pick.randrange(len(changed))] = word()
            if base % 3 == 0:
                changed[10:10] = passage
            texts.append(" ".join(changed))
            own = changed if base % 4 == 0 else own
    pick.shuffle(texts)
    table = list(enumerate(texts))
    got = neardup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()
    want = plain_components(table)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert 12 < len({c for _, c in want.values()}) < len(table)


def test_near_duplicates_of_awkward_rows(spark, docs):
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs).collect()), key=repr)
    want = plain_components({r[0]: r[1] for r in rows() if r[0] is not None}.items())
    assert got == sorted(((r[0], want[r[0]][1] if r[0] is not None else None, r[0] is None or want[r[0]][1] == r[0])
                          for r in rows()), key=repr)
    one = neardup.deduplicated(docs)
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.collect() if r["doc_id"] is not None) == sorted(k for k, (_, c) in want.items() if k == c)
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_chunks_keep_the_promise():
    """Signatures within the distance share a key; the bound holds but once in a million."""
    chunks = neardup.plan(0.85)
    pick = np.random.default_rng(0)
    for _ in range(300):
        one = pick.integers(0, 1 << 16, chunks.positions).astype(np.uint16)
        two = one.copy()
        at = pick.choice(chunks.positions, pick.integers(0, chunks.distance + 1), replace=False)
        two[at] += 1
        keys = neardup.bucket_keys(np.stack([one, two]), chunks)
        assert (keys[0] == keys[1]).any()
    assert len(chunks.chunks) * 2 > chunks.distance


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1001 + k) for k in range(50)] + [(5000, 5000), (7, 3)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(301)}, **{k: 1000 for k in range(1000, 1051)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
    odd = [(3, 3), (None, 4), (5, None), (8, 7), (8, 7), (7, 8), (9, 8)]      # loops, nulls, repeats: 7, 8 and 9 only
    got = components.components(spark.createDataFrame(odd, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(7, 7), (8, 7), (9, 7)]


def test_neighbours(spark):
    pick = np.random.default_rng(2)
    vectors = pick.normal(size=(1500, 12)) * pick.uniform(0.2, 3, (1500, 1))
    vectors[100:400] = vectors[100]                      # copies
    table = [(k, v.tolist(), "x") for k, v in enumerate(vectors)]
    table += [(2000, None, "n"), (2020, [0.0] * 12, "z"), (2040, [None] + [1.0] * 11, "c"), (2060, [float("nan")] * 12, "f"),
              (2080, [float("inf")] + [0.0] * 11, "i"), (None, [1.0] * 12, "k"), (2100, [1.0, 2.0], "d")]
    rows_ = spark.createDataFrame(table, "vec_id long, embedding array<double>, score string")
    built = hnsw.index(hnsw.usable(rows_, "embedding", "vec_id"), shard_rows=400)
    got = hnsw.search(built, hnsw.usable(rows_.where("vec_id % 20 = 0"), "embedding", "vec_id"), 20).toPandas()
    hits = total = 0
    for query in range(0, 1500, 20):
        score = (vectors * vectors[query]).sum(axis=1)
        order = [k for k in np.lexsort((np.arange(1500), -score)) if k != query][:20]
        own = got[got["query_id"] == query].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert np.allclose(own["score"], score[own["vec_id"]], rtol=1e-12)
        pairs = list(zip(-own["score"], own["vec_id"]))
        assert pairs == sorted(pairs)
        hits += len(set(order) & set(own["vec_id"]))
        total += 20
    assert hits >= 0.95 * total
    assert set(got["query_id"]) == set(range(0, 1500, 20))   # 2100 has no other of its dimension
    empty = rows_.limit(0)
    assert hnsw.nearest(empty, empty).count() == 0
    few = rows_.where("vec_id < 5")
    assert hnsw.nearest(few, few.where("vec_id = 0")).count() == 4


def test_neighbours_beside_very_long_vectors_and_repeated_ids(spark):
    """Lengths from tiny to huge do not spoil each other's shards; an id in several rows is found once."""
    pick = np.random.default_rng(4)
    vectors = pick.normal(size=(1200, 24))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[7] *= 3e5
    vectors[8] *= 1e170
    vectors[9] *= 1e-170
    vectors[600:800] *= np.exp(pick.uniform(0, 14, 200))[:, None]
    table = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(33, vectors[33].tolist())] * 2 + [(33, vectors[34].tolist())]
    rows_ = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = hnsw.nearest(rows_, rows_.where("vec_id % 20 = 0 or vec_id in (7, 9, 33)")).toPandas()
    assert not got.duplicated(["query_id", "vec_id"]).any() and (got.groupby("query_id").size() == 20).all()
    hits = total = 0
    for query in [*range(0, 1200, 20), 7, 9]:
        score = (vectors * vectors[query]).sum(axis=1)
        score[33] = max(score[33], score[34])
        order = [k for k in np.lexsort((np.arange(1200), -score)) if k != query][:20]
        hits += len(set(order) & set(got[got["query_id"] == query]["vec_id"]))
        total += 20
    assert hits >= 0.95 * total


def test_kept_candidates_shrink_with_shards():
    assert [hnsw.kept_candidates(20, n) for n in (1, 2, 7, 1000)] == [160, 107, 96, 96]


def test_index_starts_over():
    index = Index(3)
    assert index.codes(["a", "b", "a"])[0].tolist() == [0, 1, 0]
    assert index.codes(["b", "c", "d"])[0].tolist() == [1, 2, 3]
    numbers, fresh, anew = index.codes(["d", "a"])
    assert (numbers.tolist(), fresh, anew) == ([0, 1], ["d", "a"], True)


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline as pipeline
    spark.createDataFrame([(1, 0), (3, 1), (9, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path)).cache()
        assert after.columns == docs.columns and after.count() <= now.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        now = after
    left = {r["doc_id"] for r in now.collect()}
    assert 1 in left and 3 in left and not left & {2, 4, 5, 6, 7, 8, 13, 14, 15}
    assert pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() >= now.count()
