"""Words one letter apart, by bit sets over blocks of the vocabulary, and the forms they vary.

A block of words has one bit set per (place, letter): the words that hold the
letter there. A word meets the whole block letter by letter; three sets, shifted
by one place where a letter is missing, say which words agree so far without a
fault, with one letter replaced, or with one letter put in. All words of a block
ask at once, 64 words a machine word.

Two words one letter apart, the shorter of ``l`` letters, agree before and
behind the fault. So for every ``l`` the places of the shorter word are cut into
segments, and words that agree outside a segment form a group; a pair belongs to
the segment that holds the first place where it differs, hence to one group. A
group over ``limit`` words is cut into those of its two half segments, again and
again; with a segment of one place it holds no more words than there are letters
or pairs of letters. Whole groups share a block.

Defined results: null and empty texts hold no words; a null id counts as an
empty one; repeated rows count again; an empty table gives no rows; other
columns are not read; runs of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from copse.llm.batches import named
from copse.session import removed, ship, written

#: Fixed values of the query: what a run is, and every how many runs (by checksum) one letter is lost.
RUN = "[A-Za-zÀ-ÿ]+"
SLIPS = 199
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a group from which its segment is halved, and letters (words times length) likewise.
GROUP_WORDS, GROUP_LETTERS = 2048, 1 << 24
#: Words that share a block, unless one group has more; words of it that ask at once.
BLOCK_WORDS, ASK_WORDS = 2048, 2048
#: Keys of large groups that are broadcast; their list is counted first.
HOT_KEYS = 50_000


def vocabulary(df: DataFrame, text: str = "text", doc_id: str = "doc_id", slips: int = SLIPS,
               letters: int = 6, least: int = 5) -> DataFrame:
    """``(word, n)``: words of at least ``letters`` letters that occur at least ``least`` times.

    A run loses one letter where ``slips`` divides the checksum of id and run.
    """
    lowered = F.translate(F.coalesce(*named(text), F.lit("")), UPPER, LOWER)
    runs = df.select(F.coalesce(named(doc_id)[0].cast("string"), F.lit("")).alias("id"),
                     F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("run")).where(
        F.length("run") >= letters)
    mark = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (mark % F.length("run")).cast("int")
    short = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, F.length("run")))
    return runs.select(F.when(mark % slips == 0, short).otherwise(F.col("run")).alias("word")).where(
        F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def near_pairs(words: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers ``(i, j)`` of words one letter apart, ``i`` of ``size`` letters and ``j`` of as many or one more.

    ``words`` have ``size`` or ``size + 1`` letters.
    """
    n, wide = len(words), -(-len(words) // 64)
    codes = np.array(words, f"U{size + 1}").view(np.uint32).reshape(n, size + 1)
    letters, places = np.unique(codes, return_inverse=True)
    places = places.reshape(n, size + 1)
    lengths = np.fromiter(map(len, words), np.int64, n)
    every = np.arange(n)

    def bits(rows: np.ndarray, columns: np.ndarray, n_rows: int) -> np.ndarray:
        plain = np.zeros((n_rows, wide * 64), bool)
        plain[rows, columns] = True
        return np.packbits(plain, axis=1, bitorder="little").view("<u8")

    of_size = bits(lengths - size, every, 2)
    found_i, found_j = [], []
    asking = np.flatnonzero(lengths == size)
    for k in range(0, len(asking), ASK_WORDS):
        own = asking[k:k + ASK_WORDS]
        exact = np.full((len(own), wide), ~np.uint64(0))
        replaced, put_in = np.zeros_like(exact), np.zeros_like(exact)
        here = bits(places[:, 0], every, len(letters))
        for p in range(size):
            ahead = bits(places[:, p + 1], every, len(letters))
            letter = places[own, p]
            hit = here[letter]
            put_in = (put_in | exact) & ahead[letter]
            replaced = (replaced & hit) | (exact & ~hit)
            exact &= hit
            here = ahead
        near = (replaced & of_size[0]) | ((put_in | exact) & of_size[1])
        row, word = np.nonzero(near)
        which, bit = np.nonzero(np.unpackbits(near[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        found_i.append(own[row[which]])
        found_j.append(word[which] * 64 + bit)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return join(found_i), join(found_j)


def _block(rows: pa.Table) -> pa.RecordBatch:
    """Pairs of a block, both ways round, each from the one group that holds its fault."""
    size = rows["l"][0].as_py()
    words = rows["word"].to_pylist()
    n, key, first, last = (rows[c].to_numpy() for c in ("n", "key", "a", "b"))
    i, j = near_pairs(words, size)
    kept = key[i] == key[j]
    i, j = i[kept], j[kept]
    codes = np.array(words, f"U{size + 1}").view(np.uint32).reshape(len(words), size + 1)[:, :size]
    differ = codes[i] != codes[j]
    fault = np.where(differ.any(axis=1), differ.argmax(axis=1), size - 1)
    kept = (first[i] <= fault) & (fault < last[i])
    i, j = i[kept], j[kept]
    longer = np.fromiter((len(words[x]) > size for x in j), bool, len(j))   # equal lengths ask both ways
    one, other = np.concatenate([i, j[longer]]), np.concatenate([j, i[longer]])
    text = rows["word"].combine_chunks()
    return pa.RecordBatch.from_arrays([text.take(pa.array(one)), text.take(pa.array(other)), pa.array(n[other])],
                                      names=["word", "near", "near_n"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups put together to blocks; rows come ordered by length and group."""
    held: list[pa.RecordBatch] = []
    count, ended = 0, None                       # rows held, and where the last whole group among them ends
    for batch in batches:
        size, key = batch.column("l").to_numpy(), batch.column("key").to_numpy()
        starts = np.flatnonzero((size[1:] != size[:-1]) | (key[1:] != key[:-1])) + 1
        at = 0
        if held:
            before = (held[-1].column("l")[-1].as_py(), held[-1].column("key")[-1].as_py())
            if before != (size[0], key[0]):
                starts = np.concatenate([[0], starts])
        for start in starts.tolist():
            if start > at:
                held.append(batch.slice(at, start - at))
                count += start - at
                at = start
            if count >= BLOCK_WORDS or held and held[-1].column("l")[0].as_py() != size[start]:
                yield _block(pa.Table.from_batches(held))
                held, count = [], 0
        if at < batch.num_rows:
            held.append(batch.slice(at))
            count += batch.num_rows - at
    if held:
        yield _block(pa.Table.from_batches(held))


def _keyed(rows: DataFrame) -> DataFrame:
    """Rows of a segment [a, b) of ``l`` places with the number of their group."""
    behind = F.col("l") - F.col("b")
    return rows.select("word", "n", "l", "a", "b", F.xxhash64(
        "l", "a", "b", F.substr("word", F.lit(1), F.col("a")),
        F.substr("word", F.length("word") - behind + 1, behind)).alias("key"))


def _halves(a: Column, b: Column) -> Column:
    middle = ((a + b) / 2).cast("int")
    return F.array(F.struct(a.alias("a"), middle.alias("b")), F.struct(middle.alias("a"), b.alias("b")))


def groups(words: DataFrame, limit: int = GROUP_WORDS) -> DataFrame:
    """Rows ``(word, n, l, a, b, key)`` of groups of bounded size that hold every pair one letter apart."""
    length = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("l")).where("l > 0")
    rows = rows.select("word", "n", "l", F.inline(F.when(F.col("l") > 1, _halves(F.lit(0), F.col("l"))).otherwise(
        F.array(F.struct(F.lit(0).alias("a"), F.lit(1).alias("b"))))))
    whole = None
    while True:
        rows = written(_keyed(rows), "word-groups")
        hot = written(rows.where("b - a > 1").groupBy("key").agg(F.count("*").alias("_n"), F.max("l").alias("_l")).where(
            (F.col("_n") > limit) | (F.col("_n") * F.col("_l") > GROUP_LETTERS)).select("key"), "large-groups")
        n_hot = hot.count()
        if not n_hot:
            removed(hot)
            return rows if whole is None else whole.unionByName(rows)
        keys = F.broadcast(hot) if n_hot <= HOT_KEYS else hot
        calm = rows.join(keys, "key", "left_anti")
        whole = calm if whole is None else whole.unionByName(calm)
        rows = rows.join(keys, "key", "left_semi").select("word", "n", "l", F.inline(_halves(F.col("a"), F.col("b"))))


def near_words(words: DataFrame, limit: int = GROUP_WORDS) -> DataFrame:
    """``(word, near, near_n)``: every word with each word one letter apart, for distinct ``(word, n)``."""
    ship(words.sparkSession)
    dealt = groups(words, limit).repartition("key").sortWithinPartitions("l", "key")
    return dealt.mapInArrow(_pairs, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for rows ``(word, form)``: forms followed to the last, twice as far each round."""
    now = written(forms.select("word", F.col("form").alias("root")), "word-roots")
    while True:
        above = now.select(F.col("word").alias("root"), F.col("root").alias("_up"))
        after = written(now.join(above, "root", "left").select(
            "word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("_moved")), "word-roots")
        removed(now)
        if after.where("_moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")


def variants(words: DataFrame, times: int = 5, limit: int = GROUP_WORDS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for words ``(word, n)``.

    ``form`` is the near word of largest ``n`` (of equal ones the first by code
    points) if it occurs at least ``times`` as often; ``root`` the end of its chain.
    """
    words = written(words.select("word", "n"), "vocabulary")
    best = near_words(words, limit).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("_best"))
    fits = -F.col("_best.m") >= F.col("n") * times
    rows = written(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(fits, F.col("_best.near")).alias("form"), F.when(fits, -F.col("_best.m")).alias("form_n")), "word-forms")
    return rows.join(roots(rows.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
