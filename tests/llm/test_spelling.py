"""Spelling variants: bit sets against plain edit distance, large groups, chains, awkward rows."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from copse.llm import queries, spelling
from awkward import frame, rows


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def plain_vocabulary(table):
    counts = Counter()
    for doc_id, text in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_variants(words):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        if found:
            best = min(found, key=lambda v: (-words[v], v))
            if words[best] >= 5 * words[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@given(st.lists(st.text("abé", min_size=5, max_size=6), max_size=90))
@settings(max_examples=200, deadline=None)
def test_bit_sets_equal_edit_distance(words):
    i, j = spelling.near_pairs(words, 5)
    want = {(a, b) for a, x in enumerate(words) for b, y in enumerate(words) if len(x) == 5 and one_apart(x, y)}
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(want)


def test_blocks_of_askers(monkeypatch):
    monkeypatch.setattr(spelling, "ASK_WORDS", 7)
    words = ["".join(x) for x in zip(*[iter("abbababaabababbbababababaabbab" * 20)] * 6)]
    i, j = spelling.near_pairs(words, 6)
    assert len(i) == sum(one_apart(x, y) for x in words for y in words)


@pytest.mark.parametrize("limit", [2, 20, 2048])
def test_near_words_equal_plain(spark, limit):
    """Many words with a common start, so that groups are large; every pair comes once each way."""
    pick = random.Random(7)
    words = {"".join(pick.choice("ab") for _ in range(pick.randint(6, 9))) for _ in range(250)}
    words |= {"prefix" + "".join(pick.choice("abc") for _ in range(pick.randint(1, 4))) for _ in range(80)}
    words |= {"x" * 5000, "x" * 5001, "x" * 2500 + "y" + "x" * 2499, "q", "qq", "z"}
    counts = {w: pick.choice([5, 6, 30, 31, 200, 1000]) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    pairs = [(r["word"], r["near"]) for r in spelling.near_words(table, limit).collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, b) for a in words for b in words if one_apart(a, b)}
    assert got(spelling.variants(table, limit=limit)) == plain_variants(counts)


def test_chains_and_ties(spark):
    counts = {"letter": 1000, "lettar": 200, "lettr": 40, "lettres": 7, "lettre": 8, "abcdef": 50, "abcdeg": 50, "abcdeh": 5,
              "alone": 5}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows_ = {r[0]: r for r in got(spelling.variants(table))}
    assert rows_["lettr"][1:3] == ("letter", "letter") and rows_["abcdeh"][1] == "abcdef" and rows_["abcdef"][1] is None
    assert rows_["lettar"][2] == "letter" and rows_["lettre"][2] == "letter"
    assert rows_["alone"] == ("alone", None, "alone", 5, 0, None)
    assert sorted(rows_.values()) == plain_variants(counts)
    assert spelling.variants(table.limit(0)).count() == 0


def test_vocabulary_equals_plain(spark):
    pick = random.Random(3)
    stems = ["example", "Straße", "naïveté", "LETTERS", "word×word", "short", "Ünïcode"]
    table = [(k, " ".join(pick.choice(stems) + pick.choice(["", "s", "-x", "1"]) for _ in range(40))) for k in range(300)]
    table += [(None, "example example"), (7, None), (8, ""), (9, "y" * 200_000)] + [(9, "y" * 200_000)] * 4 + table[:20]
    df = spark.createDataFrame(table, "doc_id long, text string")
    found = {r["word"]: r["n"] for r in spelling.vocabulary(df).collect()}
    assert found == plain_vocabulary(table)
    assert any(len(w) == 6 and w not in {s.lower() for s in stems} for w in found)
    assert spelling.vocabulary(df.limit(0)).count() == 0


def test_query_on_awkward_rows(spark, tmp_path):
    docs = frame(spark)
    docs.unionByName(docs).unionByName(docs).drop("a.b").write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_variants(plain_vocabulary([(r[0], r[1]) for r in rows()] * 3))
    assert got(queries.QUERIES["op12_spelling_variants"](spark, str(tmp_path))) == want


def test_query_on_the_small_table(spark):
    """All documents of the smallest table against plain edit distance."""
    import pandas as pd
    docs = pd.read_parquet("/root/testdata/sf0.001/documents.parquet")
    words = plain_vocabulary(zip(docs["doc_id"], docs["text"]))
    assert got(queries.QUERIES["op12_spelling_variants"](spark, "/root/testdata/sf0.001")) == plain_variants(words)
