"""Filter audit: masks, retractions over micro-batches, the report against plain counting, awkward rows."""

import itertools
import re
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from copse.llm import filters, queries
from copse.session import checkpoint_dir
from awkward import frame, rows


def plain_mask(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return sum(1 << k for k, fails in enumerate((
        len(words) < 200, 100 * len(set(words)) < 50 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 3 * len(text), re.search(r"[#$%&*|]", text) is not None)) if fails)


def plain_report(table, labels):
    """``table`` of (doc_id, text, lang), ``labels`` of doc_id to (good, toxic): every order applied to every document."""
    ids = {}
    for doc_id, text, _ in table:
        if doc_id is not None:
            ids.setdefault(text or "", []).append(doc_id)
    masks = [plain_mask(t) | 16 * (k is not None and min(ids[t or ""]) < k) for k, t, _ in table]
    out, shapley = {}, Counter()
    for part in {lang or "" for _, _, lang in table}:
        own = [(m, *labels.get(k, (0, 0))) for (k, _, lang), m in zip(table, masks) if (lang or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            gone = 0
            for step, name in enumerate(order, 1):
                bit = 1 << "ABCDE".index(name)
                hit = [r for r in left if r[0] & bit]
                left = [r for r in left if not r[0] & bit]
                shapley[part, name] += len(hit)
                out[part, "".join(order), step] = (
                    len(left), len(hit), sum(bool(m & bit and m & gone) for m, _, _ in own), sum(m == bit for m, _, _ in own),
                    sum(r[1] for r in hit), sum(r[2] for r in hit))
                gone |= bit
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in df.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
        "shapley").collect()}


@given(st.lists(st.sampled_from(["a", "B", "cc", "é", "#", "$x", "\n", " ", "Ab"]), max_size=12), st.sampled_from([1, 30]))
@settings(max_examples=300, deadline=None)
def test_masks_equal_plain(own, times):
    text = " ".join(own * times)
    assert filters.own_mask(text.encode()) == plain_mask(text)


BODY = " ".join(f"w{k}" for k in range(210))
TABLE = [
    (9, BODY, "en"), (3, BODY, "de"), (5, BODY, None), (3, BODY, "de"), (1, BODY, "fr"), (12, BODY, "en"),
    (None, BODY, "en"), (None, None, None), (20, None, "en"), (21, "", "en"), (19, "", "de"), (22, "A " * 300, "de"),
    (23, BODY + " #", "de"), (24, "one two", "fr"), (2, "one two", "fr"), (30, BODY + " x", "en"), (31, BODY + " y", "de"),
]
LABELS = [(1, 1, 0), (3, 1, 1), (9, 0, 1), (9, 1, None), (20, None, 1), (24, 1, 0), (None, 1, 1), (77, 1, 1), (2, None, None)]
JUDGED = {1: (1, 0), 3: (1, 1), 9: (1, 1), 20: (0, 1), 24: (1, 0)}


def test_smaller_ids_take_earlier_masks_back(spark, tmp_path):
    """A row a file, files in the order above: ids of one text come down from 9 to 3 and 1 over micro-batches."""
    path = f"{tmp_path}/documents.parquet"
    for k, row in enumerate(TABLE):
        spark.createDataFrame([row], "doc_id long, text string, lang string").coalesce(1).write.mode("append").parquet(path)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    folder = f"{checkpoint_dir(spark)}/{tmp_path.name}-audit"
    counts = filters.counters(spark, path, labels, folder, batch_bytes=1)
    changed = spark.read.parquet(f"{folder}/changes")
    assert changed.select("batch").distinct().count() == len(TABLE)
    assert changed.where("n < 0").count() >= 3
    assert {tuple(r)[:4] for r in counts.collect() if r["n"] < 0} == set()
    assert got(filters.report(counts)) == plain_report(TABLE, JUDGED)
    # New files alone are read by a second call: a still smaller id takes the least one's mask back.
    more = [(0, BODY, "es"), (40, "one two", "es")]
    spark.createDataFrame(more, "doc_id long, text string, lang string").coalesce(1).write.mode("append").parquet(path)
    counts = filters.counters(spark, path, labels, folder)
    assert spark.read.parquet(f"{folder}/changes").select("batch").distinct().count() == len(TABLE) + 1
    assert got(filters.report(counts)) == plain_report(TABLE + more, JUDGED)


def test_large_groups_of_copies_in_one_batch(spark, tmp_path):
    table = [(k * 7919 % 3001, BODY, ["en", "de", None][k % 3]) for k in range(3000)] + TABLE
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(table, "doc_id long, text string, lang string").repartition(5).write.parquet(path)
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert got(filters.audited(spark, path, labels)) == plain_report(table, JUDGED | {77: (1, 1)})
    import pandas as pd
    one = pd.DataFrame({"digest": b"d", "doc_id": range(100), "part": "en", "mask": 1, "good": 0, "toxic": 0})
    first, rest = sorted(next(filters._combined(iter([one]))).itertuples(), key=lambda r: r.copy)
    assert (first.doc_id, first.n, rest.n, rest.copy) == (0, 1, 99, True)


def test_empty_tables_and_awkward_rows(spark, tmp_path):
    docs = frame(spark).drop("a.b")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs.limit(0).write.parquet(f"{tmp_path}/none.parquet")
    assert filters.audited(spark, f"{tmp_path}/none.parquet", labels).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    found = queries.QUERIES["op13_filter_audit"](spark, str(tmp_path))
    assert got(found) == plain_report([r[:3] for r in rows()], {})
    one = next(p for p in (tmp_path / "documents.parquet").iterdir() if p.suffix == ".parquet")
    assert filters.audited(spark, str(one), labels).columns == found.columns


@pytest.mark.parametrize("name", ["op13_filter_audit"])
def test_shapley_adds_up(spark, name):
    """Over all filters the values come to 120 times what is removed in the end, whatever the order."""
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas()
    for part, own in df.groupby("part"):
        ends = own[own["step"] == 5]
        assert ends["kept"].nunique() == 1
        removed = own.groupby("filter_order")["removed"].sum()
        one = own[own["filter_order"] == "ABCDE"]
        assert removed.nunique() == 1 and one["shapley"].sum() == 120 * removed.iloc[0]
