"""Byte-level BPE: the ranks' own library, offsets of the tokenizers library, decoding, awkward rows."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from copse.llm import bytebpe, queries
from awkward import frame, rows


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


def _library():
    import public_tokenizers
    import tiktoken
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                             mergeable_ranks=bytebpe.read_ranks(bytebpe.ranks_path()))


LIBRARY = _library()
CODEC = bytebpe.codec(bytebpe.library_tokenizer(bytebpe.ranks_path()))
TEXTS = ["", " ", "\n", "a", "  two  spaces ", "a   b 　\n c ", "it's I'LL we've 'x", "end.\n\n  Next\r\n\tline",
         "\x00\x1c\x85", "日本語のテキスト。", "é é ß ﬁ 🎉👩‍👩‍👧", "12 345 ²½", "<|endoftext|>", "a" * 5000, " " * 3000 + "b",
         "� ᠎ x"]


def test_every_token_has_its_merge():
    ranks = bytebpe.read_ranks(bytebpe.ranks_path())
    assert all((bytebpe.last_merge(t, ranks) is None) == (len(t) == 1) for t in ranks)
    assert len(set(bytebpe.byte_characters())) == 256


def test_ids_equal_the_library():
    texts = TEXTS + [r[1] or "" for r in rows()]
    own = bytebpe.Codec(bytebpe.library_tokenizer(bytebpe.ranks_path()), limit=40)
    for _ in range(2):
        ids, sizes = own.encode([t.encode() for t in texts])
        at = 0
        for text, size in zip(texts, sizes):
            assert ids[at:at + size].tolist() == LIBRARY.encode_ordinary(text)
            assert own.decode(ids[at:at + size]) == text.encode()
            at += size


@given(st.text("aA1é中  　\n\t.!'s\x1c\x85ßя🎉", max_size=30) | st.text(max_size=20))
@settings(max_examples=500, deadline=None)
def test_ids_equal_the_library_for_any_text(text):
    ids, _ = CODEC.encode([text.encode()])
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_offsets_are_those_of_the_library():
    for text in TEXTS:
        ids, _ = CODEC.encode([text.encode()])
        start, end = CODEC.offsets(text.encode(), ids)
        want = CODEC.tokenizer.encode(text, add_special_tokens=False)
        assert ids.tolist() == want.ids and list(zip(start, end)) == want.offsets


def test_rows(spark, docs):
    got = bytebpe.digests(docs).collect()
    assert len(got) == len(rows()) and all(r["round_trip"] for r in got)
    want = []
    for r in rows():
        ids = LIBRARY.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    assert bytebpe.digests(docs.limit(0)).count() == 0
    clash = bytebpe.encoded(docs, keep=docs.columns)
    assert clash.columns == [c for c in docs.columns if c != "ids"] + ["ids"] and clash.count() == len(rows())


def test_encode_and_decode_over_a_table(spark):
    table = spark.createDataFrame([(k, t) for k, t in enumerate([*TEXTS, None])], "doc_id long, text string")
    rows_ = bytebpe.encoded(table, keep=["doc_id", "text"], offsets=True)
    got = bytebpe.decoded(rows_).orderBy("doc_id").collect()
    for r in got:
        text = r["text"] or ""
        assert r["ids"] == LIBRARY.encode_ordinary(text) and r["decoded"] == text and bytes(r["decoded_bytes"]) == text.encode()
        assert len(r["starts"]) == len(r["ends"]) == len(r["ids"])
    ids = LIBRARY.encode_ordinary("🎉")
    assert len(ids) > 1
    cut = spark.createDataFrame([(1, ids[:1]), (2, ids[1:]), (3, []), (4, None), (5, [None, 10 ** 6, -1, *ids])],
                                "k long, `my.ids` array<int>")
    back = {r["k"]: r for r in bytebpe.decoded(cut, "my.ids").collect()}
    assert back[1]["decoded_bytes"] + back[2]["decoded_bytes"] == "🎉".encode()
    assert "�" in back[1]["decoded"] and back[3]["decoded"] == "" and back[4]["decoded"] is None
    assert back[5]["decoded"] == "🎉"


def test_query(spark, docs, tmp_path):
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_byte_pieces"](spark, str(tmp_path))
    assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() == len(rows())
