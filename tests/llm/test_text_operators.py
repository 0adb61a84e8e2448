"""Quality rules, toxicity, language, personal data, pieces: awkward rows and brute force."""

import pytest
from hypothesis import given, settings, strategies as st

from copse.llm import langid, pieces, pii, quality, toxicity
from awkward import base_spans, crc, frame, quality as plain_quality, rows


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


def in_order(df, *cols):
    return sorted(map(tuple, df.select("doc_id", *cols).collect()), key=repr)


def test_quality_equals_plain(spark, docs):
    short = docs.where("doc_id is null or doc_id not in (10, 11)")
    got = in_order(quality.ledger(short), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = sorted(((r[0], *plain_quality(r[1])) for r in rows() if r[0] not in (10, 11)), key=repr)
    assert got == want
    assert quality.ledger(docs).count() == len(rows())
    assert quality.ledger(docs.limit(0)).count() == 0


def test_policies_and_ablations(spark, docs):
    rows_ = quality.ledger(docs).cache()
    for policy in (quality.BASE, quality.STANDARD, quality.SHORT):
        seen = [r["failed_bits"] & policy.mask for r in rows_.collect()]
        kept = [r[0] for r in quality.judged(rows_, policy).select(f"`kept_{policy.version}`").collect()]
        assert kept == [b == 0 for b in seen]
        for r in quality.ablations(rows_, policy).collect():
            one = 1 << [n for n, _ in quality.RULES].index(r["rule"])
            assert (r["n_failed"], r["n_only"], r["n_kept_without"]) == (
                sum(b & one != 0 for b in seen), sum(b == one for b in seen), sum(b & ~one == 0 for b in seen))
    assert quality.filtered(docs, quality.STANDARD).columns == docs.columns


@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=14))
@settings(max_examples=200, deadline=None)
def test_repeated_windows(own):
    text = " ".join(own)
    assert quality.measure([text.encode()])["n_repeat_words"] == [plain_quality(text)[4]]


SPAN_TEXTS = ["a@b.c@d.e f@@g.h x.y@z", "1.2.3.4.5.6.7.8 01.002.3.0004 999.1.1.1", "+1 (017) 555-7713 +1+1234567890+12 3456 78901 ",
              "..%@-.-.a a@b..c a@b.c..d@e.f", "4111 1111 1111 1111-4111111111111111", "12345678901234", "a@b@c.d é@b.c"]


@pytest.mark.parametrize("text", SPAN_TEXTS)
def test_spans_equal_plain(text):
    assert ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in pii.base_spans(text)) == base_spans(text)


@given(st.text("a1@.+- (2)é", max_size=40))
@settings(max_examples=500, deadline=None)
def test_spans_equal_plain_for_any_text(text):
    assert ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in pii.base_spans(text)) == base_spans(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1(" * 50_000):
        assert pii.base_spans(text) is not None


def test_personal_data_rows(spark, docs):
    found = pii.found(docs)
    got = in_order(found.select("doc_id", pii.listed(base_only=True).alias("s")), "s")
    assert got == sorted(((r[0], base_spans(r[1])) for r in rows()), key=repr)
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows())
    assert clean.where("doc_id = 9").first()["text"] == "mail [EMAIL] and [PHONE] or [IP] card [CARD]"
    assert clean.where("doc_id = 4").first()["text"] is None
    assert pii.found(docs.limit(0)).count() == 0


def test_disclosing_terms(spark):
    """A nickname only ever seen beside one address discloses it; common words and one-off neighbours do not."""
    told = [(k, f"note {k} kestrelman wrote from k.man@mail.example.org about topic{k} again") for k in range(6)]
    rest = [(100 + k, f"note {k} someone wrote about topic{k} again and again") for k in range(60)]
    copies = [(200 + k, "only copies of onceword beside x.y@mail.example.org here") for k in range(5)]
    docs = spark.createDataFrame(told + rest + copies + [(300, "Kestrelman was seen alone")], "doc_id long, text string")
    terms = {r["term"] for r in pii.disclosing_terms(docs).collect()}
    assert pii.word_hash("kestrelman") in terms
    assert not terms & {pii.word_hash(w) for w in ("note", "wrote", "about", "again", "onceword", "topic3")}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[300] == "[TERM] was seen alone"
    assert clean[0] == "note 0 [TERM] wrote [TERM] [EMAIL] about topic0 again".replace("wrote [TERM]", "wrote " + (
        "[TERM]" if pii.word_hash("from") in terms else "from"))
    assert clean[100] == rest[0][1]


def test_copies_and_repeated_mentions_count_once_on_both_sides(spark):
    """Three texts with a thousand copies each, mentions in several places of a text, and a term that is common elsewhere."""
    told = [f"note {k} kestrelman wrote from k.man@mail.example.org about topic{k}" for k in range(3)]
    often = [f"place{k} sparrowman x.y@mail.example.org and{k} later{k} sparrowman x.y@mail.example.org here{k}" for k in range(3)]
    elsewhere = [f"sparrowman was seen {k} times" for k in range(60)]
    filler = [f"filler text number {k}" for k in range(1500)]
    table = told * 1000 + often + elsewhere * 2 + filler + [None, None, "", ""]
    docs = spark.createDataFrame(list(enumerate(table)), "doc_id long, text string").repartition(4)
    got = {r["term"]: r for r in pii.disclosing_terms(docs, threshold=-100.0).collect()}
    one, other = got[pii.word_hash("kestrelman")], got[pii.word_hash("sparrowman")]
    assert (one["n_both"], one["n_entity"], one["n_texts"], one["n_contexts"]) == (3, 3, 3, 3)
    assert one["share"] == pytest.approx(1.0)
    assert (other["n_both"], other["n_entity"], other["n_texts"]) == (3, 3, 63)
    clean = pii.sanitised(docs).where("text like '%[EMAIL]%'").collect()
    assert sum("kestrelman" in r["text"] for r in clean) == 0 and sum("[TERM]" in r["text"] for r in clean) == 3000
    assert sum("sparrowman" in r["text"] for r in clean) == 3


def test_short_terms_disclose(spark):
    """Names and codes of one to three characters are measured and removed wherever they stand."""
    told = [f"note {k} Lee of room 417 金 ı wrote from k.man@mail.example.org about it{k}" for k in range(4)]
    rest = [f"note {k} of a room, someone wrote about it from here" for k in range(80)]
    docs = spark.createDataFrame(list(enumerate(told + rest + ["LEE, 金! in 417; leeward"])), "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[84] == "[TERM], [TERM]! in [TERM]; leeward"
    assert clean[2] == "note 2 [TERM] of room [TERM] [TERM] [TERM] wrote from [EMAIL] about it2"
    assert clean[10] == rest[6]


def test_contexts_by_words():
    """Ten longer words on either side with the short ones among them, whole, however many characters they take."""
    def terms(text):
        return {h for _, _, t, _ in pii.contexts(text, pii.base_spans(text)) for h in t}

    long = [f"{'w' * 60}{chr(97 + k)}" for k in range(24)]
    text = " a b ".join(long[:12]) + " x@y.org " + " c 7 ".join(long[12:])
    assert terms(text) == {pii.word_hash(w) for w in [*long[2:22], "a", "b", "c", "7"]}
    assert terms("far " + "ab " * 199 + "x@y.org") == {pii.word_hash("far"), pii.word_hash("ab")}
    assert terms("far " + "ab " * 200 + "x@y.org") == {pii.word_hash("ab")}
    assert terms("İda namé@b.org 1.2.3.4smith") >= {pii.word_hash(w) for w in ("İda", "smith")}


def test_text_hash_is_that_of_spark(spark):
    texts = ["", "a", "é ß 🎉", "x" * 1000]
    got = spark.createDataFrame(list(enumerate(texts)), "k long, text string").selectExpr("k", "xxhash64(text) h").orderBy("k").collect()
    assert [r["h"] for r in got] == [pii.text_hash(t.encode()) for t in texts]


def test_language(spark, docs):
    table = spark.createDataFrame(
        [(k, "the quick and the lazy with them that", "en") for k in range(60)]
        + [(100 + k, "der schnelle und das faule mit ihnen dass", "de") for k in range(60)], "doc_id long, text string, lang string")
    model = langid.fit(table)
    got = {r["doc_id"]: r for r in langid.identified(docs, model).collect()}
    assert len(got) and langid.identified(docs, model).count() == len(rows())
    for k in (4, 5, 6, 14):
        assert got[k]["lang_pred"] == "und" and got[k]["score"] == 0.0
    tests = spark.createDataFrame([(1, "they lazy them"), (2, "schnelle dass und")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identified(tests, model).collect()} == {1: "en", 2: "de"}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.fit(table.limit(0)) is None
    assert {r["lang_pred"] for r in langid.identified(docs, None).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    """Words share at most the whole probability."""
    import itertools
    import math

    import numpy as np
    counts = {}
    for word in ("abab", "abba", "bab", "aab"):
        marked = langid.START + word + langid.END
        for end in range(2, len(marked) + 1):
            gram = marked[max(0, end - langid.ORDER):end]
            counts[gram] = counts.get(gram, 0) + 1
    model = langid.build(["x"], list(counts), [0] * len(counts), list(counts.values()))
    ab = model.costs(["ab"])[0, 0]
    assert math.isfinite(ab) and ab < model.costs(["zz"])[0, 0]
    # All words of up to seven letters together have nearly the whole probability, and never more.
    words = ["".join(w) for n in range(1, 8) for w in itertools.product("ab", repeat=n)]
    total = float(np.exp(-model.costs(words)[:, 0]).sum())
    assert 0.5 < total <= 1.0


def test_toxicity(spark, docs):
    bad = [(k, f"text{k} here grubnak{'s' if k % 2 else ''} is word{k % 13} grubnak near{k}") for k in range(40)]
    good = [(100 + k, f"text{k} here nothing is word{k % 13} near{k} at all") for k in range(120)]
    table = spark.createDataFrame(bad + good, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k, _ in bad] + [(k, 0) for k, _ in good] + [(999, None), (None, 1)],
                                   "doc_id long, toxic int")
    lexicon = toxicity.learn(table, labels)
    assert "grubnak" in lexicon.weights and "nothing" not in lexicon.weights
    tests = spark.createDataFrame([(1, "you GRUBNAK you"), (2, "you grubn4k"), (3, "grubnákish"), (4, "a clean text"),
                                   (5, "grυbnak"), (6, "9rubnak")], "doc_id long, text string")
    n = {r["doc_id"]: r["n_matches"] for r in toxicity.scored(tests, lexicon).collect()}
    assert (n[1], n[2], n[3], n[4], n[5]) == (1, 1, 0, 0, 1)
    got = toxicity.scored(docs, lexicon)
    assert got.count() == len(rows()) and got.where("score < 0 or score > 1").count() == 0
    assert toxicity.learn(table.limit(0), labels).weights == {}
    assert toxicity.scored(docs.limit(0), lexicon).count() == 0


def test_exception_phrases_void_matches(spark):
    lexicon = toxicity.Lexicon({toxicity.fold("trash"): 3.0}, ("trash can",))
    texts = spark.createDataFrame([(1, "the trash can"), (2, "you tr4sh"), (3, "trashy")], "doc_id long, text string")
    assert {r[0]: r[1] for r in toxicity.scored(texts, lexicon).select("doc_id", "n_matches").collect()} == {1: 0, 2: 1, 3: 0}


PIECE_TEXTS = ["", "a", "  a  b ｆ\n\tc ", "héllo wörld 你好 🎉 hello", "aaaaaaaaaaaaaaaaaaaa", "    def f(x):\n        return x",
               "http://www.example.com/a?b=1&c=2", "Internationalization. ΟΔΟΣ Привет", "end.\nNext, \nline!? \n\n é. ².,\n", "\nfirst", "last \n.", "a\x00.b c", "<s></s><0x41>", " ", "       "]


def test_pieces_equal_the_library():
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    own = pieces.transducer(pieces.model_path())
    decoder = pieces.Decoder(own)
    texts = PIECE_TEXTS + [r[1] for r in rows() if r[1] and len(r[1]) < 5000]
    for text in texts:
        ids = own.encode(text)
        assert ids == library.encode(text)
        assert decoder.decode(ids) == text
        for word in own.words(own.normalised(text)):
            assert own._only_path(word) == own._shortest_path(word)


@given(st.text("abcthe ._éß\n", max_size=30))
@settings(max_examples=300, deadline=None)
def test_pieces_equal_the_library_for_any_text(text):
    import sentencepiece
    library = _library(sentencepiece)
    assert pieces.transducer(pieces.model_path()).encode(text) == library.encode(text)


_HELD = []


def _library(sentencepiece):
    if not _HELD:
        _HELD.append(sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()))
    return _HELD[0]


def test_piece_rows(spark, docs):
    got = {r["doc_id"]: r for r in pieces.digests(docs.where("doc_id is not null")).collect()}
    assert all(r["round_trip"] for r in got.values())
    assert got[4]["n_tokens"] == got[5]["n_tokens"] == 0
    import sentencepiece
    library = _library(sentencepiece)
    for r in rows():
        if r[0] is not None:
            assert (got[r[0]]["n_tokens"], got[r[0]]["ids_crc32"]) == (len(x := library.encode(r[1] or "")), crc(x))
    odd = spark.createDataFrame([(k, t) for k, t in enumerate(PIECE_TEXTS + ["a \u2581b"])], "doc_id long, text string")
    assert [r["ids"] for r in pieces.encoded(odd).orderBy("doc_id").collect()] == [library.encode(t) for t in PIECE_TEXTS + ["a \u2581b"]]
    assert [r["round_trip"] for r in pieces.digests(odd).orderBy("doc_id").collect()] == [True] * len(PIECE_TEXTS) + [False]
    assert pieces.encoded(docs.limit(0)).count() == 0


def test_pieces_decode_over_a_table(spark, tmp_path):
    """The query returns ids and the text decoded from them; ids of any origin decode as in the library."""
    from copse.llm import queries
    texts = [*PIECE_TEXTS, "a \u2581b", None]
    odd = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op6_pieces"](spark, str(tmp_path)).orderBy("doc_id").collect()
    import sentencepiece
    library = _library(sentencepiece)
    assert [r["ids"] for r in got] == [library.encode(t or "") for t in texts]
    assert [r["decoded"] for r in got] == [(t or "").replace("\u2581", " ") for t in texts]
    assert [r["round_trip"] for r in got] == [True] * len(PIECE_TEXTS) + [False, True]
    own = pieces.transducer(pieces.model_path())
    the = own.encode("the")
    half = [own.bytes_[b] for b in "é".encode()]
    lists = [[], the, the * 2, half, [own.bytes_[0x41]], own.encode("  a")]
    table = spark.createDataFrame([(k, i) for k, i in enumerate([*lists, half[:1] + the, None])], "doc_id long, `my.ids` array<int>")
    back = [r["decoded"] for r in pieces.decoded(table, "my.ids").orderBy("doc_id").collect()]
    assert back[:len(lists)] == [library.decode(i) for i in lists]
    assert back[len(lists):] == ["\ufffd the", None]
