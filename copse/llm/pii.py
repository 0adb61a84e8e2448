"""Personal data by pattern, and terms that reveal it by co-occurrence.

Patterns find e-mail addresses, IP addresses, card and phone numbers: the
protected entities. A term discloses an entity as far as seeing the term
tells of the entity: their pointwise mutual information against all the
information in the entity, ``-log2 p(entity)``. All counts come from the whole
corpus and are in one unit, different texts, so that copies of a text count
once on either side. Besides, a term must stand in several different contexts
(the words around a mention). Terms over the threshold are generalised, like
the entities, wherever they stand.

A term is a run of letters and digits of any length, in lower case. Where a
script sets no spaces, a run up to the next mark is one term, and signs that
combine with letters end one.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from copse.llm.batches import Index, Kernel, annotate, free_name, named
from copse.session import ship, written

KINDS = ("email", "ip", "card", "phone", "term")
PLACEHOLDER = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

#: A context reaches on either side of a mention to the tenth word of four or more characters;
#: shorter words on the way belong to it. Words further away are no evidence.
CONTEXT_WORDS = 10
LONG_WORD = 4
#: Words of any length that a side of a context has at most, as many as 400 characters can hold.
CONTEXT_REACH = 200
#: Contexts that a term must share with an entity before it counts as evidence.
MIN_CONTEXTS = 3
#: Share of an entity's information that a term may not reach.
DISCLOSURE = 0.85
#: Bits of the filter that lets only words worth a look pass a shuffle; a full filter lets all pass.
FILTER_BITS = 1 << 20
#: Bits of the filter over texts that stand in several rows; other texts pass no shuffle to count once.
COPY_BITS = 1 << 22

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W_]+")

Span = tuple[int, int, int]                          # start, end, number of kind


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the run of local characters before each ``@`` that has a domain behind it."""
    free = 0                                         # end of the match before
    for found in _DOMAIN.finditer(text):
        start = at = found.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            free = found.end()
            yield start, free


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = 2 * n - 9 if n > 4 else 2 * n
        total += n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns by start, then kind; each kind leftmost and without overlap."""
    out: list[Span] = []
    if "@" in text:
        out += [(a, b, 0) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m.group().split("."))):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode()) - (1 << 63)


def text_hash(text: bytes) -> int:
    """As ``xxhash64`` of Spark."""
    found = xxhash.xxh64_intdigest(text, 42)
    return found - (1 << 64) if found >> 63 else found


def folded(text: str) -> str:
    """In lower case, as long as the text itself: the few letters that grow stay as they are."""
    lower = text.lower()
    return lower if len(lower) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def contexts(text: str, spans: list[Span]) -> Iterator[tuple[int, int, list[int], int]]:
    """Per mention: hash of the entity, hash of its context, hashes of the context's terms, and how many of
    these are whole words of the text, which come first."""
    if not spans:
        return
    lower = folded(text)
    found = [m.span() for m in _TERM.finditer(lower)]
    starts, ends = [a for a, _ in found], [b for _, b in found]
    long = [k for k, (a, b) in enumerate(found) if b - a >= LONG_WORD]
    for start, end, kind in spans:
        stop, go = bisect_right(ends, start), bisect_left(starts, end)
        near, far = bisect_left(long, stop), bisect_left(long, go) + CONTEXT_WORDS
        first = max(long[near - CONTEXT_WORDS] if near >= CONTEXT_WORDS else 0, stop - CONTEXT_REACH)
        last = min(long[far - 1] + 1 if far <= len(long) else len(found), go + CONTEXT_REACH)
        before = [lower[a:b] for a, b in found[first:stop]]
        after = [lower[a:b] for a, b in found[go:last]]
        whole = set(before + after)
        if stop < len(found) and starts[stop] < start:           # words that run into the mention
            before.append(lower[starts[stop]:start])
        if go and ends[go - 1] > end:
            after.insert(0, lower[end:ends[go - 1]])
        value = text[start:end].lower()
        if kind >= 2:
            value = re.sub(r"[^0-9]", "", value)
        terms = sorted(whole) + sorted(set(before + after) - whole)
        yield word_hash(f"{kind}:{value}"), word_hash(" ".join(before + ["|"] + after)), [word_hash(t) for t in terms], len(whole)


def _mentions(docs: DataFrame, text: str) -> DataFrame:
    """(text, entity, contexts) of every text, by hash, and each entity in it."""
    def kernel() -> Kernel:
        def run(texts):
            out = []
            for raw in texts:
                own = raw.decode("utf-8") if raw else ""
                spans = base_spans(own)
                by: dict[int, list[dict]] = {}
                for entity, context, terms, whole in contexts(own, spans):
                    by.setdefault(entity, []).append({"context": context, "terms": terms, "whole": whole})
                out.append([{"text": text_hash(raw), "entity": e, "contexts": m} for e, m in by.items()])
            return {"m": out}
        return run
    rows = annotate(docs, text, kernel, "m array<struct<text: long, entity: long, "
                    "contexts: array<struct<context: long, terms: array<long>, whole: int>>>>", [])
    return rows.select(F.explode("m").alias("m")).select("m.*")


def _bits(rows, size: int) -> np.ndarray:
    bits = np.zeros(size // 64, np.int64)
    for r in rows:
        bits[r["w"]] = r["b"]
    return bits.view(np.uint64)


def _slot(column: str, size: int):
    """Number of a hash's word in a bitmap, and the word with its bit."""
    slot = F.pmod(F.col(column), F.lit(size))
    return F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod({column}, {size}) & 63 as int))")


def _filter_of(terms: DataFrame, column: str) -> np.ndarray:
    """A bitmap over hashes of ``column``; its size is fixed whatever the table holds."""
    word, bit = _slot(column, FILTER_BITS)
    return _bits(terms.groupBy(word).agg(F.bit_or(bit).alias("b")).collect(), FILTER_BITS)


def _copies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Number of different texts, and a bitmap over the hashes of those that stand in several rows."""
    own = named(text)[0]
    each = docs.where(own.isNotNull()).groupBy(F.xxhash64(own).alias("text")).agg(F.count("*").alias("n"))
    word, bit = _slot("text", COPY_BITS)
    rows = each.groupBy(word).agg(F.count("*").alias("n"), F.bit_or(F.when(F.col("n") > 1, bit).otherwise(F.lit(0).cast("long"))).alias("b")).collect()
    return sum(r["n"] for r in rows), _bits(rows, COPY_BITS)


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = np.mod(hashes, 64 * len(bits))
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


class _Passing:
    """Hashes of words that pass a filter, each word worked out once per task."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.index, self.hashes = bits, Index(), np.zeros(0, np.int64)
        self.passes = np.zeros(0, bool)

    def look(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, fresh, anew = self.index.codes(words)
        if anew:
            self.hashes, self.passes = self.hashes[:0], self.passes[:0]
        if fresh:
            hashes = np.fromiter(map(word_hash, fresh), np.int64, len(fresh))
            self.hashes = np.concatenate([self.hashes, hashes])
            self.passes = np.concatenate([self.passes, _in(self.bits, hashes)])
        return self.hashes[codes], self.passes[codes]


def _text_counts(docs: DataFrame, text: str, bits: np.ndarray, copies: np.ndarray) -> DataFrame:
    """(term, n_texts) of the terms that pass the filter, in different texts.

    Texts that have no copy are counted per batch first; the others come with
    their hash, and a term counts once for each hash.
    """
    def kernel() -> Kernel:
        passing = _Passing(bits)

        def run(texts):
            words, rows = [], []
            for raw in texts:
                own = _TERM.findall(folded(raw.decode("utf-8"))) if raw else []
                words += own
                rows.append(len(own))
            hashes, ok = passing.look(words)
            row = np.repeat(np.arange(len(texts)), rows)[ok]
            terms, term = np.unique(hashes[ok], return_inverse=True)
            pairs = np.unique(row * len(terms) + term)
            row, term = pairs // max(len(terms), 1), pairs % max(len(terms), 1)
            keys, key = np.unique(np.fromiter((text_hash(raw) if raw else 0 for raw in texts), np.int64, len(texts)), return_inverse=True)
            again = _in(copies, keys)[key[row]]
            n = np.bincount(term[~again], minlength=len(terms))
            first = [{"text": None, "term": a, "n": b} for a, b in zip(terms.tolist(), n.tolist()) if b]
            held = np.unique(key[row[again]] * len(terms) + term[again])
            first += [{"text": int(keys[k // len(terms)]), "term": int(terms[k % len(terms)]), "n": 1} for k in held.tolist()]
            return {"c": [first] + [[]] * (len(texts) - 1)}
        return run
    rows = annotate(docs, text, kernel, "c array<struct<text: long, term: long, n: long>>", [])
    once = rows.select(F.explode("c").alias("c")).groupBy("c.text", "c.term").agg(F.sum("c.n").alias("n"))
    return once.groupBy("term").agg(F.sum(F.when(F.col("text").isNull(), F.col("n")).otherwise(1)).alias("n_texts"))


def disclosing_terms(docs: DataFrame, text: str = "text", threshold: float = DISCLOSURE,
                     min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """(term, entity, n_both, n_contexts, n_entity, n_texts, share) of the terms over the threshold.

    ``n_both``, ``n_entity`` and ``n_texts`` are numbers of different texts:
    with the term in a context of the entity, with the entity, with the term.
    ``n_contexts`` is the number of different contexts of the entity with the
    term. ``share`` is the part of the entity's information that the term gives
    away. All texts count. Null texts, texts without an entity and empty
    tables add nothing.
    """
    ship(docs.sparkSession)
    n, copies = _copies(docs, text)
    seen = written(_mentions(docs, text).distinct(), "mentions")
    entities = seen.groupBy("entity").agg(F.count("*").alias("n_entity"))
    around = seen.select("entity", F.explode("contexts").alias("c")).select(
        "entity", "c.context", F.array_sort("c.terms").alias("terms")).distinct()
    evidence = around.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(
        F.count("*").alias("n_contexts")).where(F.col("n_contexts") >= min_contexts)
    texts = seen.select("entity", F.explode(F.expr("array_distinct(flatten(contexts.terms))")).alias("term")).groupBy(
        "entity", "term").agg(F.count("*").alias("n_both"))
    near = seen.select("text", F.explode(F.expr(
        "array_distinct(flatten(transform(contexts, c -> slice(c.terms, 1, c.whole))))")).alias("term")).distinct().groupBy(
        "term").agg(F.count("*").alias("n_near"))

    def share(n_texts):
        """Falls as ``n_texts`` grows."""
        # p(entity) is at most a half, so that an entity in every text still has information.
        p = F.least(F.col("n_entity") / F.lit(float(max(n, 2))), F.lit(0.5))
        return F.log2(F.least(F.col("n_both"), n_texts) / n_texts / p) / -F.log2(p)

    # A term stands in as many texts at least as it stands in near any entity: words that stay below
    # the threshold with that number, as common ones do, need no count over the corpus.
    both = evidence.join(texts, ["entity", "term"]).join(entities, "entity").join(near, "term", "left").where(
        share(F.coalesce("n_near", F.lit(1))) >= threshold).drop("n_near")
    both = written(both, "disclosing")
    counts = _text_counts(docs, text, _filter_of(both.select("term"), "term"), copies)
    return both.join(counts, "term").withColumn("share", share(F.col("n_texts"))).where(F.col("share") >= threshold)


def _spans_kernel(bits: np.ndarray | None):
    def kernel() -> Kernel:
        passing = _Passing(bits) if bits is not None and bits.any() else None

        def run(texts):
            spans, maybe = [], []
            for raw in texts:
                own = raw.decode("utf-8") if raw else ""
                spans.append([{"start": a, "end": b, "kind": k} for a, b, k in base_spans(own)])
                hits = []
                if passing and own:
                    lower = folded(own)
                    hashes, ok = passing.look(_TERM.findall(lower))
                    if ok.any():
                        hits = [{"term": int(h), "start": m.start(), "end": m.end()}
                                for m, h, good in zip(_TERM.finditer(lower), hashes, ok) if good]
                maybe.append(hits)
            return {"spans": spans, "maybe": maybe}
        return run
    return kernel


_FIELDS = ("spans array<struct<start: long, end: long, kind: int>>, "
           "maybe array<struct<term: long, start: long, end: long>>")


def found(docs: DataFrame, text: str = "text", keep: list[str] | None = None, into: str = "spans",
          threshold: float = DISCLOSURE, min_contexts: int = MIN_CONTEXTS) -> DataFrame:
    """Columns ``keep`` and ``into``: all spans of each text by start, then kind.

    Null texts count as empty. Rows, repeated ones too, keep their own spans,
    whatever their keys; a kept column named like a result gives way.
    """
    keep = ["doc_id"] if keep is None else keep
    terms = written(disclosing_terms(docs, text, threshold, min_contexts).select("term").distinct(), "terms")
    box = free_name(docs, "_pii")
    row = free_name(docs, "_row")
    rows = annotate(docs, text, _spans_kernel(_filter_of(terms, "term")), _FIELDS, keep, box)
    rows = written(rows.withColumn(row, F.monotonically_increasing_id()), "spans")
    maybe = rows.select(row, F.explode(f"{box}.maybe").alias("m")).select(row, "m.*")
    # Per text the list is as long as the text at most.
    sure = maybe.join(terms, "term").groupBy(row).agg(F.collect_list(F.struct(
        "start", "end", F.lit(KINDS.index("term")).alias("kind"))).alias("_more"))
    ordered = F.expr(f"""array_sort(concat({box}.spans, coalesce(_more, array())), (a, b) -> case
        when a.start < b.start then -1 when a.start > b.start then 1
        when a.kind < b.kind then -1 when a.kind > b.kind then 1 else 0 end)""")
    return rows.join(sure, row, "left").select(*named(*[c for c in keep if c != into]), ordered.alias(into))


def listed(spans: str = "spans", base_only: bool = False):
    """Spans as ``kind:start:end`` joined by commas."""
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    kept = f"filter({spans}, s -> s.kind < 4)" if base_only else spans
    return F.expr(f"array_join(transform({kept}, s -> concat_ws(':', element_at({names}, s.kind + 1), s.start, s.end)), ',')")


def count_of(kind: str, spans: str = "spans"):
    return F.expr(f"cast(size(filter({spans}, s -> s.kind = {KINDS.index(kind)})) as long)")


def sanitised(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """``docs`` with every span replaced by the name of its kind; overlapping spans become one.

    Null texts stay null.
    """
    spans = free_name(docs, "_spans")
    rows = found(docs, text, docs.columns, spans, **how)

    clean = F.pandas_udf(lambda t, s: pd.Series([replaced(a, b) for a, b in zip(t, s)]), "string")
    some = F.size(spans) > 0
    return rows.withColumn(text, F.when(some, clean(F.col(text), F.col(spans))).otherwise(F.col(text))).select(*named(*docs.columns))


def replaced(text: str | None, spans) -> str | None:
    if text is None or spans is None or not len(spans):
        return text
    out, at = [], 0
    for span in spans:
        start, end, kind = (span["start"], span["end"], span["kind"])
        if start >= at:
            out += [text[at:start], PLACEHOLDER[KINDS[kind]]]
        at = max(at, end)
    return "".join(out) + text[at:]

