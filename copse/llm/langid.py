"""Language identification by interpolated Kneser-Ney character models.

Each language has one model over the letters of its words, with a word start
and a word end. All models share sorted arrays of n-gram hashes, one per
order, so a single binary search finds an n-gram for every language at once.
A text is in the language of lowest cross-entropy per symbol; a temperature
and a bound on the cross-entropy, both set on rows that the counts have not
seen, turn it into a score and a verdict of rejection.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from copse.llm.batches import Index, Kernel, annotate
from copse.session import ship

ORDER = 4
#: Most rows of a language that its model is fitted on, and the most languages.
FIT_ROWS = 4_000
LANGUAGES = 200
UNKNOWN = "und"
_WORD = re.compile(r"[^\W\d_]+")
START, END = "\x02", "\x03"
UNSEEN = 1.0 / 2000.0                               # share of one symbol that was never seen
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _hashed(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` symbols that end at each place, by shifted sums."""
    out = np.zeros(len(codes), np.uint64)
    for back in range(order - 1, -1, -1):
        moved = codes if not back else np.concatenate([np.zeros(back, np.uint64), codes[:-back]])
        out = (out ^ moved) * _MIX
        out ^= out >> np.uint64(29)
    return out


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words with start and end marks, the word of each, and its place in it."""
    joined = START + (END + START).join(words) + END
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    starts = np.flatnonzero(codes == ord(START))
    word = np.cumsum(codes == ord(START)) - 1
    return codes, word, np.arange(len(codes)) - starts[word]


@dataclass
class Model:
    """Sorted hashes per order, and under each a row of values with one per language."""

    languages: list[str]
    keys: list[np.ndarray]          # n-grams of order k + 1
    shares: list[np.ndarray]        # their discounted shares among what follows the context
    contexts: list[np.ndarray]      # contexts of order k + 1
    weights: list[np.ndarray]       # what they leave to the next shorter context
    rest: np.ndarray                # what the single symbols leave to unseen ones
    temperature: float = 8.0
    worst: np.ndarray | None = None  # highest cross-entropy of each language that is not rejected

    def costs(self, words: list[str]) -> np.ndarray:
        """Nats of each word, from its start to its end mark, under each language."""
        codes, word, place = symbols(words)
        held = place > 0                             # the start mark is given
        prob = np.where(held[:, None], self.rest * UNSEEN, 1.0)
        for order in range(1, ORDER + 1):
            can = held & (place >= order - 1)        # contexts stay inside the word
            if order > 1:
                ahead = np.concatenate([np.zeros(1, np.uint64), _hashed(codes, order - 1)[:-1]])[can]
                at, found = _find(self.contexts[order - 2], ahead)
                if len(self.contexts[order - 2]):
                    prob[can] *= np.where(found[:, None], self.weights[order - 2][at], 1.0)
            at, found = _find(self.keys[order - 1], _hashed(codes, order)[can])
            if len(self.keys[order - 1]):
                prob[can] += np.where(found[:, None], self.shares[order - 1][at], 0.0)
        cost = -np.log(prob)
        edges = np.flatnonzero(place == 0)
        return np.add.reduceat(cost, edges, axis=0)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def build(languages: list[str], gram: list[str], lang: np.ndarray, count: np.ndarray) -> Model:
    """Interpolated Kneser-Ney tables from counts of the longest n-grams.

    ``gram`` are the n-grams of ORDER symbols, and shorter ones where they
    begin a word. Other short n-grams count the different symbols that stand
    in front of them.
    """
    n = len(languages)
    keys, shares = [None] * ORDER, [None] * ORDER
    contexts, weights = [None] * (ORDER - 1), [None] * (ORDER - 1)
    rest = np.ones((1, n))
    level = pd.DataFrame({"gram": gram, "lang": lang, "n": np.asarray(count, float)})
    for order in range(ORDER, 0, -1):
        size = level["gram"].str.len()
        own = level[size == order].groupby(["gram", "lang"], as_index=False)["n"].sum()
        once, twice = (own["n"] == 1).sum(), (own["n"] == 2).sum()
        discount = once / (once + 2.0 * twice) if once and twice else 0.5
        own["context"] = own["gram"].str[:-1]
        own["cut"] = np.minimum(discount, own["n"])
        total = own.groupby(["context", "lang"])["n"].transform("sum")
        own["share"], own["left"] = (own["n"] - own["cut"]) / total, own["cut"] / total
        keys[order - 1], shares[order - 1] = _sorted_rows(own["gram"], own["lang"], own["share"], n, 0.0)
        left = own.groupby(["context", "lang"], as_index=False)["left"].sum()
        if order > 1:
            contexts[order - 2], weights[order - 2] = _sorted_rows(left["context"], left["lang"], left["left"], n, 1.0)
        else:
            rest[0, left["lang"].to_numpy(int)] = np.maximum(left["left"], 1e-6)
        shorter = own.assign(gram=own["gram"].str[1:], n=1.0)[["gram", "lang", "n"]]
        level = pd.concat([level[size < order], shorter])
    return Model(languages, keys, shares, contexts, weights, rest)


def _sorted_rows(grams, lang, value, n_langs: int, default: float):
    unique, at = np.unique(np.asarray(grams, dtype=object).astype(str), return_inverse=True)
    hashes = np.array([_hashed(np.frombuffer(g.encode("utf-32-le"), np.uint32).astype(np.uint64), len(g))[-1]
                       if g else np.uint64(0) for g in unique], np.uint64)
    rows = np.full((len(unique), n_langs), default)
    rows[at, np.asarray(lang, int)] = np.asarray(value, float)
    order = np.argsort(hashes)
    return hashes[order], rows[order]


def _gram_counts(rows: DataFrame) -> DataFrame:
    """(gram, lang, n) of the longest n-grams, counted per task first."""
    def run(batches) -> Iterator[pd.DataFrame]:
        from collections import Counter
        for frame in batches:
            for lang, group in frame.groupby("lang"):
                seen: Counter = Counter()
                for text in group["text"]:
                    seen.update(words_of(text))
                grams: Counter = Counter()
                for word, n in seen.items():
                    marked = START + word + END
                    for end in range(2, len(marked) + 1):
                        grams[marked[max(0, end - ORDER):end]] += n
                if grams:
                    yield pd.DataFrame({"gram": list(grams), "lang": lang, "n": list(grams.values())})
    return rows.mapInPandas(run, "gram string, lang string, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, train=None, key: str = "doc_id", rows_per_language: int = FIT_ROWS) -> Model | None:
    """A model from the rows with text and language; None if there are none.

    At most about ``rows_per_language`` rows of a language are read, chosen by
    a hash of ``key``; a tenth of them sets temperature and rejection. The
    ``LANGUAGES`` most frequent languages are learned.
    """
    ship(docs.sparkSession)
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = (rows if train is None else rows.where(train)).select(key, "text", "lang")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not sizes:
        return None
    languages = sorted(r["lang"] for r in sizes)
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], min(1.0, rows_per_language / r["n"])).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit(7), key), F.lit(1_000_000))
    rows = rows.where(drawn < share * 1_000_000)
    tenth = F.pmod(F.xxhash64(F.lit(11), key), F.lit(10))
    counts = _gram_counts(rows.where(tenth != 0)).toPandas()
    if not len(counts):
        return None
    number = {name: k for k, name in enumerate(languages)}
    model = build(languages, counts["gram"].tolist(), counts["lang"].map(number).to_numpy(), counts["n"].to_numpy())
    seen = _costed(rows.where(tenth == 0), model, ["lang"]).select("lang", "nats", "n_symbols").where("n_symbols > 0").toPandas()
    return _calibrated(model, seen) if len(seen) else model


def _calibrated(model: Model, seen: pd.DataFrame) -> Model:
    """Temperature of least log loss, and bounds that hold for 999 of 1000 texts."""
    per = np.array(seen["nats"].tolist()) / seen["n_symbols"].to_numpy()[:, None]
    truth = seen["lang"].map({name: k for k, name in enumerate(model.languages)}).to_numpy()

    def loss(temperature: float) -> float:
        return -np.log(np.maximum(_shares(per, temperature)[np.arange(len(per)), truth], 1e-12)).mean()

    model.temperature = min((2.0 ** k for k in range(0, 9)), key=loss)
    model.worst = np.full(len(model.languages), np.inf)
    for k in range(len(model.languages)):
        own = per[truth == k, k]
        if len(own) >= 20:
            model.worst[k] = np.quantile(own, 0.999) + 3 * own.std()
    return model


def _shares(per: np.ndarray, temperature: float) -> np.ndarray:
    scaled = np.exp(-temperature * (per - per.min(axis=1, keepdims=True)))
    return scaled / scaled.sum(axis=1, keepdims=True)


def _sums(model: Model):
    """From texts to nats per language and symbols scored, each word worked out once per task."""
    def make():
        index, held = Index(), np.zeros((0, len(model.languages) + 1))

        def run(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held
            words, sizes = [], []
            for text in texts:
                found = words_of(text.decode("utf-8")) if text else []
                words += found
                sizes.append(len(found))
            codes, fresh, anew = index.codes(words)
            if anew:
                held = held[:0]
            if fresh:
                # Signs like ² are word characters but no letters: they count for nothing.
                letters = np.array([any(map(str.isalpha, w)) for w in fresh])
                length = np.array([len(w) + 1 for w in fresh], float)
                held = np.vstack([held, np.column_stack([model.costs(fresh), length]) * letters[:, None]])
            row = np.repeat(np.arange(len(texts)), sizes)
            sums = np.column_stack([np.bincount(row, held[codes, k], minlength=len(texts))
                                    for k in range(held.shape[1])]) if len(texts) else held[:0]
            return sums[:, :-1], sums[:, -1]
        return run
    return make


def _costed(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    make = _sums(model)

    def kernel() -> Kernel:
        sums = make()

        def run(texts):
            nats, n = sums(texts)
            return {"nats": nats.tolist(), "n_symbols": n.astype(int)}
        return run
    return annotate(docs, "text", kernel, "nats array<double>, n_symbols long", keep)


FIELDS = "lang_pred string, score double, cross_entropy double, rejected boolean"


def identified(docs: DataFrame, model: Model | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Language, score and cross-entropy per symbol of every whole text.

    Null texts and texts without a letter are ``und`` with score 0, as are all
    texts without a model. Ties go to the first language by name. ``rejected``
    marks texts unlike any learned language, which still get the nearest one.
    Repeated rows get the same result; other columns play no part.
    """
    def kernel() -> Kernel:
        sums = _sums(model)() if model else None

        def run(texts):
            if not model:
                n = len(texts)
                return {"lang_pred": [UNKNOWN] * n, "score": [0.0] * n, "cross_entropy": [None] * n, "rejected": [True] * n}
            nats, n = sums(texts)
            per = nats / np.maximum(n, 1)[:, None]
            best = per.argmin(axis=1)
            known = n > 0
            lowest = per[np.arange(len(per)), best]
            score = _shares(per, model.temperature)[np.arange(len(per)), best]
            over = lowest > (model.worst[best] if model.worst is not None else np.inf)
            return {"lang_pred": [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)],
                    "score": np.where(known, score, 0.0),
                    "cross_entropy": [float(x) if ok else None for x, ok in zip(lowest, known)],
                    "rejected": over | ~known}
        return run
    return annotate(docs, text, kernel, FIELDS, keep or ["doc_id"])
