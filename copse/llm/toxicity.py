"""Toxicity from a weighted lexicon, matched by Aho-Corasick over folded text.

Folding undoes what hides a word: case, accents, look-alike letters of other
alphabets, digits for letters. The lexicon is learned from labelled rows: a
word counts by its log odds of toxic against clean texts, once it stands in
enough texts beside enough different words (copies of one text count once, as
they repeat the same neighbours). Matches inside an exception phrase are
void. The sum of weights and its rate per word go through a logistic curve.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from copse.llm.batches import Kernel, annotate, tidy
from copse.session import ship, written

#: Letters of other alphabets that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
    "χ": "x", "ω": "w", "ı": "i", "ɡ": "g", "ø": "o", "đ": "d", "ł": "l",
}
#: Digits and signs written for letters. ``l`` folds to ``i`` too, since ``1`` stands for both.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i"}
_FOLD = str.maketrans(HOMOGLYPHS | DIGITS)
_MARKS = re.compile("[̀-ͯ]+")
_HIDDEN = re.compile("[​-‍⁠﻿­]+")
_TOKEN = re.compile(r"[^\W_]+")

#: Phrases in which a listed word is meant otherwise.
EXCEPTIONS = ("trash can", "trash bin", "scum line", "pond scum", "clown fish", "stupid mistake of mine")

#: Most labelled rows of a class that a lexicon is learned from, and most words it holds.
LEARN_ROWS = 20_000
LEXICON_WORDS = 5_000
CURVE_ROWS = 10_000


def fold(text: str) -> str:
    """Text as the matcher sees it; ß stays one letter, so words keep their bounds."""
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", _HIDDEN.sub("", text)))
    return text.lower().translate(_FOLD)


@dataclass(frozen=True)
class Lexicon:
    """Folded words with weights, void phrases, and the curve from sums to a score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (-3.0, 1.0, 1.0)      # bias, sum of weights, rate per word
    folded: tuple[str, ...] = field(init=False, default=())

    def __post_init__(self):
        object.__setattr__(self, "folded", tuple(fold(p) for p in self.exceptions))

    def automaton(self):
        found = ahocorasick.Automaton()
        for word, weight in self.weights.items():
            found.add_word(word, (len(word), weight))
        for phrase in self.folded:
            found.add_word(phrase, (len(phrase), 0.0))
        if len(found):
            found.make_automaton()
        return found


def _matches(automaton, text: str) -> tuple[float, int]:
    """Sum of weights and number of whole-word matches outside exception phrases."""
    if not len(automaton):
        return 0.0, 0
    hits, void, size = [], [], len(text)
    for end, (length, weight) in automaton.iter(text):
        start = end - length + 1
        if (start and text[start - 1].isalnum()) or (end + 1 < size and text[end + 1].isalnum()):
            continue
        (hits if weight else void).append((start, end, weight))
    if void:
        hits = [h for h in hits if not any(v[0] <= h[0] and h[1] <= v[1] for v in void)]
    return sum(h[2] for h in hits), len(hits)


def features(total: float, n_words: int) -> tuple[float, float]:
    """What the curve reads: the sum, and the sum per thousand words, both damped."""
    return math.log1p(total), math.log1p(1000.0 * total / max(n_words, 20))


def _scorer(lexicon: Lexicon):
    def make() -> Kernel:
        automaton = lexicon.automaton()
        bias, by_sum, by_rate = lexicon.curve

        def run(texts: list[bytes | None]) -> dict[str, list]:
            out: dict[str, list] = {"score": [], "n_matches": [], "weight": [], "n_words": []}
            for raw in texts:
                text = fold(raw.decode("utf-8")) if raw else ""
                total, n = _matches(automaton, text)
                n_words = text.count(" ") + text.count("\n") + 1 if text else 0
                a, b = features(total, n_words)
                out["score"].append(1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, bias + by_sum * a + by_rate * b)))))
                out["n_matches"].append(n)
                out["weight"].append(total)
                out["n_words"].append(n_words)
            return out
        return run
    return make


FIELDS = "score double, n_matches long, weight double, n_words long"


def scored(docs: DataFrame, lexicon: Lexicon, text: str = "text", keep: list[str] | None = None,
           into: str | None = None) -> DataFrame:
    """Score of every whole text under a lexicon.

    Null and empty texts have no match and get the score of that; an empty
    table gives none; repeated rows score alike; other columns play no part.
    """
    return annotate(docs, text, _scorer(lexicon), FIELDS, keep or ["doc_id"], into)


def _bounded_rows(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most about ``most`` rows of each class, chosen by a hash of the key."""
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for toxic in (0, 1):
        share = F.when(F.col("toxic") == toxic, min(1.0, most / max(1, sizes.get(toxic, 0)))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < share * 1_000_000)


def _word_counts(rows: DataFrame) -> DataFrame:
    """Per word: toxic and clean texts with it, and among how many kinds of
    neighbours (of 64, by hash) it stands in toxic texts. Each task counts first."""
    def run(batches) -> Iterator[pd.DataFrame]:
        for frame in batches:
            counts: dict[str, list[int]] = {}
            for text, toxic in zip(frame["text"], frame["toxic"]):
                words = _TOKEN.findall(fold(text or ""))
                for word in set(words):
                    counts.setdefault(word, [0, 0, 0])[toxic] += 1
                if toxic:
                    for word, near in zip(words, ["^"] + words):
                        counts[word][2] |= 1 << (zlib.crc32(near.encode()) & 63)
            held = [(w, c, t, m - (m >> 63 << 64)) for w, (c, t, m) in counts.items() if len(w) > 2]
            if held:
                yield pd.DataFrame(held, columns=["word", "n_clean", "n_toxic", "near"])
    return rows.mapInPandas(tidy(run), "word string, n_clean long, n_toxic long, near long").groupBy("word").agg(
        F.sum("n_clean").alias("n_clean"), F.sum("n_toxic").alias("n_toxic"),
        F.bit_count(F.bit_or("near")).alias("n_near"))


def learn(docs: DataFrame, labels: DataFrame, train=None, min_near: int = 5, min_odds: float = 3.0,
          exceptions: tuple[str, ...] = EXCEPTIONS, most_rows: int = LEARN_ROWS) -> Lexicon:
    """A lexicon from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    ``train`` is a condition on doc_id. At most ``most_rows`` rows of a class
    are read, chosen by a hash. Rows without text or label are left out; with
    no row of either class the lexicon is empty and all score low.
    """
    ship(docs.sparkSession)
    marks = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").distinct()
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    marks = _bounded_rows(marks if train is None else marks.where(train), "doc_id", most_rows)
    # The drawn labels are bounded by ``most_rows``, whatever the size of the tables.
    rows = written(rows.join(F.broadcast(marks), "doc_id"), "toxic-learn")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({}, exceptions)
    words = _word_counts(rows)
    odds = F.log(((F.col("n_toxic") + 0.5) / (n_toxic + 1)) / ((F.col("n_clean") + 0.5) / (n_clean + 1)))
    best = (words.where(F.col("n_near") >= min_near).withColumn("odds", odds).where(F.col("odds") >= min_odds)
            .orderBy(F.desc("odds"), "word").limit(LEXICON_WORDS).collect())
    lexicon = Lexicon({r["word"]: float(r["odds"]) for r in best}, exceptions)
    if not best:
        return lexicon
    few = _bounded_rows(rows.select("doc_id", "text", "toxic"), "doc_id", CURVE_ROWS)
    seen = scored(few, lexicon, keep=["toxic"]).select("toxic", "weight", "n_words").toPandas()
    return Lexicon(lexicon.weights, exceptions, _curve(seen))


def _curve(seen: pd.DataFrame) -> tuple[float, float, float]:
    """Logistic fit, with a small penalty, of the label on the two features.

    However many labelled rows are toxic, a text without a match scores 0.2 at most.
    """
    x = np.array([(1.0, *features(w, n)) for w, n in zip(seen["weight"], seen["n_words"])])
    y = seen["toxic"].to_numpy(float)
    beta = np.zeros(3)
    penalty = np.diag([1e-3, 1e-2, 1e-2]) * max(1.0, len(y) / 1000)
    for _ in range(30):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty
        beta = beta + np.linalg.solve(hessian, x.T @ (y - p) - penalty @ beta)
    return min(float(beta[0]), math.log(0.2 / 0.8)), float(beta[1]), float(beta[2])


def held_out(key: str = "doc_id"):
    """Rows that no model may learn from."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2
