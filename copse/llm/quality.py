"""Quality rules as a ledger of failure bits, with policies read off the bits.

Every rule is evaluated once per text. The ledger keeps the measurements and
one bit per failed rule; a policy is a mask of rules under a version name, so
a changed policy, a comparison of policies or the ablation of one rule reads
the ledger only and never the texts again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from copse.llm.batches import Kernel, annotate, free_name, named

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"

MEASURES = ("n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, "
            "n_repeat_words long, n_upper long, n_letters long, n_marks long")

#: Name of each rule and when it fails, by bit; ``m`` gives the column of a measurement.
RULES: tuple[tuple[str, Callable[[Callable[[str], Column]], Column]], ...] = (
    ("few_words", lambda m: m("n_words") < 50),
    ("repeated_windows", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words")),
    ("symbols", lambda m: 10 * m("n_symbols") > 3 * m("n_words")),
    ("repeated_lines", lambda m: 2 * m("n_dup_lines") > m("n_lines")),
    ("shouting", lambda m: 2 * m("n_upper") > m("n_letters")),
    ("exclamations", lambda m: 2 * m("n_marks") > m("n_words")),
    ("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 25 * m("n_words"))),
    ("too_long", lambda m: m("n_words") > 100_000),
)
BASE_RULES = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version of the rules in force: a text is kept if it fails none of them."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        names = [name for name, _ in RULES]
        return sum(1 << names.index(rule) for rule in self.rules)


BASE = Policy("base-1", BASE_RULES)
STANDARD = Policy("standard-1", BASE_RULES + ("symbols", "repeated_lines", "shouting", "exclamations", "word_length"))
#: As the standard, and without very long texts.
SHORT = Policy("short-1", STANDARD.rules + ("too_long",))


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found = Counter(windows)
    total, covered = 0, 0                       # covered: end of what is counted
    for k, window in enumerate(windows):
        if found[window] > 1:
            total += k + 3 - max(k, covered)
            covered = k + 3
    return total


def _dup_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return len(lines), len(lines) - len(set(lines))


def measure(texts: list[bytes | None]) -> dict[str, list[int]]:
    """The measurements of each text; null counts as empty."""
    out: dict[str, list[int]] = {f.split()[0]: [] for f in MEASURES.split(", ")}
    for text in texts:
        text = text or b""
        words = text.split()                    # bytes split at SPACES exactly
        joined = b"".join(words)
        chars = joined.decode("utf-8")
        n_lines, n_dup = _dup_lines(text)
        out["n_words"].append(len(words))
        out["word_chars"].append(len(chars))
        out["n_symbols"].append(len(joined) - len(joined.translate(None, SYMBOLS)))
        out["n_lines"].append(n_lines)
        out["n_dup_lines"].append(n_dup)
        out["n_repeat_words"].append(_repeat_words(words))
        ascii_upper = len(joined) - len(joined.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        ascii_lower = len(joined) - len(joined.translate(None, b"abcdefghijklmnopqrstuvwxyz"))
        out["n_upper"].append(ascii_upper)
        out["n_letters"].append(ascii_upper + ascii_lower)
        out["n_marks"].append(joined.count(b"!"))
    return out


def _kernel() -> Kernel:
    return measure


def failure_bits(m: Callable[[str], Column] = F.col) -> Column:
    """One bit per failed rule."""
    bits = F.lit(0).cast("long")
    for bit, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(fails(m), F.lit(1 << bit)).otherwise(0).cast("long"))
    return bits


def ledger(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Measurements and ``failed_bits`` of every text, beside the columns ``keep``.

    Null texts count as empty and fail for want of words; an empty table gives
    an empty ledger; repeated rows are measured each on its own; columns that
    are not kept, whatever their names, play no part.
    """
    rows = annotate(docs, text, _kernel, MEASURES, keep or ["doc_id"])
    return rows.withColumn("failed_bits", failure_bits())


def passes(policy: Policy, bits: str | Column = "failed_bits") -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def filtered(docs: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, in all their columns."""
    box = free_name(docs, "_measured")
    rows = annotate(docs, text, _kernel, MEASURES, docs.columns, box)
    return rows.where(passes(policy, failure_bits(lambda name: F.col(f"{box}.{name}")))).select(*named(*docs.columns))


def judged(rows: DataFrame, *policies: Policy) -> DataFrame:
    """The ledger with a verdict column ``kept_<version>`` per policy."""
    return rows.withColumns({f"kept_{p.version}": passes(p) for p in policies})


def ablations(rows: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy does: texts it fails, texts only it rejects,
    and texts kept without it.

    Texts are first counted by their bits, so at most ``2 ** len(RULES)`` rows
    pass the shuffle whatever the size of the ledger.
    """
    held = F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
    by_bits = rows.groupBy(held.alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(1 << bit).cast("long").alias("one"))
                                for bit, (name, _) in enumerate(RULES) if policy.mask >> bit & 1]))
    each = by_bits.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    count = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(
        count(F.col("bits").bitwiseAND(F.col("one")) != 0).alias("n_failed"),
        count(F.col("bits") == F.col("one")).alias("n_only"),
        count(F.col("bits").bitwiseAND(F.bitwise_not("one")) == 0).alias("n_kept_without"))
