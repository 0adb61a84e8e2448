"""Small tables with every awkward case, and plain versions of what queries compute."""

from __future__ import annotations

import re
import zlib

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "score double, kept boolean, n_words string, shard int, spans string, slot string, ids string, `a.b` string")


def rows():
    """Nulls, empty and very long texts, ties, repeated rows, and columns named like results."""
    plain = " ".join(f"word{k} and some" for k in range(40))
    other = " ".join(f"andere{k} und wieder" for k in range(40))
    texts = [
        (1, plain, "en"), (2, plain, "en"), (2, plain, "en"), (3, other, "de"), (None, plain, None),
        (4, None, "en"), (5, "", "de"), (6, " \t\n\x0b\x0c\r ", None), (7, "one two", "en"), (8, "ONE two", "en"),
        (9, "mail a.b@c.example.org and +1 (017) 555-7713 or 192.168.0.1 card 4111 1111 1111 1111", "en"),
        (10, "long " + " ".join(f"w{k % 7919}" for k in range(120_000)), "en"),
        (11, "x" * 300_000, "en"), (12, "ДА 你好 \x00 é É ß 🎉 … ﬁ", None), (13, plain + " more", "en"),
        (14, "!!! ### $$$ | | | ²", None), (15, "same line\nsame line\nsame line\n\n", "en"),
    ]
    return [(k, t, lang, None if k == 3 else "s", None, 0.5, None, "7", 3, "x", None, "y", "z") for k, t, lang in texts]


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    own = words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(own[i:i + 5]) for i in range(max(1, len(own) - 4))) if own else frozenset()


def quality(text):
    text = text or ""
    own = words(text)
    windows = list(zip(own, own[1:], own[2:]))
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def _luhn(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, f"email:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, f"ip:{m.start()}:{m.end()}"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, f"card:{m.start()}:{m.end()}"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, f"phone:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def crc(ids):
    import numpy as np
    return zlib.crc32(np.array(ids, "<u4").tobytes())
