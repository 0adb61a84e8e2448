"""Byte-level BPE by the ``tokenizers`` library over Arrow batches, and back.

A file of ranks (base64 bytes, rank) becomes a library tokenizer: bytes are
written as printable characters, and every token of two bytes or more gets the
merge that makes it. A text is cut where white space begins, each different
part is encoded once per task, and ids of texts are put together from those of
their parts. Decoding takes the bytes of each id by the reversed table; a
character split over several ids comes back whole as its bytes meet again.

Defined results: a null text counts as empty and gives no ids; repeated rows
give equal rows; an empty table gives no rows; kept columns may have any name
and give way to a result of the same name; texts of any length are taken whole.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from copse.llm.batches import Flat, Index, annotate, free_name, named
from copse.session import ship

#: Fixed value: the rank file of the query; a parameter everywhere else.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of different parts that a task keeps encoded before it starts over.
HELD_BYTES = 32 << 20
#: Ids that are decoded at once.
DECODE_IDS = 1 << 20


def ranks_path(name: str = RANKS) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where Latin-1 prints it, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge completes ``token`` when its own bytes are merged by rank; None if they never do."""
    parts = [token[k:k + 1] for k in range(len(token))]
    while len(parts) > 2:
        found = [(ranks.get(a + b, len(ranks)), k) for k, (a, b) in enumerate(zip(parts, parts[1:]))]
        rank, at = min(found)
        if rank == len(ranks):
            return None
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return tuple(parts) if len(parts) == 2 else None


def library_tokenizer(path: str) -> str:
    """The library's tokenizer for a rank file, in its own JSON.

    Inside any text, merges within the bytes of a token come in the order they
    have in the token alone, so one merge per token is enough. A part that is a
    token as it stands is taken at once, as ranks imply.
    """
    from tokenizers import Tokenizer, models, pre_tokenizers
    ranks, shown = read_ranks(path), byte_characters()

    def text(token: bytes) -> str:
        return "".join(shown[b] for b in token)

    merges = [last_merge(token, ranks) for token in sorted(ranks, key=ranks.get)]
    model = models.BPE(vocab={text(token): rank for token, rank in ranks.items()},
                       merges=[(text(m[0]), text(m[1])) for m in merges if m], ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
    return tokenizer.to_str()


_SPACE = rb"\x20\x09-\x0D"
_PART = re.compile(rb"[" + _SPACE + rb"]*[^" + _SPACE + rb"]+|[" + _SPACE + rb"]+")
#: White space outside ASCII, as UTF-8.
_WIDE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_WIDE_END = re.compile(rb"(?:" + _WIDE.pattern + rb")\Z")


def parts_of(text: bytes) -> list[bytes]:
    """A text cut where runs of white space begin.

    No match of the splitting pattern reaches into white space from before it,
    and none looks back, so each part is split as it is within the text.
    """
    parts = _PART.findall(text)
    if not _WIDE.search(text):
        return parts
    joined: list[bytes] = []
    for part in parts:                       # a run of white space that began before ASCII's
        if joined and _WIDE_END.search(joined[-1][-3:]):
            joined[-1] += part
        else:
            joined.append(part)
    return joined


class Codec:
    """Encodes and decodes with one tokenizer, given as the library's JSON."""

    def __init__(self, made: str, limit: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(made)
        self.index, self.flat, self.held = Index(limit), Flat(), 0
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        tokens = {rank: bytes(byte_of[c] for c in token) for token, rank in self.tokenizer.get_vocab().items()}
        listed = [tokens.get(k, b"") for k in range(max(tokens, default=-1) + 1)]
        self.sizes = np.fromiter(map(len, listed), np.int64, len(listed))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(listed), np.uint8)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        parts: list[bytes] = []
        n_parts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            own = parts_of(text) if text else []
            parts += own
            n_parts[k] = len(own)
        if self.held > HELD_BYTES:
            self.index.clear()
        codes, fresh, anew = self.index.codes(parts)
        if anew:
            self.flat.clear()
            self.held = 0
        for k in range(0, len(fresh), 20_000):
            found = self.tokenizer.encode_batch_fast([p.decode("utf-8") for p in fresh[k:k + 20_000]],
                                                     add_special_tokens=False)
            self.flat.add([e.ids for e in found])
        self.held += sum(map(len, fresh))
        ids, sizes = self.flat.take(codes)
        row = np.repeat(np.arange(len(texts)), n_parts)
        return ids, np.bincount(row, sizes, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for; ids outside the vocabulary stand for none."""
        out = []
        for k in range(0, len(ids), DECODE_IDS):
            own = ids[k:k + DECODE_IDS].astype(np.int64)
            own = own[(own >= 0) & (own < len(self.sizes))]
            sizes = self.sizes[own]
            first = np.repeat(self.starts[own] - (np.cumsum(sizes) - sizes), sizes)
            out.append(self.bytes[first + np.arange(len(first))].tobytes())
        return b"".join(out)

    def offsets(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each id stands in the text, in code points; ids of one split character all have its place."""
        lead = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        ends = np.cumsum(self.sizes[ids])
        return lead[ends - self.sizes[ids]] - 1, lead[ends - 1]


_CODECS: dict[str, Codec] = {}


def codec(made: str) -> Codec:
    """The codec of this worker, kept from task to task."""
    key = hashlib.sha256(made.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(made)
    return _CODECS[key]


def _shared(df: DataFrame, path: str | None):
    """The tokenizer made once and broadcast; its size is that of the vocabulary."""
    ship(df.sparkSession)
    return df.sparkSession.sparkContext.broadcast(library_tokenizer(path or ranks_path()))


def encoded(df: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None,
            offsets: bool = False) -> DataFrame:
    """``keep`` with ``ids``, and with ``offsets`` the code points ``starts`` and ``ends`` of each id."""
    made = _shared(df, path)

    def kernel() -> Callable:
        own = codec(made.value)

        def run(texts: list[bytes | None]) -> dict[str, object]:
            ids, sizes = own.encode(texts)
            lists = np.split(ids, np.cumsum(sizes)[:-1])
            out: dict[str, object] = {"ids": lists}
            if offsets:
                places = [own.offsets(t or b"", i) for t, i in zip(texts, lists)]
                out |= {"starts": [p[0] for p in places], "ends": [p[1] for p in places]}
            return out
        return run

    fields = "ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")
    return annotate(df, text, kernel, fields, ["doc_id"] if keep is None else keep)


def decoded(df: DataFrame, ids: str = "ids", path: str | None = None, into: str = "decoded") -> DataFrame:
    """All columns and the text of ``ids``; bytes that form no character read as U+FFFD.

    Ids may be cut anywhere: the bytes of a character split over rows are in
    the column ``<into>_bytes``, whose values concatenate to the whole. Null
    ids give null; null and unknown ids among them stand for nothing.
    """
    made = _shared(df, path)

    @F.pandas_udf("bytes binary, text string")
    def back(lists: pd.Series) -> pd.DataFrame:
        own = codec(made.value)
        raw = [None if i is None else own.decode(np.array([x for x in i if x is not None and x == x], np.int64))
               for i in lists]
        return pd.DataFrame({"bytes": raw, "text": [None if r is None else r.decode("utf-8", "replace") for r in raw]})

    box = free_name(df, "_back")
    return df.withColumn(box, back(named(ids)[0])).withColumns(
        {f"{into}_bytes": F.col(f"{box}.bytes"), into: F.col(f"{box}.text")}).drop(box)


def digests(df: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` with ``n_tokens``, SHA-256 of the ids and of the bytes decoded from them, and ``round_trip``."""
    made = _shared(df, path)

    def kernel() -> Callable:
        own = codec(made.value)

        def run(texts: list[bytes | None]) -> dict[str, object]:
            ids, sizes = own.encode(texts)
            lists = np.split(ids, np.cumsum(sizes)[:-1])
            ends = [0, *accumulate(int(own.sizes[i].sum()) for i in lists)]
            back = own.decode(ids)                       # every id of the batch, cut by text again
            texts_back = [back[a:b] for a, b in zip(ends, ends[1:])]
            return {"n_tokens": sizes,
                    "ids_sha256": [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in lists],
                    "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in texts_back],
                    "round_trip": [b == (t or b"") for b, t in zip(texts_back, texts)]}
        return run

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return annotate(df, text, kernel, fields, ["doc_id"] if keep is None else keep)
