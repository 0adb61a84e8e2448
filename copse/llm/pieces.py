"""SentencePiece encoding as a shortest path through a transducer.

The transducer is compiled from the model file: the normaliser (white space
to ``▁``, with one in front), an arc per piece, and byte arcs for characters
without a piece. Its states remember the piece before: in a model of merges an
arc is open after those pieces only beside which the merges would leave it as
it is; all others weigh infinity. Open arcs weigh minus the piece's score,
so the tropical shortest path through the composition with a text is the
encoding, and for a model of merges it is the one that the library gives. No
piece crosses from a letter to a following ``▁``, so a text is composed word
by word, and each different word once per task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from copse.llm.batches import Flat, Index, Kernel, annotate, named
from copse.session import ship

SPACE = "▁"
#: Fixed value: the model file of the query; a parameter everywhere else.
MODEL = "piece_bpe_32k.model"
#: Marks a part that follows the one before it without a space.
JOINED = "\x00"
_ENDING = re.compile("(?<=[A-Za-z0-9\u00c0-\u00ff])([.,;:!?]+)(?= |\\Z)")
#: Weight of a character in bytes: over any piece.
FALLBACK = 1e6


def model_path(name: str = MODEL) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@dataclass
class Transducer:
    """Compiled model: pieces with ids and weights, byte ids, and how pieces come about."""

    ids: dict[str, int]
    weights: dict[str, float]
    bytes_: list[int]                # id of each byte piece, -1 without fallback
    unknown: int
    dummy_prefix: bool
    merges: bool                     # arcs depend on the piece before
    prefixes: frozenset[str]

    def __post_init__(self):
        # Whether marks behind a letter, and lines, can be taken for themselves.
        self.splits = not any("\n" in p or re.search("[A-Za-z0-9\u00c0-\u00ff][.,;:!?]", p) for p in self.weights)
        self._halves: dict[str, tuple[str, str] | None] = {}
        self._open: dict[tuple[str, str], bool] = {}

    @classmethod
    def compile(cls, path: str) -> Transducer:
        from sentencepiece import sentencepiece_model_pb2 as proto
        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only the identity normaliser is compiled")
        kinds = proto.ModelProto.SentencePiece
        ids, weights, bytes_, unknown = {}, {}, [-1] * 256, 0
        for k, piece in enumerate(model.pieces):
            if piece.type == kinds.BYTE:
                bytes_[int(piece.piece[3:5], 16)] = k
            elif piece.type == kinds.UNKNOWN:
                unknown = k
            elif piece.type == kinds.NORMAL:
                ids[piece.piece], weights[piece.piece] = k, -piece.score
        if any(SPACE in p.lstrip(SPACE) for p in ids):
            raise ValueError("a piece crosses into the next word")
        prefixes = frozenset(p[:n] for p in ids for n in range(1, len(p) + 1))
        return cls(ids, weights, bytes_, unknown, model.normalizer_spec.add_dummy_prefix,
                   model.trainer_spec.model_type == proto.TrainerSpec.BPE, prefixes)

    def normalised(self, text: str) -> str:
        text = text.replace(" ", SPACE)
        return SPACE + text if self.dummy_prefix and text else text

    def words(self, text: str) -> list[str]:
        """A normalised text cut before every ``▁`` that follows another character."""
        parts = text.split(SPACE)
        out, gap = [], ""
        if parts[0]:
            out.append(parts[0])
        for part in parts[1:]:
            gap += SPACE
            if part:
                out.append(gap + part)
                gap = ""
        return out + [gap] if gap else out

    # -- which pieces may follow each other in a model of merges

    def _half(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes this one; None for a character or what merges never make."""
        if piece not in self._halves:
            found = None
            if len(piece) > 1:
                parts = list(piece)
                while len(parts) > 2:
                    best, at = None, -1
                    for k in range(len(parts) - 1):
                        w = self.weights.get(parts[k] + parts[k + 1])
                        if w is not None and (best is None or w < best):
                            best, at = w, k
                    if best is None:
                        break
                    parts[at:at + 2] = [parts[at] + parts[at + 1]]
                found = tuple(parts) if len(parts) == 2 else None
            self._halves[piece] = found
        return self._halves[piece]

    def open_after(self, left: str, right: str) -> bool:
        """Whether merges leave the two pieces side by side: no merge across the border comes before
        the ones that make them, following the pieces that touch the border while they grow."""
        key = (left, right)
        found = self._open.get(key)
        if found is None:
            found = self._open[key] = self._borders(left, right)
            if len(self._open) > 1_000_000:
                self._open.clear()
        return found

    def _borders(self, left: str, right: str) -> bool:
        ends, starts = [left], [right]
        while (h := self._half(ends[-1])) is not None:
            ends.append(h[1])
        while (h := self._half(starts[-1])) is not None:
            starts.append(h[0])
        far = float("inf")
        while True:
            x, y = ends[-1], starts[-1]
            grow_left = self.weights[ends[-2]] if len(ends) > 1 else far
            grow_right = self.weights[starts[-2]] if len(starts) > 1 else far
            across = self.weights.get(x + y, far)
            # Of equal merges the leftmost comes first: left piece, border, right piece.
            if across < grow_left and across <= grow_right and across < far:
                return False
            if grow_left == far and grow_right == far:
                return True
            if grow_left <= grow_right:
                ends.pop()
            else:
                starts.pop()

    # -- composition

    def path(self, word: str) -> list[int]:
        """Ids along the shortest path through the composition with a word."""
        return self._only_path(word) if self.merges else self._shortest_path(word)

    def _only_path(self, word: str) -> list[int]:
        """The path in a model of merges, where all but one weigh infinity.

        Every beginning of a word has one way to be merged, so a place is
        reached in one state at most: a search that takes the longest arc
        first never comes to a place twice.
        """
        n = len(word)
        state: list = [False] * (n + 1)              # (piece before, place before) once reached
        state[0] = ("", 0)
        ways = [(0, self._arcs(word, 0))]
        while not state[n]:
            at, arcs = ways[-1]
            if not arcs:
                ways.pop()
                continue
            end = arcs.pop()
            piece = word[at:end]
            if state[end] or piece in self.weights and not self.may_follow(state[at][0], piece):
                continue
            state[end] = (piece if piece in self.weights else None, at)
            if end < n:
                ways.append((end, self._arcs(word, end)))
        out, place = [], n
        while place:
            piece, back = state[place]
            out.append(self._arc_ids(word[back:place], piece))
            place = back
        return [i for ids in reversed(out) for i in ids]

    def _arcs(self, word: str, at: int) -> list[int]:
        """Ends of the arcs from a place, the shortest first; one character if it has no piece."""
        ends = []
        for end in range(at + 1, len(word) + 1):
            piece = word[at:end]
            if piece not in self.prefixes:
                break
            if piece in self.weights:
                ends.append(end)
        return ends if ends and ends[0] == at + 1 else [at + 1, *ends]

    def _shortest_path(self, word: str) -> list[int]:
        """The path of least weight, place by place."""
        # Per place and state (the piece before, "" where that does not matter, None after bytes):
        # cost, place and state before.
        places: list[dict] = [{} for _ in range(len(word) + 1)]
        places[0][""] = (0.0, 0, "")
        for at, here in enumerate(places[:-1]):
            if not here:
                continue
            end, known = at + 1, False
            while end <= len(word) and (piece := word[at:end]) in self.prefixes:
                weight = self.weights.get(piece)
                if weight is not None:
                    known |= end == at + 1
                    open_ = [(c[0], s) for s, c in here.items() if not self.merges or self.may_follow(s, piece)]
                    if open_:
                        cost, before = min(open_, key=lambda o: o[0])
                        state = piece if self.merges else ""
                        if state not in places[end] or cost + weight < places[end][state][0]:
                            places[end][state] = (cost + weight, at, before)
                end += 1
            if not known:                            # a character without a piece
                before = min(here, key=lambda s: here[s][0])
                places[at + 1][None] = (here[before][0] + FALLBACK, at, before)
        out, place = [], len(word)
        state = min(places[place], key=lambda s: places[place][s][0])
        while place:
            _, back, before = places[place][state]
            out.append(self._arc_ids(word[back:place], state))
            place, state = back, before
        return [i for ids in reversed(out) for i in ids]

    def may_follow(self, before: str | None, piece: str) -> bool:
        if len(piece) > 1 and self._half(piece) is None:
            return False                             # merges never make this piece
        return not before or self.open_after(before, piece)

    def _arc_ids(self, text: str, name: str | None) -> list[int]:
        if name is not None:
            return [self.ids[text]]
        if self.bytes_[0] < 0:
            return [self.unknown]
        return [self.bytes_[b] for b in text.encode("utf-8")]

    def encode(self, text: str) -> list[int]:
        return [i for word in self.words(self.normalised(text)) for i in self.path(word)]


_COMPILED: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """The transducer of this worker, kept from task to task."""
    if path not in _COMPILED:
        _COMPILED[path] = Transducer.compile(path)
    return _COMPILED[path]


class Decoder:
    """Texts of ids: pieces and bytes put together, ``▁`` back to white space."""

    def __init__(self, model: Transducer):
        self.data = {i: p.replace(SPACE, " ").encode() for p, i in model.ids.items()}
        self.data |= {i: bytes([b]) for b, i in enumerate(model.bytes_) if i >= 0}
        self.dummy_prefix = model.dummy_prefix

    def bytes_of(self, ids: list[int]) -> bytes:
        return b"".join([self.data.get(i, b"") for i in ids])

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 become replacement characters."""
        text = self.bytes_of(ids)
        if self.dummy_prefix and text.startswith(b" "):
            text = text[1:]
        return text.decode("utf-8", "replace")


class Encoder:
    """Ids of texts, the path of each different word found once per task."""

    def __init__(self, path: str):
        self.model = transducer(path)
        self.index, self.ids = Index(400_000), Flat()

    def words(self, text: str) -> list[str]:
        """Parts that have a path each for itself: words without their one space in front, and, marked by
        ``JOINED``, marks behind a word and lines, where no piece of the model reaches across."""
        if (not self.model.dummy_prefix or "  " in text or SPACE in text or JOINED in text
                or text[0] == " " or text[-1] == " "):
            return self.model.words(self.model.normalised(text))
        if self.model.splits:
            if "\n" in text:
                text = text.replace("\n", f" {JOINED}\n {JOINED}")
            text = _ENDING.sub(f" {JOINED}\\1", text)
        return text.split(" ")

    def _spelled(self, word: str) -> str:
        if word.startswith(JOINED):
            return word[1:]
        return word if word.startswith(SPACE) or not self.model.dummy_prefix else SPACE + word

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each text's."""
        words, sizes = [], []
        for text in texts:
            own = self.words(text.decode("utf-8")) if text else []
            words += own
            sizes.append(len(own))
        codes, fresh, anew = self.index.codes(words)
        if anew:
            self.ids.clear()
        self.ids.add([self.model.path(self._spelled(w)) for w in fresh])
        flat, lengths = self.ids.take(codes)
        row = np.repeat(np.arange(len(texts)), sizes)
        return flat, np.bincount(row, lengths, minlength=len(texts)).astype(np.int64)


FIELDS = "ids array<int>"


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` and the ids of every whole text.

    Null and empty texts have no ids; repeated rows have equal ids; an empty
    table gives an empty result; other columns play no part.
    """
    path = path or model_path()

    def kernel() -> Kernel:
        encoder = Encoder(path)

        def run(texts):
            ids, lengths = encoder.encode(texts)
            return {"ids": np.split(ids.astype(np.int32), np.cumsum(lengths)[:-1])}
        return run
    return annotate(docs, text, kernel, FIELDS, keep or ["doc_id"])


def decoded(df: DataFrame, ids: str = "ids", path: str | None = None, keep: list[str] | None = None,
            into: str = "decoded") -> DataFrame:
    """Columns ``keep`` and the text that the ids of every row stand for.

    Null ids stay null, and no ids give the empty text. Bytes that are no
    UTF-8 become replacement characters; ids without a piece add nothing.
    """
    path = path or model_path()
    ship(df.sparkSession)
    keep = [c for c in (["doc_id"] if keep is None else keep) if c != into]
    source = df.select(*named(*keep), named(ids)[0])
    schema = StructType(source.schema.fields[:len(keep)]).add(into, "string")
    plain = source.toDF(*[f"_{k}" for k in range(len(source.columns))])   # names with dots would not resolve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(transducer(path))
        for batch in batches:
            texts = [None if i is None else decoder.decode(i) for i in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(texts, pa.string())], names=[*keep, into])

    return plain.mapInArrow(run, schema)


def round_trips(docs: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep``, the ids of every text with number and checksum, the text decoded from these ids,
    and whether it is the text that was encoded.

    Null texts count as empty. A text with a ``\u2581`` of its own does not
    come back: it decodes to a space.
    """
    path = path or model_path()

    def kernel() -> Kernel:
        encoder, decoder = Encoder(path), Decoder(transducer(path))

        def run(texts):
            ids, lengths = encoder.encode(texts)
            data, ends = ids.astype("<u4").tobytes(), np.cumsum(lengths).tolist()
            split = np.split(ids.astype(np.int32), ends[:-1])
            back = [decoder.decode(i.tolist()) for i in split]
            return {"n_tokens": lengths, "ids": split, "decoded": back,
                    "ids_crc32": [zlib.crc32(data[4 * (b - n):4 * b]) for b, n in zip(ends, lengths.tolist())],
                    "round_trip": [b.encode("utf-8") == (t or b"") for b, t in zip(back, texts)]}
        return run
    return annotate(docs, text, kernel, "n_tokens long, ids array<int>, ids_crc32 long, decoded string, round_trip boolean",
                    ["doc_id"] if keep is None else keep)


def digests(docs: DataFrame, path: str | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """:func:`round_trips` without ids and texts."""
    return round_trips(docs, path, text, keep).drop("ids", "decoded")
