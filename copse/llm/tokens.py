"""Token ids of whole texts, each different word encoded once per task."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np

from copse.llm.batches import Flat, Index, kept

#: Fixed value: the vocabulary file of the queries; a parameter everywhere else.
VOCABULARY = "word_bpe_49k.json"


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


#: ASCII marks that end a word after an ASCII letter or digit, or a letter of Latin-1; searched by the first mark.
_ENDING = re.compile(rb"[.,;:!?](?:(?<=[A-Za-z0-9].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[.,;:!?]*(?=[\x20\x09-\x0D]|\Z)")

#: Words of small letters of ASCII and Latin-1.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
#: What leaves such words as they are, but for the letters that stand for their bytes.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITTERS = [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
               "behavior": "Removed", "invert": True},
              {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]


def _letters_for_bytes() -> dict[int, str]:
    """The letter that stands for each byte in vocabularies of bytes: itself if it can be seen."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) for b in seen} | {b: chr(256 + n) for n, b in enumerate(rest)}


def _model_takes_letters(path: str) -> bool:
    """Whether the file's normaliser and splitter hand such words to its merges whole and unchanged."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    parts = lambda part, names: (made[part] or {}).get(names)
    return (made["model"].get("type") == "BPE" and not made["model"].get("dropout")
            and made.get("truncation") is None and made.get("padding") is None and made.get("post_processor") is None
            and parts("normalizer", "normalizers") == _NORMALIZERS and parts("pre_tokenizer", "pretokenizers") == _SPLITTERS
            and not any(_LETTERS(t["content"].lower().encode()) for t in made["added_tokens"]))


def words_of(text: bytes) -> list[bytes]:
    """Parts of a text that the tokenizer encodes each for itself.

    It drops white space, lower-cases, and splits letters from marks; neither
    its normaliser nor its splitter looks across white space, and added tokens
    hold none. Lower case may come first but where a combining mark could join
    a capital otherwise, or an added token come about (``<|``).
    """
    if b"<|" not in text:
        if b"\xcc" not in text and b"\xcd" not in text:
            text = text.lower()                      # bytes: A-Z only
        text = _ENDING.sub(rb" \g<0>", text)
    return text.split()                              # bytes split at ASCII white space


class Encoder:
    """Ids of texts by the ``tokenizers`` library, put together from ids of words.

    This holds for tokenizers as :func:`words_of` describes; for others pass
    ``by_word=False``, which encodes whole texts. Words of small letters go to the
    library's model without its normaliser and splitter, if those would not change them.
    """

    def __init__(self, path: str, by_word: bool = True, limit: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word, self.index, self.flat = by_word, Index(limit), Flat()
        self.model = self.tokenizer.model if by_word and _model_takes_letters(path) else None
        self.letters = _letters_for_bytes()

    def _add(self, words: list[bytes]) -> None:
        lists: list = [None] * len(words)
        others = range(len(words))
        if self.model:
            tokenize, letters, others = self.model.tokenize, self.letters, []
            for k, word in enumerate(words):
                if not _LETTERS(word):
                    others.append(k)
                    continue
                text = word.decode("latin-1")
                lists[k] = [t.id for t in tokenize(text if text.isascii() else text.translate(letters))]
        found = self.tokenizer.encode_batch_fast([words[k].decode("utf-8") for k in others], add_special_tokens=False)
        for k, one in zip(others, found):
            lists[k] = one.ids
        self.flat.add(lists)

    def encode(self, texts: list[bytes | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with ``end`` behind it, and the number of ids of each."""
        if not self.by_word:
            found = [e.ids + [end] for e in self.tokenizer.encode_batch_fast(
                [(t or b"").decode("utf-8") for t in texts], add_special_tokens=False)]
            return (np.fromiter(chain.from_iterable(found), np.uint32),
                    np.fromiter(map(len, found), np.int64, len(found)))
        words: list[bytes] = []
        n_words = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            own = words_of(text) if text else []
            words += own
            n_words[k] = len(own)
        codes, fresh, anew = self.index.codes(words)
        if anew:
            self.flat.clear()
        for k in range(0, len(fresh), 20_000):
            self._add(fresh[k:k + 20_000])
        ids, sizes = self.flat.take(codes)
        row = np.repeat(np.arange(len(texts)), n_words)
        lengths = np.bincount(row, sizes, minlength=len(texts)).astype(np.int64)
        return np.insert(ids, np.cumsum(lengths), end), lengths + 1


def encoder(path: str, by_word: bool = True) -> Encoder:
    """The encoder of this worker, kept from task to task."""
    return kept(("encoder", path, by_word), lambda: Encoder(path, by_word))
