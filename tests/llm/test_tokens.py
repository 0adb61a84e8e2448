"""Words of small letters go to the model directly and have the library's ids."""

import random

from copse.llm import tokens as T


def test_words_of_letters_skip_the_normaliser_and_have_its_ids(monkeypatch):
    from tokenizers import Tokenizer
    path, pick = T.tokenizer_path(), random.Random(3)
    letters = [*"abcdefghijklmnopqrstuvwxyz", *(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)]
    words = ["".join(pick.choices(letters, k=pick.randint(1, 24))) for _ in range(3000)]
    words += ["".join(pick.choices(letters[:26], k=pick.randint(1, 90))) for _ in range(1000)] + letters + ["a" * 5000]
    odd = ["a÷b", "it's", "l'été", "É", "é", "ñ̃", "ſt", "ªº", "a­b", "x9", "µ", "Ĳ", "<|endoftext|>", "ab<|startoftext|>", "ﬁn", "ʼn"]
    library = Tokenizer.from_file(path)
    want = [e.ids for e in library.encode_batch(words + odd, add_special_tokens=False)]
    own = T.Encoder(path)
    asked: list[str] = []

    class Watched:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **options)

    own.tokenizer = Watched()
    own._add([w.encode() for w in words + odd])
    ids, sizes = own.flat.take(T.np.arange(len(want)))
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert asked == odd and not set(asked) & set(words)


def test_other_files_keep_their_normaliser(tmp_path):
    import json
    made = json.loads(open(T.tokenizer_path(), encoding="utf-8").read())
    assert T._model_takes_letters(T.tokenizer_path())
    for part in ("normalizer", "pre_tokenizer"):
        (tmp_path / part).write_text(json.dumps(made | {part: None}), encoding="utf-8")
        assert not T._model_takes_letters(str(tmp_path / part))
    token = made["added_tokens"][0] | {"content": "abc"}
    (tmp_path / "added").write_text(json.dumps(made | {"added_tokens": [token]}), encoding="utf-8")
    assert not T._model_takes_letters(str(tmp_path / "added"))
