"""Plain words are cut and lower-cased as the tokenizer does it, so that each part of them is learnt once."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sessionlake.llm import tokens, words

SIGNS = [*"aAzZ09.,;:!?'\"()-_/<>|&*$%#@", "À", "Ö", "×", "ß", "é", "÷", "þ", "ÿ", "́", "̈", "ª", "²", " ", "\u0085", "İ", "Σ", "中", "\U0001f600", "\x00", "\x1c", "\x7f"]
WHOLE = ["'s", "'T", "'re", "don't", "'''ll", "<|endoftext|>", "<|STARTOFTEXT|>", "</w>", "l’Été", "ÉTÉ,À", "ÅÅ", "alpha", "ALPHA.", "x" * 70, "Y9" * 40, "é" * 40]


def found(encoder, texts):
    for _, ids, sizes in encoder.encode(pa.array(texts)):
        at = np.append(0, np.cumsum(sizes))
        yield from (ids[at[i] : at[i + 1]].tolist() for i in range(len(sizes)))


def expected(encoder, texts):
    return [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def invented(seed, n):
    rng = random.Random(seed)
    return [None if rng.random() < 0.02 else "".join(rng.choice(WHOLE) if rng.random() < 0.05 else " " if rng.random() < 0.15 else rng.choice(SIGNS) for _ in range(rng.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def encoder():
    return tokens.WordEncoder(tokens.default_vocabulary())


def test_a_part_of_words_is_learnt_once(encoder):
    own = tokens.WordEncoder(tokens.default_vocabulary())
    given, called = [], own._called
    own._called = lambda texts: called(given.extend(texts) or texts)
    texts = ["alpha alpha, (alpha) Alpha! alpha42 ALPHA***", "été, ÉTÉ. alpha"]
    assert list(found(own, texts)) == expected(own, texts)
    assert sorted(" ".join(given).split()) == sorted(["alpha", ",", "(", ")", "!", "4", "2", "***", "été", "."])


def test_few_parts_for_many_words_of_a_store(monkeypatch):
    """What operator 3's writer asks of the tokenizer for words that differ by case, numbers and signs only."""
    own, path = tokens.WordEncoder(tokens.default_vocabulary()), tokens.default_vocabulary()
    given, called = [], own._called
    own._called = lambda texts: called(given.extend(texts) or texts)
    monkeypatch.setitem(tokens._encoders, path, own)
    texts = [f"Word{i}, ({i})word. WORD{i}" for i in range(300)]
    assert [ids.tolist() for ids in tokens.encoded(pa.array(texts), path)] == expected(own, texts)
    assert len(" ".join(given).split()) <= 20


def test_room_is_added_without_loss():
    rows = np.arange(12).reshape(4, 3)
    more = tokens._room(rows, 9)
    assert len(more) >= 9 and more.shape[1] == 3 and (more[:4] == rows).all() and tokens._room(rows, 4) is rows


@pytest.mark.parametrize("seed", range(4))
def test_cut_words_have_the_ids_of_whole_texts(encoder, seed):
    texts = invented(seed, 2000)
    assert list(found(encoder, texts)) == expected(encoder, texts)


def test_pieces_with_one_hash_or_one_place(monkeypatch):
    own = tokens.WordEncoder(tokens.default_vocabulary())
    plain = words.hashes
    monkeypatch.setattr(words, "hashes", lambda *a: plain(*a) % np.uint64(50) << np.uint64(40))
    texts = invented(7, 300)
    for _ in range(2):
        assert list(found(own, texts)) == expected(own, texts)


def test_forgotten_pieces_are_learnt_again(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 50)
    monkeypatch.setattr(tokens, "CHUNK", 500)
    own, texts = tokens.WordEncoder(tokens.default_vocabulary()), invented(8, 500)
    assert list(found(own, texts)) == expected(own, texts)


def test_bytes_that_are_no_text():
    broken = pa.Array.from_buffers(pa.string(), 3, [None, pa.array([0, 3, 5, 8], pa.int32()).buffers()[1], pa.py_buffer(b"ab\xc3\xa9c\xc3(\xe9")])
    own = tokens.WordEncoder(tokens.default_vocabulary())
    sizes, ids = [], []
    for _, part, size in own.encode(broken):
        ids += part.tolist()
        sizes += size.tolist()
    whole = [own.tokenizer.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in (b"ab\xc3", b"\xa9c", b"\xc3(\xe9")]
    assert ids == sum(whole, []) and sizes == list(map(len, whole))


def test_other_tokenizers_are_not_cut():
    known = json.load(open(tokens.default_vocabulary()))
    token = {"id": 0, "content": "END", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    assert tokens.cuts(Tokenizer.from_str(json.dumps(known)))
    for change in ({"normalizer": None}, {"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "WhitespaceSplit"}}, {"added_tokens": [token]}, {"model": known["model"] | {"end_of_word_suffix": None}}):
        try:
            other = Tokenizer.from_str(json.dumps(known | change))
        except Exception:  # the library refuses merges without their marks
            continue
        assert not tokens.cuts(other)
