"""Words that differ by case only are one word to a tokenizer that lower-cases."""

import json

import pyarrow as pa
from tokenizers import Tokenizer

from sessionlake.llm import tokens

TEXTS = ["Alpha ALPHA alpha, Alpha, <|ENDOFTEXT|> <|endoftext|> J\u030c j\u030c \u00c5B A\u030a It's IT'S (A) x|Y", "", "\u0130I K\u212a " + "Long" * 30 + " " + "lONG" * 30]


def test_cases_of_a_word_are_learnt_once():
    own = tokens.WordEncoder(tokens.default_vocabulary())
    given, called = [], own._called
    own._called = lambda texts: called(given.extend(texts) or texts)
    found = [ids.tolist() for ids in _ids(own, TEXTS)]
    assert found == [own.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]
    said = " ".join(given).split()
    assert own.folds and said.count("alpha") == 1 and "ALPHA" not in said


def test_no_folding_where_case_counts(tmp_path):
    known = json.load(open(tokens.default_vocabulary()))
    assert tokens.folds(Tokenizer.from_str(json.dumps(known)))
    assert not tokens.folds(Tokenizer.from_str(json.dumps(known | {"normalizer": None})))
    plain = {"id": 0, "content": "END", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    assert not tokens.folds(Tokenizer.from_str(json.dumps(known | {"added_tokens": [plain]})))


def _ids(encoder, texts):
    for _, ids, sizes in encoder.encode(pa.array(texts)):
        at = 0
        for n in sizes.tolist():
            yield ids[at : at + n]
            at += n
