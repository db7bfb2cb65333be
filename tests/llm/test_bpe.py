import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from portcullis.llm import byte_bpe as P

from .conftest import CLASHES, ODD


@pytest.fixture(scope="module")
def both():
    data = open(public_tokenizers.path(P.VOCABULARY), "rb").read()
    codec = P.codec(data, public_tokenizers.PATTERN)
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(codec.tokens)}, special_tokens={})
    return codec, plain


def test_ids_equal_those_of_tiktoken(both):
    codec, plain = both
    rng = random.Random(3)
    alphabet = "aAeE \n\t\x00\r<unk>▁ĀĠ日本語\U0001f600é0123#'strhe… "
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        ids = np.frombuffer(codec.encode(text), "<u4").tolist()
        assert ids == plain.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()


def test_every_token_is_reached_by_merges_alone(both):
    codec, _ = both
    for rank, token in list(enumerate(codec.tokens))[::37]:
        assert codec.model.encode("".join(P.STAND_IN[b] for b in token)) == [rank]


def test_gaps_in_ranks_are_refused():
    with pytest.raises(ValueError):
        P.ranks(b"YQ== 0\nYg== 2\n")


def test_round_trip_of_odd_texts(spark, documents, both):
    _, plain = both
    found = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in P.round_trip(documents(ODD)).collect()}
    want = set()
    for key, text in ODD:
        ids = plain.encode_ordinary(text or "")
        want.add((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == want
    assert P.round_trip(documents([])).collect() == []


def test_encode_keeps_the_other_columns(spark, documents):
    out = P.encode(documents([(1, "hello world"), (2, None)]))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", *CLASHES, "ids"]
    assert [len(r["ids"]) for r in out.orderBy("doc_id").collect()] == [2, 0]
