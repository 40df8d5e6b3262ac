import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tidemark.llm import bpe
from tidemark.llm.queries import tokenizer_ranks


@pytest.fixture(scope="module")
def both():
    ranks, pattern = tokenizer_ranks()
    return bpe.Codec(bpe.serialised_model(ranks), ranks, pattern), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_rank_library(both):
    codec, library = both
    r = random.Random(8)
    texts = ["", " ", "  a", "a  b", "it's 12 o'clock", "a\u00a0b c", "\x1c x \x1d", "a" * 3000, " " * 500, "日本語 テキスト", "👩‍👩‍👧 ok", "x \n y", "\ufeffbom \u2028 z"]
    pool = [chr(c) for c in (*range(32, 127), 9, 10, 13, 0xA0, 0xE9, 0x3B1, 0x4E00, 0x1F600, 0x200D, 0x300, 0x2029)]
    texts += ["".join(r.choice(pool + [" "] * 30) for _ in range(r.randint(0, 80))) for _ in range(2000)]
    for text in texts:
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()


def test_memory_of_words_is_bounded(both, monkeypatch):
    codec, library = both
    monkeypatch.setattr(bpe, "MOST_CACHED", 50)
    for k in range(30):
        text = " ".join(f"w{k}x{i}" for i in range(20)) + " the same words"
        assert codec.encode(text) == library.encode_ordinary(text)
    assert len(codec.known) < 200


def test_table(spark, both):
    rows = [(1, None, 5), (2, "", 5), (3, "The  café\n\n x", 5), (3, "The  café\n\n x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    encoded = bpe.encoded(df, *tokenizer_ranks(), with_ids=True)
    got = encoded.collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got[:2]] == [(0, empty, empty)] * 2
    ids = both[1].encode_ordinary(rows[2][1])
    assert got[2]["ids"] == ids and got[2]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert {r["text"] for r in bpe.decoded_texts(spark, encoded, tokenizer_ranks()[0]).collect()} == {"", rows[2][1]}
    assert bpe.encoded(df.limit(0), *tokenizer_ranks()).count() == 0
