"""Encoding, and the pipeline."""

import hashlib
import random
from collections import Counter

import pytest

from loadflow.llm import bpe, queries

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe(queries.tokenizer_path())


def test_encoding_equals_the_library(library, own):
    rnd = random.Random(1)
    letters = [*"abcdeABC  \n\t'..!?0129éÉßΣσςİıſKÅ漢字カタ한국👍🏽́‍\xa0\x00\x1f٣½ \x85", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "the", "ing", "$$$", "aaaaaaa", "</w>", "<|endoftext"]
    texts = ["".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(3000)] + ["a" * k for k in range(70)] + ["".join(rnd.choices("abn", k=40)) for _ in range(500)]
    for text, (ids, decoded) in zip(texts, own.run(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert [int(i) for i in ids.split()] == want, text
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_every_prefix_has_one_last_token(own):
    for word in ("internationalisation", "abababab", "mississippi"):
        for n in range(1, len(word) + 1):
            assert "".join(own.token[i] for i in own.encode_symbols(word[:n])) == word[:n]


def test_encoded_documents(docs, rows, library):
    got = bpe.encode_documents(docs, queries.tokenizer_path(), with_ids=True).collect()
    want = Counter()
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), tuple(ids)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], tuple(r["ids"])) for r in got) == want
    assert bpe.encode_documents(docs.where("false"), queries.tokenizer_path()).count() == 0
