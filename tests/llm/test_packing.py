"""Packing: ids equal the library's, sequences are gapless and few."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadflow.llm import packing, queries

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_ids_equal_the_library(library):
    rnd = random.Random(7)
    letters = [*"abcdeABC  \n\t'..!?0129éÉßΣσςİıſKÅ漢字カタ한국👍🏽́‍\xa0\x00\x1f٣½ \x85", "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "the", "ing", "$$$", "aaaaaaa", "</w>", "<|ENDOFTEXT|>"]
    texts = ["", *("".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(3000)), *("".join(rnd.choices("aeinstrh", k=rnd.randint(1, 25))) for _ in range(3000))]
    for text, ids in zip(texts, packing.Ids(queries.tokenizer_path()).batch(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def lower_bound(h, capacity):
    return max(-(-sum(x * n for x, n in h.items()) // capacity), sum(n for x, n in h.items() if x > capacity // 2))


@pytest.mark.parametrize("kind", ["even", "large", "small", "one", "full", "none", "few"])
def test_plans_are_exact_and_near_the_bound(kind):
    rnd, capacity = np.random.default_rng(4), 2048
    x = {
        "even": rnd.integers(1, 2048, 30_000), "large": rnd.integers(1100, 2048, 500), "small": rnd.integers(1, 60, 20_000), "one": np.full(1000, 700),
        "full": np.full(7, 2048), "none": np.empty(0, int), "few": np.array([1, 2047, 1024, 1024, 2048, 5]),
    }[kind]
    h = dict(zip(*map(np.ndarray.tolist, np.unique(x, return_counts=True)), strict=True))
    places, n = packing.plan(h, capacity)
    held, spans = defaultdict(int), defaultdict(list)
    for i, (length, first, m, sequence, offset) in enumerate(places.tolist()):
        after = places[i + 1].tolist() if i + 1 < len(places) else (None,)
        until = after[1] if after[0] == length else h[length]
        assert first == held[length] and (until - first) % m == 0
        held[length] = until
        for k in range((until - first) // m):
            spans[sequence + k].append((offset, offset + m * length))
    assert held == h and sorted(spans) == list(range(n))
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(own, own[1:]))  # noqa: B905
    bound = lower_bound(h, capacity)
    assert n <= (500 if kind == "one" else bound if kind != "even" else bound * 1.005 + 1)


def test_fit_uses_up_what_patterns_can():
    left = np.zeros(2049, np.int64)
    left[[1300, 748, 400, 348]] = 90, 30, 60, 60  # 30 times 1300 + 748, 60 times 1300 + 400 + 348
    triples, share = packing.fit(left.copy(), *packing.patterns(np.flatnonzero(left), 2048), rounds=400)
    got = {tuple(t): round(s) for t, s in zip(triples.tolist(), share.tolist(), strict=True)}
    assert got == {(1300, 748, 0): 30, (1300, 400, 348): 60}


def test_packed_documents(docs, rows, empty, library):
    got = packing.pack(docs, queries.tokenizer_path()).collect()
    want, size = defaultdict(int), 0
    for r in rows:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        size += len(ids)
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want[r["doc_id"], piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    found, held = defaultdict(int), defaultdict(list)
    for r in got:
        found[tuple(r)[:5]] += 1
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    assert found == want
    for own in held.values():
        own.sort()
        assert own[0][0] == 0 and sum(own[-1]) <= 2048 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))  # noqa: B905
    h = defaultdict(int)
    for r in got:
        h[r["length"]] += 1
    assert len(held) <= lower_bound(h, 2048) + 2
    assert packing.pack(empty, queries.tokenizer_path()).count() == 0


def test_sequences_hold_the_documents(docs, rows, library):
    got = packing.sequences(docs.where("doc_id % 5 = 0 or doc_id is null"), queries.tokenizer_path(), capacity=300).collect()
    own = defaultdict(int)
    for r in got:
        assert len(r["ids"]) == len(r["doc_ids"]) <= 300
        for i in r["doc_ids"]:
            own[i] += 1
    want = defaultdict(int)
    for r in rows:
        if r["doc_id"] is None or r["doc_id"] % 5 == 0:
            want[r["doc_id"]] += len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1
    assert own == want


def test_one_length_in_many_tasks(spark):
    same = spark.range(0, 5000, 1, 16).select(F.col("id").alias("doc_id"), F.lit("one and the same text").alias("text"))
    got = packing.pack(same, queries.tokenizer_path(), capacity=64).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_distinct("offset").alias("k"), F.count("*").alias("m")).collect()
    each = 64 // 6
    assert all(r["n"] <= 64 and r["k"] == r["m"] <= each for r in got) and len(got) == 5000 // each
