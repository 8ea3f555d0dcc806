"""Periodic runs against a search by every period."""

import hashlib
import random
import re
import time
import zlib

import pytest

from loadflow.llm import periodic, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Every stretch with a period, by every period; the least period of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and j > i:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((x, y - x, q) for (x, y), q in found.items()), key=lambda r: (r[0], r[2]))


def planted(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    return words


def kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_runs_equal_brute_force():
    rnd = random.Random(12)
    for _ in range(1500):
        texts = []
        for _ in range(rnd.randint(1, 4)):
            k, n = rnd.choice([1, 2, 2, 3, 5]), rnd.randint(0, 80)
            words = [b"w%d" % rnd.randrange(k) for _ in range(n)]
            for _ in range(rnd.randint(0, 3) if n > 4 else 0):  # runs inside of runs
                at = rnd.randrange(n)
                words[at:at] = (words[at : at + rnd.randint(1, 9)] * 50)[: rnd.randint(4, 60)]
            texts.append(words)
        assert periodic.runs_of(texts) == [brute(w) for w in texts]


def test_grammar_gives_the_sequence_back():
    rnd = random.Random(5)
    for _ in range(300):
        parts = [[rnd.randrange(3) for _ in range(rnd.randint(1, 60))] for _ in range(rnd.randint(1, 3))]
        rules, left = periodic.re_pair([x for p in parts for x in [*p, -1]][:-1], 3)
        grown = lambda s: [s] if s < 3 else grown(rules[s - 3][0]) + grown(rules[s - 3][1])  # noqa: B023, E731
        assert [[x for s in own for x in grown(s)] for own in left] == parts
        pairs = [p for own in left for p in zip(own, own[1:])]  # noqa: B905
        for p in {p for p in pairs if p[0] != p[1]}:
            assert pairs.count(p) == 1  # Re-Pair ends when no pair stands twice


@pytest.mark.parametrize("words", [[b"a"] * 30_000, [b"a", b"b"] * 20_000, [b"%d" % (i % 977) for i in range(40_000)], [b"x", *[b"a"] * 9, b"y"] * 900])
def test_long_texts(words):
    began = time.time()
    (got,) = periodic.runs_of([words])
    assert time.time() - began < 20
    if words[1] == b"a" and words[0] == b"x":
        assert len(got) == 901 and (0, len(words), 11) in got and (1, 9, 1) in got
    else:
        assert got == [(0, len(words), len(set(words)))]


def test_digest_of_documents(spark, docs, rows, empty):
    got = {}
    for r in periodic.digest(docs).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    want = {}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    some = 0
    for r in rows:
        words = planted(r["doc_id"], WORD.findall(r["text"] or ""))
        runs = brute(words) if len(words) < 3000 else periodic.runs_of([[w.encode() for w in words]])[0]
        some += bool(runs)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None, None, None)
        milli = 1000 * best[1] // best[2] if runs else None
        row = (len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(kept(words, runs))))
        want.setdefault(r["doc_id"], []).append(row)
    assert some > 10
    key = lambda x: [(v is not None, v) for v in x]
    assert {k: sorted(v, key=key) for k, v in got.items()} == {k: sorted(v, key=key) for k, v in want.items()}
    assert periodic.digest(empty).count() == 0 and periodic.collapse(empty).count() == 0


def test_collapsed_texts(spark):
    texts = [(1, "go " * 8 + "on"), (1, "go " * 8 + "on"), (2, None), (3, ""), (None, "a b a b a b a b a"), (4, "a a a a a"), (5, "ü\tü\nü ü\x0bü ü é")]
    got = periodic.collapse(spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, runs string")).collect()
    want = {(1, ((0, 8, 1),), "go on"): 2, (2, (), ""): 1, (3, (), ""): 1, (None, ((0, 9, 2),), "a b"): 1, (4, (), "a a a a a"): 1, (5, ((0, 6, 1),), "ü é"): 1}
    found = [(r["doc_id"], tuple(map(tuple, r["runs"])), r["text"]) for r in got]
    assert {x: found.count(x) for x in found} == want


def test_query(spark, sf_dir):
    assert queries.queries()["op12_periodic_runs"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
