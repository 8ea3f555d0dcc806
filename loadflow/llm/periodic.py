"""Periodic runs of words, found on a grammar.

Re-Pair turns the words of a document into a grammar: again and again the most frequent pair of neighbours becomes a
symbol of its own, until no pair stands twice; what is left is paired off level by level. Every run of at least four
periods crosses the border between the two halves of the smallest symbol that holds it, and one side of the border holds two
whole periods. So each symbol is asked once, at one of its places, for the runs that cross its border; the
answers are carried to all places of the symbol, and of the intervals with one period only the maximal ones stay.

Pairs that a document holds less than three times are in no run, as a run shows each of its pairs that often. Only the
stretches without such pairs enter the grammar.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadflow.llm.bpe import portions

#: A run has this many periods at least, and this many words.
PERIODS, SHORTEST = 4, 6
Run = tuple[int, int, int]
Change = Callable[[int | None, list[bytes]], list[bytes]]


def re_pair(symbols: list[int], fresh: int) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Rules of the grammar of some sequences, and what is left of each; rule k makes the symbol fresh + k.

    symbols: the sequences one after another, -1 between them; all others are below `fresh`. The most frequent pair goes first,
    of equally frequent ones the least; counts are of pairs that don't overlap. Places that other rules have taken
    are sorted out when their pair comes up.
    """
    s, n = symbols[:], len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, pair in enumerate(zip(s, s[1:])):  # noqa: B905
        if pair[0] >= 0 and pair[1] >= 0:
            places[pair].append(i)
    heap = [(-len(p), pair) for pair, p in places.items() if len(p) > 1]
    heapify(heap)
    rules: list[tuple[int, int]] = []
    while heap:
        count, pair = heappop(heap)
        live, taken = [], -1
        for i in places.pop(pair):
            if s[i] == pair[0] and i != taken and (j := after[i]) < n and s[j] == pair[1]:
                live.append(i)
                taken = j
        if len(live) < 2:
            continue
        if heap and len(live) < -count and -len(live) > heap[0][0]:
            places[pair] = live
            heappush(heap, (-len(live), pair))
            continue
        new, own = fresh + len(rules), defaultdict(list)
        rules.append(pair)
        for i in live:
            j = after[i]
            k, p = after[j], before[i]
            s[i], s[j], after[i] = new, -2, k
            if k < n:
                before[k] = i
                if s[k] >= 0:
                    own[new, s[k]].append(i)
            if p >= 0 and s[p] >= 0:
                own[s[p], new].append(p)
        for pair, found in own.items():
            if len(found) > 1:
                places[pair] = sorted(set(found))
                heappush(heap, (-len(found), pair))
    left: list[list[int]] = [[]]
    i = 0
    while i < n:
        if s[i] == -1:
            left.append([])
        else:
            left[-1].append(s[i])
        i = after[i]
    return rules, left


class Hashed:
    """A sequence with hashes of all its parts; what they say is always verified on the sequence itself."""

    _rnd = np.random.default_rng(12)
    BASE = np.uint64(int(_rnd.integers(1 << 62)) * 2 + 1)

    def __init__(self, t: np.ndarray):
        self.t = t
        v = t.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        v ^= v >> np.uint64(29)
        v *= np.uint64(0xBF58476D1CE4E5B9)
        n = len(t)
        power = np.ones(n + 1, np.uint64)
        np.multiply.accumulate(np.full(n, self.BASE, np.uint64), out=power[1:])
        # The hash of a part is a difference of sums, scaled to the end of the sequence by the power of what follows.
        self.power = power
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(v * power[:n][::-1], out=self.sums[1:])

    def squares(self, m: int, most: int, right: bool) -> np.ndarray:
        """Lengths q up to `most` such that the q entries next to the border m, on one side, come twice."""
        if most < 1:
            return np.empty(0, np.int64)
        t, sums, q = self.t, self.sums, np.arange(1, most + 1)
        q = q[t[m + 1 : m + most + 1] == t[m]] if right else q[t[m - most - 1 : m - 1][::-1] == t[m - 1]]
        near, far = (m + q, m + 2 * q) if right else (m - q, m - 2 * q)
        one, two = sums[near] - sums[m], sums[far] - sums[near]
        return q[one == two * self.power[q]] if right else q[one * self.power[q] == two]


def crossing(text: Hashed, s: int, m: int, e: int) -> list[Run]:
    """(start, end, period) of the runs of the part s to e that cross m, as far as they reach in that part."""
    t, found = text.t, {}
    for right in (True, False):
        squares = text.squares(m, min((e - m if right else m - s) // 2, (e - s) // PERIODS), right)
        while len(squares):
            q = int(squares[0])
            same = t[s : e - q] == t[s + q : e]
            at = m - s if right else m - s - 2 * q  # the square begins here
            ahead, back = same[at:], same[:at][::-1]
            y = s + q + at + (int(ahead.argmin()) if not ahead.all() else len(ahead))
            x = s + at - (int(back.argmin()) if not back.all() else at)
            if y < s + at + 2 * q:  # equal hashes only
                squares = squares[1:]
                continue
            if y - x >= max(SHORTEST, PERIODS * q) and found.get((x, y), q) >= q:
                found[x, y] = q
            # Squares inside of this stretch are powers of this one.
            squares = squares[m + 2 * squares > y] if right else squares[m - 2 * squares < x]
    return [(x, y, q) for (x, y), q in found.items()]


def maximal(found: np.ndarray) -> np.ndarray:
    """Of rows (start, end, period): those that no other with their period holds, each once, by start and period."""
    if not len(found):
        return found
    found = found[np.lexsort((-found[:, 1], found[:, 0], found[:, 2]))]
    reach = found[:, 2] * (found[:, 1].max() + 1) + found[:, 1]
    keep = np.r_[True, reach[1:] > np.maximum.accumulate(reach)[:-1]]
    found = found[keep]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_on_grammar(stretches: list[tuple[int, np.ndarray]]) -> list[Run]:
    """(start, length, period) of all runs of a document; stretches: first word number and word codes of its parts that may hold runs."""
    joined = np.concatenate([x for _, own in stretches for x in (own, [-1])])[:-1]
    known = np.unique(joined[joined >= 0])
    codes = np.where(joined < 0, -1, np.searchsorted(known, joined))
    rules, left = re_pair(codes.tolist(), len(known))
    length = [1] * len(known)
    for a, b in rules:
        length.append(length[a] + length[b])
    places: dict[int, list[np.ndarray]] = defaultdict(list)
    begin = 0
    for own in left:  # pair off what Re-Pair has left
        size = sum(length[x] for x in own)
        while len(own) > 1:
            paired = []
            for a, b in zip(own[::2], own[1::2]):  # noqa: B905
                paired.append(len(length))
                rules.append((a, b))
                length.append(length[a] + length[b])
            own = paired + own[len(own) // 2 * 2 :]
        if own:
            places[own[0]].append(np.array([begin]))
        begin += size + 1
    text, found = Hashed(codes), []
    for k in range(len(rules) - 1, -1, -1):
        symbol, (a, b) = len(known) + k, rules[k]
        if length[symbol] < SHORTEST or symbol not in places:
            continue
        at = np.concatenate(places.pop(symbol))
        places[a].append(at)
        places[b].append(at + length[a])
        s = int(at[0])
        for x, y, q in crossing(text, s, s + length[a], s + length[symbol]):
            found.append(np.stack([at + (x - s), at + (y - s), np.full(len(at), q)], axis=1))
    if not found:
        return []
    best = maximal(np.concatenate(found))
    starts = np.array([0, *np.cumsum([len(own) + 1 for _, own in stretches])])
    own = np.searchsorted(starts, best[:, 0], side="right") - 1
    first = np.array([f for f, _ in stretches])[own] - starts[own]
    return [(int(x), int(n), int(q)) for x, n, q in zip(best[:, 0] + first, best[:, 1] - best[:, 0], best[:, 2], strict=True)]


def repetitive(codes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(document, begin, end) of stretches in which every pair of neighbours comes three times or more in its document.

    Pairs are counted by hashes; pairs that collide only make a stretch longer.
    """
    if len(codes) < SHORTEST:
        return
    pair = (doc[1:].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + codes[1:].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + codes[:-1].astype(np.uint64)
    pair *= np.uint64(0xBF58476D1CE4E5B9)
    pair ^= pair >> np.uint64(31)
    pair *= np.uint64(0x94D049BB133111EB)
    bits = max(8, len(codes).bit_length() + 2)
    slot = (pair >> np.uint64(64 - bits)).astype(np.int64)
    left = np.flatnonzero(doc[1:] == doc[:-1])
    while True:
        count = np.bincount(slot[left], minlength=1 << bits)
        some = left[count[slot[left]] >= PERIODS - 1]
        if not len(some):
            return
        breaks = np.flatnonzero((np.diff(some) != 1) | (doc[some[1:]] != doc[some[:-1]])) + 1
        begin, end = some[np.r_[0, breaks]], some[np.r_[breaks - 1, len(some) - 1]] + 2
        long = end - begin >= SHORTEST
        begin, end = begin[long], end[long]
        if len(some) == len(left) and long.all():
            yield from zip(doc[begin].tolist(), begin.tolist(), end.tolist(), strict=True)
            return
        if not len(begin):
            return
        edge = np.zeros(len(codes) + 1, np.int64)
        edge[begin], edge[end - 1] = 1, edge[end - 1] - 1
        left = np.flatnonzero(np.cumsum(edge)[: len(codes) - 1])


def runs_of(texts: list[list[bytes]]) -> list[list[Run]]:
    """Per document, given as its words, all runs (start, length, period) by start and period."""
    size = np.array([len(t) for t in texts], np.int64)
    first, out = np.cumsum(size) - size, [[] for _ in texts]
    codes = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode().indices.to_numpy()
    doc = np.repeat(np.arange(len(texts)), size)
    stretches: dict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
    for d, begin, end in repetitive(codes, doc):
        stretches[d].append((begin - int(first[d]), codes[begin:end].astype(np.int64)))
    for d, own in stretches.items():
        out[d] = runs_on_grammar(own)
    return out


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that stand in a run after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]


def looped(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's own plant: of every tenth document or so, by a checksum of its id, the end becomes a loop of some of its words."""
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


def _in_batches(docs: DataFrame, rows: Callable[[int | None, list[bytes], list[Run]], tuple], schema: pa.Schema, ddl: str, change: Change | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out, at = b.column(0).to_pylist(), [], 0
            for part in portions([t or "" for t in b.column(1).to_pylist()], 3_000_000):
                own = ids[at : at + len(part)]
                at += len(part)
                words = [t.encode().split() for t in part]  # splits at ASCII white space only
                if change:
                    words = [change(i, w) for i, w in zip(own, words, strict=True)]
                out += [rows(i, w, r) for i, w, r in zip(own, words, runs_of(words), strict=True)]
            columns = zip(*out, strict=True) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ddl)


def collapse(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """doc_id, runs (array of start, length, period: word numbers from 0) and text, whose runs are cut to their first period, words joined by a space.

    A run is a stretch of words with smallest period q and at least 6 and 4 q words that neither neighbour extends. Words are
    divided by ASCII white space. Rows of docs(doc_id, text) are independent: repeated rows count each, other columns
    are not read, null is an empty text (without runs), a null id stays null. Whole texts are searched, which a task holds one at a time.
    change: what becomes of a document's words first.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(run)), ("text", pa.string())])
    rows = lambda i, w, r: (i, [dict(zip(("start", "length", "period"), x, strict=True)) for x in r], b" ".join(kept_words(w, r)).decode())
    return _in_batches(docs, rows, schema, "doc_id long, runs array<struct<start: long, length: long, period: long>>, text string", change)


def digest(docs: DataFrame, change: Change | None = looped) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli; null without runs; ties: first start, then period) and
    digests of all runs and of the collapsed text; see collapse. A null id has no checksum, so that its text stays as it is."""
    names = ("start", "length", "period", "exponent_milli")
    schema = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), *[(n, pa.int64()) for n in names], ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def rows(i: int | None, words: list[bytes], runs: list[Run]) -> tuple:
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
        return i, len(runs), s, n, q, n and 1000 * n // q, sha(listed), sha(b" ".join(kept_words(words, runs)))

    ddl = f"doc_id long, n_runs long, {', '.join(f'{n} long' for n in names)}, runs_sha256 string, collapsed_sha256 string"
    return _in_batches(docs, rows, schema, ddl, change)
