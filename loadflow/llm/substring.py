"""Substring dedup by fixed-block anchors.

Every document is indexed by its non-overlapping blocks of 7 words, and probes the index with every rolling window of
7 words. Any repeat of 13 words holds a whole block of the earlier document, so that no repeat is missed. Where an
anchor of one document meets a window of another, the hits are extended: the runs of 13-word windows around them are
compared over the whole corpus, which gives the maximal exact repeats and the smallest document of each window.

Documents travel in compressed chunks. Keys leave a chunk once each, sorted and delta-coded, with a flag
for anchors and for keys of several documents: a passage that a third of all documents hold costs one key a chunk. Key
ranges are reduced in tasks of bounded size, and answers go back to chunks in key order. Where there would be many ranges, a chunk
gives a fixed number of coarse ones, chunks are merged range by range, and what is merged is cut into finer ranges, so that the
number of rows follows the number of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadflow.llm.common import written

BLOCK, REPEAT = 7, 13
PIECE = "source long, part long, keys binary, low binary, value binary"


def squeeze(a: np.ndarray) -> bytes:
    """Integers, byte plane by byte plane, so that planes of zeros cost nothing."""
    return zstandard.compress(a.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unsqueeze(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def deltas(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def undeltas(raw: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(raw), dtype=np.uint64)


def rolling(h: np.ndarray, k: int, by: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(by) + h[j : j + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def groups(*sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each run of equal keys begins, and the run's number for every key."""
    if not len(sorted_keys[0]):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])]
    return np.flatnonzero(new), np.cumsum(new) - 1


class Chunk:
    """Some documents: ids (with a mask for null), words, and the keys that all steps work out alike."""

    def __init__(self, raw: bytes):
        data = zstandard.decompress(raw)
        n = int.from_bytes(data[:8], "little")
        head = np.frombuffer(data, np.int64, 3 * n, 8)
        self.ids, self.known, self.size = head[:n], head[n : 2 * n].astype(bool), head[2 * n :]
        text = data[8 + 24 * n :]
        self.words = text.split(b" ") if text else []
        self.first = np.cumsum(self.size) - self.size
        self.doc = np.repeat(np.arange(n), self.size)
        digest = xxhash.xxh64_intdigest
        self.hashes = np.fromiter((digest(w) for w in self.words), np.uint64, len(self.words))

    @staticmethod
    def pack(ids: list[int | None], texts: list[list[bytes]]) -> bytes:
        head = np.array([[i or 0 for i in ids], [i is not None for i in ids], [len(t) for t in texts]], np.int64)
        return zstandard.compress(len(ids).to_bytes(8, "little") + head.tobytes() + b" ".join([b" ".join(t) for t in texts if t]), 3)

    def inside(self, k: int) -> np.ndarray:
        """Whether the k words from each place stand in one document that has an id."""
        d = self.doc
        n = max(0, len(d) - k + 1)
        return (d[:n] == d[k - 1 : k - 1 + n]) & self.known[d[:n]] if n else np.empty(0, bool)

    def anchors(self, bits: int) -> None:
        """Distinct keys in order; per key the flags 1, if it is an anchor's, and 2, if several documents have it; places by key."""
        at = np.flatnonzero(self.inside(BLOCK))
        keys = rolling(self.hashes, BLOCK)[at] >> np.uint64(64 - bits)
        order = np.argsort(keys, kind="stable")
        self.at, keys, doc = at[order], keys[order], self.doc[at[order]]
        first, self.run = groups(keys)
        self.keys = keys[first]
        last = np.r_[first[1:], len(keys)] - 1
        self.flags = np.empty(0, np.int64)
        if len(first):
            anchor = np.logical_or.reduceat((self.at - self.first[doc]) % BLOCK == 0, first)
            self.flags = anchor.astype(np.int64) + 2 * (doc[first] != doc[last])

    def candidates(self, hit: np.ndarray) -> None:
        """The 13-word windows that hold a hit: places, distinct 128-bit hashes in order, the least id for each, places by hash."""
        n = len(self.words)
        places = np.zeros(n + 1, np.int64)
        places[self.at[hit[self.run]] + 1] = 1
        count = np.cumsum(places)
        whole = self.inside(REPEAT)
        start = np.arange(len(whole))
        wanted = whole & (count[start + REPEAT - BLOCK + 1] > count[start])
        start = np.flatnonzero(wanted)
        keys, low = rolling(self.hashes, REPEAT)[start], rolling(self.hashes, REPEAT, 0xC2B2AE3D27D4EB4F)[start]
        order = np.lexsort((low, keys))
        self.start, keys, low = start[order], keys[order], low[order]
        first, self.run13 = groups(keys, low)
        self.keys13, self.low13 = keys[first], low[first]
        ids = self.ids[self.doc[self.start]]
        self.least = np.minimum.reduceat(ids, first) if len(first) else np.empty(0, np.int64)

    def rows(self, least: np.ndarray) -> Iterator[tuple[int | None, int, int, str]]:
        """doc_id, n_words, n_removed, kept_sha256 of each document; least: the corpus' least id for keys13."""
        gone = self.start[least[self.run13] < self.ids[self.doc[self.start]]]
        edge = np.zeros(len(self.words) + REPEAT + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + REPEAT, -1)
        keep = np.cumsum(edge)[: len(self.words)] == 0
        for i in range(len(self.ids)):
            a, b = self.first[i], self.first[i] + self.size[i]
            k = keep[a:b]
            words = self.words[a:b] if k.all() else [self.words[a + j] for j in np.flatnonzero(k)]
            yield int(self.ids[i]) if self.known[i] else None, int(b - a), int(b - a - len(words)), hashlib.sha256(b" ".join(words)).hexdigest()


def pieces(source: int, keys: np.ndarray, low: np.ndarray, value: np.ndarray, bits: int, n: int, begin: int = 0, end: int | None = None) -> list[tuple]:
    """Rows (source, part, keys, low, value) of sorted keys: the key space is cut into n ranges, of which begin to end may hold keys."""
    end = n if end is None else end
    edges = np.array([min(-(-(i << bits) // n), (1 << 64) - 1) for i in range(begin + 1, end)], np.uint64)
    at = np.r_[0, np.searchsorted(keys, edges), len(keys)].tolist()
    return [(source, begin + i, deltas(keys[a:b]), squeeze(low[a:b]), squeeze(value[a:b].view(np.uint64))) for i, (a, b) in enumerate(zip(at, at[1:], strict=False)) if a < b]


def batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], ["source", "part", "keys", "low", "value"])


def merged(g: pd.DataFrame, flags: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The distinct keys of some pieces in order, with one value each, and per piece the numbers of its keys among them.

    Flags are joined, and a key of several pieces is one of several documents; of other values the least counts.
    """
    keys, low, value = [undeltas(x) for x in g["keys"]], [unsqueeze(x) for x in g["low"]], [unsqueeze(x).view(np.int64) for x in g["value"]]
    sizes = np.cumsum([len(k) for k in keys])[:-1]
    keys, low, value = np.concatenate(keys), np.concatenate(low), np.concatenate(value)
    order = np.argsort(keys, kind="stable") if flags else np.lexsort((low, keys))
    first, run = groups(keys[order]) if flags else groups(keys[order], low[order])
    joined = (np.bitwise_or if flags else np.minimum).reduceat(value[order], first)
    if flags:
        joined |= 2 * (np.diff(np.r_[first, len(keys)]) > 1)
    at = np.empty(len(order), np.int64)
    at[order] = run
    return keys[order][first], low[order][first], joined, np.split(at, sizes)


def exchange(found: DataFrame, bits: int, n_sources: int, n: int, cuts: list[int], fan: int, flags: bool) -> DataFrame:
    """source, part, answer for each piece of found: the values of its keys over all sources, in order of its keys.

    The pieces' parts are n ranges of the keys. cuts: into how many finer ones they are still to be cut, step by step. In each step
    some `fan` sources are merged range by range, and cut; the answers to what was merged are then dealt to the sources.
    """

    def answers(g: pd.DataFrame, value: np.ndarray, at: list[np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"source": g["source"], "part": g["part"], "answer": [squeeze(value[x].view(np.uint64)) for x in at]})

    def meet(g: pd.DataFrame) -> pd.DataFrame:
        _, _, value, at = merged(g, flags)
        return answers(g, value, at)

    def finer(g: pd.DataFrame) -> pd.DataFrame:
        keys, low, value, _ = merged(g, flags)
        part = int(g["part"].iat[0])
        return pd.DataFrame(pieces(int(g["team"].iat[0]), keys, low, value, bits, n * cuts[0], part * cuts[0], (part + 1) * cuts[0]), columns=["source", "part", "keys", "low", "value"])

    def deal(g: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        return answers(g, np.concatenate([unsqueeze(x).view(np.int64) for x in a.sort_values("fine")["answer"]]), merged(g, flags)[3])

    out = "source long, part long, answer binary"
    if not cuts:
        return found.groupBy("part").applyInPandas(meet, out)
    teams = -(-n_sources // fan)
    found = written(found.withColumn("team", F.pmod(F.xxhash64("source"), F.lit(teams))))
    got = exchange(found.groupBy("part", "team").applyInPandas(finer, PIECE), bits, teams, n * cuts[0], cuts[1:], fan, flags)
    got = got.select(F.floor(F.col("part") / cuts[0]).alias("part"), F.col("source").alias("team"), F.col("part").alias("fine"), "answer")
    return found.groupBy("part", "team").cogroup(got.groupBy("part", "team")).applyInPandas(deal, out)


def to_chunks(docs: DataFrame, words_in_chunk: int) -> DataFrame:
    """Written: chunk, blob, n_words. A document is never divided, so that a very long one has a chunk of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, n = [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([Chunk.pack(ids, texts)], pa.binary()), pa.array([n], pa.int64())], ["blob", "n_words"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = (t.as_py() or b"").split()
                if ids and n + len(words) > words_in_chunk:
                    yield out()
                    ids, texts, n = [], [], 0
                ids.append(i)
                texts.append(words)
                n += len(words)
        if ids:
            yield out()

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "blob binary, n_words long"), row_id="chunk")


def by_source(df: DataFrame) -> DataFrame:
    """Per chunk its answers in order of key ranges."""
    return df.groupBy(F.col("source").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("part", "answer"))).alias("a"))


def whole(answers: list[dict] | None) -> np.ndarray:
    return np.concatenate([np.empty(0, np.int64), *(unsqueeze(x["answer"]).view(np.int64) for x in answers or [])])


def dedup(docs: DataFrame, words_in_chunk: int = 1_000_000, keys_in_part: int = 4_000_000, fan: int = 256) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 per row of docs(doc_id, text).

    A word goes if a window of 13 words that covers it also starts in a row with a smaller doc_id; all is judged on the
    input, by 128 bits of a window. Null and empty texts have no words. Rows without an id neither remove nor lose words. Rows
    that share an id are one document to others, and don't remove from each other. Other columns have no influence.
    An empty table gives no rows.
    """
    chunks = to_chunks(docs, words_in_chunk)
    size = chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).first()
    bits = min(64, max(40, size["words"].bit_length() + 13))  # a false hit on an anchor only adds a candidate
    first, cuts = max(1, -(-size["words"] // keys_in_part)), []
    if first > fan:
        first, left = fan, -(-first // fan)
        while left > 1:
            cuts.append(min(left, fan))
            left = -(-left // fan)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = Chunk(blob.as_py())
                c.anchors(bits)
                if rows := pieces(chunk, c.keys, np.zeros_like(c.keys), c.flags, bits, first):
                    yield batch(rows)

    found = chunks.select("chunk", "blob").mapInArrow(probes, PIECE)
    hits = written(by_source(exchange(found, bits, size["n"], first, cuts, fan, True)))

    def hit_chunk(blob: bytes, a: list[dict] | None) -> Chunk:
        c = Chunk(blob)
        c.anchors(bits)
        c.candidates(whole(a) == 3)
        return c

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, blob, a in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                c = hit_chunk(blob.as_py(), a.as_py())
                if rows := pieces(chunk, c.keys13, c.low13, c.least, 64, first):
                    yield batch(rows)

    found = chunks.select("chunk", "blob").join(hits, "chunk").mapInArrow(windows, PIECE)
    least = written(by_source(exchange(found, 64, size["n"], first, cuts, fan, False)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob, a, m in zip(b.column(0), b.column(1), b.column(2), strict=True):
                rows = list(hit_chunk(blob.as_py(), a.as_py()).rows(whole(m.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    both = chunks.select("chunk", "blob").join(hits, "chunk", "left").join(least.withColumnRenamed("a", "m"), "chunk", "left")
    return both.select("blob", "a", "m").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
