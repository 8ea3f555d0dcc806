"""Exact top-k search by a bit-sliced index.

The index holds rows in blocks: every attribute (vector component, as an integer) of a block is a stack of bitmaps, one a
binary digit, written once. A query's score for all rows of a block is a sum of such slices, shifted by the digits of
the query's components, and is added up by bitmap arithmetic alone, whatever its number of digits. The top rows are read off
the score's slices from the most significant one downward, rows that tie at the boundary are resolved by their ids, and their
scores are read off the same slices. Groups of blocks meet groups of queries in a grid; each cell gives its k best
rows a query, and a window over those gives the k best of all.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadflow.llm.common import written

_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: What packed rows hold, for Spark and for Arrow.
QUERY_FIELDS = {"dim int": pa.int32(), "ids binary": pa.binary(), "rids binary": pa.binary()}


def quantised(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly: 64-bit integers, or Python's where these are too small."""
    if np.abs(x).max(initial=0) * scale < 1 << 60:
        return np.floor(x * scale).astype(np.int64)
    exact = [int(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale) for v in x.ravel().tolist()]
    return np.array(exact, object).reshape(x.shape)


def slices(values: np.ndarray) -> np.ndarray:
    """digits x words: the bitmaps of the binary digits of non-negative integers, least significant first."""
    width = max(1, int(values.max(initial=0)).bit_length())
    bits = np.stack([(values >> i) & 1 for i in range(width)]).astype(np.uint8)
    return bitmaps(bits)


def bitmaps(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of words."""
    padded = np.zeros((len(flags), -(-flags.shape[1] // 64) * 64), np.uint8)
    padded[:, : flags.shape[1]] = flags
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


class Adder:
    """Sums bit planes by carry-save addition: at most two planes of each weight wait for the next."""

    def __init__(self) -> None:
        self.waiting: list[list[np.ndarray]] = []

    def add(self, plane: np.ndarray, weight: int) -> None:
        while True:
            while len(self.waiting) <= weight:
                self.waiting.append([])
            own = self.waiting[weight]
            own.append(plane)
            if len(own) < 3:
                return
            a, b, c = own
            half = a ^ b
            self.waiting[weight] = [half ^ c]
            plane, weight = (a & b) | (half & c), weight + 1

    def total(self) -> list[tuple[int, np.ndarray]]:
        """The sum's slices with their weights, least significant first."""
        weight = 0
        while weight < len(self.waiting):
            own = self.waiting[weight]
            if len(own) == 2:
                a, b = own
                self.waiting[weight] = [a ^ b]
                self.add(a & b, weight + 1)
            weight += 1
        return [(w, own[0]) for w, own in enumerate(self.waiting) if own]


def chosen(planes: list[np.ndarray], left: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(query number, row number) of the `most` best rows among those in left, a bitmap, by each query's score slices; ties to lower numbers."""
    sure = np.zeros_like(left)
    need = np.minimum(most, np.bitwise_count(left).sum(axis=1, dtype=np.int64))
    for plane in reversed(planes):
        high = left & plane
        more = (np.bitwise_count(sure | high).sum(axis=1, dtype=np.int64) > need)[:, None]
        sure = np.where(more, sure, sure | high)
        left = np.where(more, high, left & ~plane)
    at = lambda m: np.unpackbits(m.view(np.uint8), axis=1, bitorder="little")
    some, tied = at(sure), at(left)
    tied &= np.cumsum(tied, axis=1, dtype=np.int32) <= (need - some.sum(axis=1, dtype=np.int64))[:, None]
    return np.nonzero(some | tied)


class Block:
    """Some rows of one length, in order of their ids: per attribute its least value and the slices of what is above that."""

    FIELDS = QUERY_FIELDS | {"low array<string>": pa.list_(pa.string()), "width array<int>": pa.list_(pa.int32()), "planes binary": pa.binary()}

    @staticmethod
    def pack(ids: np.ndarray, rids: np.ndarray, x: np.ndarray, scale: int) -> list:
        order = np.argsort(ids, kind="stable")
        v = quantised(x[order], scale)
        low = v.min(axis=0)
        own = [slices(v[:, d] - low[d]) for d in range(v.shape[1])]
        return [v.shape[1], ids[order].tobytes(), rids[order].tobytes(), [str(x) for x in low], [len(p) for p in own], np.concatenate(own).tobytes()]

    def __init__(self, row: object):
        self.ids, self.rids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.rids, np.int64)
        self.low, self.width = [int(x) for x in row.low], np.asarray(row.width)
        self.planes = np.split(np.frombuffer(row.planes, np.uint64).reshape(self.width.sum(), -1), np.cumsum(self.width)[:-1])

    def best(self, queries: np.ndarray, rids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, row number, score) of the k rows with the greatest inner products for each query, its own row apart.

        All terms are made non-negative first: a row's attributes count from the block's least, and for a negative component of a
        query the slice's complement is added. That changes all scores of a query by one amount, which is taken back in the end.
        """
        adder, size = Adder(), np.abs(queries)
        back = np.zeros(len(queries), object)
        for d, planes in enumerate(self.planes):
            negative = queries[:, d] < 0
            flip = np.where(negative, _ONES, np.uint64(0))[:, None]
            back = back + queries[:, d].astype(object) * np.array([self.low[d], self.low[d] + (1 << len(planes)) - 1], object)[negative.astype(int)]
            for j in range(int(size[:, d].max(initial=0)).bit_length()):
                mask = np.where((size[:, d] >> j) & 1 == 1, _ONES, np.uint64(0))[:, None]
                if mask.any():
                    for b, p in enumerate(planes):
                        adder.add((p[None, :] ^ flip) & mask, j + b)
        total = adder.total()
        left = ~bitmaps(rids[:, None] == self.rids[None, :])
        left[:, -1] &= _ONES >> np.uint64(-len(self.ids) % 64)
        i, j = chosen([p for _, p in total], left, k)
        kind = np.int64 if not total or total[-1][0] < 61 else object
        score, word, bit = np.zeros(len(i), kind), j // 64, (j % 64).astype(np.uint64)
        for w, p in total:
            score = score + (((p[i, word] >> bit) & np.uint64(1)).astype(np.int64).astype(kind) << w)
        return i, j, score.astype(object) + back[i]


def packed(rows: DataFrame, n: int, fields: dict[str, pa.DataType], pack: Callable[[np.ndarray, np.ndarray, np.ndarray], list]) -> DataFrame:
    """rows(vec_id, rid, v) in blocks of at most n rows, each of vectors of one length, as tasks read them."""
    names = [f.partition(" ")[0] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def out(some: list[tuple]) -> pa.RecordBatch:
            ids, rids, vs = zip(*some, strict=True)
            values = pack(np.array(ids, np.int64), np.array(rids, np.int64), np.stack(vs))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, fields.values(), strict=True)], names)

        count = 0
        for b in batches:
            flat, at = b.column(2).flatten().to_numpy(), 0
            for i, r, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).value_lengths().to_pylist(), strict=True):
                own = held.setdefault(length, [])
                own.append((i, r, flat[at : at + length]))
                at, count = at + length, count + 1
                if len(own) == n:
                    yield out(held.pop(length))
                    count -= n
                elif count == 4 * n:  # of many lengths
                    yield from map(out, held.values())
                    held, count = {}, 0
        yield from map(out, held.values())

    return rows.select("vec_id", "rid", "v").mapInArrow(run, ", ".join(fields))


def top_k(rows: DataFrame, is_query: Callable[[Column], Column], k: int = 5, scale: int = 256, rows_in_block: int = 4096, queries_in_block: int = 128, score: str = "long") -> DataFrame:
    """query_id, rank, vec_id, score: the k best of rows(vec_id, embedding) for each row of it that is_query selects.

    Score: inner product of floor(scale * x); ties go to the smaller vec_id. Every row is a candidate but the query's own, so that
    other rows with a query's id, and repeated rows, count each; queries with equal ids have each their k rows. Vectors that
    are null or empty, or that hold a null or non-finite component, and rows without an id take no part.
    Vectors meet only vectors of their length. Sums have as many digits as they need; a score that is given
    but doesn't fit the type `score` (long, or decimal(38,0)) raises an error. No row at all gives none.
    """
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    base = rows.where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))
    base = written(base, row_id="rid")
    index = written(packed(base, rows_in_block, Block.FIELDS, lambda ids, rids, v: Block.pack(ids, rids, v, scale)), row_id="block")
    raw = lambda ids, rids, v: [v.shape[1], ids.tobytes(), rids.tobytes(), v.tobytes()]
    asked = base.where(is_query(F.col("vec_id")))
    asked = asked.repartition(max(1, -(-asked.count() // (16 * queries_in_block))))  # few blocks that aren't full
    queries = written(packed(asked, queries_in_block, QUERY_FIELDS | {"v binary": pa.binary()}, raw), row_id="block")
    wide = 2 * rows.sparkSession.sparkContext.defaultParallelism
    n = [max(1, -(-blocks // max(1, min(32, blocks // wide)))) for blocks in (index.count(), queries.count())]
    group = lambda of: F.pmod(F.xxhash64("block"), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    cell = ["dim", "r", "q"]
    left = queries.select("dim", "ids", "rids", "v", group(n[1]).alias("q"), every(n[0]).alias("r"))
    right = index.select("dim", "ids", "rids", "low", "width", "planes", group(n[0]).alias("r"), every(n[1]).alias("q"))

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        found = []
        blocks = [Block(row) for row in c.itertuples()] if len(q) else []
        for row in q.itertuples() if blocks else ():
            ids, rids = np.frombuffer(row.ids, np.int64), np.frombuffer(row.rids, np.int64)
            v = quantised(np.frombuffer(row.v).reshape(len(ids), -1), scale)
            hits = []
            for b in blocks:
                i, j, s = b.best(v, rids, k)
                hits.append(pd.DataFrame({"own": rids[i], "query_id": ids[i], "vec_id": b.ids[j], "score": s}))
            best = pd.concat(hits)
            best = best.assign(down=-best["score"]).sort_values(["own", "down", "vec_id"], kind="stable")
            found.append(best.groupby("own", sort=False).head(k).drop(columns="down"))
        if not found:
            return pd.DataFrame({"own": [], "query_id": [], "vec_id": [], "score": []}, dtype=object)
        out = pd.concat(found)
        return out.assign(score=out["score"].map(str))

    found = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(run, "own long, query_id long, vec_id long, score string")
    w = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("score", F.col("score").cast("decimal(38,0)"))
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", F.col("score").cast(score).alias("score"))
