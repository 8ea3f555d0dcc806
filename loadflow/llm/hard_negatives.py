"""Hard negatives from an inverted multi-index.

Vectors are cut in two halves, each with a codebook of its own; the pair of codewords next to a vector is its cell. Cells are
written in blocks with the radius of each half around its codeword, and blocks in shards. No vector of a block scores more with an
anchor than the two halves' scores with the codewords and their radii allow. In a shard, a multi-sequence heap visits the cells from the
greatest sum of the halves' bounds downward, and stops when every window of scores that an anchor asks for is
certified: no cell left can reach its lower end, or its worst place. An anchor first asks the shard with its greatest bound, and
then those whose bound may still change what that gave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadflow.llm.common import written
from loadflow.llm.topk_bitslice import quantised

#: Codewords of each half, and rows at most on which they are fitted: a bounded sample, drawn by a hash of the rows.
CODEWORDS, SAMPLE = 16, 10_000
#: Rows of a block, blocks of a shard, and anchors of a group.
BLOCK, SHARD, GROUP = 2048, 16, 512


def means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k codewords for the rows of x: k-means, from rows that lie far from those before them."""
    rnd = np.random.default_rng(11)
    found = x[[rnd.integers(len(x))]]
    far = ((x - found[0]) ** 2).sum(axis=1)
    while len(found) < k and far.max() > 0:
        found = np.vstack([found, x[rnd.choice(len(x), p=far / far.sum())]])
        far = np.minimum(far, ((x - found[-1]) ** 2).sum(axis=1))
    for _ in range(rounds):
        near = nearest(x, found)
        count = np.bincount(near, minlength=len(found))
        sums = np.stack([np.bincount(near, x[:, d], len(found)) for d in range(x.shape[1])], axis=1) if x.shape[1] else np.zeros((len(found), 0))
        found = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], found)
    return found


def nearest(x: np.ndarray, codewords: np.ndarray) -> np.ndarray:
    return ((codewords**2).sum(axis=1)[None, :] - 2 * (x @ codewords.T)).argmin(axis=1)


@dataclass
class Codebooks:
    """Codewords of both halves for vectors of each length of the sample; others have one cell, around zero."""

    halves: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def fitted(sample: list[np.ndarray], k: int) -> Codebooks:
        by_length: dict[int, list[np.ndarray]] = {}
        for v in sample:
            by_length.setdefault(len(v), []).append(v)
        return Codebooks({n: tuple(means(h, k) for h in np.split(np.stack(own), [n // 2], axis=1)) for n, own in by_length.items()})

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        return self.halves.get(n, (np.zeros((1, n // 2)), np.zeros((1, n - n // 2))))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codewords next to both halves of each row, by number."""
        return tuple(nearest(h, c) for h, c in zip(np.split(x, [x.shape[1] // 2], axis=1), self.of(x.shape[1]), strict=True))


def floats(v: np.ndarray) -> np.ndarray:
    return v.astype(np.float64)


class Rows:
    """Vectors of one cell with their ids: as integers, and as doubles for scores that these hold exactly."""

    def __init__(self, parts: list[tuple[np.ndarray, ...]]):
        self.ids, self.rids, self.labels = (np.concatenate([p[k] for p in parts]) for k in range(3))
        self.v = np.concatenate([p[3] for p in parts])
        self.peak = float(np.abs(self.v).max(initial=0)) if self.v.dtype != object else float("inf")
        self.f = floats(self.v) if self.peak < 1 << 53 else None

    def scores(self, a: np.ndarray) -> np.ndarray:
        """Inner products with a vector of integers, exactly: in doubles where these hold all sums, else in Python's integers."""
        if self.f is not None and a.dtype != object and self.peak * float(np.abs(a).max(initial=0)) * max(1, len(a)) < 1 << 53:
            return (self.f @ a.astype(np.float64)).astype(np.int64)
        return self.v.astype(object) @ a.astype(object)


def to_bytes(v: np.ndarray) -> tuple[bytes, bool]:
    """Integers as bytes; whether they are wider than 64 bits, and so text."""
    return (",".join(map(str, v.ravel())).encode(), True) if v.dtype == object else (v.astype("<i8").tobytes(), False)


def from_bytes(raw: bytes, wide: bool) -> np.ndarray:
    return np.array([int(x) for x in raw.split(b",")], object) if wide else np.frombuffer(raw, "<i8")


class Bounds:
    """What an anchor can score with the vectors of cells, at most."""

    SLACK = 1e-9  # of doubles, in parts of what is added up

    def __init__(self, codebooks: Codebooks, anchor: np.ndarray):
        x = floats(anchor)
        halves = np.split(x, [len(x) // 2])
        books = codebooks.of(len(x))
        self.score = [c @ h for h, c in zip(halves, books, strict=True)]
        self.norm = [float(np.sqrt(h @ h)) for h in halves]
        self.least = [self.SLACK * (1 + n * float(np.sqrt((c**2).sum(axis=1)).max(initial=0))) for n, c in zip(self.norm, books, strict=True)]

    def half(self, side: int, code: np.ndarray, radius: np.ndarray) -> np.ndarray:
        return self.score[side][code] + self.norm[side] * radius * (1 + self.SLACK) + self.least[side]


@dataclass
class Want:
    """The k best rows of the anchor's label (same), or of others, with scores from low to high; None is open."""

    same: bool
    low: int | None
    high: int | None

    def __post_init__(self) -> None:
        self.best: list[tuple[int, int, int]] = []  # (-score, vec_id, row), in order

    def add(self, score: np.ndarray, ids: np.ndarray, rids: np.ndarray, k: int) -> None:
        good = np.ones(len(score), bool)
        if self.high is not None:
            good &= score <= self.high
        floor = self.floor(k)
        if floor is not None:
            good &= score >= floor
        at = np.flatnonzero(good)
        if len(at) > 4 * k:  # all that tie with the k-th stay
            least = np.partition(score[at], len(at) - k)[len(at) - k]
            at = at[score[at] >= least]
        new = [(-int(s), int(i), int(r)) for s, i, r in zip(score[at], ids[at], rids[at], strict=True)]
        self.best = sorted(self.best + new)[:k]

    def floor(self, k: int) -> int | None:
        """Rows with lower scores don't count any more; with this score, smaller ids still do."""
        kth = -self.best[k - 1][0] if len(self.best) == k else None
        return max((x for x in (kth, self.low) if x is not None), default=None)


class Shard:
    """Some blocks of vectors of one length, by cell."""

    #: Cells are visited in their order, but scored together, some rows at a time.
    PORTION = 1024

    def __init__(self, blocks: pd.DataFrame, codebooks: Codebooks):
        self.codebooks = codebooks
        parts: dict[tuple[int, int], list] = {}
        radius: list[dict[int, float]] = [{}, {}]
        for b in blocks.itertuples():
            ids, rids, labels = (np.frombuffer(x, "<i8") for x in (b.ids, b.rids, b.labels))
            parts.setdefault((b.a, b.b), []).append((ids, rids, labels, from_bytes(b.v, b.wide).reshape(len(ids), -1)))
            for side, (code, r) in enumerate(((b.a, b.ra), (b.b, b.rb))):
                radius[side][code] = max(r, radius[side].get(code, 0.0))
        self.cells = {cell: Rows(own) for cell, own in parts.items()}
        self.codes = [np.array(sorted(r)) for r in radius]
        self.radii = [np.array([r[c] for c in sorted(r)]) for r in radius]

    def visit(self, anchor: np.ndarray, rid: int, label: int, wants: list[Want], k: int) -> None:
        bounds = Bounds(self.codebooks, anchor)
        half = [bounds.half(s, self.codes[s], self.radii[s]) for s in (0, 1)]
        order = [np.argsort(-h, kind="stable") for h in half]
        half = [h[o].tolist() for h, o in zip(half, order, strict=True)]
        codes = [c[o].tolist() for c, o in zip(self.codes, order, strict=True)]
        heap, seen, held, n = [(-(half[0][0] + half[1][0]), 0, 0)], {(0, 0)}, [], 0

        def score() -> None:
            score = np.concatenate([r.scores(anchor) for r in held])
            ids, rids, labels = (np.concatenate([getattr(r, name) for r in held]) for name in ("ids", "rids", "labels"))
            same, other = labels == label, rids != rid
            for side in {w.same for w in wants}:
                own = np.flatnonzero((same if side else ~same) & other)
                picked = score[own], ids[own], rids[own]
                for w in wants:
                    if w.same == side:
                        w.add(*picked, k)

        while heap:
            if not held:
                floors = [w.floor(k) for w in wants]
                if all(f is not None and -heap[0][0] < f for f in floors):
                    return  # every window is certified
            _, i, j = heappop(heap)
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(half[0]) and y < len(half[1]) and (x, y) not in seen:
                    seen.add((x, y))
                    heappush(heap, (-(half[0][x] + half[1][y]), x, y))
            if (rows := self.cells.get((codes[0][i], codes[1][j]))) is not None:
                held.append(rows)
                n += len(rows.ids)
            if held and (n >= self.PORTION or not heap):
                score()
                held, n = [], 0


def blocks_of(base: DataFrame, codebooks: Codebooks, rows: int, held: int) -> DataFrame:
    """Blocks of base(vec_id, rid, label, v: integers as bytes, wide, dim, a, b) by cell, numbered by shard: `held` blocks that follow each other.

    Ranges of (length, cell, a hash of the row) are dealt to tasks, so that a cell of any size has as many tasks as it needs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, n = None, [], 0

        def block() -> pa.RecordBatch:
            dim, a, b = key
            ids, rids, labels, raw, wide = zip(*own, strict=True)
            v = [from_bytes(r, w) for r, w in zip(raw, wide, strict=True)]
            x = np.stack([u.astype(object) for u in v]) if any(wide) else np.stack(v)
            r = [float(np.sqrt(((h - c[i]) ** 2).sum(axis=1)).max()) for h, c, i in zip(np.split(floats(x), [dim // 2], axis=1), codebooks.of(dim), (a, b), strict=True)]
            data, is_wide = to_bytes(x)
            longs = (np.array(z, "<i8").tobytes() for z in (ids, rids, labels))
            values = [dim, a, b, *r, *longs, data, is_wide, n // held]
            return pa.RecordBatch.from_arrays([pa.array([z], f.type) for z, f in zip(values, fields, strict=True)], schema=fields)

        for batch in batches:
            cells = zip(*(batch.column(c).to_pylist() for c in ("dim", "a", "b")), strict=True)
            rest = zip(*(batch.column(c).to_pylist() for c in ("vec_id", "rid", "label", "v", "wide")), strict=True)
            for cell, row in zip(cells, rest, strict=True):
                if own and (cell != key or len(own) == rows):
                    yield block()
                    own, n = [], n + 1
                if key is not None and cell[0] != key[0]:
                    n = -(-n // held) * held  # a shard has vectors of one length
                key = cell
                own.append(row)
        if own:
            yield block()

    kinds = [("dim", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("ra", pa.float64()), ("rb", pa.float64()), *[(c, pa.binary()) for c in ("ids", "rids", "labels", "v")], ("wide", pa.bool_()), ("shard", pa.int64())]
    fields = pa.schema(kinds)
    schema = "dim int, a int, b int, ra double, rb double, ids binary, rids binary, labels binary, v binary, wide boolean, shard long"
    dealt = base.repartitionByRange("dim", "a", "b", F.xxhash64("rid")).sortWithinPartitions("dim", "a", "b")
    # Ranges are of one task each, and so are shards.
    return dealt.select("vec_id", "rid", "label", "v", "wide", "dim", "a", "b").mapInArrow(run, schema).withColumn("shard", F.shiftleft(F.spark_partition_id().cast("long"), 32) + F.col("shard"))


def prepared(rows: DataFrame, label: Callable[[Column, Column], Column] | None, scale: int, codewords: int, sample: int) -> tuple[DataFrame, Codebooks]:
    """base(vec_id, rid, label, v, wide, dim, a, b) of the rows that take part, and the codebooks."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    own = F.col("label").cast("long")
    base = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & good)
    base = base.select(F.col("vec_id").cast("long").alias("vec_id"), own.alias("label"), x.alias("x"))
    if label:
        base = base.withColumn("label", label(F.col("vec_id"), F.col("label")).cast("long"))
    base = written(base, row_id="rid")
    drawn = base.orderBy(F.xxhash64("vec_id", "rid")).limit(sample).select("x").toPandas()["x"]
    codebooks = Codebooks.fitted([floats(quantised(np.asarray(v), scale)) for v in drawn], codewords)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("x").value_lengths().to_numpy()
            at, flat = np.cumsum(size) - size, batch.column("x").flatten().to_numpy()
            raw, wide, cells = [b""] * len(size), [False] * len(size), np.zeros((len(size), 2), np.int32)
            for n in np.unique(size).tolist():
                here = np.flatnonzero(size == n)
                v = quantised(flat[at[here][:, None] + np.arange(n)], scale)
                cells[here] = np.stack(codebooks.cells(floats(v)), axis=1)
                for i, row in zip(here.tolist(), v, strict=True):
                    raw[i], wide[i] = to_bytes(row)
            columns = [*(batch.column(c) for c in ("vec_id", "rid", "label")), pa.array(raw, pa.binary()), pa.array(wide), pa.array(size.astype(np.int32)), pa.array(cells[:, 0]), pa.array(cells[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "rid", "label", "v", "wide", "dim", "a", "b"])

    return written(base.mapInArrow(run, "vec_id long, rid long, label long, v binary, wide boolean, dim int, a int, b int")), codebooks


WANTS = "array<struct<same: boolean, low: decimal(38,0), high: decimal(38,0), of: long>>"
FOUND = "rid long, of long, other long, other_id long, score decimal(38,0)"


class Index:
    """The written multi-index of some rows."""

    def __init__(self, rows: DataFrame, label: Callable[[Column, Column], Column] | None, scale: int, codewords: int, sample: int, block: int, held: int):
        self.base, self.codebooks = prepared(rows, label, scale, codewords, sample)
        self.blocks = written(blocks_of(self.base, self.codebooks, block, held))
        #: A shard's cells with their radii: some hundred bytes a shard of tens of thousands of rows.
        self.cells = written(self.blocks.groupBy("dim", "shard").agg(F.collect_set(F.struct("a", "b", "ra", "rb")).alias("cells")))

    def asked(self, anchors: DataFrame) -> DataFrame:
        """anchors(rid, dim, ...) and every shard of vectors of their length, with the greatest score that it may hold: `bound`."""
        codebooks = self.codebooks

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for raw, wide, cells in zip(*(batch.column(c).to_pylist() for c in ("v", "wide", "cells")), strict=True):
                    bounds = Bounds(codebooks, from_bytes(raw, wide))
                    a, b, ra, rb = (np.array([c[k] for c in cells]) for k in ("a", "b", "ra", "rb"))
                    out.append(float((bounds.half(0, a, ra) + bounds.half(1, b, rb)).max()))
                kept = [c for c in batch.schema.names if c != "cells"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.float64())], names=[*kept, "bound"])

        # Most vectors have one length, so anchors are dealt over tasks, each of which gets the cells of that length.
        parts = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        every = self.cells.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        pairs = anchors.withColumn("_p", F.pmod(F.xxhash64("rid"), F.lit(parts)).cast("int")).join(every, ["dim", "_p"]).drop("_p")
        schema = ", ".join([*(f"{n} {t}" for n, t in pairs.dtypes if n != "cells"), "bound double"])
        return pairs.mapInArrow(run, schema)

    def search(self, visits: DataFrame, k: int, group: int) -> DataFrame:
        """visits(rid, label, v, wide, shard, wants, home) -> what each shard holds of the k best for each want.

        A task has one shard and a group of anchors: those with the same home shard, which lie near each other, dealt by a hash where they are many.
        A shard travels only to groups that ask it.
        """
        codebooks = self.codebooks
        many = visits.groupBy("home").agg(F.count_distinct("rid").alias("_n")).select("home", F.ceil(F.col("_n") / group).alias("_of"))
        left = visits.join(many, "home").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("_of"))).drop("_of")
        left = written(left)
        right = left.select(*(F.col(c).alias(c) for c in ("shard", "home", "part"))).distinct().join(self.blocks, "shard")

        def run(asked: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(asked) and len(blocks):
                shard = Shard(blocks, codebooks)
                for row in asked.itertuples():
                    number = lambda x: None if x is None else int(x)
                    wants = [Want(w["same"], number(w["low"]), number(w["high"])) for w in row.wants]
                    shard.visit(from_bytes(row.v, row.wide), row.rid, row.label, wants, k)
                    out += [(row.rid, given["of"], r, i, -s) for given, w in zip(row.wants, wants, strict=True) for s, i, r in w.best]
            found = pd.DataFrame(out, columns=["rid", "of", "other", "other_id", "score"])
            return found.assign(score=found["score"].map(_decimal))

        key = ["shard", "home", "part"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(run, FOUND)

    def best(self, anchors: DataFrame, k: int, group: int) -> DataFrame:
        """anchors(rid, label, v, wide, dim, wants) -> rid, of, rank, other, other_id, score: the k best of each want."""
        asked = written(self.asked(anchors))
        homes = asked.groupBy("rid").agg(F.max_by("shard", F.struct("bound", "shard")).alias("home"))
        asked = asked.join(homes, "rid")
        first = written(self.search(asked.where("shard = home"), k, group))
        # A full list at home raises the lower end of its window.
        kth = first.groupBy("rid", "of").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
        known = kth.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("of", "kth"))).alias("known"))
        raised = F.transform("wants", lambda w: F.struct(w["same"].alias("same"), F.greatest(w["low"], F.try_element_at("known", w["of"])).alias("low"), w["high"].alias("high"), w["of"].alias("of")))
        rest = asked.where("shard <> home").join(known, "rid", "left").withColumn("wants", raised).drop("known")
        open_ = F.filter("wants", lambda w: w["low"].isNull() | (w["low"].cast("double") <= F.col("bound") + F.abs("bound") * 1e-12))
        rest = rest.withColumn("wants", open_.cast(WANTS)).where(F.size("wants") > 0)
        found = first.unionByName(self.search(rest, k, group))
        w = Window.partitionBy("rid", "of").orderBy(F.desc("score"), "other_id", "other")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _decimal(x: int):  # noqa: ANN202
    from decimal import Decimal

    return Decimal(x)


def mine(
    rows: DataFrame, is_anchor: Callable[[Column], Column], label: Callable[[Column, Column], Column] | None = None, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100),
    scale: int = 256, codewords: int = CODEWORDS, sample: int = SAMPLE, block: int = BLOCK, held: int = SHARD, group: int = GROUP,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows(vec_id, embedding, label).

    Scores are inner products of floor(scale * x). An anchor (is_anchor of vec_id) has as positives its first other rows of the same label,
    and for each of these as negatives the first rows of other labels with share * positive_score <= negative_score <= positive_score. Higher
    scores come first, ties by smaller vec_id. label: what becomes of a label, from (vec_id, label).
    Rows with a null id, label or vector, an empty one, or null or non-finite components take no part. Vectors meet only
    vectors of their length. Repeated rows and ids count each: an anchor's own row is no partner, another row with its id is. Every
    list is exact, whatever the codebooks; these are fitted on `sample` rows at most. Scores that don't fit a long raise an error.
    """
    index = Index(rows, label, scale, codewords, sample, block, held)
    number = lambda x: x.cast("decimal(38,0)")
    want = lambda same, low, high, of: F.struct(F.lit(same).alias("same"), number(low).alias("low"), number(high).alias("high"), of.cast("long").alias("of"))
    anchors = index.base.where(is_anchor(F.col("vec_id"))).select("rid", "vec_id", "label", "v", "wide", "dim")
    asked = anchors.drop("vec_id").withColumn("wants", F.array(want(True, F.lit(None), F.lit(None), F.lit(0))).cast(WANTS))
    near = written(index.best(asked, positives, group).select("rid", F.col("rank").alias("of"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")))
    # 80 p <= 100 n: n is at least 80 p / 100, rounded up. A negative p has an empty window.
    over, under = share
    low = F.ceil(F.col("positive_score") * over / under)
    windows = near.where(low <= F.col("positive_score")).groupBy("rid").agg(F.collect_list(want(False, low, F.col("positive_score"), F.col("of"))).cast(WANTS).alias("wants"))
    found = index.best(anchors.drop("vec_id").join(windows, "rid"), negatives, group)
    out = found.join(near, ["rid", "of"]).join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
    return out.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"),
        F.col("positive_score").cast("long").alias("positive_score"), F.col("score").cast("long").alias("negative_score"),
    )
