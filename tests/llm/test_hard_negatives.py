"""Hard negatives against all pairs in exact integers."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadflow.llm import hard_negatives, queries
from loadflow.llm.hard_negatives import Bounds, Codebooks


def brute(rows, is_anchor, k=5, scale=256):
    """rows: (vec_id, label, vector of integers)."""
    out = Counter()
    for x, (anchor, label, v) in enumerate(rows):
        if not is_anchor(anchor):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w, strict=True)), i, lab) for y, (i, lab, w) in enumerate(rows) if y != x and len(w) == len(v)]
        scored.sort()
        for p, pid, _ in [s for s in scored if s[2] == label][:k]:
            fits = [s for s in scored if s[2] != label and 80 * -p <= 100 * -s[0] <= 100 * -p][:k]
            for rank, (n, nid, _) in enumerate(fits, 1):
                out[anchor, pid, rank, nid, -p, -n] += 1
    return out


def whole(vec_id, embedding, label):
    return label is not None and vec_id is not None and embedding and all(x is not None and math.isfinite(x) for x in embedding)


def integers(rows, scale=256):
    return [(r[0], r[2], [math.floor(scale * x) for x in r[1]]) for r in rows if whole(*r)]


def test_query_equals_all_pairs(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    moved = [(i, v, (x + 1) % 10 if i is not None and x is not None and i % 7 == 0 else x) for i, v, x in rows]
    got = queries.queries()["op11_hard_negatives"](spark, sf_dir).collect()
    assert Counter(map(tuple, got)) == brute(integers(moved), lambda i: i % 100 == 0) and len(got) > 10


def test_edges_ties_hot_cells_and_lengths(spark):
    rnd = np.random.default_rng(3)
    rows = []
    for i in range(400):  # clusters, so that cells are left out
        rows.append((i, (rnd.normal(size=8) * 0.05 + 3 * np.eye(8)[i % 4]).tolist(), int(rnd.integers(3))))
    rows += [(1000 + i % 40, [0.5] * 8, 1 + i % 2) for i in range(300)]  # one vector, repeated ids
    rows += [(2000 + i, rnd.normal(size=3).tolist(), i % 2) for i in range(40)]  # another length
    rows += [(10, None, 1), (20, [None] + [1.0] * 7, 1), (30, [float("nan")] * 8, 1), (40, [float("inf")] * 8, 1), (50, [1.0] * 8, None), (None, [1.0] * 8, 1), (60, [], 1), (3000, [-1.0] * 8, 7)]
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<double>, label int, rid string, bound int")
    got = hard_negatives.mine(table.repartition(5), lambda i: i % 10 == 0, codewords=4, block=16, held=2, group=7).collect()
    assert Counter(map(tuple, got)) == brute(integers(rows), lambda i: i % 10 == 0)
    none = hard_negatives.mine(table.where("false"), lambda i: i % 10 == 0)
    assert none.collect() == [] and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_wide_numbers(spark):
    rows = [(i, [float(2**40 + i), float(3 * i), -1.5], i % 2) for i in range(12)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="CAST|OVERFLOW|overflow"):
        hard_negatives.mine(table, lambda i: i % 10 == 0).collect()
    rows = [(i, [float(2**21 + i) + 0.25, float(3 * i), -1.5], i % 2) for i in range(12)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = hard_negatives.mine(table, lambda i: i % 10 == 0, codewords=2).collect()
    assert Counter(map(tuple, got)) == brute(integers(rows), lambda i: i % 10 == 0) and got


def test_bounds_hold_and_cells_are_left_out(spark):
    rnd = np.random.default_rng(9)
    centres = rnd.normal(size=(8, 16)) * 400
    x = np.floor(np.vstack([c + rnd.normal(size=(60, 16)) * 10 for c in centres]))
    books = Codebooks.fitted(list(x), 8)
    a, b = books.cells(x)
    ra, rb = (np.sqrt(((h - c[i]) ** 2).sum(axis=1)) for h, c, i in zip(np.split(x, 2, axis=1), books.of(16), (a, b), strict=True))
    for anchor in x[::37].astype(int):
        bounds = Bounds(books, anchor)
        most = bounds.half(0, a, ra) + bounds.half(1, b, rb)
        score = x @ anchor
        assert (most >= score).all()
        best = np.sort(score)[-6]
        assert (most < best).mean() > 0.5  # most cells can't reach the sixth best
    table = spark.createDataFrame([(i, (v / 256).tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    index = hard_negatives.Index(table, None, 256, 8, 1000, 16, 2)
    asked = index.asked(index.base.where("vec_id % 50 = 0"))
    pairs = asked.select("rid", "vec_id", "shard", "bound").collect()
    shards = {r["rid"]: r["shard"] for r in index.blocks.select("shard", "rids").rdd.flatMap(lambda r: [{"rid": int(i), "shard": r["shard"]} for i in np.frombuffer(r["rids"], "<i8")]).collect()}
    ids = {r["rid"]: r["vec_id"] for r in index.base.select("rid", "vec_id").collect()}
    bound = {(r["vec_id"], r["shard"]): r["bound"] for r in pairs}
    for rid, shard in shards.items():
        for anchor in range(0, len(x), 50):
            assert x[ids[rid]] @ x[anchor] <= bound[anchor, shard]
    assert F.col("bound") is not None and len({r["shard"] for r in pairs}) > 4
