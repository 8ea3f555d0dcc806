"""SimHash near-duplicates: deletion-variant signatures, equality join, verification, components.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in at most 4 (or 5) bits have a segment
in which they differ by at most one bit, and so share the key (segment, wildcard position, other bits of the segment).
Each distinct fingerprint is indexed under its 64 one-wildcard variants, rows with equal keys meet by a shuffle, and
every link is verified on all 64 bits. Within a key's group no pair list is made: groups give a spanning forest
of their links, which is all that the components need. Components come from alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadflow.llm.common import hot_join, written

#: First bit and width of the three segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def fingerprint(raw: bytes | None, shingle: int) -> int:
    """The fingerprint of a UTF-8 text as an unsigned number."""
    words = (raw or b"").lower().split()  # bytes: lower-cases A-Z and splits on ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(begins, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(ones * 2 > len(hashes)).tolist())


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp long (the 64 bits) of each row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), shingle) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("t")).mapInArrow(run, "doc_id long, fp long")


def variants(fp: Column) -> Column:
    """The 64 keys of a fingerprint: the wildcard's bit position above the other bits of its segment."""
    keys = []
    for low, width in SEGMENTS:
        part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        keys += [part.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i))).bitwiseOR(F.lit((low + i) << 32)) for i in range(width)]
    return F.array(*keys)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which fingerprints differ; on unsigned numbers, as numpy counts the bits of absolute values."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(f: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that connect the distinct fingerprints f as all links within `most` bits do."""
    left, out = np.unique(f), []
    while left.size:
        todo, left = [left[0]], left[1:]
        while todo and left.size:
            x = todo.pop()
            near = differing(left, x) <= most
            if near.any():
                out += [(int(x), int(y)) for y in left[near]]
                todo += list(left[near])
                left = left[~near]
    return out


def rekeyed(f: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links among many fingerprints of one key: keyed again by one wildcard in each of five shorter segments."""
    out, edges = [], [64 * i // 5 for i in range(6)]
    u = f.view(np.uint64)
    for low, high in zip(edges, edges[1:], strict=False):
        part = (u >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)
        for bit in range(high - low):
            k = part & ~np.uint64(1 << bit)
            order = np.argsort(k, kind="stable")
            out += group_links(k[order], f[order], most, again=False)
    return out


def group_links(k: np.ndarray, f: np.ndarray, most: int, small: int = 64, large: int = 4096, again: bool = True) -> list[tuple[int, int]]:
    """Verified links within runs of equal keys k (sorted). Small runs compare by shifts, others by a search; before that,
    large runs are keyed again, so that the work of a run grows far slower than its pairs."""
    if len(k) < 2:
        return []
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    size = np.diff(np.r_[first, len(k)])
    out: list[tuple[int, int]] = []
    dense = set(np.flatnonzero(size > small).tolist())
    fits = np.repeat(size <= small, size)
    end = np.repeat(first + size, size)
    run = np.repeat(np.arange(len(first)), size)
    at, hits = np.flatnonzero(fits), []
    for step in range(1, small):
        at = at[at + step < end[at]]
        if not at.size:
            break
        hits.append(np.stack([at, at + step], 1)[differing(f[at], f[at + step]) <= most])
    found = np.concatenate(hits) if hits else np.empty((0, 2), np.int64)
    if found.size:
        per = np.bincount(run[found[:, 0]], minlength=len(first))
        many = per >= size  # more links than a tree needs
        dense |= set(np.flatnonzero(many).tolist())
        for a, b in found[~many[run[found[:, 0]]]].tolist():
            out.append((int(f[a]), int(f[b])))
    for g in dense:
        own = f[first[g] : first[g] + size[g]]
        out += rekeyed(own, most) if again and size[g] > large else forest(own, most)
    return out


def links(nodes: DataFrame, most: int = 4) -> DataFrame:
    """u < v: links between the distinct fingerprints nodes(fp) that connect what all links within `most` bits do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            p = np.sort(np.array(pairs, np.int64).reshape(-1, 2), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], ["u", "v"])

        k, f = np.empty(0, np.int64), np.empty(0, np.int64)
        for b in batches:
            k = np.r_[k, b.column(0).to_numpy()]
            f = np.r_[f, b.column(1).to_numpy()]
            cut = int(np.searchsorted(k, k[-1])) if len(k) else 0
            yield out(group_links(k[:cut], f[:cut], most))
            k, f = k[cut:], f[cut:]
        yield out(group_links(k, f, most))

    keyed = nodes.select(F.explode(variants(F.col("fp"))).alias("k"), "fp")
    return keyed.repartition("k").sortWithinPartitions("k").mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(u, v): root is the smallest node of its component.

    Alternates large and small stars until nothing changes; each round is a written table. The star of a node
    with many neighbours is one partial aggregate and a join that keeps hot nodes' rows where they are.
    """

    def state(df: DataFrame) -> tuple[int, int]:
        r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
        return r["n"], int(r["h"])

    def with_least(rows: DataFrame) -> DataFrame:
        """rows(u, v) and m, the least of u and all its v."""
        rows = written(rows)
        least = written(rows.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n")))
        return hot_join(rows, least, ["u"], "n", max(1, rows.count()))

    edges = written(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct())
    before = state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("m").alias("u"), "v").distinct()
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))  # from the larger to the smaller
        small = with_least(down)
        small = small.select(F.col("m").alias("u"), "v").unionByName(small.select(F.col("m").alias("u"), F.col("u").alias("v")))
        edges = written(small.where("u <> v").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, most: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links) per row of docs.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows stay, each with its result.
    A null doc_id takes part but is never a component_id, unless its whole component has none. Columns other
    than doc_id and text have no influence.
    """
    if not 0 <= most <= 5:
        raise ValueError("three segments with one wildcard find links of up to 5 bits")
    fps = written(fingerprints(docs, shingle))
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")))
    roots = written(components(links(nodes.select("fp"), most)))
    placed = written(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "n", "first_id", F.coalesce("root", "fp").alias("root")))
    least = written(placed.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("weight")))
    named = hot_join(placed, least, ["root"], "weight", max(1, placed.count())).select("fp", "n", "component_id")
    out = hot_join(fps, written(named), ["fp"], "n", max(1, fps.count()))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, most: int = 4) -> DataFrame:
    """docs without near-duplicates: of each component the row with the smallest doc_id stays (null ids come last)."""
    cols = docs.columns
    rows = written(docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row")), row_id="rid")
    near = near_duplicates(rows.select(F.col("rid").alias("doc_id"), F.col("row.text").alias("text")), shingle, most)
    near = near.join(rows.select(F.col("rid").alias("doc_id"), F.col("row.doc_id").alias("own")), "doc_id")
    best = near.groupBy("component_id").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", F.col("doc_id").alias("rid"))).alias("best"))
    return rows.join(best.select(F.col("best.rid").alias("rid")), "rid", "left_semi").select(*[F.col(f"row.`{c}`").alias(c) for c in cols])
