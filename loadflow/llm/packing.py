"""Best-fit packing of token sequences by patterns.

The histogram of lengths, which has at most as many entries as a sequence has places, decides all. Patterns of two or three
lengths that fill a sequence, or pairs that nearly do, are enumerated, and a non-negative least squares fit says how often each should
repeat so that together they use the histogram up. Repeats are rounded, and what they can't cover is packed best fit first, again on
the histogram. Then documents take their places: those of one length are numbered, and numbers are places.
"""

from __future__ import annotations

import re
import sys
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadflow.llm.bpe import WordBpe, portions
from loadflow.llm.common import written

#: Places of a sequence, and the id that ends a document.
CAPACITY, END = 2048, 0


class Ids(WordBpe):
    """The encoder, for ids alone: pieces are merged by tiktoken, and each result is held against the rule of the dynamic programming,
    that no two neighbours could have merged otherwise; a piece that fails it is encoded by that."""

    LATIN = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+").fullmatch

    def __init__(self, path: str, memo: int = 300_000):
        from tiktoken import Encoding

        super().__init__(path, memo)
        # A byte that no text holds ends a word, and joins the last letter before any merge.
        byte, end = {c: bytes([b]) for b, c in enumerate(self.letters)}, b"\xff"
        raw = lambda s: b"".join([byte[c] if ord(c) < 0x10000 else byte[chr(ord(c) - 0x10000)] + end for c in s])
        known = {raw(s): i for s, i in self.ids.items()}
        merged = sorted((self.parts[i][2], t) for t, i in known.items() if i in self.parts)
        last = [b + end for b in byte.values() if b + end in known]
        order = [bytes([b]) for b in range(256)] + last + [t for _, t in merged]
        self.of_rank = [known.get(t) for t in order]
        self.merge = Encoding("word ends", pat_str=".", mergeable_ranks={t: r for r, t in enumerate(order)}, special_tokens={})._encode_single_piece
        self.stay: set[tuple[int, int]] = set()  # pairs found to be compatible
        self.pieces = lru_cache(maxsize=memo)(self._piece)
        self.chunks = lru_cache(maxsize=memo)(self._ids)

    def _piece(self, piece: str) -> tuple[int, ...]:
        raw = piece.encode("utf-8")
        ids = [self.of_rank[r] for r in self.merge(raw + b"\xff")]
        pairs = {*zip(ids, ids[1:])}  # noqa: B905
        if None not in ids and (pairs <= self.stay or all(self.compatible(*p) for p in pairs)):
            if len(self.stay) > 1_000_000:
                self.stay.clear()
            self.stay |= pairs
            return tuple(ids)
        letters = [self.letters[b] for b in raw]
        letters[-1] = chr(ord(letters[-1]) + 0x10000)
        return tuple(self.encode_symbols("".join(letters)))

    def _ids(self, chunk: str) -> tuple[int, ...]:
        return self.pieces(chunk) if self.LATIN(chunk) else tuple([i for p in self.split.findall(chunk) for i in self.pieces(p)])

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, and where each text's begin. What stands between spaces is encoded once."""
        chunks = pc.split_pattern(pa.array([self.normal(t).replace("\n", " ") for t in texts], pa.large_string()), " ")
        coded = chunks.flatten().dictionary_encode()
        found = list(map(self.chunks, coded.dictionary.to_numpy(zero_copy_only=False)))
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
        codes = coded.indices.to_numpy()
        n = size[codes]
        ends = np.r_[0, np.cumsum(n)]
        begin = (np.cumsum(size) - size)[codes]
        ids = flat[np.repeat(begin - ends[:-1], n) + np.arange(ends[-1])]
        return ids, ends[chunks.offsets.to_numpy()]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; strings of special tokens stand for these."""
        parts: list[str] = []
        plan: list[list[int | str]] = []
        for text in texts:
            at, steps = 0, []
            for m in self.cut.finditer(text) if self.cut else ():
                steps += [len(parts), m.group()]
                parts.append(text[at : m.start()])
                at = m.end()
            plan.append([*steps, len(parts)])
            parts.append(text[at:])
        ids, at = self.plain(parts)
        own = lambda x: ids[at[x] : at[x + 1]] if isinstance(x, int) else np.array([self.special[x]], np.int32)
        return [own(steps[0]) if len(steps) == 1 else np.concatenate([own(x) for x in steps]) for steps in plan]


def encoder(path: str) -> Ids:
    """The encoder of this Python worker, which serves many tasks: what it has learned of a vocabulary and of words stays from task to task.

    This package travels with the plan and is new to each task, so the encoder is kept under a name of its own. Its memos are bounded.
    """
    held = sys.modules.setdefault("_loadflow_encoders", ModuleType("_loadflow_encoders")).__dict__
    if path not in held:
        held[path] = Ids(path)
    return held[path]


def pieces_of(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of each row of docs(doc_id, text), with part and k: the piece is the
    k-th of its length in its task. To be written before part and k are used."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, seen = encoder(path).batch, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            doc_ids, at = b.column(0), 0
            for texts in portions([t or "" for t in b.column(1).to_pylist()]):
                rows, tokens = [], []
                for i, ids in enumerate(ids_of(texts), at):
                    ids = np.append(ids, np.int32(end)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        own = ids[start : start + capacity]
                        rows.append((i, piece, start, len(own), zlib.crc32(own.tobytes()), part, seen[len(own)]))
                        seen[len(own)] += 1
                        if with_ids:
                            tokens.append(own.astype(np.int32))
                at += len(texts)
                columns = list(np.array(rows, np.int64).T)
                arrays = [doc_ids.take(pa.array(columns[0])), *map(pa.array, columns[1:])]
                if with_ids:
                    offsets = np.cumsum([0, *map(len, tokens)])
                    arrays.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(tokens))))
                arrays[1] = arrays[1].cast(pa.int32())
                yield pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, k long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


#: Room that a pair may leave, and what a place left costs in the fit, in parts of the mean count of a length.
ROOM, COST = (0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128), 0.003


def patterns(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a >= b >= c, c 0 for a pair) of the lengths: triples that fill `capacity`, and pairs that fill it or leave a little room; and that room."""
    known = np.zeros(capacity + 1, bool)
    known[lengths] = True
    found = []
    for c, room in [(0, r) for r in ROOM] + [(int(c), 0) for c in lengths[lengths <= capacity // 3]]:
        b = np.arange(max(c, 1), (capacity - c - room) // 2 + 1)
        a = capacity - c - room - b
        good = known[b] & known[a]
        found.append(np.stack([a[good], b[good], np.full(good.sum(), c), np.full(good.sum(), room)], axis=1))
    found = np.concatenate(found)
    return found[:, :3], found[:, 3]


def fit(left: np.ndarray, triples: np.ndarray, room: np.ndarray, rounds: int = 40, width: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative least squares: how often patterns repeat so that they use `left` (documents by length) up; patterns with a share, and the shares.

    What is minimised is the sum of squares of what is left of each length, and a small cost for each place that stays free, so that room is left only
    where the rest can't be used up otherwise. Coordinate descent: each round takes up to `width` patterns with the steepest
    descent, none of which share a length, so that their best steps are independent of each other; then patterns that already
    have a share are corrected, down to zero at the least.
    """
    rest = left.astype(float)
    rest[0] = 0.0
    share: dict[int, float] = {}
    a, b, c = triples.T
    three = c > 0
    # A pattern's gradient is the sum of what is left of its lengths; its best step divides that by the sum of squares of its counts.
    square = 2.0 + three + 2 * (a == b) + 2 * ((b == c) & three) + 2 * ((a == c) & three)
    cost = room * (COST * left[left > 0].mean())
    for _ in range(rounds):
        slope = (rest[a] + rest[b] + rest[c] - cost) / np.sqrt(square)
        top = np.argpartition(-slope, min(len(slope) - 1, 8 * width))[: 8 * width]
        top = top[np.argsort(-slope[top], kind="stable")]
        used, steps = set(), 0
        for j in top[slope[top] > 1e-3].tolist():
            own = {int(a[j]), int(b[j]), int(c[j])} - {0}
            if steps < width and not own & used:
                used |= own
                steps += 1
                share.setdefault(j, 0.0)
        moved = 0.0
        for _ in range(2):
            for j in list(share):
                x, y, z = int(a[j]), int(b[j]), int(c[j])
                step = max((rest[x] + rest[y] + (rest[z] if z else 0.0) - cost[j]) / square[j], -share[j])
                moved = max(moved, abs(step))
                share[j] += step
                rest[x] -= step
                rest[y] -= step
                if z:
                    rest[z] -= step
        if not steps and moved < 1e-3:
            break
    chosen = np.array([j for j, v in share.items() if v > 1e-6], np.int64)
    return triples[chosen], np.array([share[j] for j in chosen.tolist()])


Group = tuple[int, list[tuple[int, int]]]  # sequences, and the lengths that each holds with their counts


def by_patterns(left: np.ndarray, capacity: int, passes: int = 4) -> list[Group]:
    """Sequences that patterns fill; takes their documents out of `left`. Each pass fits what the one before has left, and rounds."""
    out: list[Group] = []
    for _ in range(passes):
        triples, room = patterns(np.flatnonzero(left), capacity)
        if not len(triples):
            break
        triples, share = fit(left, triples, room)
        order, done = np.lexsort((*triples.T, -share)), 0
        for j in order.tolist():
            own: dict[int, int] = {}
            for x in triples[j].tolist():
                if x:
                    own[x] = own.get(x, 0) + 1
            repeat = min(int(share[j] + 0.5), *(int(left[x]) // m for x, m in own.items()))
            if repeat:
                out.append((repeat, list(own.items())))
                for x, m in own.items():
                    left[x] -= repeat * m
                done += repeat
        if not done:
            break
    return out


def best_fit(left: np.ndarray, capacity: int) -> list[Group]:
    """The rest, from the longest down, each into the fullest sequence that has room; documents of a length move as one."""
    room: list[tuple[int, int]] = []  # (places left, number of the group), in order
    groups: list[list] = []

    def put(count: int, held: list[tuple[int, int]], free: int) -> None:
        groups.append([count, held])
        if free:
            insort(room, (free, len(groups) - 1))

    for x in range(capacity, 0, -1):
        n = int(left[x])
        while n:
            i = bisect_left(room, (x, -1))
            free, g = room.pop(i) if i < len(room) else (capacity, None)
            each = min(free // x, n)  # of one sequence
            many = n // each if g is None else min(n // each, groups[g][0])
            held = [] if g is None else groups[g][1]
            if g is not None:
                groups[g][0] -= many
                if groups[g][0]:
                    insort(room, (free, g))
            put(many, [*held, (x, each)], free - each * x)
            n -= many * each
    left[:] = 0
    return [(count, held) for count, held in groups if count]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Places for documents by length, and the number of sequences. A row of places: length, first number, documents of that length in a sequence, first sequence,
    offset; document `first number + i` of the length stands in sequence `first + i // m`, i % m lengths after the offset."""
    left = np.zeros(capacity + 1, np.int64)
    for x, n in histogram.items():
        left[x] = n
    rows, used, sequences = [], np.zeros(capacity + 1, np.int64), 0
    for count, held in [*by_patterns(left, capacity), *best_fit(left, capacity)]:
        offset = 0
        for x, m in held:
            rows.append((x, int(used[x]), m, sequences, offset))
            used[x] += count * m
            offset += m * x
        sequences += count
    rows.sort()
    return np.array(rows, np.int64).reshape(-1, 5), sequences


def placed(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces, a written table of pieces_of, with sequence_id and offset.

    The histogram has `capacity` entries at most, and so have the patterns of each size by which it is packed: the places, some thousand rows whatever
    the number of documents, travel with the plan. The number of a document within its length is its k in its task and the count of that
    length in the tasks before.
    """
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("_n"))
    counts = written(counts)
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    places, _ = plan(histogram, capacity)
    past = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_first"))
    # The counts grow with the tasks, a row for each length and task; they are never broadcast.
    numbered = pieces.join(first.hint("merge"), ["length", "part"]).withColumn("_k", F.col("k") + F.col("_first")).drop("part", "k", "_first")
    columns = [c for c in numbered.columns if c != "_k"]
    # A length's first numbers are below 2^50, so that length and number make one sorted key.
    keys = (places[:, 0] << 50) | places[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, k = (b.column(n).to_numpy() for n in ("length", "_k"))
            own = places[np.searchsorted(keys, (length << 50) | k, side="right") - 1] if len(k) else places[:0]
            i = k - own[:, 1]
            sequence, offset = own[:, 3] + i // own[:, 2], own[:, 4] + i % own[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    fields = [f"{n} {t}" for n, t in numbered.dtypes if n != "_k"]
    return numbered.mapInArrow(run, ", ".join([*fields, "sequence_id long", "offset long"]))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece: docs(doc_id, text) packed into few sequences of `capacity` ids.

    A document is its ids and the id `end`; only longer ones are cut, each piece but the last fills a sequence. Null counts as an empty
    text, which is one id. Rows are independent: repeated rows and null ids count each, other columns are not read; no rows give none.
    The number of sequences depends on the lengths alone; which of several documents of one length stands where depends on the tasks.
    """
    out = placed(written(pieces_of(docs, path, capacity, end)), capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """sequence_id, ids and doc_ids of each packed sequence: its ids in order, and the document of every id."""
    out = placed(written(pieces_of(docs, path, capacity, end, with_ids=True)), capacity)
    own = F.struct("offset", "doc_id", "ids")
    held = out.groupBy("sequence_id").agg(F.sort_array(F.collect_list(own)).alias("own"))  # at most `capacity` pieces
    spread = F.flatten(F.transform("own", lambda x: F.array_repeat(x["doc_id"], F.size(x["ids"]))))
    return held.select("sequence_id", F.flatten(F.transform("own", lambda x: x["ids"])).alias("ids"), spread.alias("doc_ids"))
