"""Sharding by Hilbert-curve order over several metadata dimensions.

Each dimension is quantised by rank: equal parts of the rows, whatever the values. The cell's index on the Hilbert curve orders the
rows, and the order is cut into runs. A shard then covers a small range in every dimension, so that readers prune
files by any of them. The global order needs no single sort: counts per cell give each cell's first place,
and rows are numbered within fine cells only. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadflow.llm.common import before, written

#: A cell's rows are dealt by a hash to fine cells of about so many rows, so that a hot cell isn't one window.
IN_FINE = 100_000


def curve_table(n: int) -> list[int]:
    """For n dimensions: at [(entry * n + direction) << n | bits] the digit on the curve, and the next state << n.

    From the Gray code's entry points and directions (Hamilton's form of the curve).
    """
    mask = (1 << n) - 1
    left = lambda x, k: ((x << k % n) | (x >> (n - k % n))) & mask
    gray = lambda i: i ^ (i >> 1)
    ones = lambda i: (i ^ (i + 1)).bit_length() - 1  # noqa: E731  trailing ones
    back = {gray(i): i for i in range(1 << n)}
    out = []
    for e in range(1 << n):
        for d in range(n):
            for bits in range(1 << n):
                w = back[left(bits ^ e, n - (d + 1) % n)]
                entry = 0 if w == 0 else gray(2 * ((w - 1) // 2))
                turn = 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n
                state = ((e ^ left(entry, d + 1)) * n + (d + turn + 1) % n) << n
                out.append(state | w)
    return out


def curve_index(parts: list[Column], bits: int) -> Column:
    """Index on the Hilbert curve of the cell whose coordinates (`bits` bits each) are parts."""
    n = len(parts)
    levels = []
    for i in range(bits - 1, -1, -1):
        digit = F.lit(0)
        for j, p in enumerate(parts):
            digit = digit.bitwiseOR(F.shiftleft(F.shiftright(p, i).bitwiseAND(F.lit(1)), j))
        levels.append(digit)
    table = F.lit(curve_table(n))

    def step(acc: Column, digit: Column) -> Column:
        found = F.get(table, F.shiftleft(acc["state"], n).bitwiseOR(digit))
        return F.struct(F.shiftright(found, n).alias("state"), F.shiftleft(acc["h"], n).bitwiseOR(found.bitwiseAND(F.lit((1 << n) - 1))).alias("h"))

    return F.aggregate(F.array(*levels), F.struct(F.lit(0).alias("state"), F.lit(0).alias("h")), step, lambda a: a["h"])


def ordered(df: DataFrame, name: str) -> Column:
    """A value that orders like the column: the bytes of strings, else a number."""
    return F.col(name).cast("binary" if dict(df.dtypes)[name] == "string" else "double")


def cells_of(rows: DataFrame, dims: list[str], total: int, bits: int) -> list[Column]:
    """The cell of each column in dims: where the middle of its value's rows stands in the order of all rows. Nulls are in cell 0.

    The values of all columns are counted together and dealt by ranges of (column, value), in one shuffle of their distinct values; prefix sums over the ranges and
    inside give their places, as every column has a value in each row. Only the least value of each cell is collected, as the cells of all
    other values follow from it.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.sparkSession.sparkContext.defaultParallelism)
    kinds = dict(rows.dtypes)
    typed = lambda d, kind: (F.col(d) if kinds[d] == kind else F.lit(None).cast(kind)).alias(kind)
    value = ["binary", "double"]
    stacked = F.array(*[F.struct(F.lit(i).alias("dim"), *[typed(d, kind) for kind in value]) for i, d in enumerate(dims)])
    counts = rows.select(F.inline(stacked)).groupBy("dim", *value).agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts.repartitionByRange(parts, "dim", *value).withColumn("part", F.spark_partition_id()))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    first = counts.groupBy("part").agg(F.sum("n").alias("n"))
    first = first.select("part", F.coalesce(F.sum("n").over(before(Window.orderBy("part"))), F.lit(0)).alias("n0"))
    at = F.coalesce(F.sum("n").over(before(Window.partitionBy("part").orderBy("dim", *value))), F.lit(0))
    placed = counts.withColumn("at", at).join(F.broadcast(first), "part")  # one row a partition of the shuffle
    place = F.col("n0") + F.col("at") - F.col("dim") * F.lit(total)
    cell = F.floor((2 * place + F.col("n")).cast("double") / (2 * max(total, 1)) * (1 << bits)).cast("int")
    known = placed.where("binary is not null or double is not null")
    found = known.groupBy("dim", cell.alias("cell")).agg(F.min(F.struct(*value)).alias("least")).collect()  # a row for each column and cell

    def cell_of(i: int, d: str) -> Column:
        least = sorted((r["cell"], r["least"][kinds[d]]) for r in found if r["dim"] == i)
        if not least:
            return F.lit(0)
        passed = F.size(F.filter(F.array(*[F.lit(v) for _, v in least]), lambda v: v <= F.col(d)))
        return F.coalesce(F.get(F.array(*[F.lit(c) for c, _ in least]), passed - 1), F.lit(0))

    return [cell_of(i, d) for i, d in enumerate(dims)]


def shard(docs: DataFrame, n_shards: int = 8, law: str = "rows", dimensions: tuple[str, ...] = ("source", "lang", "doc_id"), bits: int = 4, keep: list[str] | None = None) -> DataFrame:
    """Per row of docs the struct `row` of its columns in keep (doc_id), size, text_crc32, cell, shard and slot (gapless from 0 in each shard).

    size is the text's UTF-8 bytes (none for null) plus 1. law "rows": row counts differ by one at most; "bytes": runs
    end where the sum of sizes passes a shard's part. The size is a dimension besides those named. Null values count as the least of their dimension; repeated rows are placed each on its own.
    An empty table gives no rows.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    keep = keep or ["doc_id"]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    numbers = [ordered(docs, d).alias(f"d{i}") for i, d in enumerate(dimensions)]
    rows = written(
        docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("doc_id").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *numbers)
        .withColumn(f"d{len(numbers)}", F.col("size").cast("double")),
        row_id="rid",
    )
    dims = [f"d{i}" for i in range(len(numbers) + 1)]
    ends = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    n, total = ends["n"], ends["bytes"]

    rows = rows.withColumn("cell", curve_index(cells_of(rows, dims, n, bits), bits))
    # First places: over the cells, over the fine cells of a cell, over the rows of a fine cell.
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    cells = written(rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.floor(F.count(F.lit(1)) / IN_FINE).alias("parts")))
    rows = rows.join(F.broadcast(cells.where("parts > 0").select("cell", "parts")), "cell", "left")  # n / IN_FINE rows at most, and as many as cells
    rows = rows.withColumn("fine", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("rid"), F.col("parts") + 1))).drop("parts")
    first = before(cells.withColumnRenamed("cell", "s"), {"n0": "n", "b0": "b"}, 1 << bits * len(dims)).select(F.col("s").alias("cell"), "n0", "b0")
    fine = rows.groupBy("cell", "fine").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    w = past(Window.partitionBy("cell").orderBy("fine"))
    first = fine.withColumn("n1", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn("b1", F.coalesce(F.sum("b").over(w), F.lit(0))).join(first, "cell")
    first = first.select("cell", "fine", (F.col("n0") + F.col("n1")).alias("n0"), (F.col("b0") + F.col("b1")).alias("b0"))
    w = Window.partitionBy("cell", "fine").orderBy("id", "size", "text_crc32", "rid")
    placed = rows.withColumn("k", F.row_number().over(w) - 1).withColumn("b", F.coalesce(F.sum("size").over(past(w)), F.lit(0))).join(first, ["cell", "fine"])
    placed = placed.withColumn("place", F.col("n0") + F.col("k")).withColumn("at", F.col("b0") + F.col("b"))
    s = F.lit(n_shards).cast("long")
    if law == "rows":
        placed = placed.withColumn("shard", F.floor(F.col("place") * s / F.lit(max(n, 1))).cast("int"))
        placed = placed.withColumn("slot", F.col("place") - F.ceil(F.col("shard") * F.lit(n).cast("long") / s))
    else:
        placed = written(placed.withColumn("shard", F.floor(F.col("at") * s / F.lit(max(total, 1))).cast("int")))
        starts = placed.groupBy("shard").agg(F.min("place").alias("start"))  # one row a shard
        placed = placed.join(F.broadcast(starts), "shard").withColumn("slot", F.col("place") - F.col("start"))
    return placed.select("row", "size", "text_crc32", "cell", "shard", F.col("slot").cast("long").alias("slot"))


def digest(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: rows move when a shard is added)."""
    out = shard(docs, n_shards)
    return out.select("row.doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, law: str = "rows", folder: str = "shard_no") -> None:
    """docs as Parquet with one folder a shard, sorted along the curve, so that row groups prune as well. folder is no column of docs."""
    out = shard(docs, n_shards, law, keep=docs.columns).select("row", F.col("shard").alias(folder), "slot")
    out = out.repartition(n_shards, folder).sortWithinPartitions(folder, "slot").select("row.*", folder)
    out.write.partitionBy(folder).parquet(path)
