"""Mixing sources to target weights: fixed-length token blocks, multinomial draws per shard, index permutations.

The words of each source, in an order fixed by its documents, are one stream cut into blocks of a fixed length. A mix
is a list of slots, dealt to output shards. Each slot of a shard draws its source, which makes the shard's counts
multinomial; what a source draws beyond its quota goes to sources short of theirs, so that totals are exact.
A source's slots run through its blocks in pseudorandom order, a new permutation for each round, and
slots meet blocks by an equality join on (source, block). Sources are a table like any other, however many there are.
Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadflow.llm.common import before, count_words, hot_join, words_of, written
from loadflow.operators.ordered import row_numbers

#: Up to so many sources are broadcast (and at most 4096 rows more); beyond, they are joined by shuffles.
FEW = 10_000
#: Documents of a source are ordered by hash buckets, then by id; a bucket holds about so many rows of all sources.
IN_BUCKET = 65536


def source_key(source: Column) -> Column:
    """Orders by code point with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


class Sources:
    """The table of sources: s (numbers from 0 in order of keys), key, n (rows), words, target, and the slots of a mix:
    whole rounds over all blocks, then as many blocks as the rest needs, the last one cut to fit.

    Targets share the sum of all words by repeating weights. A target stops at `most` times its source's words, and the excess is
    shared by weight among the others until none is above: all have min(unit * weight, most * words) for one
    unit, to which Newton's steps climb; each step is one aggregate over the table.
    """

    def __init__(self, rows: DataFrame, length: int, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0):
        sizes = rows.groupBy("key").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        table = row_numbers(sizes, "s", ["key"]).withColumn("s", F.col("s") - 1)
        table = written(table.withColumn("weight", F.get(F.array(*[F.lit(str(w)).cast("decimal(18,6)") for w in weights]), F.pmod("s", F.lit(len(weights))).cast("int"))))
        sums = table.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
        self.count, self.rows, unit, full = sums["n"], sums["rows"], 0.0, F.col("words") * F.lit(most)
        capped = lambda u: (F.col("words") == 0) | (F.col("weight").cast("double") * F.lit(u) > full)
        while sums["words"]:
            at = table.agg(F.sum(F.when(~capped(unit), F.col("weight"))).alias("weight"), F.coalesce(F.sum(F.when(capped(unit), F.col("words"))), F.lit(0)).alias("words")).first()
            step = (sums["words"] - most * at["words"]) / float(at["weight"]) if at["weight"] else unit
            if step <= unit:
                break
            unit = step
        target = F.when(capped(unit), full).otherwise(F.col("weight").cast("double") * F.lit(unit))
        due, blocks = F.round(F.col("target")).cast("long"), F.ceil(F.col("words") / F.lit(length))
        table = table.select("s", "key", "n", "words", target.alias("target"))
        table = table.select("*", F.coalesce(blocks, F.lit(0)).alias("blocks"), F.when(F.col("words") > 0, F.floor(due / F.col("words"))).otherwise(0).alias("whole"))
        table = table.withColumn("rest", due - F.col("whole") * F.col("words")).withColumn("slots", F.col("whole") * F.col("blocks") + F.ceil(F.col("rest") / F.lit(length)))
        self.table = written(table)
        self.slots = self.table.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n")).first()["n"]

    def few(self, table: DataFrame) -> DataFrame:
        """A table with a row a source (and 4096 more at most), for a join: broadcast if there are few sources."""
        return F.broadcast(table) if self.count <= FEW else table

    def join(self, rows: DataFrame, *columns: str) -> DataFrame:
        """rows(key, ...) of the documents with columns of their sources; hot sources' rows stay where they are."""
        if self.count <= FEW:
            return rows.join(F.broadcast(self.table.select("key", *columns)), "key")
        return hot_join(rows, self.table.select("key", "n", *columns), ["key"], "n", max(1, self.rows))


def permuted(index: Column, size: Column, seed: list[Column], rounds: int = 12) -> Column:
    """A pseudorandom permutation of 0 .. size - 1 at index, keyed by seed: a swap-or-not shuffle.

    In each round x and its mirror image key - x (mod size) are swapped or not, as a hash of the larger of them says.
    """
    step = lambda x, i: F.pmod(F.pmod(F.xxhash64(i, *seed), size) - x + size, size)
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(rounds - 1)),
        index.cast("long"),
        lambda x, i: F.when(F.xxhash64(F.greatest(x, step(x, i)), i, F.lit(1), *seed).bitwiseAND(F.lit(1)) == 1, step(x, i)).otherwise(x),
    )


def measured(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Written: rid, key (of the source), size in words, a hash of the text, and the columns in keep as the struct `row`."""
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    return written(docs.select(row.alias("row"), source_key(F.col("source")).alias("key"), count_words(F.col("text")).alias("size"), F.xxhash64("text").alias("hash")), row_id="rid")


def streams(rows: DataFrame, order: list[str], n_rows: int) -> DataFrame:
    """rows with `begin`, the place of its first word in its source's stream.

    Prefix sums in two levels: over the buckets of a source, and over the rows of a bucket. Rows that agree in all of order stand side by side.
    """
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(max(64, n_rows // IN_BUCKET))))
    inside = Window.partitionBy("key", "bucket").orderBy(*order, "rid").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("key", "bucket").agg(F.sum("size").alias("n")).select("key", "bucket", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    placed = rows.withColumn("begin", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return placed.join(base, ["key", "bucket"]).withColumn("begin", F.col("begin") + F.col("base")).drop("bucket", "base")


def pieces(placed: DataFrame, length: int) -> DataFrame:
    """Each row's words by block: rid, key, block, low and high (words of the row), at (place in the block). Rows without words have none."""
    last = F.col("begin") + F.col("size") - 1
    each = placed.where("size > 0").select("rid", "key", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / length), F.floor(last / length))).alias("block"))
    first = F.col("block") * length - F.col("begin")
    low = F.greatest(F.lit(0), first)
    return each.select("rid", "key", "block", low.alias("low"), F.least(F.col("size"), first + length).alias("high"), (low - first).alias("at"))


def cells(df: DataFrame, begin: str, end: str, width: int) -> DataFrame:
    """A row for each cell of a width that the interval [begin, end) reaches into."""
    return df.withColumn("cell", F.explode(F.sequence(F.floor(F.col(begin) / width), F.floor((F.col(end) - 1) / width))))


def draw(sources: Sources, length: int, shard_slots: int, seed: int) -> DataFrame:
    """The mix: shard, key, round, block, keep (words taken from the block's start).

    Draws are hashes of (seed, slot), so that reruns agree: a slot draws a number below that of all slots, and the source in whose
    interval it falls, found by an equality join on cells of the numbers. Counts per (shard, source) are all that is ordered.
    """
    total, spark = sources.slots, sources.table.sparkSession
    live = written(before(sources.table.where("slots > 0"), {"first": "slots"}, sources.count))
    parts = max(spark.sparkContext.defaultParallelism, -(-total // 4_000_000))
    width = max(1, -(-total // 4096)) if sources.count <= FEW else 256
    edges = cells(live.select("s", "first", (F.col("first") + F.col("slots")).alias("behind")), "first", "behind", width)
    x = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(total, 1)))
    drawn = spark.range(0, total, 1, parts).select(F.floor(F.col("id") / shard_slots).alias("shard"), x.alias("x")).withColumn("cell", F.floor(F.col("x") / width))
    counts = drawn.join(sources.few(edges), "cell").where("first <= x and x < behind").groupBy("shard", "s").agg(F.count(F.lit(1)).alias("n"))
    past = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.join(sources.few(live.select("s", "slots")), "s")).withColumn("from", F.coalesce(F.sum("n").over(past), F.lit(0)))
    kept = F.greatest(F.lit(0), F.least(F.col("n"), F.col("slots") - F.col("from")))
    counts = written(counts.select("shard", "s", "from", kept.alias("n"), (F.col("n") - kept).alias("over")))
    # What sources drew beyond their quotas, in order of (source, shard), fills what others lack, in order of source.
    sums = counts.groupBy("s").agg(F.sum("n").alias("have"), F.sum("over").alias("over"))
    sums = live.select("s", "slots").join(sums, "s", "left").select("s", F.coalesce("have", F.lit(0)).alias("have"), F.coalesce("over", F.lit(0)).alias("over"), (F.col("slots") - F.coalesce("have", F.lit(0))).alias("lack"))
    sums = written(before(sums, {"spare": "over", "gap": "lack"}, sources.count))
    spare = counts.withColumn("begin", F.coalesce(F.sum("over").over(past), F.lit(0))).where("over > 0").join(sources.few(sums.select("s", "spare")), "s")
    spare = cells(spare.select("shard", (F.col("begin") + F.col("spare")).alias("begin"), (F.col("begin") + F.col("spare") + F.col("over")).alias("end")), "begin", "end", 1024)
    gaps = cells(sums.where("lack > 0").select("s", "have", "gap", (F.col("gap") + F.col("lack")).alias("gap_end")), "gap", "gap_end", 1024)
    low, high = F.greatest("begin", "gap", F.col("cell") * 1024), F.least("end", "gap_end", (F.col("cell") + 1) * 1024)
    moved = spare.join(gaps, "cell").where(low < high).select("shard", "s", (F.col("have") + low - F.col("gap")).alias("from"), (high - low).alias("n"))
    runs = counts.where("n > 0").select("shard", "s", "from", "n").unionByName(moved)
    runs = runs.join(sources.few(live.select("s", "key", "words", "blocks", "whole", "rest", "slots")), "s")
    # A row of runs stands for up to a shard's slots, which Spark's size estimates can't know; the number keeps it from joining partitions.
    slots = runs.repartition(parts, "shard", "s").withColumn("j", F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)))
    slots = slots.withColumn("round", F.floor(F.col("j") / F.col("blocks")))
    block = permuted(F.pmod("j", "blocks"), F.col("blocks"), [F.lit(seed), F.col("key"), F.col("round")])
    last = (F.col("j") == F.col("slots") - 1) & (F.col("round") == F.col("whole")) & (F.col("rest") % length > 0)
    return slots.select("shard", "key", "round", block.alias("block"), F.when(last, F.col("rest") % length).otherwise(length).cast("long").alias("keep"))


def mixed(docs: DataFrame, length: int = 128, shard_slots: int = 65536, seed: int = 42, weights: tuple[float, ...] = (5, 2, 1), keep: list[str] | None = None) -> tuple[DataFrame, DataFrame, Sources]:
    """rows (rid, key, size, row), spans and the sources of a mix of docs(doc_id, text, source, ...).

    spans is the mix itself: shard, key, round, block, rid, low, high - words low to high (exclusive) of row rid stand
    in that block of that shard. A row is in a round of its source at most once, so that `most` rounds bound its words.
    Null and empty texts have no words; a null source is one of its own; repeated rows are rows of their own.
    An empty table has no sources and no spans.
    """
    rows = measured(docs, keep or docs.columns)
    sources = Sources(rows, length, weights)
    placed = streams(rows.select("rid", "key", "size", "hash", F.col("row.doc_id").alias("doc_id")), ["doc_id", "hash"], sources.rows)
    blocks = pieces(placed, length)
    spans = draw(sources, length, shard_slots, seed).hint("merge").join(blocks, ["key", "block"]).where("at < keep")
    spans = spans.select("shard", "key", "round", "block", "rid", "low", F.least("high", F.col("low") + F.col("keep") - F.col("at")).alias("high"))
    return rows, spans, sources


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken per row of docs: how many of its words the mix takes, repeats counted."""
    rows, spans, sources = mixed(docs.select("doc_id", "source", "text"), keep=["doc_id", "source"], **options)
    used = spans.groupBy("rid").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    out = rows.select("rid", "key", "size", F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"))
    out = sources.join(out, "words", "target").join(used, "rid", "left")
    return out.select("doc_id", "source", "size", F.col("words").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: per row of docs and round that takes any of its words, one row of docs' columns.

    Its text is the whole text, if the round takes all its words; else the taken words in order, joined by one space,
    and n_chars is their length. Rows without words have no part in a mix and stay as they are.
    """
    cols = docs.columns
    rows, spans, _ = mixed(docs, **options)
    part = spans.groupBy("rid", "round").agg(F.sum(F.col("high") - F.col("low")).alias("n"), F.sort_array(F.collect_list(F.struct("low", "high"))).alias("spans"))
    out = rows.select("rid", "size", "row").join(part, "rid", "left").where("size = 0 or n is not null")
    out = out.withColumn("w", F.when(F.col("n") < F.col("size"), words_of(F.col("row.text"))))
    cut = F.array_join(F.flatten(F.transform("spans", lambda s: F.slice("w", (s["low"] + 1).cast("int"), (s["high"] - s["low"]).cast("int")))), " ")
    text = F.when(F.col("n") < F.col("size"), cut).otherwise(F.col("row.text"))
    out = out.select("row", "n", "size", text.alias("t"))
    pick = {"text": F.col("t"), "n_chars": F.when(F.col("n") < F.col("size"), F.length("t").cast("long")).otherwise(F.col("row.n_chars") if "n_chars" in cols else F.lit(None))}
    return out.select(*[(pick[c] if c in pick else F.col(f"row.`{c}`")).alias(c) for c in cols])
