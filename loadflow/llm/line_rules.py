"""Quality rules with cross-document line frequency.

Lines are normalised and hashed; a line that stands in too many distinct documents of a host is boilerplate there,
and is removed. Documents of which too little is left are rejected. Exact copies of a document count once. Rules
within a document (few words, repeated windows of words) reject on their own. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadflow.llm.common import SPACE, hot_join, let, running, text_id, words_of, written

#: Words in a window that may not repeat too often within a document.
WINDOW = 5


def normal(line: Column) -> Column:
    """A line in lower case with digits as one sign and white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), SPACE, " "))


def words_in(normal_line: Column) -> Column:
    return (F.length(normal_line) - F.length(F.replace(normal_line, F.lit(" "), F.lit(""))) + 1).cast("long")


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal(line))


def with_repeat_words(df: DataFrame, out: str) -> DataFrame:
    """df(w: words) with the number of words in windows of WINDOW words that occur twice or more in w.

    Sorting (hash, place) brings equal windows together; texts without any stop at a count of distinct hashes.
    """
    df = df.withColumn("_g", F.transform("w", lambda x: F.xxhash64(x)))
    each = F.transform(F.sequence(F.lit(0), F.size("_g") - WINDOW), lambda i: F.xxhash64(*[F.get("_g", i + k) for k in range(WINDOW)]))
    df = df.withColumn("_h", F.when(F.size("_g") >= WINDOW, each))
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), pairs))
    near = lambda x, i: x["h"] == F.get("_s", i)["h"]
    again = F.filter("_s", lambda x, i: F.coalesce(F.when(i > 0, near(x, i - 1)), F.lit(False)) | F.coalesce(near(x, i + 1), F.lit(False)))
    df = df.withColumn("_p", F.sort_array(F.transform(again, lambda x: x["i"])))
    cover = F.transform("_p", lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - x, F.lit(WINDOW))))
    total = F.aggregate(cover, F.lit(0), lambda a, x: a + x)
    return df.withColumn(out, F.coalesce(total, F.lit(0)).cast("long")).drop("_g", "_h", "_s", "_p")


def measured(docs: DataFrame, host_col: str, keep: list[str]) -> DataFrame:
    """Per row of docs: its columns in keep as `row`, host, text_id, the base counts, and lines (h, n words) with a word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"),
        F.when(F.col(host_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(host_col))).alias("host"),
        text_id(text).alias("text_id"),
        text.alias("t"),
        words_of(text).alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("l"),
    )
    df = with_repeat_words(df, "n_repeat_words")
    return df.select(
        "row", "host", "text_id", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"), "n_repeat_words",
        F.transform(F.transform("l", normal), lambda x: F.struct(F.xxhash64(x).alias("h"), words_in(x).alias("n"))).alias("lines"),
    )


def judged(docs: DataFrame, host_col: str, min_docs: int, max_share: float, max_docs: int, min_words: int, max_removed: float, keep: list[str], with_lines: bool) -> DataFrame:
    """Per row of docs its columns in keep as `row`, the base counts, base_failed, n_removed, kept; with_lines: also gone, the hashes of its boilerplate lines."""
    rows = written(measured(docs, host_col, keep))
    texts = written(rows.groupBy("host", "text_id").agg(F.first("lines").alias("lines"), F.count(F.lit(1)).alias("copies")))
    each = texts.select("host", "text_id", F.explode("lines").alias("x")).groupBy("host", "text_id", F.col("x.h").alias("h")).agg(F.sum("x.n").alias("n"))
    each = written(each)
    hosts = texts.groupBy("host").agg(F.count(F.lit(1)).alias("in_host"))
    often = each.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > min_docs)
    limit = F.least(F.col("in_host") * max_share, F.lit(float(max_docs)))
    often = written(often.join(hosts, "host").where(F.col("docs") > limit).select("host", "h", "docs", F.lit(True).alias("gone")))
    lost = hot_join(each, often, ["host", "h"], "docs", max(1, each.count())).where("gone").groupBy("host", "text_id")
    lost = lost.agg(F.sum("n").alias("n_removed"), *([F.collect_list("h").alias("gone")] if with_lines else []))  # of one text's lines
    lost = written(texts.select("host", "text_id", "copies").join(lost, ["host", "text_id"]))
    out = hot_join(rows.drop("lines"), lost, ["host", "text_id"], "copies", max(1, rows.count())).withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("n_removed") < min_words) | (F.col("n_removed") > F.col("n_words") * max_removed)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def judge(
    docs: DataFrame, host_col: str = "source", min_docs: int = 2, max_share: float = 0.05, max_docs: int = 1000, min_words: int = 5, max_removed: float = 0.8, keep: list[str] | None = None
) -> DataFrame:
    """docs' columns in keep (doc_id), base counts, base_failed, n_removed (words in boilerplate lines), kept.

    A line is boilerplate for a host if more than max_share of the host's distinct documents have it, or more than max_docs; in small
    hosts, more than min_docs in any case, so that a share of a few documents isn't one or two. A document is depleted, and not kept, if fewer than min_words words are left or more than
    max_removed of its words went. A null host is one host; null and empty texts have no words and fail the base
    rule. Repeated rows each get the same result.
    """
    keep = keep or ["doc_id"]
    out = judged(docs, host_col, min_docs, max_share, max_docs, min_words, max_removed, keep, False)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed", "kept"]
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], *counts)


def without(text: Column, gone: Column) -> Column:
    """The text without those lines (with a word) whose hashes are in gone.

    The hashes of all lines and those in gone are sorted together, each line behind its hash in gone; so that it needs no search a line.
    """
    lines = F.split(text, "\n")
    event = lambda h, at, own: F.struct(h.alias("h"), at.alias("at"), own.alias("own"))

    def cleaned(own: Column) -> Column:
        marks = F.transform(gone, lambda h: event(h, F.lit(-1), h))
        places = F.transform(own, lambda x, i: event(F.when(x.rlike(r"[^\x20\x09-\x0D]"), line_hash(x)), i, F.lit(None).cast("long")))
        return let(F.sort_array(F.concat(marks, places)), lambda e: let(running(F.transform(e, lambda x: x["own"]), F.greatest), lambda last: joined(own, e, last)))

    def joined(own: Column, events: Column, last: Column) -> Column:
        left = F.filter(F.arrays_zip(F.transform(events, lambda x: x["at"]), F.zip_with(events, last, lambda x, g: F.coalesce(x["h"] == g, F.lit(False)))), lambda x: (x["0"] >= 0) & ~x["1"])
        return F.array_join(F.transform(F.sort_array(F.transform(left, lambda x: x["0"])), lambda i: F.get(own, i)), "\n")

    return let(lines, cleaned)


def clean(docs: DataFrame, host_col: str = "source", min_docs: int = 2, max_share: float = 0.05, max_docs: int = 1000, min_words: int = 5, max_removed: float = 0.8) -> DataFrame:
    """The documents that judge keeps, in docs' columns, without their boilerplate lines. n_chars follows the text."""
    cols = docs.columns
    out = judged(docs, host_col, min_docs, max_share, max_docs, min_words, max_removed, cols, True).where("kept")
    out = out.withColumn("_text", F.when(F.size("gone") > 0, without(F.col("row.text"), F.col("gone"))))
    pick = {"text": F.coalesce("_text", F.col("row.text"))}
    if "n_chars" in cols:
        pick["n_chars"] = F.when(F.col("_text").isNotNull(), F.length("_text").cast("long")).otherwise(F.col("row.n_chars"))
    return out.select(*[pick.get(c, F.col(f"row.`{c}`")).alias(c) for c in cols])
