"""What several of the operators share: words, written tables, joins on hot keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loadflow.sources.shared import written

__all__ = ["SPACE", "WORD", "before", "count_words", "cut", "hot_join", "let", "running", "text_id", "words_of", "written"]

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def count_words(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), SPACE)
    return (
        F.size(parts)
        - F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
        - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    ).cast("long")


def text_id(text: Column) -> Column:
    """128 bits that tell texts apart; null is the empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text, F.length(text)).alias("b"))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """An array with each of its values joined to all before it (sums, maxima), by doubling: n log n steps for n values."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    back = lambda a, i, k: F.get(a, i - F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(steps, values, lambda a, k: F.transform(a, lambda x, i: F.coalesce(join(x, back(a, i, k)), x)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, wherever body names it, inside of lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cut(text: Column, pieces: Column) -> Column:
    """The pieces (begin, end, in code points and in order) of a text.

    A place in a text is found by a pass over all before it; so n pieces are cut from root n larger ones, and take root n passes.
    """

    def large(p: Column, size: Column, g: Column) -> Column:
        return let(F.slice(p, g * size + 1, size), lambda own: let(own[0]["begin"], lambda at: small(own, at)))

    def small(own: Column, at: Column) -> Column:
        return let(F.substring(text, at + 1, F.element_at(own, -1)["end"] - at), lambda t: F.transform(own, lambda x: F.substring(t, x["begin"] - at + 1, x["end"] - x["begin"])))

    root = lambda p: F.greatest(F.ceil(F.sqrt(F.size(p))).cast("int"), F.lit(1))
    groups = lambda p, size: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / size).cast("int")), lambda g: large(p, size, g))
    return F.when(F.size(pieces) > 0, let(pieces, lambda p: let(root(p), lambda size: F.flatten(groups(p, size))))).otherwise(F.expr("cast(array() as array<string>)"))


def before(df: DataFrame, sums: dict[str, str], most: int) -> DataFrame:
    """df(s, ...) with, per entry of sums, the sum of a column over all rows with a smaller s. s numbers the rows, below `most`.

    Prefix sums inside groups of about root `most` numbers, and over the groups.
    """
    df = df.withColumn("_g", F.shiftright("s", most.bit_length() // 2 + 1))
    groups = df.groupBy("_g").agg(*[F.sum(c).alias(f"_{out}") for out, c in sums.items()])
    past = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_g", *[F.coalesce(F.sum(f"_{out}").over(past(Window.orderBy("_g"))), F.lit(0)).alias(f"_{out}") for out in sums])
    inside = past(Window.partitionBy("_g").orderBy("s"))
    df = df.withColumns({out: F.coalesce(F.sum(c).over(inside), F.lit(0)) for out, c in sums.items()}).join(groups, "_g")
    return df.withColumns({out: F.col(out) + F.col(f"_{out}") for out in sums}).drop("_g", *[f"_{out}" for out in sums])


def hot_join(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows LEFT JOIN table on keys that are unique in table, whatever the skew of rows.

    weight is how many rows of `rows` have the key, total the number of rows. A key is hot with more than a quarter of the rows that a
    shuffle partition has on average (or than a thousandth of all); by arithmetic there are fewer hot keys than four times the
    partitions (or than a thousand), so that they may be broadcast, and their rows stay where they are. All other keys are joined by a shuffle.
    """
    most = max(1000, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    is_hot = F.col(weight) * F.lit(most) > F.lit(total)
    hot = table.where(is_hot).drop(weight)
    cold = table.where(~is_hot).drop(weight)
    here = rows.join(F.broadcast(hot), keys)
    there = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    return here.unionByName(there)
