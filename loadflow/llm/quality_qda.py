"""Quality classifier: regularised quadratic discriminant analysis over transformed statistics of each text.

Per class one mean and one covariance, shrunk towards the pooled covariance and towards a sphere. The sums behind
them are one aggregate over all labelled rows, so that the fit needs no sample. Scores are differences of
Gaussian log densities; the inverse Cholesky factors are worked out once and become constants of the plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadflow.llm.common import words_of, written

#: The statistics that enter the score, see `statistics`.
FEATURES = (
    "f_words", "f_word_len", "f_symbols", "f_upper", "f_digits", "f_marks", "f_bangs",
    "f_same_next", "f_distinct3", "f_dup_lines", "f_odd_words",
)


def _share(part: Column, whole: Column) -> Column:
    return F.sqrt(F.greatest(part, F.lit(0)) / F.greatest(whole, F.lit(1)).cast("double"))


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Per row of docs its columns as the struct `row`, and FEATURES of its text. A null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("t"), words_of(text).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x) != "")
    gone = lambda pattern: F.length("t") - F.length(F.regexp_replace("t", pattern, ""))
    three = F.when(
        F.size("w") > 2,
        F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))),
    )
    same = F.size(F.filter("w", lambda x, i: (i > 0) & (x == F.get("w", i - 1))))
    odd = F.size(F.filter("w", lambda x: x.rlike(r"[#*$%&|<>]{2,}|!{2,}")))
    df = df.select(
        "row", "t", F.size("w").alias("n"), F.length("t").alias("c"), three.alias("g3"), lines.alias("l"),
        same.alias("same"), odd.alias("odd"), F.length(F.array_join("w", "")).alias("wc"),
    )
    return df.select(
        "row",
        F.log1p("n").alias("f_words"),
        F.log1p(F.col("wc") / F.greatest("n", F.lit(1))).alias("f_word_len"),
        _share(gone(r"[#*$%&|<>]"), F.col("c")).alias("f_symbols"),
        _share(gone(r"\p{Lu}"), F.col("c")).alias("f_upper"),
        _share(gone(r"[0-9]"), F.col("c")).alias("f_digits"),
        _share(gone(r"[.,;:]"), F.col("c")).alias("f_marks"),
        _share(gone(r"[!?]"), F.col("c")).alias("f_bangs"),
        _share(F.col("same"), F.col("n")).alias("f_same_next"),
        _share(F.size("g3") - F.size(F.array_distinct("g3")), F.col("n")).alias("f_distinct3"),
        _share(F.size("l") - F.size(F.array_distinct("l")), F.size("l")).alias("f_dup_lines"),
        _share(F.col("odd"), F.col("n")).alias("f_odd_words"),
    )


@dataclass
class Discriminant:
    """Per class (0, 1): log prior minus half the log determinant, mean, and inverse Cholesky factor."""

    bias: list[float]
    mean: list[np.ndarray]
    whiten: list[np.ndarray]

    def score(self) -> Column:
        """Probability of class 1 as a column over FEATURES, from 0 to 1."""

        def density(k: int) -> Column:
            centred = [F.col(f) - F.lit(float(m)) for f, m in zip(FEATURES, self.mean[k], strict=True)]
            rows = [reduce(lambda a, b: a + b, [centred[j] * F.lit(float(row[j])) for j in range(i + 1)]) for i, row in enumerate(self.whiten[k])]
            return F.lit(self.bias[k]) - F.lit(0.5) * reduce(lambda a, b: a + b, [r * r for r in rows])

        gap = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), density(0) - density(1)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(gap))


def fit(labelled: DataFrame, label_col: str = "label", to_pooled: float = 0.2, to_sphere: float = 0.02) -> Discriminant | None:
    """From rows of FEATURES and a label 0 or 1. None where a class is missing.

    Covariance of a class = (1 - to_sphere) * ((1 - to_pooled) * own + to_pooled * pooled) + to_sphere * mean variance * I.
    """
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i + 1)]
    sums = {
        int(r["label"]): r
        for r in labelled.where(F.col(label_col).isin(0, 1))
        .groupBy(F.col(label_col).alias("label"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)],
            *[F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs],
        )
        .collect()
    }
    if set(sums) != {0, 1}:
        return None
    count = [sums[k]["n"] for k in (0, 1)]
    mean, scatter = [], []
    for k in (0, 1):
        mean.append(np.array([sums[k][f"s{i}"] for i in range(d)]) / count[k])
        second = np.zeros((d, d))
        for i, j in pairs:
            second[i, j] = second[j, i] = sums[k][f"p{i}_{j}"]
        scatter.append(second - count[k] * np.outer(mean[k], mean[k]))
    pooled = (scatter[0] + scatter[1]) / sum(count)
    bias, whiten = [], []
    for k in (0, 1):
        own = (1 - to_pooled) * scatter[k] / count[k] + to_pooled * pooled
        sphere = max(np.trace(own) / d, 1e-9)
        factor = np.linalg.cholesky((1 - to_sphere) * own + to_sphere * sphere * np.eye(d))
        bias.append(math.log(count[k] / sum(count)) - float(np.log(np.diag(factor)).sum()))
        whiten.append(np.linalg.inv(factor))
    return Discriminant(bias, mean, whiten)


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """For each row of docs: doc_id (or the columns in keep, which must hold doc_id), held_out, score, predicted.

    Learns from the labelled rows that aren't held out. Repeated rows of labels count once, rows that disagree about
    a document all count, null labels don't. Empty and null texts get a score as well; without both classes every
    score is 0.5. A null doc_id is never labelled and not held out. Other columns of docs have no influence.
    """
    keep = keep or ["doc_id"]
    found = written(statistics(docs.select(*keep, *[c for c in ["text"] if c not in keep])).withColumn("row", F.struct(*[F.col(f"row.`{c}`") for c in keep])))
    known = labels.where(F.col("quality").isNotNull() & ~held_out("doc_id")).select("doc_id", F.col("quality").alias("label")).distinct()
    model = fit(known.join(found.select(F.col("row.doc_id").alias("doc_id"), *FEATURES), "doc_id"))
    score = model.score() if model else F.lit(0.5)
    return found.select(
        *[F.col(f"row.`{c}`").alias(c) for c in keep], F.coalesce(held_out("row.doc_id"), F.lit(False)).alias("held_out"), score.alias("score")
    ).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
