"""Secret scans: pattern candidates, then corpus-wide ownership frequency to tell examples from live credentials.

Every candidate's value is hashed and counted over distinct repositories and distinct owners of the whole corpus.
A value that many owners (or very many repositories) show is a copied example; one that stays with its owner and
looks random is taken for live. Exact copies of a text are one repository of one owner, so that a leaked credential doesn't pass
for an example because its document was copied. Base patterns always give spans; loose candidates (a random-looking run without a
keyword) give a span only where their ownership says live. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadflow.llm.common import cut, hot_join, running, text_id, written

#: kind, pattern, group that holds the value, least length of the value. Base kinds in the order of ties.
BASE = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: A long run of credential characters; live-looking is decided later.
LOOSE = ("owned", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)

_SPANS = "array<struct<start:int,rank:int,kind:string,stop:int,value:string>>"


def find_all(text: Column, kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """All leftmost non-overlapping matches with a value of `least` characters, as spans in code points.

    The lengths of the matches and of the texts between them, added up, give the positions. Texts without a match cost one pass.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    passed = F.concat(F.array(F.lit(0)), F.transform(whole, F.length))
    starts = running(F.zip_with(F.split(text, pattern, -1), passed, lambda p, n: F.length(p) + n), lambda x, y: x + y)  # the last has no match
    each = F.arrays_zip(starts, whole, F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    spans = F.transform(
        F.filter(each, lambda x: F.coalesce(F.length(x["2"]) >= least, F.lit(False))),
        lambda x: F.struct(x["0"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["0"] + F.length(x["1"])).alias("stop"), x["2"].alias("value")),
    )
    return F.when(text.rlike(pattern), spans).otherwise(F.expr(f"cast(array() as {_SPANS})"))


def looks_live(value: Column) -> Column:
    """Random-looking: letters and digits, and at least 8 different characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 8)


def apart(loose: Column, base: Column) -> Column:
    """The spans of loose that no span of base touches.

    In order of starts of base and ends of loose, the farthest end of all base spans passed says whether one reaches into a loose span.
    """
    event = lambda at, is_base, reach, s: F.struct(at.alias("at"), F.lit(is_base).alias("is_base"), reach.alias("reach"), s.alias("s"))
    events = F.sort_array(F.concat(F.transform(base, lambda s: event(s["start"], 1, s["stop"], s)), F.transform(loose, lambda s: event(s["stop"], 0, F.lit(0), s))))
    far = running(F.transform(events, lambda e: e["reach"]), F.greatest)
    free = F.filter(F.arrays_zip(events, far), lambda x: (x["0"]["is_base"] == 0) & (x["1"] <= x["0"]["s"]["start"]))
    return F.when((F.size(base) > 0) & (F.size(loose) > 0), F.transform(free, lambda x: x["0"]["s"])).otherwise(loose)


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs' columns in keep, base and loose: span arrays of the whole text, in order. Null texts count as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = [find_all(text, *one, rank) for rank, one in enumerate(BASE)]
    df = docs.select(*keep, F.sort_array(F.concat(*found)).alias("base"), find_all(text, *LOOSE, len(BASE)).alias("loose"))
    df = df.withColumn("loose", F.filter("loose", lambda s: looks_live(s["value"])))
    return df.withColumn("loose", apart(F.col("loose"), F.col("base")))


def scan(docs: DataFrame, owner_col: str = "source", max_owners: int = 2, max_repos: int = 20, keep: list[str] | None = None) -> DataFrame:
    """For each row of docs, its columns in keep (doc_id) and
    base, spans: arrays of (start, rank, kind, stop, value, verdict), sorted; verdict is live, example or null.

    A repository is a distinct text; its owner is one of those that show it, the same in every run. A value is live if it looks random and
    at most max_owners owners and max_repos repositories have it; a value beyond either number is an example. A null
    owner is one of its own. Rows whose texts are null or empty have no spans; repeated rows each get their result.
    Work follows the number of matches (times its logarithm); the counts are partial aggregates and hot values are joined apart.
    """
    keep = keep or ["doc_id"]
    owner = F.md5(F.when(F.col(owner_col).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(owner_col))))
    who = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "text", F.conv(F.substring(owner, 1, 15), 16, 10).cast("long").alias("owner"), text_id(F.col("text")).alias("repo")
    )
    rows = written(candidates(who, ["row", "owner", "repo"]), row_id="rid")
    each = rows.select("rid", "owner", "repo", F.posexplode(F.concat("base", "loose")).alias("at", "s"))
    each = written(each.select("rid", "at", "owner", "repo", F.sha2(F.col("s.value").cast("binary"), 256).alias("h"), looks_live(F.col("s.value")).alias("random")))
    per_repo = each.groupBy("h", "repo").agg(F.min("owner").alias("owner"), F.count(F.lit(1)).alias("n"), F.max("random").alias("random"))
    per_owner = per_repo.groupBy("h", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"), F.max("random").alias("random"))
    verdicts = per_owner.groupBy("h").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n"), F.max("random").alias("random"))
    verdict = F.when((F.col("owners") > max_owners) | (F.col("repos") > max_repos), "example").when(F.col("random"), "live")
    judged = hot_join(each.select("rid", "at", "h"), written(verdicts.select("h", "n", verdict.alias("verdict"))), ["h"], "n", max(1, each.count()))
    per_row = judged.groupBy("rid").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "verdict"))), lambda x: x["verdict"]).alias("verdicts"))
    some = F.size("base") + F.size("loose") > 0
    found = rows.where(some).join(per_row, "rid").select("row", "base", "loose", "verdicts")
    df = rows.where(~some).select("row", "base", "loose", F.expr("cast(array() as array<string>)").alias("verdicts")).unionByName(found)
    said = lambda spans, first: F.transform(spans, lambda s, i: s.withField("verdict", F.get("verdicts", i + first)))
    df = df.select("row", said(F.col("base"), F.lit(0)).alias("base"), said(F.col("loose"), F.size("base")).alias("loose"))
    spans = F.sort_array(F.concat("base", F.filter("loose", lambda s: s["verdict"] == "live")))
    return df.select(*[F.col(f"row.`{c}`").alias(c) for c in keep], "base", spans.alias("spans"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """The scan in numbers and digests per row of docs(doc_id, text, source)."""
    df = scan(docs)
    number = lambda spans, field, value: F.size(F.filter(spans, lambda s: s[field] == value)).cast("long")
    return df.select(
        "doc_id", *[number("base", "kind", k).alias(f"n_{k}") for k, *_ in BASE], F.sha2(as_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"),
        number("spans", "verdict", "live").alias("n_live"), number("spans", "verdict", "example").alias("n_example"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with the spans of live credentials replaced by mark; copied examples stay. n_chars follows the text.

    Spans that overlap are replaced as one.
    """
    cols = docs.columns
    df = scan(docs, keep=cols).withColumn("hits", F.filter("spans", lambda s: s["verdict"] == "live"))
    ends = running(F.transform("hits", lambda s: s["stop"]), F.greatest)
    each = F.zip_with(F.transform("hits", lambda s: s["start"]), F.concat(F.array(F.lit(0)), ends), lambda a, b: F.struct(b.alias("begin"), a.alias("end")))
    kept = F.filter(each, lambda x, i: x["end"].isNull() | (i == 0) | (x["end"] >= x["begin"]))  # the last piece has no end
    pieces = F.transform(kept, lambda x: F.struct(x["begin"], F.coalesce(x["end"], F.length("text")).alias("end")))
    df = df.withColumn("text", F.when(F.size("hits") > 0, F.array_join(cut(F.col("text"), pieces), mark)).otherwise(F.col("text")))
    if "n_chars" in cols:
        df = df.withColumn("n_chars", F.when(F.size("hits") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return df.select(*[F.col(f"`{c}`") for c in cols])
