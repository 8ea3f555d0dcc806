"""Column lineage over tables of metadata: columns(script, tbl, col, ...), deps(script, tbl, col, upstream, up_col, external)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadflow.sources.shared import written

# Words in an expression that are no columns.
STOP_WORDS = (
    "as", "resident", "from", "where", "group", "by", "order", "load", "inline", "mapping", "distinct", "and", "or", "not", "null", "true", "false",
    "if", "then", "else", "end", "case", "when", "in", "like", "is", "on", "using", "asc", "desc", "concatenate", "noconcatenate",
)
# What quoted text looks like in an expression, and a function's name or else a column's (the group).
QUOTED_TEXT = r"'[^']*'"
NAME = r'(?U)[A-Za-z_][\w$#]*+\s*\(|("[^"]+"|\[[^\]]+\]|[A-Za-z_][\w$]*)'
#: The mapping table that a lookup names first.
LOOKED_UP = r"(?i)apply_?map\s*\(\s*['\"\[]?([^'\"\],()]+)"
#: Aggregates that make a column's mapping an aggregate; and the longer list of those that the library has.
AGGREGATES = ("sum", "count", "avg", "min", "max", "only")
ALL_AGGREGATES = (*AGGREGATES, "median", "stdev", "mode", "concat", "firstsortedvalue", "fractile", "aggr", "fieldvaluecount")

_KEY = ["script", "tbl", "col"]


def referenced_columns(expr: Column) -> Column:
    """M1: columns that an expression names, each once, in order: text in quotes and names before a parenthesis are none."""
    bare = F.regexp_replace(F.coalesce(expr, F.lit("")), QUOTED_TEXT, " ")
    tokens = F.regexp_extract_all(bare, F.lit(NAME), F.lit(1))  # empty for a function
    names = F.transform(tokens, lambda t: F.trim(F.regexp_replace(t, r'^["\[]|["\]]$', "")))
    return F.array_distinct(F.filter(names, lambda n: (n != "") & ~F.lower(n).isin(*STOP_WORDS) & ~n.rlike(r"^[0-9]+$")))


def resolve_providers(refs: DataFrame, joins: DataFrame, outputs: DataFrame, tables: DataFrame) -> DataFrame:
    """M2: refs(script, tbl, col, up_col) with upstream and external.

    The first joined table (joins: script, base_tbl, right_tbl, pos) that has the column among its outputs(script, tbl, col)
    provides it; else the table's own row source (tables: script, tbl, source, source_external).
    """
    r, j = refs.alias("r"), joins.alias("j")
    o = outputs.select("script", F.lower("tbl").alias("o_tbl"), F.lower("col").alias("o_col")).distinct()
    offered = r.join(j, (F.col("r.script") == F.col("j.script")) & (F.lower("r.tbl") == F.lower("j.base_tbl"))).select("r.script", "r.tbl", "r.col", "r.up_col", "j.right_tbl", "j.pos")
    offered = offered.join(o, (offered.script == o.script) & (F.lower(offered.right_tbl) == o.o_tbl) & (F.lower(offered.up_col) == o.o_col), "left_semi")
    joined = offered.groupBy("script", "tbl", "col", "up_col").agg(F.min_by("right_tbl", "pos").alias("joined"))
    out = refs.join(joined, ["script", "tbl", "col", "up_col"], "left").join(tables.select("script", "tbl", "source", "source_external"), ["script", "tbl"], "left")
    return out.select(
        "script", "tbl", "col", F.coalesce("joined", "source", F.lit("?")).alias("upstream"), "up_col",
        (F.col("joined").isNull() & F.coalesce("source_external", F.lit(False))).alias("external"),
    )


def mapping_type(expr: Column, n_refs: Column, grouped: Column, passthrough: Column, from_join: Column, aggregates: tuple[str, ...] = AGGREGATES) -> Column:
    """M3: lookup, constant, aggregate, join, direct or derived, whichever comes first in this order."""
    return (
        F.when(F.lower(expr).rlike(r"applymap|apply_map\("), "lookup")
        .when(n_refs == 0, "constant")
        .when(grouped & F.lower(expr).rlike(rf"\b({'|'.join(aggregates)})\s*\("), "aggregate")
        .when(passthrough & (n_refs == 1) & from_join, "join")
        .when(passthrough & (n_refs == 1), "direct")
        .otherwise("derived")
    )


def lookup_providers(columns: DataFrame, maps: DataFrame) -> DataFrame:
    """M2: a row of deps for each mapping table (maps: script, map) that a column's expression (columns: script, tbl, col, expr) looks up: its mapped_value."""
    used = columns.select(*_KEY, F.explode(F.array_distinct(F.transform(F.regexp_extract_all("expr", F.lit(LOOKED_UP), F.lit(1)), lambda m: F.lower(F.trim(m))))).alias("_map"))
    known = maps.select("script", F.col("map").alias("upstream"), F.lower("map").alias("_map"))
    return used.join(known, ["script", "_map"]).select(*_KEY, "upstream", F.lit("mapped_value").alias("up_col"), F.lit(False).alias("external"))


def with_passed_through(deps: DataFrame, joins: DataFrame, outputs: DataFrame, tables: DataFrame) -> DataFrame:
    """M4: deps, and rows for columns that a table hands on without listing them: those that others name but the table's outputs
    lack come from its joined tables or its row source (see resolve_providers), and so on upward until nothing new is named."""
    known = outputs.select("script", F.lower("tbl").alias("_t"), F.lower("col").alias("_c")).distinct()
    names = tables.select("script", "tbl", F.lower("tbl").alias("_t")).dropDuplicates(["script", "_t"])
    new, out = written(deps), deps
    while True:
        named = new.where(~F.col("external")).select("script", F.lower("upstream").alias("_t"), F.lower("up_col").alias("_c"), F.col("up_col").alias("col"))
        named = named.groupBy("script", "_t", "_c").agg(F.min("col").alias("col")).join(known, ["script", "_t", "_c"], "left_anti")
        refs = written(named.join(names, ["script", "_t"]))
        if refs.isEmpty():
            return out
        new = written(resolve_providers(refs.select("script", "tbl", "col", F.col("col").alias("up_col")), joins, outputs, tables))
        out = out.unionByName(new)
        known = known.unionByName(refs.select("script", "_t", "_c"))


_NODE, _UP, _SOURCE = ["n1", "n2"], ["u1", "u2"], ["s1", "s2"]


def _bits(names: list[str], *parts: Column) -> list[Column]:
    """128 bits of some values, as two columns: joins and sorts of numbers are the fast ones."""
    return [F.xxhash64(*parts).alias(names[0]), F.xxhash64(F.lit(1), *parts).alias(names[1])]


def _as(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def _heads(points: DataFrame) -> DataFrame | None:
    """u1, u2, h1, h2: of each column that has one dependency, and that on another column, the first column down its chain that has not.

    Chains are followed by pointer jumping: each step doubles the distance, and a table has a row a column. A chain that ends in a ring
    of such columns has no source; its rows point into the ring for good. None where no chain has two such columns.
    """
    single = points.groupBy(*_NODE).agg(F.count(F.lit(1)).alias("_n"), F.count("u1").alias("_open"), F.first("u1").alias("h1"), F.first("u2").alias("h2"))
    heads = written(_as(single.where("_n = 1 and _open = 1").select(*_NODE, "h1", "h2"), _NODE, _UP))
    if heads.join(heads.select(F.col("h1").alias("u1"), F.col("h2").alias("u2")), _UP, "left_semi").isEmpty():
        return None
    n, steps = heads.count(), 0
    while 1 << steps <= n:
        ahead = heads.select(F.col("u1").alias("h1"), F.col("u2").alias("h2"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
        further = heads.join(ahead, ["h1", "h2"], "left")
        heads = written(further.select(*_UP, F.coalesce("_h1", "h1").alias("h1"), F.coalesce("_h2", "h2").alias("h2"), F.col("_h1").isNotNull().alias("_moved")))
        moved = not heads.where("_moved").isEmpty()
        heads, steps = heads.drop("_moved"), steps + 1
        if not moved:
            break
    return heads


def _skipped(df: DataFrame, heads: DataFrame | None, columns: list[str]) -> DataFrame:
    """df with the heads of chains in place of the columns that stand in them."""
    if heads is None:
        return df
    a, b = columns
    out = _as(df, columns, _UP).join(heads, _UP, "left")
    return out.withColumns({"h1": F.coalesce("h1", "u1"), "h2": F.coalesce("h2", "u2")}).drop(*_UP).withColumnsRenamed({"h1": a, "h2": b})


def _grown(first: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """first and all that step gives for it, for what is new in that, and so on; each row once. Every round is a written table of the new rows."""
    keys = first.columns
    new = known = written(first.distinct())
    while not new.isEmpty():
        new = written(step(new).distinct().join(known, keys, "left_anti"))
        known = known.unionByName(new)
    return known


def ultimate_sources(deps: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """M4: script, tbl, col, source, source_col: the external columns that each column comes from, each once.

    Columns with a single dependency are skipped over first (see _heads), however long their chains. Among the others every source is
    handed on to the columns that depend on it, round by round, and only what is new to a column goes further: so cycles end, all tables
    together hold each column's sources once, and the rounds are those of the longest way past columns with several
    dependencies. Columns and sources are 128 bits. starts: only these columns; then columns that they don't come from are left out of the rounds.
    See with_passed_through for columns that a table hands on without listing them.
    """
    deps = deps.select(*_KEY, "upstream", "up_col", F.coalesce("external", F.lit(False)).alias("external"))
    node = lambda names, tbl, col: _bits(names, F.col("script"), F.lower(tbl), F.lower(col))
    source = _bits(_SOURCE, F.col("upstream"), F.col("up_col"))
    known = lambda cond, columns: [F.when(cond, c).alias(n) for n, c in columns]
    own = deps.select(
        *node(_NODE, "tbl", "col"), *known(~F.col("external"), zip(_UP, node(_UP, "upstream", "up_col"), strict=True)), *known(F.col("external"), zip(_SOURCE, source, strict=True)),
    )
    points = written(own.distinct())
    sources = deps.where("external").select(*source, F.col("upstream").alias("source"), F.col("up_col").alias("source_col")).distinct()
    heads = _heads(points)
    names = _skipped((starts if starts is not None else deps).select(*_KEY).distinct().select(*_KEY, *node(_NODE, "tbl", "col")), heads, _NODE)
    core = points if heads is None else points.join(_as(heads.select(*_UP), _UP, _NODE), _NODE, "left_anti")
    edges = core.where("u1 is not null").select(*_NODE, *_UP)
    edges = edges if heads is None else written(_skipped(edges, heads, _UP).distinct())
    found = core.where("s1 is not null").select(*_NODE, *_SOURCE)
    if starts is not None:
        used = _grown(names.select(*_NODE), lambda new: _as(new.join(edges, _NODE).select(*_UP), _UP, _NODE))
        edges, found = edges.join(used, _NODE, "left_semi"), found.join(used, _NODE, "left_semi")
    reached = _grown(found, lambda new: edges.join(_as(new, _NODE, _UP), _UP).select(*_NODE, *_SOURCE))
    return names.join(reached, _NODE).join(sources, _SOURCE).select(*_KEY, "source", "source_col")


def table_edges(deps: DataFrame) -> DataFrame:
    """M5: script, upstream, tbl: which table feeds which, each once."""
    return deps.select("script", "upstream", "tbl").distinct()


def consumers(deps: DataFrame) -> DataFrame:
    """M5: upstream, n_consumers and consumers (sorted) of every source."""
    return table_edges(deps).groupBy("script", "upstream").agg(F.count_distinct("tbl").alias("n_consumers"), F.sort_array(F.collect_set("tbl")).alias("consumers"))


def lineage_records(deps: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per table one JSON record: inputs, and for each column its input fields, DIRECT for kind `direct`, else INDIRECT.

    kinds: script, tbl, col, kind.
    """
    rows = deps.join(kinds.select(*_KEY, "kind"), _KEY)
    field = F.struct(F.col("upstream").alias("name"), F.col("up_col").alias("field"), F.when(F.col("kind") == "direct", "DIRECT").otherwise("INDIRECT").alias("type"))
    cols = rows.groupBy(*_KEY).agg(F.sort_array(F.collect_set(field)).alias("inputFields"), F.collect_set("upstream").alias("ups"))
    out = cols.groupBy("script", "tbl").agg(F.sort_array(F.flatten(F.collect_list("ups"))).alias("inputs"), F.sort_array(F.collect_list(F.struct("col", "inputFields"))).alias("fields"))
    record = F.struct(F.lit("BATCH").alias("processingType"), F.array_distinct("inputs").alias("inputs"), F.col("tbl").alias("output"), F.col("fields"))
    return out.select("script", "tbl", F.to_json(record).alias("record"))


def namespace(locator: Column, kind: Column) -> Column:
    """Where a source is, by its locator and kind: the scheme of a locator that has one, a database, or files of that kind."""
    # The formats of namespaces.
    scheme = F.substring_index(locator, "://", 1)
    return F.when(F.contains(locator, F.lit("://")), F.concat(F.lit("qvd://"), scheme)).when(kind == "sql", "db://source").otherwise(F.concat(F.lit("file://"), F.coalesce(kind, F.lit(""))))


def lineage_events(deps: DataFrame, kinds: DataFrame, sources: DataFrame, target: str, producer: str, run_id: str, event_time: str) -> DataFrame:
    """Per table one JSON event of a finished run: run id, time, job, inputs and the output with the lineage of its columns.

    sources: script, source, locator, kind of external sources; an input that is one of them has the namespace of its kind, others have that of the target. deps, kinds:
    see lineage_records; a table without columns has no event. run_id and event_time are given, so that a job's events agree and reruns repeat.
    """
    of = sources.select("script", F.lower("source").alias("_s"), namespace(F.col("locator"), F.col("kind")).alias("_ns")).groupBy("script", "_s").agg(F.min("_ns").alias("_ns"))
    rows = deps.join(kinds.select(*_KEY, "kind"), _KEY).withColumn("_s", F.lower("upstream")).join(of, ["script", "_s"], "left")
    place = F.coalesce("_ns", F.lit(target)).alias("namespace")
    changed = F.when(F.col("kind") == "direct", "DIRECT").otherwise("INDIRECT")
    field = F.struct(place, F.col("upstream").alias("name"), F.col("up_col").alias("field"), F.array(F.struct(changed.alias("type"), F.col("kind").alias("subtype"))).alias("transformations"))
    cols = rows.groupBy(*_KEY).agg(F.sort_array(F.collect_set(field)).alias("inputFields"))
    fields = cols.groupBy("script", "tbl").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("col", F.struct("inputFields"))))).alias("fields"))
    inputs = rows.groupBy("script", "tbl").agg(F.sort_array(F.collect_set(F.struct(place, F.col("upstream").alias("name")))).alias("inputs"))
    made = lambda **parts: F.struct(*[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in parts.items()])
    job = made(namespace=F.col("script"), name=F.col("tbl"), facets=made(jobType=made(processingType="BATCH", jobType="TASK")))
    output = made(namespace=target, name=F.col("tbl"), facets=made(columnLineage=made(fields=F.col("fields"))))
    event = made(eventType="COMPLETE", eventTime=event_time, producer=producer, run=made(runId=run_id), job=job, inputs=F.col("inputs"), outputs=F.array(output))
    return fields.join(inputs, ["script", "tbl"]).select("script", "tbl", F.to_json(event).alias("event"))


def join_dependencies(joins: DataFrame) -> DataFrame:
    """Script, from_tbl, to_tbl, type."""
    return joins.select("script", F.col("right_tbl").alias("from_tbl"), F.col("base_tbl").alias("to_tbl"), F.col("join_kind").alias("type"))


def filter_lineage(deps: DataFrame, targets: list[str] | None = None, sources: list[str] | None = None) -> DataFrame:
    """The rows whose table is a target and whose upstream is a source; None leaves a side open."""
    out = deps
    if targets is not None:
        out = out.where(F.lower("tbl").isin([t.lower() for t in targets]))
    if sources is not None:
        out = out.where(F.lower("upstream").isin([s.lower() for s in sources]))
    return out
