"""Queries: metadata jobs. Their rows of metadata are derived from the given tables, so that they grow with them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadflow.operators import inventory, lineage, search
from loadflow.plans.common import query, table
from loadflow.sources.shared import shared_dir

_COLUMNS = """(SELECT p_brand AS script, 'tab_' || p_type AS tbl, 'c' || p_partkey AS col, p_partkey AS pos, CASE WHEN p_size % 3 = 0 THEN 'mart' ELSE 'staging' END AS layer, CASE WHEN p_size % 2 = 0 THEN 'qvd' ELSE 'resident' END AS kind,
  CASE p_size % 6 WHEN 0 THEN 'ApplyMap(''M'', k' || p_size || ', ''none'')' WHEN 1 THEN '''fixed''' WHEN 2 THEN 'Sum("Unit Price") * Num(Qty)' WHEN 3 THEN 'key' || p_size WHEN 4 THEN 'if([' || p_name || '] = 1, a_1, a_1 & b)' ELSE 'Max(x) + 12' END AS expr,
  p_size % 6 = 3 AS passthrough, p_size % 4 = 2 AS grouped, CASE WHEN p_size % 10 = 0 THEN 2 ELSE 0 END AS n_warnings, p_size FROM part)"""

_JOINS = """(SELECT p_brand AS script, 'tab_' || p_type AS base_tbl, 'tab_' || p_size AS right_tbl, min(p_partkey) AS pos FROM part GROUP BY ALL)"""


def _columns(spark: SparkSession, sf: str) -> DataFrame:
    """columns: a part is a column of the table of its type in the script of its brand."""
    size = F.col("p_size")
    kinds = (
        F.when(size % 6 == 0, F.concat(F.lit("ApplyMap('M', k"), size.cast("string"), F.lit(", 'none')"))).when(size % 6 == 1, "'fixed'").when(size % 6 == 2, 'Sum("Unit Price") * Num(Qty)')
        .when(size % 6 == 3, F.concat(F.lit("key"), size.cast("string"))).when(size % 6 == 4, F.concat(F.lit("if(["), F.col("p_name"), F.lit("] = 1, a_1, a_1 & b)"))).otherwise("Max(x) + 12")
    )
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("script"), F.concat(F.lit("tab_"), F.col("p_type")).alias("tbl"), F.concat(F.lit("c"), F.col("p_partkey").cast("string")).alias("col"), F.col("p_partkey").alias("pos"),
        F.when(size % 3 == 0, "mart").otherwise("staging").alias("layer"), F.when(size % 2 == 0, "qvd").otherwise("resident").alias("kind"), kinds.alias("expr"), (size % 6 == 3).alias("passthrough"),
        (size % 4 == 2).alias("grouped"), F.when(size % 10 == 0, 2).otherwise(0).alias("n_warnings"), "p_size",
    )


def _joins(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    own = p.select(F.col("p_brand").alias("script"), F.concat(F.lit("tab_"), F.col("p_type")).alias("base_tbl"), F.concat(F.lit("tab_"), F.col("p_size").cast("string")).alias("right_tbl"), "p_partkey")
    return own.groupBy("script", "base_tbl", "right_tbl").agg(F.min("p_partkey").alias("pos")).withColumn("join_kind", F.lit("left"))


@query(f"""SELECT script, col, array_to_string(list_distinct_in_order, '|') AS refs FROM (SELECT script, col, CASE p_size % 6 WHEN 0 THEN ['k' || p_size] WHEN 1 THEN [] WHEN 2 THEN ['Unit Price', 'Qty'] WHEN 3 THEN ['key' || p_size]
  WHEN 4 THEN [regexp_extract(expr, '\\[(.*)\\]', 1), 'a_1', 'b'] ELSE ['x'] END AS list_distinct_in_order FROM {_COLUMNS})""")
def m1_referenced_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _columns(spark, sf).select("script", "col", F.array_join(lineage.referenced_columns(F.col("expr")), "|").alias("refs"))


@query("""WITH o AS (SELECT DISTINCT p_brand AS script, p_type AS tbl, p_name AS col FROM part), j AS (SELECT p_brand AS script, 'fact_' || p_size AS base_tbl, p_type AS right_tbl, min(p_partkey) AS pos FROM part GROUP BY ALL),
  r AS (SELECT DISTINCT p_brand AS script, 'fact_' || p_size AS tbl, 'x' AS col, upper(p_name) AS up_col FROM part UNION ALL SELECT DISTINCT p_brand, 'fact_' || p_size, 'y', 'none' FROM part),
  g AS (SELECT r.script, r.tbl, r.col, r.up_col, arg_min(j.right_tbl, j.pos) AS joined FROM r JOIN j ON r.script = j.script AND r.tbl = j.base_tbl JOIN o ON o.script = r.script AND o.tbl = j.right_tbl AND lower(o.col) = lower(r.up_col) GROUP BY ALL)
  SELECT r.script, r.tbl, r.col, coalesce(joined, 'source:' || r.script) AS upstream, r.up_col, joined IS NULL AND CAST(substr(r.tbl, 6) AS INTEGER) % 2 = 0 AS external FROM r LEFT JOIN g USING (script, tbl, col, up_col)""")
def m2_providers(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").withColumn("script", F.col("p_brand")).withColumn("tbl", F.concat(F.lit("fact_"), F.col("p_size").cast("string")))
    outputs = p.select("script", F.col("p_type").alias("tbl"), F.col("p_name").alias("col")).distinct()
    joins = p.groupBy("script", F.col("tbl").alias("base_tbl"), F.col("p_type").alias("right_tbl")).agg(F.min("p_partkey").alias("pos"))
    refs = p.select("script", "tbl", F.lit("x").alias("col"), F.upper("p_name").alias("up_col")).distinct().unionByName(p.select("script", "tbl", F.lit("y").alias("col"), F.lit("none").alias("up_col")).distinct())
    sources = p.select("script", "tbl", F.concat(F.lit("source:"), F.col("script")).alias("source"), (F.col("p_size") % 2 == 0).alias("source_external")).distinct()
    return lineage.resolve_providers(refs, joins, outputs, sources)


@query(f"SELECT script, tbl, col, 'm' AS upstream, 'mapped_value' AS up_col, false AS external FROM {_COLUMNS} WHERE p_size % 6 = 0")
def m2_lookup_providers(spark: SparkSession, sf: str) -> DataFrame:
    columns = _columns(spark, sf)
    return lineage.lookup_providers(columns, columns.select("script").distinct().withColumn("map", F.lit("m")))


@query(f"""SELECT script, col, CASE p_size % 6 WHEN 0 THEN 'lookup' WHEN 1 THEN 'constant' WHEN 3 THEN CASE WHEN p_size % 5 = 0 THEN 'join' ELSE 'direct' END WHEN 4 THEN 'derived' ELSE CASE WHEN grouped THEN 'aggregate' ELSE 'derived' END END AS mapping FROM {_COLUMNS}""")
def m3_mapping_types(spark: SparkSession, sf: str) -> DataFrame:
    refs = F.size(lineage.referenced_columns(F.col("expr")))
    kind = lineage.mapping_type(F.col("expr"), refs, F.col("grouped"), F.col("passthrough"), F.col("p_size") % 5 == 0)
    return _columns(spark, sf).select("script", "col", kind.alias("mapping"))


def _order_deps(spark: SparkSession, sf: str) -> DataFrame:
    """deps: the column of order k depends on those of k / 8 and k / 16; the first eight come from outside."""
    k = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))
    up = lambda by: k.where(k.k >= by).select("k", F.floor(k.k / by).alias("up"), F.lit(False).alias("external"))
    deps = up(8).unionByName(up(16)).unionByName(k.where("k < 8").select("k", F.col("k").alias("up"), F.lit(True).alias("external")))
    name = lambda c: F.col(c).cast("string")
    return deps.select(
        F.lit("orders").alias("script"), F.concat(F.lit("T"), name("k")).alias("tbl"), F.lit("c").alias("col"),
        F.when(F.col("external"), F.concat(F.lit("source"), name("up"))).otherwise(F.concat(F.lit("t"), name("up"))).alias("upstream"), F.lit("c").alias("up_col"), "external",
    )


@query("""WITH RECURSIVE e AS (SELECT o_orderkey AS k, o_orderkey // 8 AS up FROM orders WHERE o_orderkey >= 8 UNION SELECT o_orderkey, o_orderkey // 16 FROM orders WHERE o_orderkey >= 16),
  r(k, n) AS (SELECT o_orderkey, o_orderkey FROM orders UNION SELECT r.k, e.up FROM r JOIN e ON r.n = e.k)
  SELECT 'orders' AS script, 'T' || k AS tbl, 'c' AS col, 'source' || n AS source, 'c' AS source_col FROM r WHERE n < 8""")
def m4_ultimate_sources(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.ultimate_sources(_order_deps(spark, sf))


@query("""SELECT DISTINCT p_brand AS script, 'mart' AS tbl, 'c' || p_partkey AS col, CASE WHEN p_partkey % 50 % 2 = 0 THEN 'direct' WHEN p_partkey % 50 % 5 = 0 THEN 'dim source' ELSE 'lake' END AS source, 'k' || p_partkey % 50 AS source_col FROM part""")
def m4_passed_through(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of a mart from a table that lists some of them, is joined to one that has others, and hands on the rest of two tables below."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("script"), "p_partkey", (F.col("p_partkey") % 50).alias("n"), F.concat(F.lit("k"), (F.col("p_partkey") % 50).cast("string")).alias("k"))
    dep = lambda df, tbl, col, upstream, external: df.select("script", F.lit(tbl).alias("tbl"), col.alias("col"), F.lit(upstream).alias("upstream"), F.col("k").alias("up_col"), F.lit(external).alias("external"))
    mart = dep(p, "mart", F.concat(F.lit("c"), F.col("p_partkey").cast("string")), "Mid", False)
    listed = dep(p.where("n % 2 = 0"), "mid", F.col("k"), "direct", True).unionByName(dep(p.where("n % 5 = 0"), "dim", F.col("k"), "dim source", True)).distinct()
    scripts, deps = p.select("script").distinct(), mart.unionByName(listed)
    named = lambda *rows: scripts.select("script", F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in r.items()]) for r in rows])))
    tables = named({"tbl": "mart", "source": "mid", "source_external": False}, {"tbl": "mid", "source": "stage", "source_external": False}, {"tbl": "stage", "source": "lake", "source_external": True}, {"tbl": "dim", "source": "dim source", "source_external": True})
    every = lineage.with_passed_through(deps, named({"base_tbl": "mid", "right_tbl": "dim", "pos": 1}), deps.select("script", "tbl", "col"), tables)
    return lineage.ultimate_sources(every, mart)


def _customer_deps(spark: SparkSession, sf: str) -> DataFrame:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.lit("crm").alias("script"), F.concat(F.lit("mart_"), F.col("n_name")).alias("tbl"), F.concat(F.lit("c"), (F.col("c_custkey") % 9).cast("string")).alias("col"),
        F.concat(F.lit("src_"), F.col("c_mktsegment")).alias("upstream"), F.concat(F.lit("u"), (F.col("c_custkey") % 4).cast("string")).alias("up_col"), F.lit(True).alias("external"),
    )


_DEPS = "(SELECT 'crm' AS script, 'mart_' || n_name AS tbl, 'c' || c_custkey % 9 AS col, 'src_' || c_mktsegment AS upstream, 'u' || c_custkey % 4 AS up_col FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"SELECT DISTINCT script, upstream, tbl FROM {_DEPS}")
def m5_table_edges(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.table_edges(_customer_deps(spark, sf))


@query(f"SELECT script, upstream, count(DISTINCT tbl) AS n_consumers, array_to_string(list_sort(list(DISTINCT tbl)), ',') AS consumers FROM {_DEPS} GROUP BY ALL")
def m5_consumers(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.consumers(_customer_deps(spark, sf)).withColumn("consumers", F.array_join("consumers", ","))


@query(f"SELECT script, count(DISTINCT tbl) AS n_tables, count(col) AS n_fields, count(*) FILTER (n_warnings > 0) AS n_flagged, CAST(round(100 * (count(col) - count(*) FILTER (n_warnings > 0)) / count(col), 1) AS DOUBLE) AS auto_pct FROM {_COLUMNS} GROUP BY 1")
def m6_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.coverage(_columns(spark, sf))


@query(f"SELECT layer, kind, count(DISTINCT (script, tbl)) AS n_tables, count(col) AS n_fields FROM {_COLUMNS} GROUP BY ALL")
def m6_by_layer(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.by_layer(_columns(spark, sf))


@query(f"""WITH a AS (SELECT script, tbl, count(col) AS f, sum(n_warnings) AS w, bool_or(grouped) AS g FROM {_COLUMNS} GROUP BY ALL), j AS (SELECT script, base_tbl AS tbl, count(*) AS n FROM {_JOINS} GROUP BY ALL),
  s AS (SELECT script, tbl, CAST(round(CAST(f * 0.2 + coalesce(n, 0) * 2 + w * 3 + CASE WHEN g THEN 2 ELSE 0 END AS DECIMAL(18,4)), 1) AS DOUBLE) AS score FROM a LEFT JOIN j USING (script, tbl))
  SELECT script, tbl, score, CASE WHEN score < 5 THEN 'Low' WHEN score < 12 THEN 'Medium' ELSE 'High' END AS effort FROM s""")
def m7_effort(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.effort(_columns(spark, sf), _joins(spark, sf))


@query("""SELECT doc_id, score FROM (SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 + (length(lower(text)) - length(replace(lower(text), 'license', ''))) / 7 AS INTEGER) AS score FROM documents)
  WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def m8_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.retrieve(table(spark, sf, "documents").select("doc_id", "text"), "text", "The license, the", 20, "doc_id").select("doc_id", "score")


@query("""SELECT doc_id, score FROM (SELECT doc_id, CAST((length(lower(text)) - length(replace(lower(text), 'the', ''))) / 3 + (length(lower(text)) - length(replace(lower(text), 'license', ''))) / 7 AS INTEGER) AS score FROM documents)
  WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def m8_search_index(spark: SparkSession, sf: str) -> DataFrame:
    """The same question as m8_retrieve, asked of a written index."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    search.build_index(table(spark, sf, "documents"), "text", "doc_id", path, buckets=8)
    return search.search(spark, path, "The license, the", 20).withColumnRenamed("key", "doc_id").select("doc_id", "score")


@query("""SELECT DISTINCT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 1000 = 1 THEN 'missing' ELSE 'changed' END AS kind FROM lineitem WHERE l_orderkey % 1000 = 1 OR l_orderkey % 1000 = 2 AND l_linenumber = 1
  UNION ALL SELECT DISTINCT -l_orderkey - 1, l_linenumber, 'extra' FROM lineitem WHERE l_orderkey % 1000 = 3""")
def m9_reconcile_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All lines against a copy that lacks some orders, has other quantities in some lines, and orders of its own."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    other = li.withColumn("l_quantity", F.when((F.col("l_orderkey") % 1000 == 2) & (F.col("l_linenumber") == 1), F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    own = li.where("l_orderkey % 1000 = 3").withColumn("l_orderkey", -F.col("l_orderkey") - 1)
    return search.reconcile_rows(li, other.where("l_orderkey % 1000 <> 1").unionByName(own), ["l_orderkey", "l_linenumber"])


@query("""SELECT 'orders' AS name, count(*) AS source_rows, count(*) FILTER (o_orderstatus <> 'P') AS target_rows, CAST(sum(CAST(o_totalprice AS DECIMAL(38,4))) AS DOUBLE) AS source_sum, CAST(sum(CAST(o_totalprice AS DECIMAL(38,4))) FILTER (o_orderstatus <> 'P') AS DOUBLE) AS target_sum FROM orders
  UNION ALL SELECT 'customer', count(*), count(*), NULL, NULL FROM customer""")
def m9_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    df = inventory.reconcile({"orders": (o, o.where("o_orderstatus <> 'P'")), "customer": (c, c)}, {"orders": "o_totalprice"})
    return df.withColumn("source_sum", F.col("source_sum").cast("double")).withColumn("target_sum", F.col("target_sum").cast("double"))


@query(f"SELECT script, tbl, string_agg(tbl || '.' || col || ' = ' || expr, chr(10) ORDER BY pos, col) AS text FROM {_COLUMNS} GROUP BY ALL")
def m10_catalog_text(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.catalog_text(_columns(spark, sf))


@query(f"""WITH d AS (SELECT DISTINCT * FROM {_DEPS}),
  f AS (SELECT script, tbl, col, list_sort(list({{'name': upstream, 'field': up_col, 'type': CASE WHEN col < 'c5' THEN 'DIRECT' ELSE 'INDIRECT' END}})) AS i FROM d GROUP BY ALL),
  g AS (SELECT script, tbl, list_sort(list({{'col': col, 'inputFields': i}})) AS fields FROM f GROUP BY ALL), u AS (SELECT script, tbl, list_sort(list(DISTINCT upstream)) AS inputs FROM d GROUP BY ALL)
  SELECT script, tbl, CAST(to_json({{'processingType': 'BATCH', 'inputs': inputs, 'output': tbl, 'fields': fields}}) AS VARCHAR) AS record FROM g JOIN u USING (script, tbl)""")
def m11_lineage_records(spark: SparkSession, sf: str) -> DataFrame:
    deps = _customer_deps(spark, sf)
    kinds = deps.select("script", "tbl", "col").distinct().withColumn("kind", F.when(F.col("col") < "c5", "direct").otherwise("derived"))
    return lineage.lineage_records(deps, kinds)


@query(f"""WITH d AS (SELECT DISTINCT *, CASE WHEN upstream LIKE '%BUILDING' THEN 'qvd://lib' WHEN upstream LIKE '%MACHINERY' THEN 'db://source' WHEN upstream LIKE '%AUTOMOBILE' THEN 'file://file' ELSE 'lake://mart' END AS ns FROM {_DEPS})
  SELECT script, tbl, upstream, max(ns) AS namespace, count(DISTINCT col) AS n_columns, 'run-1' AS run_id, 'COMPLETE' AS event_type FROM d GROUP BY ALL""")
def m11_lineage_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a run, read back: each input with its place and the columns that come from it."""
    deps = _customer_deps(spark, sf)
    kinds = deps.select("script", "tbl", "col").distinct().withColumn("kind", F.when(F.col("col") < "c5", "direct").otherwise("derived"))
    up, ends = F.col("upstream"), lambda s: F.col("upstream").endswith(s)
    kind = F.when(ends("BUILDING"), "qvd").when(ends("MACHINERY"), "sql").when(ends("AUTOMOBILE"), "file")
    sources = deps.select("script", up.alias("source"), F.when(ends("BUILDING"), "lib://data/x.qvd").otherwise("x").alias("locator"), kind.alias("kind")).where("kind is not null").distinct()
    events = lineage.lineage_events(deps, kinds, sources, "lake://mart", "loadflow", "run-1", "2026-01-01T00:00:00Z")
    shape = "eventType string, run struct<runId: string>, outputs array<struct<facets: struct<columnLineage: struct<fields: map<string, struct<inputFields: array<struct<namespace: string, name: string, field: string>>>>>>>>"
    e = events.select("script", "tbl", F.from_json("event", shape).alias("e"))
    fields = e.select("script", "tbl", "e.eventType", "e.run.runId", F.explode(F.col("e.outputs")[0]["facets"]["columnLineage"]["fields"]).alias("col", "f"))
    each = fields.select("script", "tbl", "eventType", "runId", "col", F.explode("f.inputFields").alias("i"))
    return each.groupBy("script", "tbl", F.col("i.name").alias("upstream"), F.col("runId").alias("run_id"), F.col("eventType").alias("event_type")).agg(
        F.max("i.namespace").alias("namespace"), F.count_distinct("col").alias("n_columns")
    )


@query(f"SELECT script, right_tbl AS from_tbl, base_tbl AS to_tbl, 'left' AS type FROM {_JOINS}")
def m12_join_dependencies(spark: SparkSession, sf: str) -> DataFrame:
    return lineage.join_dependencies(_joins(spark, sf))


@query(f"SELECT tbl, upstream, count(*) AS n FROM {_DEPS} WHERE tbl IN ('mart_NATION_1', 'mart_NATION_7') AND upstream IN ('src_BUILDING', 'src_MACHINERY') GROUP BY ALL")
def m13_filter_lineage(spark: SparkSession, sf: str) -> DataFrame:
    df = lineage.filter_lineage(_customer_deps(spark, sf), ["mart_NATION_1", "MART_nation_7"], ["src_building", "src_MACHINERY"])
    return df.groupBy("tbl", "upstream").agg(F.count(F.lit(1)).alias("n"))
