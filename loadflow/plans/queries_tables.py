"""Queries: sources, projections, joins, unions, aggregates and ordered operators over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadflow.operators import aggregates as A
from loadflow.operators import mapping, ordered, sketches, tables
from loadflow.plans.common import query, table
from loadflow.sources import landing, manifest, publish, readers, shared, sinks
from loadflow.sources.shared import shared_dir, written


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


# Sources and sinks


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def s1_load_extract(spark: SparkSession, sf: str) -> DataFrame:
    return readers.load_parquet(spark, f"{sf}/orders.parquet", "o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def s2_load_delimited(spark: SparkSession, sf: str) -> DataFrame:
    """Customers written as text with labels and read back."""
    path = _scratch(spark)
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).option("sep", ";").csv(path)
    return readers.load_text(spark, path, "c_custkey long, c_name string, c_mktsegment string", delimiter=";")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority")
def s3_load_sql(spark: SparkSession, sf: str) -> DataFrame:
    readers.load_named(spark, "orders_s3", f"{sf}/orders.parquet")
    return readers.load_sql(spark, "SELECT o_orderpriority, count(*) AS n FROM orders_s3 GROUP BY o_orderpriority")


@query("SELECT c_custkey, c_acctbal FROM customer")
def s4_load_resident(spark: SparkSession, sf: str) -> DataFrame:
    readers.load_named(spark, "customer_s4", f"{sf}/customer.parquet")
    return readers.load_resident(spark, "customer_s4", "c_custkey", "c_acctbal")


@query("SELECT v.label, count(*) AS n FROM orders JOIN (VALUES ('P', 'pending'), ('F', 'filled'), ('O', 'open')) AS v(code, label) ON o_orderstatus = v.code GROUP BY v.label")
def s5_load_inline(spark: SparkSession, sf: str) -> DataFrame:
    status = readers.load_inline(spark, [("P", "pending"), ("F", "filled"), ("O", "open")], "o_orderstatus string, label string")
    return tables.natural_join(table(spark, sf, "orders"), status).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT r AS recno, count(o_orderkey) AS n FROM range(1, 13) t(r) LEFT JOIN orders ON month(o_orderdate) = r GROUP BY r")
def s6_autogenerate(spark: SparkSession, sf: str) -> DataFrame:
    months = readers.autogenerate(spark, 12)
    orders = table(spark, sf, "orders").select(F.month("o_orderdate").cast("long").alias("recno"), "o_orderkey")
    return tables.natural_join(months, orders, "left").groupBy("recno").agg(F.count("o_orderkey").alias("n"))


@query("SELECT year(o_orderdate)::INTEGER AS y, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1")
def s7_s8_load_each_file(spark: SparkSession, sf: str) -> DataFrame:
    """A file for each year of orders, read in one scan, and a table's name given to each file."""
    path = _scratch(spark)
    table(spark, sf, "orders").withColumn("y", F.year("o_orderdate")).write.partitionBy("y").parquet(path)
    folders = shared.subfolders(spark, path)
    df = readers.load_each(spark, folders, "file").drop("file")
    for i, folder in enumerate(folders):
        readers.load_named(spark, f"orders_s8_{i}", folder)
    named = readers.load_resident(spark, "orders_s8_0")
    for i in range(1, len(folders)):
        named = named.unionByName(readers.load_resident(spark, f"orders_s8_{i}"))
    totals = lambda d: d.groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))
    return totals(df).intersect(totals(named))


@query("""SELECT CASE WHEN year(o_orderdate) < 1997 THEN 1 ELSE 2 END AS load, count(*) AS n, count(*) FILTER (year(o_orderdate) >= 1997) AS with_priority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
  FROM orders GROUP BY 1""")
def s7_load_added(spark: SparkSession, sf: str) -> DataFrame:
    """Files of early years are loaded; then those of later years come, with a column more and keys as text, and only these are loaded."""
    o, folder, path = table(spark, sf, "orders"), _scratch(spark), _scratch(spark)
    o.where("year(o_orderdate) < 1997").select("o_orderkey", "o_totalprice").write.parquet(f"{folder}/early")
    first = manifest.load_added(spark, folder, path)
    first.done()
    o.where("year(o_orderdate) >= 1997").select(F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_totalprice", "o_orderpriority").write.parquet(f"{folder}/late")
    second = manifest.load_added(spark, folder, path)
    both = first.rows.withColumn("load", F.lit(1)).withColumn("o_orderpriority", F.lit(None).cast("string")).unionByName(second.rows.withColumn("load", F.lit(2)).withColumn("o_orderkey", F.col("o_orderkey").cast("long")))
    return both.groupBy("load").agg(F.count("o_orderkey").alias("n"), F.count("o_orderpriority").alias("with_priority"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def s9_append_new(spark: SparkSession, sf: str) -> DataFrame:
    """Orders up to a day are history; the fresh load holds the later half again and the rest."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    history, fresh = o.where("o_orderdate < '1999-01-01'"), o.where("o_orderdate >= '1997-01-01'")
    return landing.append_new(history, fresh, ["o_orderkey"]).drop("o_orderdate")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def s9_latest_per_key(spark: SparkSession, sf: str) -> DataFrame:
    return landing.latest(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


_MERGED = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 AND o_orderpriority <> '3-MEDIUM' THEN 'x' ELSE o_orderstatus END AS status, o_orderpriority FROM orders
  WHERE NOT (o_orderkey % 7 = 0 AND o_orderpriority <> '3-MEDIUM')"""


def _merge_orders(spark: SparkSession, sf: str, path: str) -> DataFrame:
    """Of stored orders (without those of every third customer), all priorities but one are loaded anew: with new orders, changed ones (every fifth) and deleted ones (every seventh)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), "o_orderpriority")
    landing.merge(spark, path, o.where("o_custkey % 3 <> 0 or o_orderpriority = '3-MEDIUM'"), ["o_orderkey"], ["o_orderpriority"])
    anew = o.where("o_orderpriority <> '3-MEDIUM' and o_orderkey % 7 <> 0")
    anew = anew.withColumn("status", F.when(F.col("o_orderkey") % 5 == 0, "x").otherwise(F.col("status")))
    return landing.merge(spark, path, anew, ["o_orderkey"], ["o_orderpriority"], complete=True)


@query(_MERGED)
def s9_merge(spark: SparkSession, sf: str) -> DataFrame:
    _merge_orders(spark, sf, path := _scratch(spark))
    return spark.read.schema("o_orderkey long, o_custkey long, status string, o_orderpriority string").parquet(path)


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 7 = 0 THEN CASE WHEN o_custkey % 3 <> 0 THEN 'deleted' END WHEN o_custkey % 3 = 0 THEN 'new'
  WHEN o_orderkey % 5 = 0 AND o_orderstatus <> 'x' THEN 'changed' END AS kind FROM orders WHERE o_orderpriority <> '3-MEDIUM') WHERE kind IS NOT NULL GROUP BY 1""")
def s9_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _merge_orders(spark, sf, _scratch(spark)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _raw_orders(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("order_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("order_date"),
        F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("total_price"),
        F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "O", "false").otherwise("?").alias("is_filled"),
    )


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_orderdate AS DATE) AS order_date, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_totalprice AS DECIMAL(38,4)) END AS total_price,
  CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS is_filled FROM orders""")
def s10_typed_landing(spark: SparkSession, sf: str) -> DataFrame:
    return landing.land(_raw_orders(spark, sf))


@query("""SELECT v.col, v.type, CAST(v.n_failed AS BIGINT) AS n_failed FROM (SELECT count(*) FILTER (o_orderkey % 7 = 0) AS a, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS b FROM orders) s,
  LATERAL (VALUES ('order_id', 'string', 0), ('order_date', 'date', 0), ('total_price', 'decimal(38,4)', a), ('is_filled', 'boolean', b)) v(col, type, n_failed)""")
def s10_failed_casts(spark: SparkSession, sf: str) -> DataFrame:
    return landing.failed_casts(_raw_orders(spark, sf))


@query("""SELECT p_brand || '_' || k AS name, s AS kind, CASE WHEN regexp_matches(lower(p_brand || '_' || k), '^(.*_fact|.*_dim|.*fact|fact.*|dim.*|.*_report|.*_kpi|.*summary)$') THEN 'mart'
  WHEN s IN ('qvd', 'file', 'sql', 'inline') THEN 'staging' ELSE 'intermediate' END AS layer
  FROM (SELECT DISTINCT p_brand FROM part) p, (VALUES ('fact', 'qvd'), ('rows', 'file'), ('map', 'resident'), ('KPI', 'sql'), ('SalesFact', 'file')) v(k, s)""")
def s11_layers(spark: SparkSession, sf: str) -> DataFrame:
    kinds = readers.load_inline(spark, [("fact", "qvd"), ("rows", "file"), ("map", "resident"), ("KPI", "sql"), ("SalesFact", "file")], "k string, kind string")
    names = tables.natural_join(table(spark, sf, "part").select("p_brand").distinct(), kinds, allow_cross=True)
    df = names.select(F.concat_ws("_", "p_brand", "k").alias("name"), "kind")
    return df.withColumn("layer", sinks.layer(F.col("name"), F.col("kind")))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def s12_s15_store(spark: SparkSession, sf: str) -> DataFrame:
    """A mart stored by status and read back."""
    path = _scratch(spark)
    mart = table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    sinks.store(mart, path, ["o_orderstatus"])
    return spark.read.schema("o_orderpriority string, n long, o_orderstatus string").parquet(path)


@query("""SELECT 'view' AS kind, o_orderstatus AS k, count(*) AS n FROM orders GROUP BY ALL UNION ALL SELECT 'table', o_orderpriority, count(*) FROM orders GROUP BY ALL""")
def s12_materialise(spark: SparkSession, sf: str) -> DataFrame:
    """A staging table as a view and a mart as a table of the catalog, each by the layer of its name."""
    o, name = table(spark, sf, "orders"), f"s12_{uuid.uuid4().hex}"
    count = lambda c: o.groupBy(F.col(c).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    for t, df in ((f"{name}_rows", count("o_orderstatus")), (f"{name}_fact", count("o_orderpriority"))):
        sinks.materialise(df, t, sinks.layer_of(t, "file"))
    kinds = {t.name: "view" if t.isTemporary else "table" for t in spark.catalog.listTables() if t.name.startswith(name)}
    made = [spark.table(t).select(F.lit(kind).alias("kind"), "k", "n") for t, kind in sorted(kinds.items())]
    return made[0].unionByName(made[1])


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def s14_rebuild(spark: SparkSession, sf: str) -> DataFrame:
    """A table of the catalog, rebuilt over another one of its name."""
    o, name = table(spark, sf, "orders"), f"s14_{uuid.uuid4().hex}"
    sinks.rebuild(o.select("o_orderkey"), name)
    sinks.rebuild(o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), name)
    return spark.table(name)


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def s15_save(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in place of others, then more rows added."""
    o, name = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), f"s15_{uuid.uuid4().hex}"
    sinks.rebuild(o.where("o_orderstatus = 'P'"), name)
    sinks.save(o.where("o_orderstatus = 'F'"), name, overwrite=True)
    sinks.save(o.where("o_orderstatus <> 'F'"), name, overwrite=False)
    return spark.table(name)


@query("SELECT o_orderkey, o_orderstatus, CAST(2 AS INTEGER) AS loads FROM orders")
def s13_store_over_itself(spark: SparkSession, sf: str) -> DataFrame:
    """A history is read, grows by the orders it lacks, and is stored where it was read; then once more under a pointer."""
    o, path = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), _scratch(spark)
    sinks.store(o.where("o_orderstatus = 'F'").withColumn("loads", F.lit(1)), path)
    history = readers.load_parquet(spark, path)
    sinks.store(landing.append_new(history, o.withColumn("loads", F.lit(1)), ["o_orderkey"]), path)
    publish.publish(readers.load_parquet(spark, path), f"{path}_published")
    publish.publish(publish.published(spark, f"{path}_published").withColumn("loads", F.col("loads") + 1), f"{path}_published")
    return publish.published(spark, f"{path}_published")


@query("SELECT o_orderstatus, 2 * count(*) AS n FROM orders GROUP BY 1")
def s14_rebuild_from_itself(spark: SparkSession, sf: str) -> DataFrame:
    """A table of the catalog that is rebuilt from its own rows."""
    name = f"s14_{uuid.uuid4().hex}"
    sinks.rebuild(table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")), name)
    sinks.rebuild(spark.table(name).withColumn("n", F.col("n") * 2), name)
    return spark.table(name)


@query("SELECT 'Customers' AS name, count(*) AS n FROM customer")
def s16_drop(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of a job's tables, after one is dropped."""
    job = tables.Tables(spark)
    for name, source in (("Orders", "orders"), ("Customers", "customer")):
        job.load(name, table(spark, sf, source))
    job.drop("orders")
    left = [job[name].agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name in job.names]
    return tables.concatenate(*left)


# Projections and filters


@query("SELECT o_orderkey AS \"Order ID\", o_totalprice * 0.5 AS half FROM orders WHERE length(o_orderstatus) > 0 AND o_totalprice > 500")
def p1_p5_project_filter(spark: SparkSession, sf: str) -> DataFrame:
    df = tables.rename(table(spark, sf, "orders"), {"o_orderkey": "Order ID"}).where((F.length("o_orderstatus") > 0) & (F.col("o_totalprice") > 500))
    return tables.select(df, "Order ID", half=F.col("o_totalprice") * 0.5)


@query("SELECT * FROM supplier")
def p3_all_fields(spark: SparkSession, sf: str) -> DataFrame:
    return tables.select(table(spark, sf, "supplier"))


@query("SELECT c_custkey, substr(c_name, 10) AS no FROM customer WHERE TRY_CAST(substr(c_name, 10) AS DOUBLE) > 100")
def p6_text_compared_with_number(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").select("c_custkey", F.substring("c_name", 10, 99).alias("no"))
    return df.where(F.col("no").try_cast("double") > 100)


@query("SELECT s_suppkey, s_name AS supplier FROM supplier")
def p7_p8_drop_rename(spark: SparkSession, sf: str) -> DataFrame:
    return tables.rename(tables.drop_fields(table(spark, sf, "supplier"), "s_nationkey", "s_acctbal"), {"s_name": "supplier"})


@query("SELECT n_nationkey, n_name || '-' || CASE WHEN n_regionkey <> 2 THEN r_name END AS place, CASE WHEN n_nationkey = 0 THEN true WHEN n_nationkey = 1 THEN false END AS flag FROM nation JOIN region ON n_regionkey = r_regionkey")
def p9_p10_literals_concat(spark: SparkSession, sf: str) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    part = F.when(F.col("n_regionkey") != 2, F.col("r_name"))
    flag = F.when(F.col("n_nationkey") == 0, F.lit(True)).when(F.col("n_nationkey") == 1, F.lit(False)).otherwise(F.lit(None))
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.concat("n_name", F.lit("-"), part).alias("place"), flag.alias("flag"))


@query("SELECT k, k * 2 AS twice, CASE WHEN k * 2 > 100 THEN 'big' ELSE 'small' END AS size FROM (SELECT o_orderkey + 1 AS k FROM orders WHERE o_orderstatus = 'F')")
def p11_preceding_load(spark: SparkSession, sf: str) -> DataFrame:
    inner = tables.select(table(spark, sf, "orders").where("o_orderstatus = 'F'"), k=F.col("o_orderkey") + 1)
    return tables.select(inner, "k", twice=F.col("k") * 2).withColumn("size", F.when(F.col("twice") > 100, "big").otherwise("small"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def p12_branch(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return tables.choose("open", {"open": lambda: o.where("o_orderstatus = 'O'"), "all": lambda: o}).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


# Joins and lookups


def _keyed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All lines and all parts; lines of more than 40 pieces have a key that no part has, and parts of sizes below 5 one that no line has."""
    key = F.when(F.col("l_quantity") > 40, -F.col("l_partkey") - 1).otherwise(F.col("l_partkey"))
    part = F.when(F.col("p_size") < 5, F.col("p_partkey") + 1_000_000_000).otherwise(F.col("p_partkey"))
    return table(spark, sf, "lineitem").select(key.alias("PartKey"), "l_orderkey", "l_linenumber"), table(spark, sf, "part").select(part.alias("partkey"), "p_brand")


_L = "(SELECT CASE WHEN l_quantity > 40 THEN -l_partkey - 1 ELSE l_partkey END AS PartKey, l_orderkey, l_linenumber FROM lineitem) l"
_P = "(SELECT CASE WHEN p_size < 5 THEN p_partkey + 1000000000 ELSE p_partkey END AS partkey, p_brand FROM part) p"


@query(f"SELECT PartKey, l_orderkey, l_linenumber, p_brand FROM {_L} LEFT JOIN {_P} USING (PartKey)")
def j1_j2_left_join(spark: SparkSession, sf: str) -> DataFrame:
    return tables.natural_join(*_keyed(spark, sf), "left")


@query(f"SELECT PartKey, l_orderkey, l_linenumber, p_brand FROM {_L} JOIN {_P} USING (PartKey)")
def j3_inner_join(spark: SparkSession, sf: str) -> DataFrame:
    return tables.natural_join(*_keyed(spark, sf))


@query(f"SELECT PartKey AS \"PartKey\", l_orderkey, l_linenumber, p_brand FROM {_L} RIGHT JOIN {_P} USING (PartKey)")
def j4_right_join(spark: SparkSession, sf: str) -> DataFrame:
    return tables.natural_join(*_keyed(spark, sf), "right")


@query(f"SELECT PartKey, l_orderkey, l_linenumber, p_brand FROM {_L} FULL JOIN {_P} USING (PartKey)")
def j5_full_join(spark: SparkSession, sf: str) -> DataFrame:
    return tables.natural_join(*_keyed(spark, sf), "full")


_HOT_L = "(SELECT CASE WHEN l_orderkey % 3 = 0 THEN 7 WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_partkey END AS key, l_orderkey, l_linenumber FROM lineitem)"
_HOT_P = "(SELECT CASE WHEN p_size < 5 THEN p_partkey + 1000000000 WHEN p_size > 48 THEN NULL ELSE p_partkey END AS key, p_name, p_brand FROM part)"


def _hot_keyed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Lines of which a third has one key and some have none, and parts of which some have none and some one that no line has."""
    key = F.when(F.col("l_orderkey") % 3 == 0, 7).when(F.col("l_orderkey") % 7 == 0, None).otherwise(F.col("l_partkey"))
    part = F.when(F.col("p_size") < 5, F.col("p_partkey") + 1_000_000_000).when(F.col("p_size") > 48, None).otherwise(F.col("p_partkey"))
    return table(spark, sf, "lineitem").select(key.alias("key"), "l_orderkey", "l_linenumber"), table(spark, sf, "part").select(part.alias("key"), "p_name", "p_brand")


@query(f"SELECT key, l_orderkey, l_linenumber, p_name, p_brand FROM {_HOT_L} LEFT JOIN {_HOT_P} USING (key)")
def j2_skewed_left_join(spark: SparkSession, sf: str) -> DataFrame:
    return tables.skewed_join(*_hot_keyed(spark, sf), "left")


@query(f"SELECT key, l_orderkey, l_linenumber, p_name, p_brand FROM {_HOT_L} FULL JOIN {_HOT_P} USING (key)")
def j5_skewed_full_join(spark: SparkSession, sf: str) -> DataFrame:
    return tables.skewed_join(*_hot_keyed(spark, sf), "full")


@query("SELECT o_orderstatus, count(*) AS n, min(no) AS first, max(no) AS last FROM (SELECT o_orderstatus, row_number() OVER (ORDER BY o_orderstatus) AS no FROM orders) GROUP BY 1")
def w5_row_numbers_of_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers in an order of three values: each value's numbers are one range without gaps."""
    numbered = ordered.row_numbers(table(spark, sf, "orders").select("o_orderstatus", "o_orderkey"), "no", ["o_orderstatus"])
    return numbered.groupBy("o_orderstatus").agg(F.count_distinct("no").alias("n"), F.min("no").alias("first"), F.max("no").alias("last"))


@query(f"SELECT 'left' AS side, count(*) AS n, count(DISTINCT PartKey) AS keys FROM {_L} WHERE EXISTS (FROM {_P} WHERE p.partkey = l.PartKey) UNION ALL SELECT 'right', count(*), count(DISTINCT partkey) FROM {_P} WHERE EXISTS (FROM {_L} WHERE p.partkey = l.PartKey)")
def j6_keep(spark: SparkSession, sf: str) -> DataFrame:
    left, right = tables.keep(*_keyed(spark, sf), "inner")
    count = lambda df, side: df.agg(F.lit(side).alias("side"), F.count(F.lit(1)).alias("n"), F.count_distinct("PartKey").alias("keys"))
    return count(left, "left").unionByName(count(right, "right"))


@query("""SELECT r_name, n_name, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def j7_j8_star(spark: SparkSession, sf: str) -> DataFrame:
    """Tables linked by equally named keys, joined in order."""
    li = tables.rename(table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice"), {"l_orderkey": "order"})
    o = tables.rename(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), {"o_orderkey": "order", "o_custkey": "cust"})
    c = tables.rename(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), {"c_custkey": "cust", "c_nationkey": "nation"})
    n = tables.rename(table(spark, sf, "nation"), {"n_nationkey": "nation", "n_regionkey": "region"})
    r = tables.rename(table(spark, sf, "region"), {"r_regionkey": "region"})
    df = tables.join_all(li, [(o, "inner"), (c, "inner"), (n, "inner"), (r, "inner")])
    return df.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("revenue"))


@query("SELECT o_orderkey, o_custkey, c_mktsegment, n_name FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey < 20")
def j7_join_into(spark: SparkSession, sf: str) -> DataFrame:
    """Joins into a table by its name, and into the one loaded last."""
    job = tables.Tables(spark)
    job.load("Orders", table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("cust")))
    job.load("Customers", table(spark, sf, "customer").select(F.col("c_custkey").alias("Cust"), "c_mktsegment", F.col("c_nationkey").alias("nation")))
    job.join(table(spark, sf, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("Nation"), "n_name"), "left")
    job.join(job["Customers"], "inner", into="Orders")
    out = tables.rename(job["Orders"], {"cust": "o_custkey"}).drop("nation")
    job.drop("Orders", "Customers")
    return out


@query("SELECT r_name, n_name FROM nation, region")
def j9_cross(spark: SparkSession, sf: str) -> DataFrame:
    return tables.natural_join(table(spark, sf, "nation").select("n_name"), table(spark, sf, "region").select("r_name"), allow_cross=True)


@query("SELECT c_mktsegment AS mapped_key, min(c_name) AS mapped_value FROM customer GROUP BY 1")
def j10_build_map(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.build_map(table(spark, sf, "customer"), "c_mktsegment", "c_name")


@query("SELECT o_orderkey, coalesce(CASE WHEN c_nationkey < 20 THEN n_name END, 'Unknown') AS nation FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def j11_apply_map(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    m = mapping.build_map(table(spark, sf, "nation").where("n_nationkey < 20"), "n_nationkey", "n_name")
    return mapping.apply_map(o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_nationkey"), m, "c_nationkey", "nation", "Unknown").select("o_orderkey", "nation")


# Unions


@query("SELECT c_custkey AS key, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL BY NAME SELECT s_suppkey AS key, s_name AS name FROM supplier")
def u1_concatenate(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return tables.concatenate(c, table(spark, sf, "supplier").select(F.col("s_name").alias("Name"), F.col("s_suppkey").alias("Key")))


@query("SELECT CASE o_orderstatus WHEN 'P' THEN 'apart' ELSE 'one' END AS name, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def u2_u3_registry(spark: SparkSession, sf: str) -> DataFrame:
    """Two loads under one name append; a third, kept apart, is another table."""
    o, job = table(spark, sf, "orders"), tables.Tables(spark)
    job.load("Orders", o.where("o_orderstatus = 'F'"))
    job.load("orders", o.where("o_orderstatus = 'O'"))
    job.load("OrdersP", o.where("o_orderstatus = 'P'"), noconcatenate=True)
    count = lambda key, name: job[key].groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "o_orderstatus", "n")
    out = count("Orders", "one").unionByName(count("OrdersP", "apart"))
    job.drop("Orders", "OrdersP")
    return out


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def u4_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return tables.load_distinct(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


# Aggregates


@query("""SELECT l_returnflag, year(l_shipdate)::INTEGER AS y, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS total, count(l_quantity) AS n, round(avg(l_discount), 6) AS mean, min(l_tax) AS low, max(l_tax) AS high,
  min(l_linestatus) AS only_status FROM lineitem GROUP BY ALL""")
def a0_a6_group(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("y")).agg(
        A.Sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("total"), A.Count(F.col("l_quantity")).alias("n"), F.round(A.Avg(F.col("l_discount")), 6).alias("mean"),
        A.Min(F.col("l_tax")).alias("low"), A.Max(F.col("l_tax")).alias("high"), A.Only(F.col("l_linestatus")).alias("only_status"),
    )


@query("""SELECT l_returnflag, round(median(l_extendedprice), 4) AS med, round(stddev_samp(l_quantity), 6) AS sd, round(quantile_cont(l_extendedprice, 0.9), 4) AS q90, count(DISTINCT l_partkey) AS parts,
  arg_min(l_orderkey, (l_extendedprice, l_orderkey)) AS cheapest FROM lineitem GROUP BY 1""")
def a7_a14_statistics(spark: SparkSession, sf: str) -> DataFrame:
    li, price = table(spark, sf, "lineitem"), F.col("l_extendedprice")
    own = li.groupBy("l_returnflag").agg(
        F.round(A.Stdev(F.col("l_quantity")), 6).alias("sd"), A.FieldValueCount(F.col("l_partkey")).alias("parts"), F.round(A.FirstSortedValue(F.col("l_orderkey"), price), 0).alias("cheapest")
    )
    places = A.fractiles(li, ["l_returnflag"], price, {"med": 0.5, "q90": 0.9})
    return own.join(places, "l_returnflag").withColumn("med", F.round("med", 4)).withColumn("q90", F.round("q90", 4))


@query("""SELECT n_regionkey, round(median(c_acctbal), 4) AS med, round(quantile_cont(c_acctbal, 0.25), 4) AS q25, count(DISTINCT c_mktsegment) AS segments FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def a7_a12_in_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The same as columns for groupBy().agg(), for groups that fit a task."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    balance = F.col("c_acctbal")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_regionkey").agg(F.round(A.Median(balance), 4).alias("med"), F.round(A.Fractile(balance, 0.25), 4).alias("q25"), A.FieldValueCount(F.col("c_mktsegment")).alias("segments"))


@query("SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS low, true AS median_close, true AS q90_close, true AS parts_close FROM lineitem GROUP BY 1")
def a7_a12_a14_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """States of each month's lines, merged; and whether what they say is as close to the exact ranks and counts as it should be."""
    li, by = table(spark, sf, "lineitem"), "l_returnflag"
    states = sketches.sketched(li.withColumn("month", F.trunc("l_shipdate", "month")), [by, "month"], F.col("l_extendedprice"), F.col("l_partkey"))
    said = sketches.read_off(sketches.merged(written(states), [by]), {"low": 0.0, "med": 0.5, "q90": 0.9}, "parts").withColumnRenamed("n", "said_n")
    below = lambda c: F.count_if(F.col("l_extendedprice") <= F.col(c)) / F.count(F.lit(1))
    exact = li.join(said, by).groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.max("low").alias("low"), below("med").alias("at_med"), below("q90").alias("at_q90"), F.count_distinct("l_partkey").alias("exact_parts"), F.max("parts").alias("parts"), F.max("said_n").alias("said_n")
    )
    close = lambda c, p: F.abs(F.col(c) - p) <= sketches.RANK_ERROR
    parts = F.abs(F.col("parts") - F.col("exact_parts")) <= F.greatest(sketches.DISTINCT_ERROR * F.col("exact_parts"), F.lit(1.0))
    return exact.where("n = said_n").select(by, "n", "low", close("at_med", 0.5).alias("median_close"), close("at_q90", 0.9).alias("q90_close"), parts.alias("parts_close"))


@query("SELECT c_nationkey, c_mktsegment AS mode_segment FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1")
def a9_mode(spark: SparkSession, sf: str) -> DataFrame:
    return A.modes(table(spark, sf, "customer"), ["c_nationkey"], F.col("c_mktsegment"), "mode_segment")


@query("SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS nations FROM nation GROUP BY 1")
def a10_concat(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(A.Concat("n_name", "; ").alias("nations"))


@query("SELECT o_orderstatus, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT o_orderstatus, o_custkey, count(*) AS n FROM orders GROUP BY ALL) GROUP BY 1")
def a13_aggr(spark: SparkSession, sf: str) -> DataFrame:
    return A.aggr(table(spark, sf, "orders"), ["o_orderstatus", "o_custkey"], {"n": F.count(F.lit(1))}, ["o_orderstatus"], {"most": F.max("n"), "mean": F.round(F.avg("n"), 6)})


# Order-dependent operators


@query("SELECT o_custkey, o_orderkey, lag(o_totalprice, 2) OVER w AS two_back, lag(o_orderkey) OVER w AS prev FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def w1_w2_peek(spark: SparkSession, sf: str) -> DataFrame:
    o, by = table(spark, sf, "orders"), (["o_orderdate", "o_orderkey"], ["o_custkey"])
    df = ordered.peek(o, F.col("o_totalprice"), "two_back", *by, back=2)
    return ordered.previous(df, F.col("o_orderkey"), "prev", *by).select("o_custkey", "o_orderkey", "two_back", "prev")


@query("SELECT o_orderkey, lag(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey) AS prev_customer FROM orders")
def w1_peek_global(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return ordered.peek(o, F.col("o_custkey"), "prev_customer", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "prev_customer")


@query("SELECT o_orderpriority AS value FROM (SELECT o_orderpriority, min(o_orderkey) AS f FROM orders GROUP BY 1) QUALIFY row_number() OVER (ORDER BY f) = 3")
def w3_field_value(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.field_value(table(spark, sf, "orders"), F.col("o_orderpriority"), 3, F.col("o_orderkey"))


@query("SELECT o_orderkey, dense_rank() OVER (ORDER BY f) AS no FROM (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS f FROM orders)")
def w4_autonumber(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.autonumber(table(spark, sf, "orders"), F.col("o_custkey"), "no", F.col("o_orderkey")).select("o_orderkey", "no")


@query("""WITH f AS (SELECT o_custkey, min(o_orderkey) FILTER (o_orderdate < '1997-01-01') AS a, min(o_orderkey) AS b FROM orders GROUP BY 1),
  n AS (SELECT o_custkey, row_number() OVER (ORDER BY a IS NULL, CASE WHEN a IS NULL THEN b ELSE a END) AS no FROM f) SELECT o_orderkey, no FROM orders JOIN n USING (o_custkey)""")
def w4_autonumber_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Customers numbered over two loads: the second keeps the numbers of the first."""
    o, path = table(spark, sf, "orders"), _scratch(spark)
    ordered.autonumber_stored(o.where("o_orderdate < '1997-01-01'"), F.col("o_custkey"), "no", F.col("o_orderkey"), path)
    return ordered.autonumber_stored(o, F.col("o_custkey"), "no", F.col("o_orderkey"), path).select("o_orderkey", "no")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rowno, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS in_customer FROM orders")
def w5_row_numbers(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    df = ordered.row_numbers(o, "rowno", ["o_orderdate", "o_orderkey"])
    return ordered.row_numbers(df, "in_customer", ["o_orderkey"], ["o_custkey"]).select("o_orderkey", "rowno", "in_customer")


@query("SELECT l_orderkey, l_linenumber, CAST(i AS INTEGER) AS iterno FROM lineitem, range(1, 51) r(i) WHERE i <= l_linenumber")
def w6_iterno(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.iterno(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), F.col("l_linenumber"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def t2_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.top_k(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), F.col("o_totalprice"), 25, ["o_orderkey"])


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 40")
def t3_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.first_rows(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), 40, ["o_orderdate", "o_orderkey"])
