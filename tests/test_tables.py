import datetime
import random

import pytest
from pyspark.sql import functions as F

from loadflow.operators import aggregates, inventory, lineage, mapping, ordered, tables
from loadflow.sources import landing, readers, sinks


def rows(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_keys_ignore_case_and_keep_left_order(spark):
    left = spark.createDataFrame([(1, 2, 3)], "B int, a int, c int")
    right = spark.createDataFrame([(2, 1)], "A int, b int")
    assert tables.shared_columns(left, right) == ["B", "a"]
    assert tables.natural_join(left, right).columns == ["B", "a", "c"]


def test_joins_with_null_keys_and_repeats(spark):
    left = spark.createDataFrame([(1, "x"), (None, "n"), (2, "y"), (2, "y")], "k int, l string")
    right = spark.createDataFrame([(2, "r"), (None, "m"), (3, "s")], "K int, r string")
    assert rows(tables.natural_join(left, right)) == [(2, "y", "r"), (2, "y", "r")]
    assert len(rows(tables.natural_join(left, right, "left"))) == 4
    assert len(rows(tables.natural_join(left, right, "full"))) == 6
    with pytest.raises(ValueError):
        tables.natural_join(left, spark.range(2))
    with pytest.raises(ValueError):
        tables.natural_join(left, right, "outer join")


def test_keep_reduces_and_does_not_merge(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, l string")
    right = spark.createDataFrame([(2, "r"), (3, "s")], "K int, r string")
    a, b = tables.keep(left, right, "left")
    assert (rows(a), rows(b), b.columns) == ([(1, "x"), (2, "y")], [(2, "r")], ["K", "r"])
    a, b = tables.keep(left, right, "right")
    assert (rows(a), rows(b)) == ([(2, "y")], [(2, "r"), (3, "s")])
    a, b = tables.keep(left, right, merge=True)
    assert rows(a) == [(2, "y", "r")]


def test_concatenate_fills_and_counts(spark):
    a = spark.createDataFrame([(1, "x")], "k int, name string")
    b = spark.createDataFrame([("y", 5)], "NAME string, extra int")
    assert rows(tables.concatenate(a, b)) == [(1, "x", None), (None, "y", 5)]


def test_registry(spark):
    job = tables.Tables(spark)
    job.load("A", spark.createDataFrame([(1, "x")], "k int, v string"))
    job.load("a", spark.createDataFrame([("y", 2)], "v string, k int"))
    assert job["A"].count() == 2
    with pytest.raises(ValueError):
        job.load("A", spark.range(1))
    job.load("B", spark.createDataFrame([(1, "z")], "k int, w string"))
    job.join(job["A"], "left")
    assert rows(job["B"]) == [(1, "z", "x")]
    job.join(spark.createDataFrame([(2, 9)], "k int, q int"), "inner", into="A")
    assert rows(job["A"]) == [(2, "y", 9)]
    job.rename_table("B", "C")
    assert job.names == ["A", "C"] and spark.table("C").count() == 1
    job.drop("C")
    with pytest.raises(KeyError):
        job["C"]


def test_lookup_first_match_default_and_rows(spark):
    m = mapping.build_map(spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, None, 1), (None, "z", 1)], "k int, v string, o int"), "k", "v", "o")
    assert rows(m) == [(1, "b"), (2, None)]
    df = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "k int")
    assert rows(mapping.apply_map(df, m, "k", "out", "none")) == [(1, "b"), (1, "b"), (2, "none"), (3, "none"), (None, "none")]
    assert rows(mapping.apply_map(df, m, "k", "out")) == [(1, "b"), (1, "b"), (2, None), (3, None), (None, None)]


def test_branch():
    assert tables.choose(1, {1: lambda: "one"}) == "one"
    assert tables.choose(2, {1: lambda: "one"}, lambda: "else") == "else"
    with pytest.raises(ValueError):
        tables.choose(2, {})


def test_rename_unknown(spark):
    with pytest.raises(ValueError):
        tables.rename(spark.range(1), {"nope": "x"})


def test_aggregates_on_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, "q"), ("a", 1, "p"), ("a", None, "r"), ("b", 3, "z")], "g string, k int, v string")
    out = df.groupBy("g").agg(aggregates.FirstSortedValue(F.col("v"), F.col("k")), aggregates.Mode(F.col("v")), aggregates.Concat("v", "|"), aggregates.Only(F.col("k"), strict=True), aggregates.Only(F.col("v"), strict=True))
    assert rows(out) == [("a", "p", "p", "p|q|r", 1, None), ("b", "z", "z", "z", 3, "z")]


def test_row_numbers_are_gapless_over_many_ranges(spark):
    df = spark.range(0, 5000, 1, 7).withColumn("v", F.xxhash64("id"))
    got = ordered.row_numbers(df, "n", ["v", "id"]).orderBy("n").select("n", "v").collect()
    assert [r["n"] for r in got] == list(range(1, 5001))
    assert [r["v"] for r in got] == sorted(r["v"] for r in got)
    assert ordered.row_numbers(spark.range(0), "n", ["id"]).count() == 0


def test_peek_autonumber_field_value_iterno(spark):
    df = spark.createDataFrame([(3, "b"), (1, "a"), (2, "b"), (4, None)], "o int, v string")
    assert rows(ordered.previous(df, F.col("v"), "p", ["o"])) == [(1, "a", None), (2, "b", "a"), (3, "b", "b"), (4, None, "b")]
    assert rows(ordered.autonumber(df, F.col("v"), "n", F.col("o"))) == [(1, "a", 1), (2, "b", 2), (3, "b", 2), (4, None, None)]
    assert rows(ordered.field_value(df, F.col("v"), 2, F.col("o"))) == [("b",)]
    assert rows(ordered.field_value(df, F.col("v"), 5, F.col("o"))) == []
    assert rows(ordered.iterno(spark.createDataFrame([(2,), (0,), (None,)], "t int"), F.col("t"))) == [(2, 1), (2, 2)]


def test_landing(spark):
    assert [landing.type_for(c) for c in ("OrderDate", "load_ts", "Sales Rep", "CustomerID", "is_open", "note", "updated")] == ["date", "timestamp_ntz", "decimal(38,4)", "string", "boolean", "string", "date"]
    raw = spark.createDataFrame([("1", "2024-02-30"), (None, "2024-02-29")], "amount string, order_date string")
    assert landing.land(raw, {"amount": "int"}).collect()[1]["order_date"] == datetime.date(2024, 2, 29)
    assert rows(landing.failed_casts(raw)) == [("amount", "decimal(38,4)", 0), ("order_date", "date", 1)]


def test_incremental(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    assert rows(landing.append_new(old, spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), ["k"])) == [(1, "a"), (2, "c")]


def test_sinks_round_trip(spark, tmp_path):
    df = spark.range(5).withColumnRenamed("id", "n")
    sinks.store(df, f"{tmp_path}/t")
    sinks.store(df, f"{tmp_path}/t")
    assert readers.load_parquet(spark, f"{tmp_path}/t").count() == 5
    sinks.rebuild(df, "sink_test")
    sinks.save(df, "sink_test", overwrite=False)
    assert spark.table("sink_test").count() == 10
    sinks.save(df, "sink_test")  # a rerun puts its rows in place of those
    assert spark.table("sink_test").count() == 5
    sinks.materialise(df, "stage_view", "staging")
    sinks.materialise(df, "sales_fact_t", "mart")
    assert spark.table("stage_view").count() == spark.table("sales_fact_t").count() == 5
    assert [sinks.layer_of(*x) for x in (("Sales_Fact", "qvd"), ("SalesFact", "resident"), ("x", "file"), ("x", "resident"))] == ["mart", "mart", "staging", "intermediate"]


def test_each_file_and_text(spark, tmp_path):
    for i in range(2):
        spark.range(i, i + 1).write.parquet(f"{tmp_path}/{i}")
    df = readers.load_each(spark, [f"{tmp_path}/0", f"{tmp_path}/1"], "file")
    assert df.select("file").distinct().count() == 2
    (tmp_path / "t.csv").write_text("k,v\n1,é\n", encoding="utf-8")
    assert rows(readers.load_text(spark, f"{tmp_path}/t.csv", "k int, v string")) == [(1, "é")]
    assert rows(readers.autogenerate(spark, 2)) == [(1,), (2,)]


def test_database_in_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    df = spark.range(100).select("id", (F.col("id") * 2).alias("twice"))
    df.write.format("jdbc").option("url", url).option("dbtable", "numbers").save()
    whole = readers.load_jdbc(spark, url, "numbers")
    parts = readers.load_jdbc(spark, url, "(select * from numbers where \"id\" >= 10) t", column="id", low=10, high=100, parts=3, fetchsize="10")
    assert whole.count() == 100 and parts.rdd.getNumPartitions() == 3
    assert rows(parts) == rows(df.where("id >= 10"))


def test_referenced_columns(spark):
    cases = {"Num(UnitPrice) * Num(Quantity)": ["UnitPrice", "Quantity"], "if([A b] = 'x, y', \"C d\", null())": ["A b", "C d"], "'only text'": [], "a & A & a": ["a", "A"], None: [], "Größe * Num (a$1) + [Sales f(x)]": ["Größe", "a$1", "Sales f(x)"], "if(x=1,'Y','N')": ["x"]}
    df = spark.createDataFrame([(k,) for k in cases], "e string")
    assert {r[0]: r[1] for r in df.select("e", lineage.referenced_columns(F.col("e"))).collect()} == cases


def test_lineage_of_the_sales_sample(spark):
    deps = spark.createDataFrame(
        [
            ("s", "sales_fact", "TotalRevenue", "SalesEnriched", "GrossAmount", False), ("s", "sales_fact", "TherapeuticArea", "SalesEnriched", "TherapeuticArea", False),
            ("s", "SalesEnriched", "GrossAmount", "SalesRaw", "GrossAmount", False), ("s", "SalesEnriched", "TherapeuticArea", "Products", "TherapeuticArea", False),
            ("s", "SalesRaw", "GrossAmount", "sales_2026", "UnitPrice", True), ("s", "SalesRaw", "GrossAmount", "sales_2026", "Quantity", True),
            ("s", "Products", "TherapeuticArea", "products", "Therapeutic Area", True), ("s", "loop", "a", "loop", "b", False), ("s", "loop", "b", "LOOP", "A", False),
        ],
        "script string, tbl string, col string, upstream string, up_col string, external boolean",
    )
    found = {(r["tbl"], r["col"], r["source"], r["source_col"]) for r in lineage.ultimate_sources(deps).collect()}
    assert {x[2:] for x in found if x[:2] == ("sales_fact", "TotalRevenue")} == {("sales_2026", "UnitPrice"), ("sales_2026", "Quantity")}
    assert {x[2:] for x in found if x[:2] == ("sales_fact", "TherapeuticArea")} == {("products", "Therapeutic Area")}
    assert not [x for x in found if x[0] == "loop"]


DEPS = "script string, tbl string, col string, upstream string, up_col string, external boolean"


def test_lineage_of_long_chains_cycles_and_dotted_names(spark):
    chain = [("s", f"t{i}", "c", f"T{i - 1}", "C", False) for i in range(1, 300)] + [("s", "t0", "c", "ext", "x", True)]
    dotted = [("s", "out", "x", "a", "b.c", False), ("s", "a", "b.c", "ext1", "p", True), ("s", "a.b", "c", "ext2", "q", True)]
    ring = [("s", f"r{i}", "c", f"r{(i + 1) % 7}", "c", False) for i in range(7)] + [("s", "r3", "c", "ext", "ring", True), ("s", "r5", "c", "nowhere", "z", False), ("s", "u", "c", "ext", "n", None)]
    found = rows(lineage.ultimate_sources(spark.createDataFrame(chain + dotted + ring, DEPS)))
    want = [("s", f"t{i}", "c", "ext", "x") for i in range(300)] + [("s", "out", "x", "ext1", "p"), ("s", "a", "b.c", "ext1", "p"), ("s", "a.b", "c", "ext2", "q")] + [("s", f"r{i}", "c", "ext", "ring") for i in range(7)]
    assert found == sorted(want, key=str)
    starts = spark.createDataFrame([("s", "T299", "c")], "script string, tbl string, col string")
    assert rows(lineage.ultimate_sources(spark.createDataFrame(chain, DEPS), starts)) == [("s", "T299", "c", "ext", "x")]
    assert lineage.ultimate_sources(spark.createDataFrame([], DEPS)).count() == 0


def test_lineage_writes_no_more_than_its_result(spark, monkeypatch):
    """24 layers whose columns depend on four columns each: the tables on the way stay in proportion to the result."""
    rnd, sizes, write = random.Random(1), [], lineage.written
    deps = [("s", f"l{n}", f"c{i}", f"l{n - 1}" if n else "ext", f"c{j}" if n else f"e{i % 4}", n == 0) for n in range(24) for i in range(40) for j in rnd.sample(range(40), 4 if n else 1)]
    reach = {}
    for _, tbl, col, up, up_col, external in deps:
        reach.setdefault((tbl, col), set()).update({(up, up_col)} if external else reach[up, up_col])

    def seen(df):
        out = write(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(lineage, "written", seen)
    found = rows(lineage.ultimate_sources(spark.createDataFrame(deps, DEPS)))
    assert found == sorted([("s", *k, *x) for k, v in reach.items() for x in v], key=str)
    assert sum(sizes) < 4 * (len(deps) + len(found))


def test_lookups_and_columns_handed_on(spark):
    cols = spark.createDataFrame([("s", "t", "a", "ApplyMap('CountryMap', Code, 'x') & apply_map( \"Other\", k)"), ("s", "t", "b", "Code"), ("s", "t", "c", "ApplyMap('None', Code)"), ("z", "t", "a", "ApplyMap('CountryMap', Code)"), ("s", "t", "n", None)], "script string, tbl string, col string, expr string")
    maps = spark.createDataFrame([("s", "countrymap"), ("s", "Other")], "script string, map string")
    assert rows(lineage.lookup_providers(cols, maps)) == [("s", "t", "a", "Other", "mapped_value", False), ("s", "t", "a", "countrymap", "mapped_value", False)]
    deps = spark.createDataFrame([("s", "mart", "x", "mid", "x", False), ("s", "mart", "y", "loop1", "y", False), ("s", "mart", "z", "gone", "z", False)], DEPS)
    tables_of = spark.createDataFrame([("s", "mart", "mid", False), ("s", "Mid", "stage", False), ("s", "stage", "file", True), ("s", "loop1", "loop2", False), ("s", "loop2", "loop1", False)], "script string, tbl string, source string, source_external boolean")
    none = spark.createDataFrame([], "script string, base_tbl string, right_tbl string, pos int")
    every = lineage.with_passed_through(deps, none, deps.select("script", "tbl", "col"), tables_of)
    assert rows(lineage.ultimate_sources(every, deps)) == [("s", "mart", "x", "file", "x")]


def test_quantiles_and_modes_of_any_group(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (5, 1, 1, 9, 4, 4, 4)] + [("b", 2.0), ("c", None), (None, 3.0), (None, 5.0), ("a", None)], "g string, x double")
    assert rows(aggregates.fractiles(df, ["g"], F.col("x"), {"m": 0.5, "q": 0.9, "low": 0.0, "high": 1.0})) == rows(df.groupBy("g").agg(*[F.percentile("x", F.lit(p)).alias(n) for n, p in (("m", 0.5), ("q", 0.9), ("low", 0.0), ("high", 1.0))]))
    assert rows(aggregates.modes(df, ["g"], F.col("x"), "m")) == [("a", 4.0), ("b", 2.0), ("c", None), (None, 3.0)]


def test_nested_recorders_keep_recording(spark):
    from loadflow.sources.shared import recorded, release, written

    with recorded() as outer:
        with recorded() as inner:
            pass
        written(spark.range(1))
    assert len(outer) == 1 and inner == []
    release(spark, outer)


def test_mapping_types(spark):
    df = spark.createDataFrame([("ApplyMap('M', k)", 1, False, False, False), ("1", 0, False, False, False), ("Sum(x)", 1, True, False, False), ("x", 1, False, True, True), ("x", 1, False, True, False), ("Median(x)", 1, True, False, False)], "e string, n int, g boolean, p boolean, j boolean")
    args = [F.col(c) for c in "engpj"]
    assert [r[0] for r in df.select(lineage.mapping_type(args[0], args[1], args[2], args[3], args[4])).collect()] == ["lookup", "constant", "aggregate", "join", "direct", "derived"]
    assert df.select(lineage.mapping_type(*args, aggregates=lineage.ALL_AGGREGATES)).collect()[-1][0] == "aggregate"


def test_retrieve_falls_back_to_first_rows(spark):
    df = spark.createDataFrame([(3, "abc the"), (1, None), (2, "The the")], "id int, t string")
    assert [tuple(r) for r in inventory.retrieve(df, "t", "the", 2, "id").select("id", "score").collect()] == [(2, 2), (3, 1)]
    assert [r["id"] for r in inventory.retrieve(df, "t", "nothing a", 2, "id").collect()] == [1, 2]


def test_coverage_of_nothing(spark):
    df = spark.createDataFrame([("s", "t", None, None)], "script string, tbl string, col string, n_warnings int")
    assert inventory.coverage(df).collect()[0]["auto_pct"] == 100.0
