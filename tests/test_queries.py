import __spark_entry__ as entry
import duckdb
import pytest
from pyspark.sql import functions as F

from fluentlake import catalogue
from fluentlake.export.render import DataFile, to_html, to_json, to_text, to_xml, zip_files
from fluentlake.functions import scalars as S
from fluentlake.operators.table import Table

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(frame, columns):
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_against_sql(spark, db, name):
    found = catalogue.queries()[name](spark, DATA).toPandas()
    if sql := catalogue.oracle_sql().get(name):
        wanted = db.execute(sql).df()
        columns = sorted(wanted.columns)
        assert sorted(found.columns) == columns
        assert rows(found, columns) == rows(wanted, columns)
    else:
        assert len(found)


def test_whole_tables(spark):
    data = "/root/testdata/sf0.01"
    found = catalogue.queries()
    keys = lambda t, c: sorted(r[0] for r in spark.read.parquet(f"{data}/{t}.parquet").select(c).collect())
    assert sorted((r["n"], r["o_orderkey"]) for r in found["number"](spark, data).collect()) == list(enumerate(keys("orders", "o_orderkey")))
    series = {}
    for r in sorted(spark.read.parquet(f"{data}/customer.parquet").collect(), key=lambda r: r["c_custkey"]):
        series.setdefault(r["c_mktsegment"], []).append(r["c_name"])
    assert {r["c_mktsegment"]: r["text"].split("+") for r in found["reduce_concat"](spark, data).collect()} == series
    merged = sorted([(k, 1, "n") for k in keys("nation", "n_nationkey")] + [(k, 0, "s") for k in keys("supplier", "s_suppkey")])
    assert sorted((r["n"], r["k"], r["src"]) for r in found["merge_sorted"](spark, data).collect()) == [(n, k, src) for n, (k, _, src) in enumerate(merged)]


@pytest.mark.parametrize("key", ["id", "7 * id % 1000", "if(id % 3 = 0, null, id % 5)", "cast(null as long)"])
@pytest.mark.parametrize("kind", ["up", "down", "reverse"])
def test_positions_need_no_single_task(spark, key, kind):
    """No task numbers all rows, even where all have the same key; positions are whole and follow the order."""
    listed = Table(spark.range(1000).selectExpr("id", f"{key} as k"), ("id",))
    listed = {"up": lambda: listed.sort(lambda r: r.k), "down": lambda: listed.sort(lambda r: r.k, reverse=True), "reverse": lambda: Table(listed.df, ("k",)).reverse()}[kind]()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = sorted(listed.number().df.select("n", "k", "id", F.spark_partition_id().alias("task")).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r["n"] for r in found] == list(range(1000)) and {r["id"] for r in found} == set(range(1000))
    first = lambda k, id: ((k is not None, k or 0), id)
    back = lambda k, id: ((k is None, -(k or 0)), id if kind == "down" else 0)
    keys = [(first if kind == "up" else back)(r["k"], r["id"]) for r in found]
    assert keys == sorted(keys)
    tasks = [r["task"] for r in found]
    assert len(set(tasks)) > 1 and max(map(tasks.count, set(tasks))) < 600


def test_positions_of_nothing_and_without_order(spark):
    assert Table(spark.range(0), ("id",)).number().df.collect() == []
    with pytest.raises(ValueError):
        Table(spark.range(3)).number()
    assert Table(spark.range(3), ("id",)).number("id").df.schema.simpleString() == "struct<id:bigint>"


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_plans_push_filters(spark):
    plan = catalogue.queries()["accept"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan and "l_tax" not in plan
    assert "collect_list" not in catalogue.queries()["flagship_group_size"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_float_text(spark):
    values = [(3.0, "3"), (1e6, "1e+06"), (100000.0, "100000"), (1234567.5, "1.2345675e+06"), (0.0001, "0.0001"), (0.00025, "0.00025"), (-1e-7, "-1e-07"), (1e300, "1e+300"), (1e21, "1e+21"), (0.00001, "1e-05"), (0.5, "0.5"), (-2.25, "-2.25"), (float("inf"), "+Inf"), (123456789.0, "1.23456789e+08"), (20.5, "20.5"), (0.0, "0")]
    df = spark.createDataFrame(values, "x double, want string").select(S.float_text(F.col("x")).alias("got"), "want")
    assert all(r["got"] == r["want"] for r in df.collect())


def test_exporters():
    value = [{"b": 1, "a": "x<y"}]
    assert to_json(value) == '[{"a":"x<y","b":"1"}]'
    assert to_xml(value) == '<list><entry><map a="x&lt;y" b="1"/></entry></list>'
    assert "more..." in to_html(list(range(5)), 3)
    assert to_text({"a": 1, "b": [2]}) == "a: 1\nb:\n    2\n"
    file = DataFile("t", "s", lambda x: x).add("y", "m", lambda x: x * x).csv("a.csv", [1, 2])
    assert file.data == b'"t[s]","y[m]"\n"1","1"\n"2","4"\n'
    assert zip_files("z.zip", [file]).mime == "application/zip"
