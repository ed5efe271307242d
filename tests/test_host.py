import dataclasses

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fluentlake.export.language import formatted_float, strftime_of, with_exports
from fluentlake.export.render import to_html
from fluentlake.lang.compiler import run_text
from fluentlake.sources.wrappers import Attributes, FunctionMap, SizedTable
from fluentlake.streaming.stateful import compact_step, fold_step, run_to_table, stream_scan, value_window_step


@dataclasses.dataclass
class Thing:
    a: int
    b: float
    c: str
    d: list


def test_wrappers(spark):
    things = [Thing(1, 2.5, "x", []), Thing(2, 0.5, "y", [])]
    t = Attributes.reflected(Thing).table(spark, things)
    assert t.df.columns == ["_pos", "a", "b", "c"] and [tuple(r) for r in run_text("t.map(x->x.a*x.b).sum()", {"t": t}).collect()] == [(3.5,)]
    own = Attributes().attr("double", lambda x: 2 * x.a, int)
    assert own.record(things[0]) == {"double": 2} and [r["double"] for r in own.table(spark, things).df.collect()] == [2, 4]
    with pytest.raises(ValueError, match="item 0, attribute n"):
        Attributes().attr("n", lambda x: x.nothing, int).table(spark, things)
    m = FunctionMap({"a": 1, "b": 2}.__getitem__, "a", "b", "c")
    assert run_text("m.a+m.b", {"m": m}) == 3 and run_text("m.size()", {"m": m}) == 2
    assert SizedTable(spark.range(5), ("id",), 5).size().first()[0] == 5


def test_exports_in_the_language():
    host = with_exports()
    f = host.run('dataFile("t","s",x->x.t).add("y","m",x->x.v*2).addIf(false,"z","",x->x.v).dat("a.dat",rows)', rows=[{"t": 1, "v": 2}, {"t": 2, "v": 3}])
    assert f.data == b"#t[s]\ty[m]\n1\t4\n2\t6\n"
    f = host.run('[dataFile("t","",x->x).timeIsDate().dateFormat("02.01.2006").timeFormat("15:04").add("y","",x->x).csv("a.csv",[0])].zip("z.zip")')
    assert f.name == "z.zip" and f.mime == "application/zip"
    assert to_html(host.run('style({color:"red"},5)')) == '<span style="color:red">5</span>'
    assert to_html(host.run('[[styleCell("x",1),colspan(2,3)]]')) == '<table><tr><td style="x">1</td><td colspan="2">3</td></tr></table>'
    assert to_html([1, "a"], custom=lambda v: "<b>1</b>" if v == 1 else None).count("<b>1</b>") == 1
    assert strftime_of("2006-01-02 15:04:05") == "%Y-%m-%d %H:%M:%S"
    assert [formatted_float(2e-6, 6, k) for k in ("unicode", "ascii", "latex")] == ["2⋅10⁻⁶", "2*10^-6", r"2\cdot 10^{-6}"] and formatted_float(1.5) == "1.5"


def test_streams_keep_their_state(spark, tmp_path):
    """Three micro-batches give what one table gives."""
    rows = [(k % 2, k, float(k // 3)) for k in range(30)]
    for k in range(3):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], "u long, t long, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("u long, t long, v double").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    found = run_to_table(stream_scan(read(), ["u"], ["t"], ["v"], ["u", "t"], StructType().add("s", "double"), fold_step(0.0, lambda a, x: a + x))).collect()
    assert {(r["u"], r["t"]): r["s"] for r in found} == {(u, t): sum(v for a, b, v in rows if a == u and b <= t) for u, t, _ in rows}
    found = run_to_table(stream_scan(read(), ["u"], ["t"], ["v"], ["u", "t"], StructType().add("stays", "boolean"), compact_step())).where("stays").collect()
    assert {(r["u"], r["t"]) for r in found} == {(u, t) for u, t, v in rows if v not in [x for a, b, x in rows if a == u and b == t - 2]}
    found = run_to_table(stream_scan(read(), ["u"], ["t"], ["v", "v"], ["u", "t"], StructType().add("n", "long").add("s", "double"), value_window_step())).collect()
    assert {(r["u"], r["t"]): r["n"] for r in found} == {(u, t): sum(1 for a, b, x in rows if a == u and b <= t and abs(x - v) <= 1) for u, t, v in rows}


def test_plans_without_nested_loops_or_global_sorts(spark):
    from fluentlake import catalogue

    plan = lambda name: catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan("interpolation") and "Window" not in plan("min_max")
    assert "LeftSemi" in plan("language_joins") and F.col("x") is not None
