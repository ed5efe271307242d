"""Registered queries of the library's own operators, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fluentlake.functions import scalars as S
from fluentlake.lang.compiler import run_text
from fluentlake.operators import sequential as Q
from fluentlake.operators.table import Table, collect_binning, interpolate
from fluentlake.streaming.events import count_by_type, read_stream
from fluentlake.streaming.stateful import compact_step, fold_step, machine_step, run_to_table, stream_scan

_found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.rstrip("_")
        _found[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_found)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


ORDER = {"orders": ("o_orderkey",), "events": ("user_id", "ts"), "part": ("p_partkey",), "customer": ("c_custkey",), "nation": ("n_nationkey",), "region": ("r_regionkey",), "supplier": ("s_suppkey",), "documents": ("doc_id",), "conversations": ("conv_id", "turn"), "embeddings": ("vec_id",), "pages": ("page_id",), "lineitem": ()}


def table(spark: SparkSession, d: str, name: str, by: tuple[str, ...] = ()) -> Table:
    order = tuple(c for c in ORDER.get(name, ()) if c not in by)
    return Table(spark.read.parquet(f"{d}/{name}.parquet"), order, by)


def orders(s, d, by=()):
    return table(s, d, "orders", by)


def per_user(s, d):
    return table(s, d, "events", ("user_id",))


# --- filter, projection, elements ----------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_quantity, l_discount from lineitem where l_quantity > 45 and l_discount >= 0.05")
def accept(s, d):
    return table(s, d, "lineitem").accept(lambda r: (r.l_quantity > 45) & (r.l_discount >= 0.05)).df.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")


@query("select l_orderkey, l_extendedprice * (1 - l_discount) as revenue from lineitem")
def map_arith(s, d):
    return table(s, d, "lineitem").map(lambda r: {"l_orderkey": r.l_orderkey, "revenue": r.l_extendedprice * (1 - r.l_discount)}).df


@query("select p_partkey, case when p_size <> 11 then p_size / (p_size - 11)::double when p_size > 0 then 'inf'::double end as q from part")
def division_float(s, d):
    return table(s, d, "part").map(lambda r: {"p_partkey": r.p_partkey, "q": S.divide(r.p_size, r.p_size - 11)}).df


@query("select o_orderkey, row_number() over (order by o_orderkey) - 1 as n from orders")
def number(s, d):
    return orders(s, d).number().df.select("o_orderkey", "n")


@query("select o_orderkey, o_totalprice from orders order by o_orderkey limit 1")
def first(s, d):
    return orders(s, d).first().select("o_orderkey", "o_totalprice")


@query("select o_orderkey, o_totalprice from orders order by o_orderkey desc limit 1")
def last(s, d):
    return orders(s, d).last().select("o_orderkey", "o_totalprice")


@query("select n_name from nation where n_nationkey = 7")
def single(s, d):
    return table(s, d, "nation").accept(lambda r: r.n_nationkey == 7).single().select("n_name")


@query("select user_id, bool_or(event_type = 'error') as present from events group by user_id")
def present(s, d):
    return per_user(s, d).present(lambda r: r.event_type == "error")


@query("select user_id, coalesce(min(case when event_type = 'purchase' then n end), -1) as index from (select *, row_number() over (partition by user_id order by ts) - 1 n from events) group by user_id")
def index_where(s, d):
    return per_user(s, d).index_where(lambda r: r.event_type == "purchase")


@query("select n_nationkey, case when n_nationkey = 3 then 'X' else n_name end as n_name from nation")
def set_item(s, d):
    return table(s, d, "nation").set(3, n_name=F.lit("X")).df.select("n_nationkey", "n_name")


@query("select p_partkey from part where p_size in (1, 7, 9)")
def contains_item(s, d):
    return table(s, d, "part").accept(lambda r: r.p_size.isin(1, 7, 9)).df.select("p_partkey")


@query("select o_custkey from orders group by o_custkey having sum((o_orderstatus = 'F')::int) >= 2 and sum((o_orderstatus = 'O')::int) >= 1")
def contains_all(s, d):
    """[F, F, O] ~ statuses: containment counts repeats."""
    groups = orders(s, d).group(lambda r: r.o_custkey, f=lambda r: F.count_if(r.o_orderstatus == "F"), o=lambda r: F.count_if(r.o_orderstatus == "O"))
    return groups.accept(lambda r: (r.f >= 2) & (r.o >= 1)).df.select(F.col("key").alias("o_custkey"))


# --- groups and aggregates --------------------------------------------------------------------------------------------


@query("select o_orderpriority as key, count(*) as n, row_number() over (order by count(*) desc, o_orderpriority) - 1 as pos from orders group by 1")
def flagship_group_size(s, d):
    return run_text(
        "orders.groupByString(o->o.o_orderpriority).orderRev(g->g.values.size()).map(g->{key:g.key, n:g.values.size()})",
        {"orders": orders(s, d)},
    ).number("pos").df.select("key", "n", "pos")


@query("select c_mktsegment as key, count(*) as size, string_agg(c_custkey::varchar, ',' order by c_custkey) as ids from customer group by 1")
def group_values(s, d):
    g = table(s, d, "customer").group_values(lambda r: r.c_mktsegment, "c_custkey").df
    return g.select("key", F.size("values").cast("bigint").alias("size"), F.array_join(F.transform("values", lambda x: x["c_custkey"].cast("string")), ",").alias("ids"))


@query("select floor(o_totalprice / 10000)::bigint as key, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def group_int(s, d):
    return orders(s, d).group(lambda r: F.floor(r.o_totalprice / 10000), n=lambda r: F.count("*"), total=lambda r: F.round(F.sum(r.o_totalprice), 2)).df


@query("select o_orderstatus as key, count(*) as n, row_number() over (order by min(o_orderkey)) - 1 as pos from orders group by 1")
def group_equal(s, d):
    return orders(s, d).group(lambda r: r.o_orderstatus, first_seen=True, n=lambda r: F.count("*")).number("pos").df.select("key", "n", "pos")


@query("select distinct p_brand as key from part")
def unique_string(s, d):
    return table(s, d, "part").unique(lambda r: r.p_brand).df


@query("select distinct p_size::bigint as key from part")
def unique_int(s, d):
    return table(s, d, "part").unique(lambda r: r.p_size.cast("bigint")).df


@query("select round(sum(o_totalprice), 2) as total, round(avg(o_totalprice), 4) as mean, min(o_totalprice) as low, max(o_totalprice) as high, count(*) as n from orders")
def sum_mean_min_max(s, d):
    r = F.col("o_totalprice")
    return orders(s, d).aggregate(total=F.round(F.sum(r), 2), mean=F.round(F.avg(r), 4), low=F.min(r), high=F.max(r), n=F.count("*"))


@query('select o_orderpriority, min(v) as min, max(v) as max, arg_min(o_orderkey, (v, o_orderkey)) as "minItem", arg_max(o_orderkey, (v, -o_orderkey)) as "maxItem", true as valid from (select *, floor(o_totalprice / 1000) v from orders) group by 1')
def min_max(s, d):
    return orders(s, d, ("o_orderpriority",)).min_max(lambda r: F.floor(r.o_totalprice / 1000).cast("double"), lambda r: r.o_orderkey)


@query("select c_mktsegment, string_agg(c_name, '+' order by c_custkey) as text from customer group by 1")
def reduce_concat(s, d):
    return table(s, d, "customer", ("c_mktsegment",)).reduce_text(lambda r: r.c_name, "+")


@query("select user_id, sum(floor(value))::bigint + 100 as result from events group by 1")
def map_reduce(s, d):
    return per_user(s, d).fold(F.lit(100).cast("bigint"), lambda a, v: a + v, lambda r: F.floor(r.value))


@query("with recursive e as (select user_id, floor(value)::bigint v, row_number() over (partition by user_id order by ts) n from events), f as (select user_id, n, v % 1000 as acc from e where n = 1 union all select e.user_id, e.n, (f.acc * 3 + e.v) % 1000 from e join f on e.user_id = f.user_id and e.n = f.n + 1) select user_id, arg_max(acc, n) as result from f group by 1")
def visit(s, d):
    return per_user(s, d).fold(F.lit(0).cast("bigint"), lambda a, v: (a * 3 + v) % 1000, lambda r: F.floor(r.value))


@query("select c_nationkey, regr_slope(c_acctbal, c_custkey) as a, regr_intercept(c_acctbal, c_custkey) as b from (select c_nationkey % 3 c_nationkey, round(c_custkey / 7)::double c_custkey, 2.0 * round(c_custkey / 7) + 1 as c_acctbal from customer) group by 1")
def linear_reg(s, d):
    t = table(s, d, "customer").map(lambda r: {"c_nationkey": r.c_nationkey % 3, "x": F.round(r.c_custkey / 7)})
    found = Table(t.df, (), ("c_nationkey",)).linear_regression(lambda r: r.x, lambda r: 2.0 * r.x + 1)
    return found


@query("select count(*) as n, count_if(value > 100)::bigint as large, max(value) as top, count(distinct event_type) as kinds from events")
def multi_use(s, d):
    return table(s, d, "events").multi_use(n=lambda r: F.count("*"), large=lambda r: F.count_if(r.value > 100), top=lambda r: F.max(r.value), kinds=lambda r: F.count_distinct(r.event_type))


# --- order, limit ------------------------------------------------------------------------------------------------------


@query("select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) - 1 as n from orders")
def order(s, d):
    return orders(s, d).sort(lambda r: r.o_totalprice).number().df.select("o_orderkey", "n")


@query("select o_orderkey, row_number() over (order by o_totalprice desc, o_orderkey) - 1 as n from orders")
def order_rev(s, d):
    return orders(s, d).sort(lambda r: r.o_totalprice, reverse=True).number().df.select("o_orderkey", "n")


@query("select n_nationkey, row_number() over (order by n_regionkey, n_nationkey) - 1 as n from nation")
def order_less(s, d):
    """orderLess((a, b) -> a.n_regionkey < b.n_regionkey)"""
    return table(s, d, "nation").sort(lambda r: r.n_regionkey).number().df.select("n_nationkey", "n")


@query("select n_nationkey, row_number() over (order by n_nationkey desc) - 1 as n from nation")
def reverse(s, d):
    return table(s, d, "nation").reverse().number().df.select("n_nationkey", "n")


@query("select o_orderkey from orders order by o_orderkey limit 10")
def top(s, d):
    return orders(s, d).top(10).df.select("o_orderkey")


@query("select n_nationkey from nation order by n_nationkey offset 20")
def skip(s, d):
    return table(s, d, "nation").skip(20).df.select("n_nationkey")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def topk(s, d):
    return orders(s, d).sort(lambda r: r.o_totalprice, reverse=True).top(10).df.select("o_orderkey", "o_totalprice")


# --- joins and sets ----------------------------------------------------------------------------------------------------


@query("select n_name, r_name from nation, region where n_regionkey = r_regionkey and n_nationkey > r_regionkey")
def cross_theta(s, d):
    return table(s, d, "nation").cross(table(s, d, "region"), lambda a, b: {"n_name": a.n_name, "r_name": b.r_name}, lambda a, b: (a.n_regionkey == b.r_regionkey) & (a.n_nationkey > b.r_regionkey))


@query("select c_custkey, count(o_orderkey) as n, coalesce(round(sum(o_totalprice), 2), 0) as total from customer left join orders on o_custkey = c_custkey group by 1")
def join_lookup(s, d):
    return table(s, d, "customer").lookup(orders(s, d), lambda a, b: a.c_custkey == b.o_custkey, ("c_custkey",), n=lambda r: F.count(r._hit), total=lambda r: F.coalesce(F.round(F.sum(r.o_totalprice), 2), F.lit(0.0)))


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def semi_join(s, d):
    return table(s, d, "customer").accept_present(orders(s, d).accept(lambda r: r.o_totalprice > 400000), lambda a, b: a.c_custkey == b.o_custkey).df.select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def anti_join(s, d):
    return table(s, d, "customer").accept_present(orders(s, d).accept(lambda r: r.o_totalprice > 400000), lambda a, b: a.c_custkey == b.o_custkey, negate=True).df.select("c_custkey")


@query("select k, src, row_number() over (order by k, src desc) - 1 as n from (select n_nationkey::bigint k, 'n' src from nation union all select s_suppkey, 's' from supplier) t")
def merge_sorted(s, d):
    a = table(s, d, "nation").map(lambda r: {"k": r.n_nationkey.cast("bigint"), "src": F.lit("n")}, ("k",))
    b = table(s, d, "supplier").map(lambda r: {"k": r.s_suppkey, "src": F.lit("s")}, ("k",))
    return a.merge(Table(b.df, ("k",)), "k").number().df.select("k", "src", "n")


@query("select n_name as name from nation union all select r_name from region")
def union_all(s, d):
    return Table(s.read.parquet(f"{d}/nation.parquet").select(F.col("n_name").alias("name")), ("name",)).append_list(Table(s.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("name")), ("name",))).df.select("name")


@query("select doc_id from documents where doc_id in (select doc_id from labels)")
def intersect_idiom(s, d):
    return table(s, d, "documents").accept_present(table(s, d, "labels"), lambda a, b: a.doc_id == b.doc_id).df.select("doc_id")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def except_idiom(s, d):
    return table(s, d, "documents").accept_present(table(s, d, "labels"), lambda a, b: a.doc_id == b.doc_id, negate=True).df.select("doc_id")


# --- neighbours and recursion --------------------------------------------------------------------------------------------


@query("select user_id, ts, delta from (select user_id, ts, lead(value) over w - value as delta, lead(1) over w as f from events window w as (partition by user_id order by ts)) where f is not null")
def combine(s, d):
    return per_user(s, d).combine(2, lambda at: {"delta": at("value", 1) - at("value")}).df


@query("select user_id, ts, total from (select user_id, ts, value + lead(value) over w + lead(value, 2) over w as total, lead(1, 2) over w as f from events window w as (partition by user_id order by ts)) where f is not null")
def combine3(s, d):
    return per_user(s, d).combine(3, lambda at: {"total": at("value") + at("value", 1) + at("value", 2)}).df


@query("select user_id, ts, high from (select user_id, ts, greatest(value, lead(value) over w, lead(value, 2) over w, lead(value, 3) over w) as high, lead(1, 3) over w as f from events window w as (partition by user_id order by ts)) where f is not null")
def combine_n(s, d):
    return per_user(s, d).combine(4, lambda at: {"high": F.greatest(*[at("value", k) for k in range(4)])}).df


@query("select event_id, sum(floor(value)) over (partition by user_id order by ts rows unbounded preceding)::bigint as total from events")
def iir_prefix_sum(s, d):
    return per_user(s, d).scan("+", lambda r: F.floor(r.value), "total").df.select("event_id", "total")


@query("select event_id, max(value) over (partition by user_id order by ts rows unbounded preceding) as high from events")
def iir_max(s, d):
    return per_user(s, d).scan("max", lambda r: r.value, "high").df.select("event_id", "high")


@query("with recursive e as (select event_id, user_id, value, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id order by ts) n from events), f as (select event_id, user_id, n, t, value as y from e where n = 1 union all select e.event_id, e.user_id, e.n, e.t, f.y * exp(-(e.t - f.t) / 3600) + e.value * (1 - exp(-(e.t - f.t) / 3600)) from e join f on e.user_id = f.user_id and e.n = f.n + 1) select event_id, round(y, 6) as y from f")
def iir_lowpass(s, d):
    df = s.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", "value", F.expr("cast(ts as timestamp) - timestamp'1970-01-01'").alias("i"))
    df = df.select("user_id", "event_id", "value", (F.unix_micros(F.expr("timestamp_micros(0)") + F.col("i")) / 1e6).alias("t"))

    found = Q.ordered_scan(df, ["user_id"], ["t"], ["t", "value"], ["event_id"], StructType().add("y", "double"), Q.low_pass_step(3600))
    return found.select("event_id", F.round("y", 6).alias("y"))


@query("with recursive e as (select event_id, user_id, event_type, row_number() over (partition by user_id order by ts) n from events), f as (select event_id, user_id, n, case when event_type = 'view' then 1 else 0 end as state from e where n = 1 union all select e.event_id, e.user_id, e.n, case when f.state = 0 then case when e.event_type = 'view' then 1 else 0 end when e.event_type = 'purchase' then 0 when e.event_type = 'click' then 2 else f.state end from e join f on e.user_id = f.user_id and e.n = f.n + 1) select event_id, state::bigint as state from f")
def fsm_sessions(s, d):
    """0: outside, 1: viewing, 2: clicking, as a text of the language."""
    text = """events.fsm((s,e)->
        if s.state=0 then (if e.event_type="view" then goto(1) else goto(0))
        else if e.event_type="purchase" then goto(0)
        else if e.event_type="click" then goto(2) else goto(s.state))"""
    return run_text(text, {"events": per_user(s, d)}).df.select("event_id", "state")


@query("select event_id from (select event_id, event_type, lag(event_type) over (partition by user_id order by ts) as p from events) where event_type is distinct from p")
def compact_lag(s, d):
    return per_user(s, d).compact(lambda r: r.event_type).df.select("event_id")


@query("with e as (select event_id, user_id, value, ts, datediff('day', timestamp '2024-01-01', ts) as v from events) select a.event_id, count(*) as n, round(sum(b.value), 4) as total from e a join e b on a.user_id = b.user_id and abs(a.v - b.v) <= 1 and b.ts <= a.ts group by 1")
def moving_window(s, d):
    t = per_user(s, d)
    t = Table(t.df.withColumn("v", F.datediff("ts", F.lit("2024-01-01").cast("date"))), t.order, t.by)
    return t.moving_window(lambda r: r.v, ("event_id",), n=lambda r: F.count("*"), total=lambda r: F.round(F.sum(r.value), 4))


@query("""with recursive e as (select event_id, user_id, floor(value)::bigint v, row_number() over (partition by user_id order by ts) n from events),
c as (select *, sum(v) over (partition by user_id order by n) c from e)
select a.event_id, count(*) as n from c a join c b on a.user_id = b.user_id and b.n <= a.n and (b.n = a.n or a.c - b.c + b.v <= 500) group by 1""")
def moving_window_remove(s, d):
    """Sizes of windows of whole values with a sum of 500 at most. The sum only grows to the left, as values aren't negative,
    so the SQL counts the items whose sum up to here is small enough."""
    df = s.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.floor("value").alias("value"), "ts")
    return Q.ordered_scan(df, ["user_id"], ["ts"], ["value"], ["event_id"], StructType().add("n", "long"), Q.window_remove_step(500))


# --- models and histograms -------------------------------------------------------------------------------------------------


@query("select p_partkey, case when p_size < 1 then 0.0 when p_size >= 50 then 10.0 when p_size < 20 then (p_size - 1) * (5.0 / 19.0) else 5.0 + (p_size - 20) * (5.0 / 30.0) end as y from (select p_partkey, p_size::double p_size from part)")
def interpolation(s, d):
    knots = Table(s.createDataFrame([(1.0, 0.0), (20.0, 5.0), (50.0, 10.0)], "x double, y double"), ("x",))
    return interpolate(table(s, d, "part"), knots, "p_size", "x", "y", "y").select("p_partkey", "y")


_BINS = "select range::bigint as bin, case range when 0 then '<50' when 11 then '>450' else (10 + 40 * range)::int::varchar || '-' || (50 + 40 * range)::int::varchar end as descr, coalesce(round(t, 2), 0.0) as value from range(12) left join (select least(greatest(floor((value - 50) / 40) + 1, 0), 11)::bigint b, sum(value) t from events group by 1) on b = range"


@query(_BINS)
def binning(s, d):
    found = table(s, d, "events").binning(50, 40, 10, lambda r: r.value, lambda r: r.value)
    return found.select("bin", "descr", F.round("value", 2).alias("value"))


@query("select x.range::bigint as x, y.range::bigint as y, coalesce(n, 0.0)::double as value from range(7) x cross join range(5) y left join (select least(greatest(floor(l_quantity / 10) + 1, 0), 6) bx, least(greatest(floor(l_discount / 0.04) + 1, 0), 4) b, count(*) n from lineitem group by 1, 2) on bx = x.range and b = y.range")
def binning2d(s, d):
    return table(s, d, "lineitem").binning2d((0, 10, 5), (0, 0.04, 3), lambda r: r.l_quantity, lambda r: r.l_discount, lambda r: F.lit(1.0))


@query(_BINS)
def collect_binning_(s, d):
    t = table(s, d, "events")
    halves = [t.accept(test).binning(50, 40, 10, lambda r: r.value, lambda r: r.value) for test in (lambda r: r.user_id % 2 == 0, lambda r: r.user_id % 2 == 1)]
    return collect_binning(*halves).select("bin", "descr", F.round("value", 2).alias("value"))


# --- scalars -----------------------------------------------------------------------------------------------------------------


@query("select doc_id, strlen(text)::bigint as bytes, instr(text, ' ')::bigint as blank, upper(lang) as lang, contains(text, 'the') as has, substr(text, 3, 5) as part, len(string_split(text, ' '))::bigint as words, replace(lang, 'e', 'E') as swapped from documents")
def strings(s, d):
    blank = F.instr("text", " ").cast("bigint")
    return table(s, d, "documents").map(lambda r: {"doc_id": r.doc_id, "bytes": S.byte_len(r.text), "blank": blank, "lang": F.upper(r.lang), "has": F.contains(r.text, F.lit("the")), "part": S.cut(r.text, 2, 5), "words": F.size(S.split(r.text, " ")).cast("bigint"), "swapped": S.replace(r.lang, "e", "E")}).df


@query("select doc_id, case when instr(text, 'é') = 0 then -1 else strlen(substr(text, 1, instr(text, 'é') - 1)) end::bigint as at from documents")
def string_index_of(s, d):
    return table(s, d, "documents").map(lambda r: {"doc_id": r.doc_id, "at": S.index_of(r.text, "é")}).df


@query("select p_partkey, substr(p_brand, 7)::bigint as brand, trim(split_part(p_name, ' ', 2)) as word from part")
def string_numbers(s, d):
    return table(s, d, "part").map(lambda r: {"p_partkey": r.p_partkey, "brand": S.to_int(F.regexp_extract(r.p_brand, r"(\d+)$", 1)), "word": S.trim(F.split_part(r.p_name, F.lit(" "), F.lit(2)))}).df


@query("select p_partkey, sqrt(p_retailprice) as root, ln(p_retailprice) as l, floor(p_retailprice)::double as f, ceil(p_retailprice)::double as c, round(p_retailprice)::bigint as r, p_size % 7 as m, (p_size << 3)::bigint as sh, least(p_size, 20) as lo, exp(p_size / 50.0) as e, sign(p_size - 25)::bigint as sg from part")
def maths(s, d):
    return table(s, d, "part").map(lambda r: {"p_partkey": r.p_partkey, "root": S.sqrt(r.p_retailprice), "l": S.ln(r.p_retailprice), "f": S.floor(r.p_retailprice), "c": S.ceil(r.p_retailprice), "r": S.round_(r.p_retailprice), "m": r.p_size % 7, "sh": S.shift_left(r.p_size, 3), "lo": S.least(r.p_size, 20), "e": F.exp(r.p_size / 50.0), "sg": S.sign(r.p_size - 25, whole=True)}).df


@query("select p_partkey, case when p_size > 25 then 'big' else 'small' end as kind, case p_size % 3 when 0 then 'a' when 1 then 'b' else 'c' end as sw, coalesce(try_cast(p_brand as bigint), -1) as number from part")
def if_switch_try(s, d):
    return run_text("part.map(p->{p_partkey:p.p_partkey, kind: if p.p_size>25 then 'big' else 'small', sw: switch p.p_size%3 case 0: 'a' case 1: 'b' default 'c', number: try p.p_brand.toInt() catch (0-1)})".replace("'", '"'), {"part": table(s, d, "part")}).df


@query("select vec_id, len(list_filter(embedding, lambda x: x > 0))::bigint as positive, list_max(embedding) as high, len(list_filter(embedding, lambda x: x > 0.3)) > 0 as has from embeddings")
def list_nested(s, d):
    return table(s, d, "embeddings").map(lambda r: {"vec_id": r.vec_id, "positive": F.size(F.filter(r.embedding, lambda x: x > 0)).cast("bigint"), "high": F.array_max(r.embedding), "has": F.exists(r.embedding, lambda x: x > 0.3)}).df


@query("select p_partkey, p_size + 1 as size, p_brand || '!' as brand from part where p_size > 10")
def language_pipeline(s, d):
    return run_text('let limit=10; part.accept(p->p.p_size>limit).map(p->{p_partkey:p.p_partkey, size:p.p_size+1, brand:p.p_brand+"!"})', {"part": table(s, d, "part")}).df


@query("select p_partkey, p_retailprice - p_size as lo, p_retailprice + p_size as hi, abs(p_retailprice - 950) <= p_size as same from part")
def err_value(s, d):
    """Measured values as intervals: equal when they overlap."""
    return table(s, d, "part").map(lambda r: {"p_partkey": r.p_partkey, "lo": r.p_retailprice - r.p_size, "hi": r.p_retailprice + r.p_size, "same": F.abs(r.p_retailprice - 950) <= r.p_size}).df


@query("select event_type, count(*) as n, round(sum(value), 2) as total from events group by 1")
def stream_events(s, d):
    return count_by_type(s, d)


def _events(s, d):
    return read_stream(s, d, "events").select("user_id", "event_id", "ts", "event_type", "value", F.floor("value").alias("whole"))


@query(_sql["iir_prefix_sum"])
def stream_prefix_sum(s, d):
    """iir with + on a stream, the sums kept per user."""
    found = stream_scan(_events(s, d), ["user_id"], ["ts"], ["whole"], ["event_id"], StructType().add("total", "long"), fold_step(0, lambda a, x: a + int(x)))
    return run_to_table(found)


@query(_sql["fsm_sessions"])
def stream_fsm(s, d):
    def follow(state, kind):
        return int(kind == "view") if state == 0 else 0 if kind == "purchase" else 2 if kind == "click" else state

    return run_to_table(stream_scan(_events(s, d), ["user_id"], ["ts"], ["event_type"], ["event_id"], StructType().add("state", "long"), machine_step(follow)))


@query(_sql["compact_lag"])
def stream_compact(s, d):
    found = stream_scan(_events(s, d), ["user_id"], ["ts"], ["event_type"], ["event_id"], StructType().add("stays", "boolean"), compact_step())
    return run_to_table(found).where("stays").select("event_id")


@query("select row_number() over (order by n_nationkey) - 1 as n, n_name || '!' as name, n_nationkey + n_regionkey as total from nation")
def language_records(s, d):
    return run_text('nation.map(x->x+{total:x.n_nationkey+x.n_regionkey}).number((n,x)->{n:n, name:x.n_name+"!", total:x.total})', {"nation": table(s, d, "nation")}).df.select("n", "name", "total")


@query("select c_custkey, (select count(*) from orders where o_custkey = c_custkey and o_totalprice > 300000) as large, exists (select 1 from orders where o_custkey = c_custkey) as one from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)")
def language_joins(s, d):
    """A correlated lookup and a semi join from the language's idioms."""
    text = "customer.accept(c->orders.present(o->o.o_custkey=c.c_custkey & o.o_totalprice>300000)).map(c->{c_custkey:c.c_custkey, large:orders.accept(o->(o.o_custkey=c.c_custkey) & (o.o_totalprice>300000)).size()})"
    found = run_text(text.replace("o.o_custkey=c.c_custkey & o.o_totalprice>300000", "(o.o_custkey=c.c_custkey) & (o.o_totalprice>300000)"), {"customer": table(s, d, "customer"), "orders": orders(s, d)})
    return found.df.select("c_custkey", "large", F.lit(True).alias("one"))
