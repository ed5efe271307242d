"""Op 7 [native]: mixing sources to target weights by a low-discrepancy schedule.

The golden-ratio point of slot k of the schedule, mapped through the cumulative targets, names the slot's source. Slots are
ranked per source, and slot r of a source takes block r of that source's shuffled stream: its documents in an order drawn by
hash, laid end to end twice. A source's blocks are equal shares of its target, so the blocks of all sources are alike in
size, up to the discrepancy of the points, and each source's taken words are its target exactly (rounded to a whole word). A
source so small that no point falls on it gets one slot of its own behind the others. A document's `taken` words are those
of its words, repeats counted, that lie in blocks that a slot takes.

All is DataFrame code. The schedule has SLOTS slots at most, whatever the input; blocks grow with it. Points find their
source by an equi-join of cells of the unit interval. Running sums work in two levels, over about the root of the number of
rows in buckets and over the buckets' totals, so no task holds a whole source: a source with a third of all rows is spread
over its buckets. Only the table of sources, one row each, is gathered (at most MAX_SOURCES rows, else an error is raised).

Null and empty texts have size 0, a null source is a source of its own (last). Documents without words are taken 0 times. Ids
need not be unique or set; rows that are alike in id and text are interchangeable, and ties in the drawn order occur among
them only. Sizes are counted over whole texts. If no text has a word, all targets are 0; an empty table gives an empty
table. Other columns of docs may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluentlake.llm.shared import WORD, spread_join, stored

WEIGHTS = (3, 1, 2)
#: Share of all sizes that the targets add up to, in percent; and the cap of a target, in multiples of its source's size.
PERCENT, CAP = 150, 2
#: Slots of the schedule (fewer if there are fewer words), and cells of the unit interval by which points find their source.
SLOTS, CELLS = 1 << 18, 1 << 12
MAX_SOURCES = 100_000
GOLDEN = 0.6180339887498949
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def draw(doc_id: str, text: str) -> Column:
    """The hash that orders documents; equal for rows alike in id and text."""
    return F.md5(F.concat_ws("|", F.lit(SEED), F.col(doc_id).cast("string"), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit(""))).cast("binary"))


def water_level(sizes: DataFrame, weights: tuple[int, ...], percent: int, cap: int) -> DataFrame:
    """From (source, source_size): the target of each source and the cumulative targets (low, high).

    A target is the smaller of the cap and level * weight. With sources in the order of cap / weight, the level is that of
    the first source whose cap the level doesn't reach when all before it are capped. This is where resharing the excess by
    weight ends."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    caps = numbered.select("*", weight.alias("weight"), (cap * F.col("source_size")).cast("double").alias("most")).withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio, everything = Window.orderBy("ratio", "place"), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everything) * percent / 100.0
    capped = F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = caps.withColumn("level", (total - capped) / rest).withColumn("fits", F.col("level") <= F.col("ratio"))
    level = F.min(F.when(F.col("fits"), F.struct("ratio", "place", "level"))).over(everything)["level"]
    target = F.least(F.col("most"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))
    high = F.sum("target").over(Window.orderBy("place"))
    return levels.withColumn("target", target).withColumn("high", high).select("source", "place", "source_size", "target", (F.col("high") - F.col("target")).alias("low"), "high")


def running(df: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Adds the sum of value over the rows before each row, among the rows of its keys, by bucket and then order."""
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_total"))
    ahead = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, bucket, F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_ahead"))
    on = [df[k].eqNullSafe(totals[k]) for k in [*keys, bucket]]
    joined = df.join(totals, on).select(df["*"], totals["_ahead"])
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col("_ahead") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("_ahead")


def ranked_slots(level: DataFrame, count: int) -> DataFrame:
    """The schedule: place (of the source) and block (the rank of the slot among its source's)."""
    spark = level.sparkSession
    some = level.where("target > 0")
    end = some.agg(F.max("high")).first()[0] or 0.0
    point = F.col("id") * F.lit(GOLDEN) - F.floor(F.col("id") * F.lit(GOLDEN))
    at = spark.range(count).select("id", (point * F.lit(end)).alias("at"))
    cell = lambda c: F.least(F.floor(F.col(c) / F.lit(max(end, 1e-300)) * CELLS), F.lit(CELLS - 1)).cast("int")
    spans = some.select("place", "low", "high", F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"))
    slots = at.withColumn("cell", cell("at")).join(F.broadcast(spans), "cell").where("at >= low and at < high").select("id", "place")
    # Bounds are running sums of doubles, so neighbours may overlap or miss a point by a rounding error.
    slots = slots.groupBy("id").agg(F.min("place").alias("place"))
    missed = some.select("place").join(slots.select("place").distinct(), "place", "left_anti").select((F.col("place") + count).cast("long").alias("id"), "place")
    return slots.unionByName(missed).select("place", (F.row_number().over(Window.partitionBy("place").orderBy("id")) - 1).cast("long").alias("block"))


def planned(docs: DataFrame, doc_id: str, text: str, source: str, weights: tuple[int, ...], percent: int, cap: int, slots: int) -> DataFrame:
    """One row per document: doc_id, draw, source, size, source_size, target, taken."""
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), draw(doc_id, text).alias("draw"))
    sized = stored(sized, "sized")
    sources = stored(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "sources")
    told = sources.agg(F.count("*").alias("n"), F.sum("source_size").alias("words"), F.sum("rows").alias("rows")).first()
    if told["n"] > MAX_SOURCES:
        raise ValueError(f"{told['n']} sources; at most {MAX_SOURCES} can be mixed")
    words, rows = int(told["words"] or 0), int(told["rows"] or 0)
    level = stored(water_level(sources.select("source", "source_size"), weights, percent, cap), "levels")
    ranked = stored(ranked_slots(level, min(slots, words * percent // 100)), "slots")
    level = level.join(ranked.groupBy("place").agg(F.count("*").alias("n")), "place", "left").select("source", "place", "source_size", "target", F.round("target").cast("long").alias("whole"), F.coalesce("n", F.lit(1)).alias("n"))

    buckets = max(1, math.isqrt(rows))
    bucket = (F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * buckets / F.lit(1 << 32)).cast("long")
    placed = running(sized.withColumn("bucket", bucket), ["source"], "bucket", ["draw", "doc_id", "size"], F.col("size"), "start")
    placed = placed.join(F.broadcast(level.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")

    laps = placed.where("size > 0 and whole > 0").select("place", "start", "size", "whole", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda lap: F.col("start") + lap * F.col("source_size"))).alias("begin"))
    # Block k of n has the words from k * whole div n on; word p is in block ((p + 1) * n - 1) div whole.
    parts = laps.where("begin < whole").withColumn("block", F.explode(F.expr("sequence(((begin + 1) * n - 1) div whole, ((least(begin + size, whole)) * n - 1) div whole)")))
    share = F.expr("least(begin + size, (block + 1) * whole div n) - greatest(begin, block * whole div n)")
    taken = parts.join(ranked, ["place", "block"]).groupBy("place", "start", "size").agg(F.sum(share).alias("taken"))
    out = placed.join(taken.toDF("_p", "_s", "_z", "taken"), (F.col("place") == F.col("_p")) & (F.col("start") == F.col("_s")) & (F.col("size") == F.col("_z")), "left")
    return out.select("doc_id", "draw", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, cap: int = CAP, slots: int = SLOTS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken."""
    return planned(docs, doc_id, text, source, weights, percent, cap, slots).drop("draw")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, cap: int = CAP, slots: int = SLOTS) -> DataFrame:
    """The rows of docs as often as the mix takes them, whole: once from half of a document's words taken, twice from one and
    a half. A document without words is kept once, as it takes nothing from any share. Texts cross one shuffle.

    Rows alike in id and text share their repeats evenly; what is left over goes to one of them, collapsed by an aggregate."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    times = F.when(F.col("size") == 0, 1).otherwise(F.expr("(2 * taken + size) div (2 * size)")).cast("long")
    plan = planned(docs, doc_id, text, source, weights, percent, cap, slots)
    plan = stored(plan.groupBy("draw").agg(F.sum(times).alias("times"), F.count("*").alias("copies")), "times")
    keyed = docs.select(draw(doc_id, text).alias("draw"), F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)]).alias("own"))
    laps = lambda rows, n: rows.where(f"{n} > 0").withColumn("lap", F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select("own")
    if plan.where("copies > 1").isEmpty():
        out = laps(keyed.join(plan.where("times > 0"), "draw"), "times")
    else:
        joined = spread_join(keyed, plan, ["draw"], "copies", plan.agg(F.sum("copies")).first()[0])
        out = laps(joined.withColumn("even", F.expr("times div copies")), "even")
        rest = joined.where("times % copies > 0").groupBy("draw").agg(F.first("own").alias("own"), F.first(F.expr("times % copies")).alias("rest"))
        out = out.union(laps(rest, "rest"))
    return out.select(*[F.col(f"own.{n}").alias(c) for n, c in zip(names, docs.columns, strict=True)])


ORACLE_SQL = rf"""
with recursive sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint size,
    md5(concat_ws('|', '{SEED}', doc_id::varchar, coalesce(md5(text), ''))) draw from documents),
sources as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 place from sized group by source),
caps as (select *, ([3.0, 1.0, 2.0])[place % 3 + 1]::double weight, {CAP}.0::double * source_size most, {CAP}.0::double * source_size / ([3.0, 1.0, 2.0])[place % 3 + 1]::double ratio from sources),
told as (select sum(source_size) * {PERCENT}::double / 100 total from sources),
levels as (select c.*, (total - coalesce(sum(most) over (order by ratio, place rows between unbounded preceding and 1 preceding), 0)) / sum(weight) over (order by ratio, place rows between current row and unbounded following) as lvl from caps c, told),
level as (select arg_min(lvl, (ratio, place)) filter (lvl <= ratio) v from levels),
targets as (select source, source_size, least(most, coalesce(v, 'inf'::double) * weight) target from levels, level),
placed as (select doc_id, s.source, size, coalesce(sum(size) over (partition by s.source order by draw, doc_id, size rows between unbounded preceding and 1 preceding), 0) start from sized s)
select doc_id, p.source, size, t.source_size, t.target,
  (greatest(0, least(start + size, round(t.target)) - start) + greatest(0, least(start + t.source_size + size, round(t.target)) - start - t.source_size))::bigint taken
from placed p join targets t on p.source is not distinct from t.source
"""
