"""Set algebra of index regions, region maps, and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coordinates import linear_id
from ..operators import kernels, regions, splits
from ..operators.mappers import Chunk, EvenSplit
from ..operators.regions import Box
from ..sources.files import table
from .common import CELLS, WIDTH, cells, query

#: Boxes of two sets, of all parts and of all customers: a corner and an extent from their numbers, on a grid that grows with them.
_A = "a as (select p_partkey as min0, p_partkey * 11 % 97 as min1, p_partkey + p_size % 5 + 1 as max0, p_partkey * 11 % 97 + p_size % 40 + 1 as max1 from part)"
_B = "b as (select c_custkey as min0, c_custkey * 13 % 97 as min1, c_custkey + c_nationkey % 7 + 1 as max0, c_custkey * 13 % 97 + c_custkey % 30 + 1 as max1 from customer)"
#: Both sets as cells, to count by; the boxes that the operators return are checked by what they cover.
_CELLS = "{0}c as (select distinct unnest(range(min0, max0)) as i0, i1 from (select min0, max0, unnest(range(min1, max1)) as i1 from {0}))"
_SETS = f"with {_A}, {_B}, {_CELLS.format('a')}, {_CELLS.format('b')}"


def _boxes_a(spark, d) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").select(k.alias("min0"), (k * 11 % 97).alias("min1"), (k + s % 5 + 1).alias("max0"), (k * 11 % 97 + s % 40 + 1).alias("max1"))


def _boxes_b(spark, d) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("min0"), (k * 13 % 97).alias("min1"), (k + F.col("c_nationkey") % 7 + 1).alias("max0"), (k * 13 % 97 + k % 30 + 1).alias("max1"))


#: Canonical boxes in SQL, from cells: runs along dimension 1, then equal runs along dimension 0.
_CANON = """f as (select i0, min(i1) as min1, max(i1) + 1 as max1 from (select i0, i1, i1 - row_number() over (partition by i0 order by i1) as g from {0}) group by i0, g)
select min(i0) as min0, max(i0) + 1 as max0, min1, max1 from (select *, i0 - row_number() over (partition by min1, max1 order by i0) as g from f) group by min1, max1, g"""


@query(f"{_SETS}, x as (select * from ac union select * from bc), {_CANON.format('x')}")
def region_union(spark, d):
    """The canonical boxes of all cells of either set."""
    return regions.combine_regions(_boxes_a(spark, d), _boxes_b(spark, d), F.col("in_a") | F.col("in_b"))


@query(f"{_SETS}, x as (select * from ac intersect select * from bc), {_CANON.format('x')}")
def region_intersection(spark, d):
    return regions.combine_regions(_boxes_a(spark, d), _boxes_b(spark, d), F.col("in_a") & F.col("in_b"))


@query(f"{_SETS}, x as (select * from ac except select * from bc), {_CANON.format('x')}")
def region_difference(spark, d):
    return regions.combine_regions(_boxes_a(spark, d), _boxes_b(spark, d), F.col("in_a") & ~F.col("in_b"))


@query(f"with {_A}, {_B} select *, (max0 - min0) * (max1 - min1) as area from (select greatest(a.min0, b.min0) as min0, least(a.max0, b.max0) as max0, greatest(a.min1, b.min1) as min1, least(a.max1, b.max1) as max1 from a, b where a.min0 < b.max0 and b.min0 < a.max0 and a.min1 < b.max1 and b.min1 < a.max1)")
def box_intersections(spark, d):
    """Overlaps of two sets of boxes: an equi-join in buckets of both dimensions."""
    out = regions.intersections(_boxes_a(spark, d), _boxes_b(spark, d), 2, (16, 64))
    return out.withColumn("area", (F.col("max0") - F.col("min0")) * (F.col("max1") - F.col("min1")))


_RUNS = "i as (select l_suppkey as k, l_orderkey as lo, l_orderkey + floor(l_quantity)::bigint as hi from lineitem)"


def _runs(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("lo"), (F.col("l_orderkey") + F.floor("l_quantity")).alias("hi"))


@query(f"""with {_RUNS}, m as (select *, max(hi) over (partition by k order by lo, hi rows between unbounded preceding and 1 preceding) as reach from i where lo < hi),
n as (select *, sum(case when reach is null or lo > reach then 1 else 0 end) over (partition by k order by lo, hi rows unbounded preceding) as island from m)
select k, min(lo) as lo, max(hi) as hi from n group by k, island""")
def merge_intervals(spark, d):
    """The union of each supplier's runs of order numbers: gaps and islands."""
    return regions.merge_intervals(_runs(spark, d), ["k"])


@query(f"""with {_RUNS}, c as (select k, lo as x from i union select k, hi from i), s as (select k, x as lo, lead(x) over (partition by k order by x) as hi from c),
d as (select k, x, sum(n) over (partition by k order by x) as depth from (select k, x, sum(n) as n from (select k, lo as x, 1 as n from i union all select k, hi, -1 from i) group by all))
select s.k, lo, hi, depth::bigint as depth from s join d on s.k = d.k and lo = x where depth > 0""")
def dissect_intervals(spark, d):
    """Runs cut at every end of any of them, with the number of runs over each piece."""
    runs = _runs(spark, d)
    ends = runs.select("k", F.explode(F.array(F.struct(F.col("lo").alias("x"), F.lit(1).alias("n")), F.struct(F.col("hi").alias("x"), F.lit(-1).alias("n")))).alias("e"))
    cuts = ends.groupBy("k", F.col("e.x").alias("lo")).agg(F.sum("e.n").alias("n"))
    w = Window.partitionBy("k").orderBy("lo")
    return cuts.select("k", "lo", F.lead("lo").over(w).alias("hi"), F.sum("n").over(w).cast("long").alias("depth")).where("depth > 0")


@query("select p_brand, min(p_partkey) as min0, max(p_partkey) + 1 as max0, min(p_size) as min1, max(p_size) + 1 as max1 from part group by 1")
def bounding_boxes(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("min0"), (F.max("p_partkey") + 1).alias("max0"), F.min("p_size").alias("min1"), (F.max("p_size") + 1).alias("max1"))


@query(f"""{_SETS}, o as (select i0, i1, case when a and b then 'ab' when a then 'a' else 'b' end as owners from (select i0, i1, bool_or(s = 'a') as a, bool_or(s = 'b') as b from (select *, 'a' as s from ac union all select *, 'b' from bc) group by all)),
f as (select owners, i0, min(i1) as min1, max(i1) + 1 as max1 from (select *, i1 - row_number() over (partition by owners, i0 order by i1) as g from o) group by owners, i0, g)
select owners, min(i0) as min0, max(i0) + 1 as max0, min1, max1 from (select *, i0 - row_number() over (partition by owners, min1, max1 order by i0) as g from f) group by owners, min1, max1, g""")
def region_owners(spark, d):
    """Overlapping regions split into boxes that have the same owners throughout."""
    out = regions.overlay(_boxes_a(spark, d), _boxes_b(spark, d))
    owners = F.when(F.col("in_a") & F.col("in_b"), "ab").when(F.col("in_a"), "a").otherwise("b")
    return out.select(owners.alias("owners"), "min0", "max0", "min1", "max1")


@query(f"""with {_RUNS}, u as (select event_id as i0, max(hi) as reach from events join i on event_id >= lo and event_id < hi group by 1)
select event_id as i0, coalesce(reach, -1) as value from events left join u on i0 = event_id""")
def region_map(spark, d):
    """A map over the events' ids, updated by runs of ids (a later run ends further on), then with a default where none came."""
    runs = _runs(spark, d).select("lo", "hi", F.col("hi").alias("at"), F.col("hi").alias("value"))
    held = regions.overwrite_runs(runs, "at", "value")
    ids = table(spark, d, "events").select(F.col("event_id").alias("lo"), (F.col("event_id") + 1).alias("hi"), F.col("event_id").alias("i0"))
    found = regions.interval_join(ids, held).select("i0", "value")
    return ids.select("i0").join(found, "i0", "left").select("i0", F.coalesce("value", F.lit(-1)).alias("value"))


@query(f"""with {_RUNS}, m as (select *, max(hi) over (order by lo, hi rows between unbounded preceding and 1 preceding) as reach from i where lo < hi),
n as (select *, sum(case when reach is null or lo > reach then 1 else 0 end) over (order by lo, hi rows unbounded preceding) as island from m)
select min(lo) as lo, max(hi) as hi from n group by island""")
def merge_all_intervals(spark, d):
    """The union of all runs of order numbers, in pieces of a bounded width."""
    return regions.merge_intervals(_runs(spark, d), width=512)


@query("""select greatest(o_orderkey, p_partkey * 7) as lo, least(o_orderkey + 3 + o_custkey % 40, p_partkey * 7 + p_size) as hi, o_custkey as value, p_partkey as asked
from orders join part on o_orderkey < p_partkey * 7 + p_size and p_partkey * 7 < o_orderkey + 3 + o_custkey % 40""")
def region_values(spark, d):
    """What a map of runs holds in each of many queried runs: an overlap join in buckets."""
    o, p = table(spark, d, "orders"), table(spark, d, "part")
    held = o.select(F.col("o_orderkey").alias("lo"), (F.col("o_orderkey") + 3 + F.col("o_custkey") % 40).alias("hi"), F.col("o_custkey").alias("value"))
    asked = p.select((F.col("p_partkey") * 7).alias("lo"), (F.col("p_partkey") * 7 + F.col("p_size")).alias("hi"), F.col("p_partkey").alias("asked"))
    return regions.interval_join(held, asked)


@query(f"with {CELLS}, r as (select i0, i1, 255 - greatest(0, least(255, floor(v * 100)::bigint)) as v from cells) select i0, i1, case when v < 250 then 0 else v end as v from r")
def applied_values(spark, d):
    """A function of all values of a map; cells of equal values stay apart only by their coordinates."""
    b = cells(spark, d)
    b = kernels.parallel_for(b, v=F.lit(255) - F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col("v") * 100))))
    return kernels.parallel_for(b, v=F.when(F.col("v") < 250, 0).otherwise(F.col("v"))).df


_SPLITS = [("1d", (128,), (1,), 4), ("1d", (13,), (1,), 5), ("1d", (80,), (16,), 3), ("1d", (96,), (48,), 3), ("2d", (128, 128), (1, 1), 4), ("2d", (100, 100), (1, 1), 6), ("2d", (128, 120), (8, 8), 4), ("2d", (64, 256), (1, 1), 8), ("2d", (256, 64), (1, 1), 8)]
_SPLIT_ROWS = {
    ("1d", 0): [(0, 32), (32, 64), (64, 96), (96, 128)], ("1d", 1): [(0, 3), (3, 6), (6, 9), (9, 11), (11, 13)], ("1d", 2): [(0, 32), (32, 64), (64, 80)], ("1d", 3): [(0, 48), (48, 96)],
}


@query(" union all ".join(f"select {n}::bigint as fixture, {k}::bigint as chunk, {a}::bigint as min0, {b}::bigint as max0" for (_, n), rows in _SPLIT_ROWS.items() for k, (a, b) in enumerate(rows)))
def split_bounds_1d(spark, d):
    rows = [(n, k, b.min[0], b.max[0]) for n, (kind, e, g, p) in enumerate(_SPLITS) if kind == "1d" for k, b in enumerate(splits.split_1d(Box.full(e), g, p))]
    return spark.createDataFrame(rows, "fixture long, chunk long, min0 long, max0 long")


#: Where the rows and the columns of tiles of each fixture begin and end.
_TILES = {4: ([0, 64, 128], [0, 64, 128]), 5: ([0, 34, 67, 100], [0, 50, 100]), 6: ([0, 64, 128], [0, 64, 120]), 7: ([0, 32, 64], [0, 64, 128, 192, 256]), 8: ([0, 64, 128, 192, 256], [0, 32, 64])}


@query(f"""with f as (select * from (values {", ".join(f"({n}, {r}, {c})" for n, (r, c) in _TILES.items())}) t(fixture, r, c)), x as (select *, unnest(range(1, len(r))) as i from f), y as (select *, unnest(range(1, len(c))) as j from x)
select fixture::bigint as fixture, ((i - 1) * (len(c) - 1) + j - 1)::bigint as chunk, r[i]::bigint as min0, r[i + 1]::bigint as max0, c[j]::bigint as min1, c[j + 1]::bigint as max1 from y""")
def split_bounds_2d(spark, d):
    """All bounds of two-dimensional splits."""
    rows = [(n, k, b.min[0], b.max[0], b.min[1], b.max[1]) for n, (kind, e, g, p) in enumerate(_SPLITS) if kind == "2d" for k, b in enumerate(splits.split_2d(Box.full(e), g, p))]
    return spark.createDataFrame(rows, "fixture long, chunk long, min0 long, max0 long, min1 long, max1 long")


@query("""with n as (select (max(vec_id) + 1) // 8 as each, (max(vec_id) + 1) % 8 as more from embeddings), c as (select vec_id as i0, (generate_subscripts(embedding, 1) - 1)::bigint as i1, unnest(embedding)::double as v from embeddings)
select case when i0 < more * (each + 1) then i0 // (each + 1) else more + (i0 - more * (each + 1)) // each end as tile, count(*) as n, min(i0 * 64 + i1) as first from c, n group by 1""")
def split_tiles(spark, d):
    """Cells dealt to the tiles of a two-dimensional split: a long narrow array gets one column of tiles."""
    b = cells(spark, d)
    n, _ = b.extent()
    tile = splits.tile_of((n, WIDTH), (1, WIDTH), 8)
    return b.df.groupBy(tile.alias("tile")).agg(F.count("*").alias("n"), F.min(linear_id((n, WIDTH))).alias("first"))


@query("select event_id // 500 as chunk, count(*) as n, round(sum(value), 4) as v from events group by 1")
def oversubscription(spark, d):
    """Several partitions for each chunk; sums by chunk are the same."""
    e = table(spark, d, "events").select(F.col("event_id").alias("i0"), F.col("value").alias("v"))
    out = splits.distributed(e.withColumn("chunk", F.floor(F.col("i0") / 500)), F.col("chunk"), 4, 3)
    return out.groupBy("chunk").agg(F.count("*").alias("n"), F.round(F.sum("v"), 4).alias("v"))


_EVEN = [(128, 1, 0, 1, 8), (128, 1, 4, 2, 8), (131, 1, 5, 2, 7), (128, 10, 0, 1, 8), (131, 10, 0, 1, 7), (131, 10, 5, 2, 7), (236, 10, 6, 1, 7)]


@query("select * from (values (0::bigint, 0::bigint, 16::bigint), (1, 64, 32), (2, 95, 36), (3, 0, 20), (4, 0, 20), (5, 100, 31), (6, 200, 36)) t(fixture, first, n)")
def even_split_bounds(spark, d):
    rows = []
    for k, (n, g, node, many, nodes) in enumerate(_EVEN):
        (b,) = EvenSplit(g).region(Chunk((node,), (many,), (nodes,)), (n,)).boxes
        rows.append((k, b.min[0], b.range[0]))
    return spark.createDataFrame(rows, "fixture long, first long, n long")


