"""Access patterns as joins: equal coordinates, fixed boxes, slices, neighbourhoods, prefixes; and updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kernels
from ..operators.buffer import Buffer, from_columns, index_space
from ..operators.regions import overwrite
from ..operators.splits import run_of
from ..sources.files import table
from .common import CELLS, WIDTH, cells, events, orders, parts, query, rounded

BOX = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def _sum(near, taps=None):
    cols = [near[t] for t in (taps or near)]
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


@query("select event_id as i0, round(value + o_totalprice, 4) as v from events join orders on event_id = o_orderkey")
def one_to_one(spark, d):
    a, b = events(spark, d), orders(spark, d)
    both = kernels.one_to_one(a, b.with_df(b.df.withColumnRenamed("v", "w"), ["w"]))
    return both.df.select("i0", F.round(F.col("v") + F.col("w"), 4).alias("v"))


@query("select event_id as i0, round(value * (select sum(p_retailprice) from part where p_partkey < 16), 4) + 0.0 as v from events")
def fixed_box(spark, d):
    box = parts(spark, d).box([0], [16])

    def folded(a):
        return rounded(F.col("v") * F.aggregate(a, F.lit(0.0), lambda s, x: s + x["v"]), 4)

    return kernels.fold_fixed(events(spark, d), box, folded, "w").df.select("i0", F.col("w").alias("v"))


@query("select c_custkey as i0, (select sum(n_regionkey) from nation where n_nationkey <= c_nationkey)::bigint as v from customer")
def whole_buffer(spark, d):
    """Every customer reads all nations."""
    n = from_columns(table(spark, d, "nation"), ["n_nationkey"], (25,), v=F.col("n_regionkey").cast("long"))
    c = from_columns(table(spark, d, "customer"), ["c_custkey"], nation="c_nationkey")

    def folded(a):
        return F.aggregate(F.filter(a, lambda x: x["i0"] <= F.col("nation")), F.lit(0).cast("long"), lambda s, x: s + x["v"])

    return kernels.fold_fixed(c, n, folded, "w").df.select("i0", F.col("w").alias("v"))


@query(f"with {CELLS} select a.i1 as i0, b.i1 as i1, round(sum(a.v * b.v), 4) + 0.0 as v from cells a join cells b on a.i0 = b.i0 group by all")
def slice_contraction(spark, d):
    m = cells(spark, d)
    out = kernels.contract(m, m, a_dim=0, b_dim=0)
    return out.df.select("i0", "i1", rounded("v", 4).alias("v"))


@query(f"with {CELLS} select a.i1 // 8 as i0, a.i1 % 8 as i1, b.i1 as i2, round(sum(a.v * b.v), 4) + 0.0 as v from cells a join cells b on a.i0 = b.i0 group by all")
def slice_contraction_3d(spark, d):
    """A cube and a matrix, summed over their first dimension: an array of three dimensions."""
    out = kernels.contract(cube(spark, d), cells(spark, d), a_dim=0, b_dim=0)
    return out.df.select("i0", "i1", "i2", rounded("v", 4).alias("v"))


@query(f"with {CELLS} select i0, 63 - i1 as i1, round(v, 6) + 0.0 as v from cells")
def tiled_matmul(spark, d):
    """A product with the mirrored identity, by tiles."""
    i, j = F.col("i0"), F.col("i1")
    mirror = index_space(spark, (WIDTH, WIDTH), v=F.when(i + j == WIDTH - 1, 1.0).otherwise(0.0))
    out = kernels.contract_tiled(cells(spark, d), mirror, 64)
    return out.df.select("i0", "i1", rounded("v").alias("v"))


@query(f"with {CELLS} select i0, i1, round(v * p_retailprice, 6) + 0.0 as by_column, round(v * value, 6) + 0.0 as by_row from cells join part on p_partkey = i1 join events on event_id = i0")
def rows_and_columns(spark, d):
    """Vectors of either dimension meet a matrix."""
    m = kernels.along(cells(spark, d), parts(spark, d), 1, "x")
    m = kernels.along(m, events(spark, d), 0, "y")
    return m.df.select("i0", "i1", rounded(F.col("v") * F.col("x")).alias("by_column"), rounded(F.col("v") * F.col("y")).alias("by_row"))


@query("select o_orderkey as i0, o_totalprice as v, c_acctbal as w from orders join customer on o_custkey = c_custkey")
def gather(spark, d):
    o = from_columns(table(spark, d, "orders"), ["o_orderkey"], v="o_totalprice", at=F.col("o_custkey"))
    c = from_columns(table(spark, d, "customer"), ["c_custkey"], v="c_acctbal")
    return kernels.gather(o, "at", c).df.select("i0", "v", "w")


@query(f"""with {CELLS} select a.i0, a.i1, round(avg(b.v), 6) + 0.0 as v, count(*) as n from cells a join cells b
on b.i0 between a.i0 - 1 and a.i0 + 1 and b.i1 between a.i1 - 1 and a.i1 + 1 group by all""")
def neighbourhood_skip(spark, d):
    """The mean of a 3 × 3 box, of the cells that are in the array."""

    def mean(near):
        n = _sum({t: F.when(c.isNotNull(), 1).otherwise(0) for t, c in near.items()})
        return F.struct((_sum({t: F.coalesce(c, F.lit(0.0)) for t, c in near.items()}) / n).alias("v"), n.cast("long").alias("n"))

    out = kernels.stencil(cells(spark, d), BOX, mean, "skip")
    return out.df.select("i0", "i1", rounded("v.v").alias("v"), "v.n")


@query(f"""with {CELLS}, top as (select max(i0) as n from cells), offs as (select a.range - 1 as a, b.range - 1 as b from range(3) a, range(3) b)
select x.i0, x.i1, round(avg(y.v), 6) + 0.0 as v from cells x, top, offs join cells y
on y.i0 = least(n, greatest(0, x.i0 + a)) and y.i1 = least(63, greatest(0, x.i1 + b)) group by all""")
def neighbourhood_edge(spark, d):
    """The same, where cells beyond the array are the nearest ones in it."""
    out = kernels.stencil(cells(spark, d), BOX, lambda near: _sum(near) / 9, "edge")
    return out.df.select("i0", "i1", rounded("v").alias("v"))


@query(f"""with {CELLS}, offs as (select a.range - 1 as a, b.range - 1 as b from range(3) a, range(3) b)
select x.i0, x.i1, round(sum(coalesce(y.v, 0.25)) / 9, 6) + 0.0 as v from cells x cross join offs left join cells y on y.i0 = x.i0 + a and y.i1 = x.i1 + b group by all""")
def neighbourhood_constant(spark, d):
    """The same, where cells beyond the array are a quarter."""
    out = kernels.stencil(cells(spark, d), BOX, lambda near: _sum(near) / 9, "constant", 0.25)
    return out.df.select("i0", "i1", rounded("v").alias("v"))


@query(f"""with {CELLS} select i0, i1, round(coalesce(lag(v) over r, v) + coalesce(lead(v) over r, v) + coalesce(lag(v) over c, v) + coalesce(lead(v) over c, v) - 4 * v, 6) + 0.0 as v
from cells window r as (partition by i0 order by i1), c as (partition by i1 order by i0)""")
def neighbourhood_along_axes(spark, d):
    """The five-point Laplacian."""
    out = kernels.stencil(cells(spark, d), CROSS, lambda near: _sum(near, CROSS[1:]) - 4 * near[0, 0], "edge")
    return out.df.select("i0", "i1", rounded("v").alias("v"))


@query("""with e as (select event_id as i0, value as v from events), top as (select max(i0) as n from e), offs as (select range - 2 as a from range(4))
select x.i0, round(sum(y.v * (a + 3)), 6) + 0.0 as v from e x, top, offs join e y on y.i0 = least(n, greatest(0, x.i0 + a)) group by x.i0""")
def neighbourhood_1d(spark, d):
    """Four cells of a line, weighted; beyond its ends the nearest one."""
    out = kernels.stencil(events(spark, d), [(-2,), (-1,), (0,), (1,)], lambda near: sum(near[(a,)] * (a + 3) for a in (-2, -1, 0, 1)), "edge")
    return out.df.select("i0", rounded("v").alias("v"))


#: An embedding as 8 × 8 cells of a third dimension.
CUBE = f"{CELLS}, cube as (select i0, i1 // 8 as i1, i1 % 8 as i2, v from cells)"
STAR = [(0, 0, 0), (-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]


def cube(spark, d):
    b = cells(spark, d)
    return Buffer(b.df.select("i0", F.floor(F.col("i1") / 8).alias("i1"), (F.col("i1") % 8).alias("i2"), "v"), (None, 8, 8))


@query(f"""with {CUBE}, offs as (select * from (values {", ".join(map(str, STAR))}) t(a, b, c))
select x.i0, x.i1, x.i2, round(sum(case when a = 0 and b = 0 and c = 0 then -6 * y.v else coalesce(y.v, 0.5) end), 6) + 0.0 as v
from cube x cross join offs left join cube y on y.i0 = x.i0 + a and y.i1 = x.i1 + b and y.i2 = x.i2 + c group by all""")
def neighbourhood_3d(spark, d):
    """The seven-point Laplacian, with a half beyond the array."""
    out = kernels.stencil(cube(spark, d), STAR, lambda near: _sum(near, STAR[1:]) - 6 * near[0, 0, 0], "constant", 0.5)
    return out.df.select("i0", "i1", "i2", rounded("v").alias("v"))


@query(f"""with {CELLS}, h as (select * from cells where (i0 * 7 + i1 * 3) % 5 <> 0), offs as (select * from (values (0, -1), (0, 1), (-1, 0), (1, 0), (1, 1)) t(a, b))
select x.i0, x.i1, round(sum(coalesce(y.v, -1)), 6) + 0.0 as v from h x cross join offs left join h y on y.i0 = x.i0 + a and y.i1 = x.i1 + b group by all""")
def neighbourhood_over_holes(spark, d):
    """Neighbours of an array with absent cells, found by coordinate: an absent one counts as beyond the array."""
    b = cells(spark, d)
    out = kernels.stencil(b.with_df(b.df.where((F.col("i0") * 7 + F.col("i1") * 3) % 5 != 0)), [(0, -1), (0, 1), (-1, 0), (1, 0), (1, 1)], _sum, "constant", -1.0)
    return out.df.select("i0", "i1", rounded("v").alias("v"))


@query(f"""with {CELLS}, h as (select i0, i1, case when (i0 + i1) % 4 <> 1 then v end as v from cells), top as (select max(i0) as n from h), offs as (select * from (values (0, 1, 'r'), (-1, 0, 'u')) t(a, b, k))
select x.i0, x.i1, max(case when k = 'r' then round(y.v, 6) + 0.0 end) as right_, max(case when k = 'u' then round(y.v, 6) + 0.0 end) as up
from h x, top, offs left join h y on y.i0 = least(n, greatest(0, x.i0 + a)) and y.i1 = least(63, greatest(0, x.i1 + b)) group by x.i0, x.i1""")
def neighbourhood_null_cells(spark, d):
    """A null cell is in the array: its neighbours see null, not the nearest other value."""
    b = cells(spark, d)
    b = b.with_df(b.df.withColumn("v", F.when((F.col("i0") + F.col("i1")) % 4 != 1, F.col("v"))))
    out = kernels.stencil(b, [(0, 1), (-1, 0)], lambda near: F.struct(near[0, 1].alias("right_"), near[-1, 0].alias("up")), "edge")
    return out.df.select("i0", "i1", rounded("v.right_").alias("right_"), rounded("v.up").alias("up"))


@query(f"""with {CELLS}, offs as (select a.range - 2 as a, b.range - 1 as b, ((a.range * 4 + b.range) % 7 - 3) / 10.0::double as w from range(5) a, range(4) b)
select x.i0, x.i1, round(sum(w * coalesce(y.v, 0)), 6) + 0.0 as v from cells x cross join offs left join cells y on y.i0 = x.i0 + a and y.i1 = x.i1 + b group by all""")
def neighbourhood_dense(spark, d):
    """Any weights over a box of 5 × 4 cells, tile by tile in arrays."""
    w = [[((a * 4 + b) % 7 - 3) / 10.0 for b in range(4)] for a in range(5)]
    out = kernels.dense_stencil(cells(spark, d), w, [-2, -1])
    return out.df.select("i0", "i1", rounded("v").alias("v"))


@query(f"""with {CELLS} select i0, i1, round(coalesce(lag(v, 3) over c, 0) + 2 * coalesce(lead(v, 2) over c, 0), 6) + 0.0 as v
from cells window c as (partition by i1 order by i0)""")
def neighbourhood_far(spark, d):
    """Offsets of different reach along one dimension."""
    out = kernels.stencil(cells(spark, d), [(-3, 0), (2, 0)], lambda near: near[-3, 0] + 2 * near[2, 0], "constant")
    return out.df.select("i0", "i1", rounded("v").alias("v"))


@query("""with n as (select (max(event_id) + 1) // 10 as blocks, max(event_id) + 1 as n from events),
p as (select *, blocks // 7 as each, blocks % 7 as more from events, n),
r as (select *, case when event_id // 10 < more * (each + 1) then event_id // 10 // (each + 1) else least(6, more + (event_id // 10 - more * (each + 1)) // each) end as part from p)
select part, count(*) as n, min(event_id) as first, round(sum(value), 4) as v from r group by part""")
def even_split(spark, d):
    """Seven runs of whole tens."""
    b = events(spark, d)
    (n,) = b.extent()
    part = run_of("i0", n, 7, 10)
    return b.df.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("i0").alias("first"), F.round(F.sum("v"), 4).alias("v"))


@query(f"with {CELLS} select i0, i1, round(avg(v) over (partition by i1 order by i0 rows between unbounded preceding and 1 preceding), 6) + 0.0 as v from cells")
def growing_prefix(spark, d):
    """Each row reads all earlier rows."""
    out = kernels.growing_mean(cells(spark, d).df, "i0", "v", "mean", ["i1"], block=128)
    return out.select("i0", "i1", rounded("mean").alias("v"))


@query("select event_id as i0, sum(floor(value)::bigint) over (order by event_id)::bigint as upto, (sum(floor(value)::bigint) over (order by event_id) - floor(value)::bigint)::bigint as before from events")
def running_sum(spark, d):
    """A scan of a whole buffer in blocks, inclusive and exclusive."""
    df = events(spark, d).df.select("i0", F.floor("v").alias("x"))
    out = kernels.scan(df, "i0", "x", "upto", block=512)
    return out.select("i0", "upto", (F.col("upto") - F.col("x")).alias("before"))


@query("select p_partkey as i0, case when p_partkey between 10 and 99 then -1.0 else p_retailprice end as v from part")
def update_write(spark, d):
    """A write that keeps the cells it doesn't reach."""
    b = parts(spark, d)
    new = kernels.parallel_for(b, [10], [90], v=F.lit(-1.0))
    return kernels.update(b, new).df


@query("select p_partkey as i0, case when p_partkey between 10 and 99 then p_retailprice * 2 else p_retailprice end as v from part where p_partkey not between 10 and 99 or p_partkey % 2 = 0")
def update_discard(spark, d):
    """A write that discards its box: odd cells of it are then not there."""
    b = parts(spark, d)
    new = b.with_df(b.df.where("i0 % 2 = 0").withColumn("v", F.col("v") * 2))
    return kernels.discard_write(b, new, [10], [90]).df


@query("select p_partkey as i0, p_retailprice as v, reverse(p_partkey::varchar) as w from part")
def double_buffer_swap(spark, d):
    a = parts(spark, d)
    b = from_columns(table(spark, d, "part"), ["p_partkey"], v=F.reverse(F.col("p_partkey").cast("string")))
    a, b = b, a
    return kernels.one_to_one(b, Buffer(a.df.withColumnRenamed("v", "w"), a.shape, ("w",))).df


@query("""with last as (select l_partkey, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) as v from lineitem group by 1)
select p_partkey as i0, coalesce(v, p_retailprice) as v from part left join last on l_partkey = p_partkey""")
def last_writer(spark, d):
    """Each part's price is that of the last line item that wrote it."""
    b = parts(spark, d)
    log = table(spark, d, "lineitem").select(F.col("l_partkey").alias("i0"), F.col("l_extendedprice").alias("v"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice").alias("at"))
    return overwrite(b.df, log, ["i0"], "at", "v")
