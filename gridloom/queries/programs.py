"""Whole programs: image filters, products, simulations, loops, host tasks, and task graphs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from ..functions.coordinates import compressed, linearised, truncated_byte
from ..operators import host, kernels
from ..operators.buffer import Buffer, index_space
from ..operators.mappers import All, Chunk, Custom, Neighborhood, OneToOne
from ..operators.reductions import equal_everywhere, reduction
from ..operators.regions import Box
from ..plans.loops import cut, iterate, supersteps, until
from ..plans.program import Access, Program
from ..plans.topologies import TOPOLOGIES
from ..sources.files import load, save, scratch, table
from .common import CELLS, GREY, WIDTH, byte, cells, events, parts, query, rounded
from .joins import BOX, CROSS


def grey(spark, d) -> Buffer:
    b = cells(spark, d)
    return b.with_df(b.df.withColumn("v", byte("v")))


def _lin(c: str) -> str:
    return f"case when {c} <= 0.04045 then {c} / 12.92 else pow(({c} + 0.055) / 1.055, 2.4) end"


def _srgb(c: str) -> str:
    return f"case when {c} <= 0.0031308 then {c} * 12.92 else pow({c}, {1 / 2.4!r}) * 1.055 - 0.055 end"


_RGB = "max(case when i1 % 4 = {} then v end)"


@query(f"""with {GREY}, px as (select i0, i1 // 4 as i1, {", ".join(f"{_RGB.format(k)} / 255.0::double as {c}" for k, c in enumerate("rgb"))} from grey group by i0, i1 // 4),
lin as (select i0, i1, {", ".join(f"{_lin(c)} as {c}" for c in "rgb")} from px), m as (select min(least(r, g, b)) as lo, max(greatest(r, g, b)) as hi from lin),
s as (select i0, i1, {", ".join(f"({c} - lo) / (hi - lo) as {c}" for c in "rgb")} from lin, m)
select i0, i1, {", ".join(f"floor(round(({_srgb(c)}) * 255, 6))::int as {c}" for c in "rgb")}, 0 as a from s""")
def contrast_stretch(spark, d):
    """Linear light, the least and the largest value over three channels, rescaled, and back to bytes.

    A pixel is four neighbouring entries of an embedding; its fourth channel becomes 0.
    """
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("i0"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 4), F.lit(4)), lambda k: F.slice("embedding", k + 1, 3))).alias("i1", "p"))
    light = e.select("i0", F.col("i1").cast("long").alias("i1"), *[linearised(byte(F.col("p")[k].cast("double")) / 255.0).alias(c) for k, c in enumerate("rgb")])
    pixels = Buffer(light, (None, WIDTH // 4), ("r", "g", "b"))
    ends = reduction(pixels, lo=("minimum", F.least("r", "g", "b")), hi=("maximum", F.greatest("r", "g", "b")))
    both = kernels.with_scalar(pixels, Buffer(ends, (), ("lo", "hi")))
    out = [truncated_byte(compressed((F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo")))).alias(c) for c in "rgb"]
    return both.df.select("i0", "i1", *out, F.lit(0).alias("a"))


@query("select n_nationkey as k, string_agg(case when i = len(n_name) - 1 then '' else chr(ascii(n_name[i + 1]) - 1) end, '' order by i) as text from (select *, unnest(range(len(n_name))) as i from nation) group by 1")
def hello_world(spark, d):
    """Each character moves down by one in place; the last one ends the text."""
    chars = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.posexplode(F.split("n_name", "")).alias("i0", "c"), F.length("n_name").alias("n"))
    moved = chars.withColumn("c", F.when(F.col("i0") == F.col("n") - 1, "").otherwise(F.chr(F.ascii("c") - 1)))
    return moved.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i0", "c"))), lambda s: s["c"]), "").alias("text"))


@query("select range as i0, 2 * range as v from range(512)")
def syncing(spark, d):
    b = index_space(spark, (512,), v=F.col("i0"))
    return kernels.parallel_for(b, v=F.col("v") * 2).df


@query("select a.range as i0, b.range as i1, case when a.range = b.range then 1.0 else 0.0 end::double as v, true as verified from range(48) a, range(48) b")
def matmul(spark, d):
    """The mirrored identity twice gives the identity back."""
    n, i, j = 48, F.col("i0"), F.col("i1")
    one = index_space(spark, (n, n), v=F.when(i == j, 1.0).otherwise(0.0))
    mirror = index_space(spark, (n, n), v=F.when(i + j == n - 1, 1.0).otherwise(0.0))
    out = kernels.contract(kernels.contract(one, mirror), mirror)
    return out.df.crossJoin(F.broadcast(equal_everywhere(out, one).withColumnRenamed("same", "verified")))


_TAPS = [math.exp(-(k * k) / 18.0) / math.sqrt(2 * 3.141592 * 9.0) for k in range(-8, 8)]


def _taps_sql(value: str, by: str) -> str:
    return " + ".join(f"{w!r} * coalesce({'lag' if k < 8 else 'lead'}({value}, {abs(k - 8)}) over {by}, 0)" for k, w in enumerate(_TAPS))


@query(f"""with {GREY}, n as (select max(i0) + 1 as n from grey), g as (select i0, i1, v / 255.0::double as v from grey),
x as (select i0, i1, {_taps_sql('v', 'c')} as v from g window c as (partition by i1 order by i0)),
y as (select i0, i1, {_taps_sql('v', 'r')} as v from x window r as (partition by i0 order by i1)),
blur as (select i0, i1, n, case when i0 < 8 or i1 < 8 or i0 > n - 9 or i1 > 55 then 0.0 else v end as v from y, n),
s as (select *, 5 * v - coalesce(lag(v) over r, 0) - coalesce(lead(v) over r, 0) - coalesce(lag(v) over c, 0) - coalesce(lead(v) over c, 0) as w from blur window r as (partition by i0 order by i1), c as (partition by i1 order by i0))
select i0, i1, round(case when i0 < 8 or i1 < 8 or i0 > n - 9 or i1 > 55 then 0.0 else least(1.0, w) end, 6) + 0.0 as v from s""")
def convolution(spark, d):
    """A Gaussian of 16 × 16 taps (-8 to 7), then a sharpening cross; both are 0 within eight cells of the border."""
    g = grey(spark, d)
    n, _ = g.extent()
    border = (F.col("i0") < 8) | (F.col("i1") < 8) | (F.col("i0") > n - 9) | (F.col("i1") > WIDTH - 9)
    b = kernels.separable(g.with_df(g.df.withColumn("v", F.col("v") / 255.0)), [_TAPS, _TAPS], [-8, -8])
    b = b.with_df(b.df.withColumn("v", F.when(border, 0.0).otherwise(F.col("v"))))
    sharp = kernels.stencil(b, CROSS, lambda near: 5 * near[0, 0] - near[-1, 0] - near[1, 0] - near[0, -1] - near[0, 1], "constant")
    return sharp.df.select("i0", "i1", rounded(F.when(border, 0.0).otherwise(F.least(F.lit(1.0), "v"))).alias("v"))


@query(f"with {GREY}, s as (select i0, i1, lag(v) over r + lead(v) over r + lag(v) over c + lead(v) over c - 4 * v as s from grey window r as (partition by i0 order by i1), c as (partition by i1 order by i0)) select i0, i1, 255 - greatest(0, s) as v from s where s is not null")
def edge_detection(spark, d):
    """Only the inside is computed: border cells stay unwritten."""
    out = kernels.stencil(grey(spark, d), CROSS, lambda near: F.lit(255) - F.greatest(F.lit(0), near[-1, 0] + near[1, 0] + near[0, -1] + near[0, 1] - 4 * near[0, 0]), "skip")
    n, m = cells(spark, d).extent()
    inside = (F.col("i0") >= 1) & (F.col("i0") < n - 1) & (F.col("i1") >= 1) & (F.col("i1") < m - 1)
    return out.df.where(inside)


@query("select a.range as i0, b.range as i1, a.range * 20 + b.range + 2 as v from range(256) a, range(20) b")
def independent_tasks(spark, d):
    """Two rounds, in each of which every column has a task of its own that adds one to it."""
    b = index_space(spark, (256, 20), v=F.col("i0") * 20 + F.col("i1"))
    for _ in range(2):
        add = sum(F.when(F.col("i1") == c, 1).otherwise(0) for c in range(20))
        b = kernels.parallel_for(b, v=F.col("v") + add)
    return b.df


def _blend_sql(src: str) -> str:
    return f"(select a.i0, a.i1, 0.5 * any_value(a.v) + 0.5 * avg(b.v) as v from {src} a join {src} b on abs(a.i0 - b.i0) <= 1 and abs(a.i1 - b.i1) <= 1 group by all)"


@query(f"with s0 as (select a.range as i0, b.range as i1, 1.0::double - (a.range + b.range) % 2 as v from range(128) a, range(128) b), s1 as {_blend_sql('s0')}, s2 as {_blend_sql('s1')} select i0, i1, round(v, 6) as v from s2")
def stencil_blend(spark, d):
    """Two rounds of a blend with the mean of the cells around, on a checkerboard."""
    b = index_space(spark, (128, 128), v=1.0 - (F.col("i0") + F.col("i1")) % 2)

    def blend(near):
        n = sum(F.when(c.isNotNull(), 1).otherwise(0) for c in near.values())
        return 0.5 * near[0, 0] + 0.5 * sum(F.coalesce(c, F.lit(0.0)) for c in near.values()) / n

    for _ in range(2):
        b = kernels.stencil(b, BOX, blend, "skip")
    return b.df.select("i0", "i1", F.round("v", 6).alias("v"))


_LAP = "(coalesce(lead(u) over r, u) - u) - (u - coalesce(lag(u) over r, u)) + (coalesce(lead(u) over c, u) - u) - (u - coalesce(lag(u) over c, u))"
_AXES = "window r as (partition by i0 order by i1), c as (partition by i1 order by i0)"


def _wave_sql(steps: int, n: int = 32) -> str:
    q = f"with w0 as (select a.range as i0, b.range as i1, exp(-(pow(b.range - {n / 4}, 2) + pow(a.range - {n / 4}, 2)) / {2 * (n / 8) ** 2}) as u from range({n}) a, range({n}) b), s0 as (select i0, i1, u, u + 0.5 * 0.0625 * ({_LAP}) as up from w0 {_AXES})"
    for k in range(steps):
        q += f", s{k + 1} as (select i0, i1, 2 * u - up + 0.0625 * ({_LAP}) as u, u as up from s{k} {_AXES})"
    return f"{q} select i0, i1, round(u, 6) + 0.0 as u from s{steps}"


@query(_wave_sql(6))
def wave_simulation(spark, d):
    """Leapfrog steps of the wave equation with clamped borders; the first half step writes the earlier state, without a swap."""
    n, c = 32, 0.0625
    i, j = F.col("i0"), F.col("i1")
    bump = F.exp(-(F.pow(j - n / 4, F.lit(2.0)) + F.pow(i - n / 4, F.lit(2.0))) / (2 * (n / 8) ** 2))
    state = index_space(spark, (n, n), u=bump, up=F.lit(0.0))

    def pull(near):
        u = F.col("u")
        return sum((near("u", dim, 1) - u) - (u - near("u", dim, -1)) for dim in (0, 1))

    state = supersteps(state, lambda near, t: {"up": F.col("u") + 0.5 * c * pull(near)}, 1)
    state = supersteps(state, lambda near, t: {"u": 2 * F.col("u") - F.col("up") + c * pull(near), "up": F.col("u")}, 6, per=3)
    return state.df.select("i0", "i1", rounded("u").alias("u"))


@query(f"with {CELLS} select i0, i1, v, true as same from cells")
def transposed_io(spark, d):
    """Written, transposed, written, transposed back: the same."""
    m = cells(spark, d)
    a, b = scratch(spark, "io"), scratch(spark, "io")
    save(kernels.transpose(m), a)
    save(kernels.transpose(load(spark, a, (WIDTH, None))), b)
    back = load(spark, b, (None, WIDTH))
    return back.df.crossJoin(F.broadcast(equal_everywhere(back, m)))


@query(f"with {CELLS} select i0 as vec, t.range as i0, i1, round(v, 6) + 0.0 as v from cells, range(4) t")
def radiosity(spark, d):
    """Each row is the mean of all rows before it; the first row is an embedding, of each one."""
    first = cells(spark, d).df.select(F.col("i0").alias("vec"), F.lit(0).cast("long").alias("i0"), "i1", "v")

    def step(rows, t):
        new = rows.groupBy("vec", "i1").agg((F.sum("v") / (t + 1)).alias("v")).select("vec", F.lit(t + 1).cast("long").alias("i0"), "i1", "v")
        return rows.unionByName(new)

    out = iterate(first, step, 3, checkpoint_every=2)
    return out.select("vec", "i0", "i1", rounded("v").alias("v"))


_SYSTEM = f"{CELLS}, n as (select count(distinct i0) as n from cells), m as (select a.i1 as i0, b.i1 as i1, sum(a.v * b.v) + case when a.i1 = b.i1 then 10 * any_value(n) else 0 end as v from cells a join cells b on a.i0 = b.i0, n group by a.i1, b.i1), b as (select p_partkey % 64 as i0, avg(p_retailprice) as y from part group by 1)"


def _sweep_sql(k: int) -> str:
    return f"x{k} as (select b.i0, (any_value(y) - sum(case when m.i0 = m.i1 then 0 else m.v * x end)) / any_value(d) as x from b join m on b.i0 = m.i0 join x{k - 1} x on x.i0 = m.i1 join (select i0 as di, v as d from m where i0 = i1) on di = b.i0 group by b.i0)"


@query(f"with {_SYSTEM}, x0 as (select i0, 0.0::double as x from b), {_sweep_sql(1)}, {_sweep_sql(2)}, {_sweep_sql(3)} select i0, round(x, 6) + 0.0 as x from x3")
def jacobi(spark, d):
    """Three sweeps on the Gram matrix of the embeddings, made diagonally dominant; the right side is means of all prices."""
    m = cells(spark, d)
    n = m.df.select("i0").distinct().count()
    gram = kernels.contract(m, m, a_dim=0, b_dim=0).df.withColumn("v", F.col("v") + F.when(F.col("i0") == F.col("i1"), 10.0 * n).otherwise(0.0))
    gram = cut(gram)
    y = parts(spark, d).df.groupBy((F.col("i0") % WIDTH).alias("i0")).agg(F.avg("v").alias("y"))
    diagonal = gram.where("i0 = i1").select("i0", F.col("v").alias("d"))

    def sweep(x, t):
        rest = gram.where("i0 <> i1").join(x.select(F.col("i0").alias("i1"), "x"), "i1").groupBy("i0").agg(F.sum(F.col("v") * F.col("x")).alias("s"))
        return y.join(diagonal, "i0").join(rest, "i0").select("i0", ((F.col("y") - F.col("s")) / F.col("d")).alias("x"))

    out = iterate(y.select("i0", F.lit(0.0).alias("x")), sweep, 3)
    return out.select("i0", rounded("x").alias("x"))


@query("with k as (select ceil(log2(max(p_retailprice) / 100))::int as k from part) select p_partkey as i0, round(p_retailprice / pow(2, k), 6) as v, k::bigint as steps from part, k")
def convergence_loop(spark, d):
    """Halved until the largest value is at most 100: a reduction decides each round."""
    out, steps, _ = until(parts(spark, d).df, lambda s, t: s.withColumn("v", F.col("v") / 2), lambda s: F.max("v"), lambda m: m <= 100)
    return out.select("i0", F.round("v", 6).alias("v"), F.lit(steps).cast("long").alias("steps"))


@query("""with n as (select max(event_id) + 1 as n from events), e as (select event_id, value, n // 4 as each, n % 4 as more, n from events, n),
p as (select *, case when event_id < more * (each + 1) then event_id // (each + 1) else more + (event_id - more * (each + 1)) // each end as part from e)
select part, min(event_id) as first, count(*) as extent, any_value(n) as size, round(sum(value), 4) as v from p group by part""")
def host_partitions(spark, d):
    """A host function for each of four runs, told its place."""

    def total(p: host.Partition, cells: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [p.index], "first": [p.offset], "extent": [p.extent], "size": [p.size], "v": [round(float(cells["v"].sum()), 4)]})

    return host.partitioned(events(spark, d), 4, total, "part long, first long, extent long, size long, v double")


@query("select 2::bigint as nodes, count(*) as n from events")
def host_collective(spark, d):
    """Two tasks that start together; each counts its rows."""
    found = host.collective(events(spark, d).df, lambda node, nodes, rows: iter([(node, nodes, sum(1 for _ in rows))]), 2)
    return spark.createDataFrame([(max(f[1] for f in found), sum(f[2] for f in found))], "nodes long, n long")


def wave_program(steps: int = 3, n: int = 64) -> Program:
    p = Program()
    u, up = p.buffer("u", (n, n)), p.buffer("up", (n, n))
    near = Neighborhood((1, 1), along_axes=True)
    p.submit("setup", (n, n), [Access(u, "discard_write", OneToOne())])
    p.submit("zero", (n, n), [Access(up, "discard_write", OneToOne())])
    for k in range(steps):
        p.submit(f"step {k}", (n, n), [Access(up, "read_write", OneToOne()), Access(u, "read", near)])
        u, up = up, u
    return p


@query("select * from (values (3::bigint, 2::bigint, 'true', 'up'), (3, 1, 'true', 'u'), (4, 1, 'true', 'u'), (4, 3, 'anti', 'u'), (4, 3, 'true', 'up'), (5, 3, 'true', 'up'), (5, 4, 'anti', 'up'), (5, 4, 'true', 'u')) t(task, on_task, kind, buffer)")
def task_graph(spark, d):
    """What each task of a wave simulation waits for."""
    return spark.createDataFrame([(x.task, x.on, x.kind, x.buffer) for x in wave_program().dependencies], "task long, on_task long, kind string, buffer string")


@query("select * from (values (0::bigint, 1::bigint, 64::bigint), (1, 0, 64), (1, 2, 64), (2, 1, 64), (2, 3, 64), (3, 2, 64)) t(source, target, cells)")
def halo_exchange(spark, d):
    """Cells that neighbouring chunks of a stencil need from one another."""
    p = wave_program()
    task = p.tasks[2]
    owners = {"u": [OneToOne().region(c, (64, 64)) for c in task.chunks(4)]}
    rows = [(a, b, n) for buffer, a, b, n in p.transfers(task, 4, owners) if buffer == "u"]
    return spark.createDataFrame(rows, "source long, target long, cells long")


@query("select * from (values ('out', 0::bigint, 1::bigint, 16::bigint), ('out', 1, 2, 16), ('out', 2, 3, 16)) t(buffer, a, b, cells)")
def overlapping_writes(spark, d):
    """Chunks that would write the same cells."""
    p = Program()
    p.buffer("out", (32, 16))
    grown = Custom(lambda c: Box((c.offset[0], 0), (c.offset[0] + c.range[0] + 1, 16)))
    t = p.submit("bad", (32, 16), [Access("out", "discard_write", grown)])
    rows = [(b, i, j, r.area) for b, i, j, r in p.overlapping_writes(t, 4)]
    return spark.createDataFrame(rows, "buffer string, a long, b long, cells long")


@query("select 1::bigint as warned, 0::bigint as never_again")
def uninitialised_reads(spark, d):
    """A read of cells that no task wrote is told; a read after the write isn't."""
    p = Program()
    p.buffer("a", (10,))
    p.submit("half", (5,), [Access("a", "discard_write", OneToOne())])
    p.submit("all", (10,), [Access("a", "read", All())])
    first = len(p.warnings)
    p.submit("rest", (10,), [Access("a", "discard_write", OneToOne())])
    p.submit("again", (10,), [Access("a", "read", OneToOne())])
    assert OneToOne().region(Chunk((0,), (10,), (10,)), (10,)).area == 10
    return spark.createDataFrame([(first, len(p.warnings) - first)], "warned long, never_again long")


@query("select * from (values ('soup', 100::bigint, 1::bigint), ('chain', 30, 30), ('expanding tree', 31, 5), ('contracting tree', 31, 5), ('wave', 203, 202), ('jacobi', 51, 51)) t(topology, tasks, depth)")
def task_graph_topologies(spark, d):
    """The number of tasks of typical programs, and of those on their longest chain."""
    rows = [(name, len(p.tasks), p.critical_path()) for name, p in ((name, make()) for name, make in TOPOLOGIES.items())]
    return spark.createDataFrame(rows, "topology string, tasks long, depth long")
