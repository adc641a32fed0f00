"""What happens on the driver: fences, host objects, the queue, constraints, regions and coordinates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.points import Point
from ..operators import host, kernels
from ..operators.buffer import from_host, index_space, scalar
from ..operators.groups import Groups
from ..operators.host import HostObject
from ..operators.mappers import Custom, OneToOne
from ..operators.reductions import reduction
from ..operators.regions import Box, Region, RegionBuilder, RegionMap, bounding_box, connected_bounding_boxes, merged_overlapping
from ..plans.program import MODES, Access, Program
from ..plans.queue import Queue
from ..sources.files import table
from .common import CELLS, cells, events, parts, query


@query(f"with {CELLS} select i0 - 100 as i0, i1 - 10 as i1, v from cells where i0 between 100 and 119 and i1 between 10 and 13")
def snapshot_box(spark, d):
    """A copy of a box on the driver, made in the background, and read from its corner."""
    taken = host.fence(cells(spark, d), [100, 10], [20, 4]).result()
    return from_host(spark, taken).df


@query("select n_nationkey as i0, n_regionkey + 1 as v from nation")
def fence_buffer(spark, d):
    """A snapshot of a whole buffer after the command groups before it; a later one doesn't change it."""
    q = Queue("infinite")
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i0"), F.col("n_regionkey").cast("long").alias("v"))
    q.bind("n", index_space(spark, (25,), v=F.lit(0)).with_df(nations))
    q.submit("add", "n", lambda b: kernels.parallel_for(b, v=F.col("v") + 1), "n")
    taken = q.fence("n")
    q.submit("clear", "n", lambda b: kernels.parallel_for(b, v=F.lit(0).cast("long")), "n")
    return from_host(spark, taken.result()).df


@query("select * from (values (0::bigint, 1::bigint, 3::bigint)) t(first, between_, last)")
def fence_host_object(spark, d):
    """Copies of a host object between its tasks; a task that takes no value only keeps the order."""
    q, state, token = Queue(), HostObject([]), HostObject()
    begun = q.fence(state)
    q.host_task("one", state, lambda v: v.append(1))
    between = q.fence(state)
    q.host_task("token", token, lambda v: None)
    for _ in range(2):
        q.host_task("more", state, lambda v: v.append(2))
    rows = [tuple(len(x.result()) for x in (begun, between, q.fence(state)))]
    assert q.log == ["one", "token", "more", "more"] and token.log == ["token"]
    return spark.createDataFrame(rows, "first long, between_ long, last long")


@query("select count(*) as n, 1::bigint as times from nation")
def host_once(spark, d):
    """A task that runs one time, on the driver, with what a job gives."""
    seen = []
    n = host.once(lambda: (seen.append(1), table(spark, d, "nation").count())[1])
    return spark.createDataFrame([(n, len(seen))], "n long, times long")


@query("""with e as (select event_id, value from events where event_id between 100 and 349)
select (case when event_id < 184 then 0 when event_id < 267 then 1 else 2 end)::bigint as part, min(event_id) as first, count(*) as extent, round(sum(value), 4) as v from e group by 1""")
def host_partitions_with_offset(spark, d):
    """A host function for three runs of a box; coordinates stay absolute."""

    def total(p: host.Partition, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [p.index], "first": [p.offset], "extent": [p.extent], "v": [round(float(rows["v"].sum()), 4)]})

    return host.partitioned(events(spark, d), 3, total, "part long, first long, extent long, v double", [100], [250])


@query("select p_partkey as i0, p_retailprice * 8 as v, 4::bigint as tasks from part")
def queue_lookahead(spark, d):
    """The same command groups whatever is made when: lazily, at once, or every other version; then flushed and waited for."""
    out = []
    for lookahead in ("infinite", "none", "automatic"):
        q = Queue(lookahead, horizon=2)
        q.bind("a", parts(spark, d))
        for k in range(3):
            q.submit(f"double {k}", "a", lambda b: kernels.parallel_for(b, v=F.col("v") * 2), "a")
        q.flush()
        q.wait(barrier=lookahead == "none")
        q.submit("name", "a", lambda b: b, "a")
        out.append((q.named("a").df, len(q.log)))
    first = out[0][0]
    assert all(first.exceptAll(df).isEmpty() for df, _ in out[1:])
    return first.select("i0", "v", F.lit(out[0][1]).cast("long").alias("tasks"))


@query("select max(value) as v, 2::bigint as submitted from events")
def reduction_overwritten(spark, d):
    """A pending fold that a later one overwrites is never made."""
    e = events(spark, d)
    q = Queue("infinite")
    q.bind("s", scalar(spark, 0.0))
    jobs = spark.sparkContext.statusTracker()
    before = len(jobs.getJobIdsForGroup(None))
    q.submit("sum", "s", lambda: scalar(spark, 0.0).with_df(reduction(e, v=("plus", F.col("v")))))
    q.submit("most", "s", lambda: scalar(spark, 0.0).with_df(reduction(e, v=("maximum", F.col("v")))))
    assert len(jobs.getJobIdsForGroup(None)) == before
    return q.buffers["s"].df.select("v", F.lit(len(q.log)).cast("long").alias("submitted"))


@query("select * from (values ('discard_read_write', false, true), ('discard_write', false, true), ('read', true, false), ('read_write', true, true), ('write', true, true)) t(mode, reads, writes)")
def access_modes(spark, d):
    rows = [(m, a.reads, a.writes) for m in MODES for a in [Access("b", m, OneToOne())]]
    return spark.createDataFrame(rows, "mode string, reads boolean, writes boolean")


@query("select a.range as i0, b.range as i1, (a.range // 2 * 2 + 1) * 12 + b.range // 3 * 3 + 2 as v from range(8) a, range(12) b")
def group_broadcast_by_coordinates(spark, d):
    """The value of the lane at a place of two dimensions."""
    g = Groups(index_space(spark, (8, 12), v=F.col("i0") * 12 + F.col("i1")), (2, 3))
    return g.df.select("i0", "i1", g.broadcast("v", (1, 2)).alias("v"))


@query("select * from (values ('lcm', 24::bigint, 4::bigint), ('refused', 0, 0), ('repeated hint', 0, 0)) t(what, granularity, chunks)")
def split_constraints(spark, d):
    """The least granularity of a group size and a constraint; what doesn't divide the range is refused, and so are two splits."""
    p, rows = Program(), []
    p.buffer("b", (96,))
    t = p.submit("t", (96,), [Access("b", "discard_write", OneToOne())], local=(8,), constraint=(6,))
    rows.append(("lcm", t.granularity()[0], len(t.chunks(9))))
    for what, bad in (("refused", {"constraint": (7,)}), ("repeated hint", {"hints": {"split_1d": True, "split_2d": True}})):
        try:
            p.submit("bad", (96,), **bad)
        except ValueError:
            rows.append((what, 0, 0))
    return spark.createDataFrame(rows, "what string, granularity long, chunks long")


@query("select * from (values (2::bigint, 1::bigint, 'group g'), (4, 3, 'log'), (5, 2, 'group g')) t(task, on_task, what)")
def ordered_tasks(spark, d):
    """Collective tasks of a group, and tasks that share a host object, follow one another."""
    p = Program()
    p.submit("all 1", (4,), collective=True, group="g"), p.submit("all 2", (4,), collective=True, group="g")
    p.submit("note", (1,), objects=("log",)), p.submit("more", (1,), objects=("log",))
    p.submit("all 3", (4,), collective=True, group="g"), p.submit("other", (4,), collective=True, group="h")
    return spark.createDataFrame([(x.task, x.on, x.buffer) for x in p.dependencies if x.kind == "order"], "task long, on_task long, what string")


_SLABS = "x as (select distinct k, unnest(range(min0, max0)) as i0, i1 from (select k, min0, max0, unnest(range(min1, max1)) as i1 from b))"


@query(f"""with b as (select s_nationkey::bigint as k, s_suppkey % 23 as min0, s_suppkey * 7 % 19 as min1, s_suppkey % 23 + s_suppkey % 4 + 1 as max0, s_suppkey * 7 % 19 + s_suppkey % 5 + 1 as max1 from supplier), {_SLABS},
f as (select k, i0, min(i1) as min1, max(i1) + 1 as max1 from (select *, i1 - row_number() over (partition by k, i0 order by i1) as g from x) group by k, i0, g)
select k, min(i0) as min0, max(i0) + 1 as max0, min1, max1 from (select *, i0 - row_number() over (partition by k, min1, max1 order by i0) as g from f) group by k, min1, max1, g""")
def region_normalised(spark, d):
    """The boxes of each nation's suppliers, collected one after another, in canonical form."""
    k = F.col("s_suppkey")
    boxes = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("k"), (k % 23).alias("min0"), (k * 7 % 19).alias("min1"), (k % 23 + k % 4 + 1).alias("max0"), (k * 7 % 19 + k % 5 + 1).alias("max1"))

    def normalised(pdf: pd.DataFrame) -> pd.DataFrame:
        builder = RegionBuilder()
        for r in pdf.itertuples():
            builder.add(Box((r.min0, r.min1), (r.max0, r.max1)))
        return pd.DataFrame([(pdf["k"].iat[0], b.min[0], b.max[0], b.min[1], b.max[1]) for b in builder.build().boxes], columns=["k", "min0", "max0", "min1", "max1"])

    return boxes.groupBy("k").applyInPandas(normalised, "k long, min0 long, max0 long, min1 long, max1 long")


#: Three parts: two boxes with a common edge, one that touches them in a corner only, and one that overlaps it.
_PARTS = [((0, 0), (2, 2)), ((2, 0), (4, 1)), ((4, 1), (6, 3)), ((5, 2), (8, 4)), ((20, 20), (21, 22))]


@query("select * from (values ('connected', 0::bigint, 0::bigint, 4::bigint, 2::bigint), ('connected', 4, 1, 8, 4), ('connected', 20, 20, 21, 22), ('merged', 0, 0, 2, 2), ('merged', 2, 0, 4, 1), ('merged', 4, 1, 8, 4), ('merged', 20, 20, 21, 22), ('all', 0, 0, 21, 22)) t(what, min0, min1, max0, max1)")
def connected_and_merged_boxes(spark, d):
    """Bounding boxes of connected parts (by edges, not corners), of boxes that overlap, and of all."""
    boxes = [Box(a, b) for a, b in _PARTS]
    found = [("connected", b) for b in connected_bounding_boxes(Region.of(*boxes))] + [("merged", b) for b in merged_overlapping(boxes)] + [("all", bounding_box(boxes))]
    return spark.createDataFrame([(w, *b.min, *b.max) for w, b in found], "what string, min0 long, min1 long, max0 long, max1 long")


@query("select * from (values (0::bigint, 4::bigint, 'a'), (4, 6, 'b'), (6, 10, 'a')) t(lo, hi, value)")
def applied_map(spark, d):
    """A function of all values of a region map; parts whose values have become equal are one."""
    m = RegionMap((10,), 0)
    m.update(Box((2,), (4,)), 2), m.update(Box((4,), (6,)), 1), m.update(Box((8,), (99,)), 4)
    m.apply(lambda v: "ab"[v % 2])
    return spark.createDataFrame([(b.min[0], b.max[0], v) for b, v in m.values(Box((0,), (10,)))], "lo long, hi long, value string")


@query("""select n_nationkey as k, n_nationkey + 3 as plus, 100 - n_nationkey as minus, n_nationkey * n_regionkey as times, n_nationkey // 4 as each, n_nationkey % 4 as rest, n_nationkey << 2 as shifted, n_nationkey & 5 as both_, n_nationkey | 8 as either, xor(n_nationkey, 3) as other,
least(n_nationkey, n_regionkey) as low, greatest(n_nationkey, n_regionkey) as high, n_regionkey < n_nationkey as below, n_nationkey * 10 + n_regionkey as linear, 1 as added, 2 as dims from nation""")
def coordinate_arithmetic(spark, d):
    """Points of two dimensions (key, region): arithmetic, bits, comparisons, extremes, linear numbers and casts."""

    def computed(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for k, r in zip(pdf["k"].tolist(), pdf["r"].tolist(), strict=True):
            p, q = Point(k, r), Point(r, k)
            rows.append((k, (p + 3)[0], (100 - p)[0], (p * q)[0], (p // 4)[0], (p % 4)[0], (p << 2)[0], (p & 5)[0], (p | 8)[0], (p ^ 3)[0], p.min(q)[0], p.max(q)[0], q.less(p)[0], p.linear((25, 10)), p.cast(3, 1)[2], len(p.cast(3).cast(2))))
        return pd.DataFrame(rows, columns=out)

    out = "k plus minus times each rest shifted both_ either other low high below linear added dims".split()
    kinds = {"below": "boolean", "added": "int", "dims": "int"}
    points = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_regionkey").cast("long").alias("r"))
    return points.mapInPandas(lambda batches: map(computed, batches), ", ".join(f"{c} {kinds.get(c, 'long')}" for c in out))


@query("select * from (values ('out of bounds', 1::bigint), ('inside', 0)) t(what, found)")
def undeclared_cells(spark, d):
    """Cells that a kernel's function uses beside those that it declared."""
    p = Program()
    p.buffer("b", (32,), initialised=True)
    t = p.submit("shifted", (32,), [Access("b", "read", OneToOne())])
    used = {"out of bounds": Custom(lambda c: Box.at((c.offset[0],), (c.range[0] + 1,))), "inside": OneToOne()}
    return spark.createDataFrame([(k, len(p.undeclared(t, {"b": m}, 4)) and 1) for k, m in used.items()], "what string, found long")
