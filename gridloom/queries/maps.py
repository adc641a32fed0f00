"""Sources, sinks, maps over index spaces, and snapshots."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.coordinates import group_columns, linear_id
from ..operators import kernels
from ..operators.buffer import from_host, index_space, scalar
from ..operators.host import each_item, windowed
from ..sources.files import decoded_grey, load, save, save_grey, scratch
from ..sources.images import CHANNELS, read_image, save_image
from ..streaming.frames import FrameSink, pack_frames, read_frames, unpack_frames
from .common import CELLS, GREY, WIDTH, byte, cells, events, orders, parts, query, rounded


@query(f"with {CELLS} select i0, i1, v from cells")
def source_array_column(spark, d):
    return cells(spark, d).df


@query("select event_id as i0, value + 0.0 as v from events")
def source_columns(spark, d):
    return events(spark, d).df.select("i0", (F.col("v") + 0.0).alias("v"))


@query("select a.range as i0, b.range as i1, c.range as i2, case when a.range = 1 and b.range = 2 and c.range = 3 then 42 else 0 end::bigint as v from range(5) a, range(4) b, range(7) c")
def source_host_array(spark, d):
    array = np.zeros((5, 4, 7), np.int64)
    array[1, 2, 3] = 42
    return from_host(spark, array).df


@query("select 42.0::double as before, 13.37::double as v where 42.0 > 13.37")
def scalar_write(spark, d):
    before = scalar(spark, 42.0, "double")
    return kernels.with_scalar(scalar(spark, 13.37, "double"), before.with_df(before.df.withColumnRenamed("v", "before"), ["before"])).df.select("before", "v")


@query("select a.range as i0, b.range as i1, a.range * 96 + b.range as id, case when a.range = b.range then 1 else 0 end::bigint as identity, (a.range + b.range + 1) % 2 as checker from range(128) a, range(96) b")
def index_space_2d(spark, d):
    i, j = F.col("i0"), F.col("i1")
    return index_space(spark, (128, 96), id=i * 96 + j, identity=F.when(i == j, 1).otherwise(0).cast("long"), checker=(i + j + 1) % 2).df


@query("select event_id as i0, round(sin(value), 6) + 0.0 as v from events")
def map_sine(spark, d):
    b = events(spark, d)
    return kernels.parallel_for(b, v=rounded(F.sin("v"))).df


@query("select o_orderkey as i0, round(o_totalprice * 2, 4) as v, o_orderkey - 100 as id from orders where o_orderkey between 100 and 599")
def map_with_offset(spark, d):
    b = orders(spark, d)
    return kernels.parallel_for(b, [100], [500], v=F.round(F.col("v") * 2, 4), id=linear_id((500,), (100,))).df


@query("select event_id as i0, case when value >= 50 then value else 0 end as v from events")
def map_condition(spark, d):
    """A kernel's condition sets values; no cell goes away."""
    return kernels.parallel_for(events(spark, d), v=F.when(F.col("v") >= 50, F.col("v")).otherwise(0.0)).df


@query(f"with {CELLS} select i0, i1, i0 * 64 + i1 as id from cells")
def linear_ids(spark, d):
    return kernels.parallel_for(cells(spark, d), id=linear_id((0, WIDTH))).df


@query("""
select a.range as i0, b.range as i1, c.range as i2, a.range // 3 as g0, b.range // 5 as g1, c.range // 11 as g2, a.range % 3 as l0, b.range % 5 as l1, c.range % 11 as l2,
  ((a.range // 3) * 3 + b.range // 5) * 2 + c.range // 11 as "group", ((a.range % 3) * 5 + b.range % 5) * 11 + c.range % 11 as lane
from range(12) a, range(15) b, range(22) c""")
def group_geometry(spark, d):
    shape, local = (12, 15, 22), (3, 5, 11)
    return index_space(spark, shape).df.withColumns(group_columns(shape, local))


@query(f"with {CELLS} select i0, i1, round(sqrt(abs(v)), 6) as v from cells")
def host_each_item(spark, d):
    return each_item(cells(spark, d), lambda p: p.assign(v=np.round(np.sqrt(np.abs(p["v"])), 6)), "i0 long, i1 long, v double")


@query(f"with {CELLS} select i0 - 100 as i0, i1 - 10 as i1, v from cells where i0 between 100 and 119 and i1 between 10 and 13")
def box_of_cells(spark, d):
    """A box as a filter, counted from its corner."""
    return cells(spark, d).box([100, 10], [20, 4], rebase=True).df


@query(f"with {CELLS} select i1 as i0, i0 as i1, v from cells")
def transpose(spark, d):
    return kernels.transpose(cells(spark, d)).df


@query(f"with {CELLS} select i0, v from cells where i1 = 7")
def column_select(spark, d):
    return cells(spark, d).df.where("i1 = 7").select("i0", "v")


@query(f"""with {CELLS}, n as (select max(i0) + 1 as n from cells), b as (select i0, i1, v, n // 4 as each, n % 4 as more from cells, n),
p as (select *, case when i0 < more * (each + 1) then i0 // (each + 1) else more + (i0 - more * (each + 1)) // each end as part from b)
select i0, i1, v, part, part * each + least(part, more) as window_offset, (i0 - (part * each + least(part, more))) * 64 + i1 as linear from p""")
def allocation_window(spark, d):
    return windowed(cells(spark, d), 4)


@query(f"with {CELLS} select i0, i1, v from cells where i0 >= 50")
def parquet_round_trip(spark, d):
    path = scratch(spark, "cells")
    save(cells(spark, d), path)
    return load(spark, path, (None, WIDTH)).df.where("i0 >= 50")


@query(f"with {GREY} select i0, i1, v from grey")
def image_round_trip(spark, d):
    b = cells(spark, d)
    path = scratch(spark, "grey")
    save_grey(b.with_df(b.df.withColumn("v", byte("v"))), path)
    return decoded_grey(spark.read.parquet(path)).df


@query(f"with {GREY} select i0, i1, v as r, 255 - v as g, ((i0 + i1) % 256)::int as b from grey")
def colour_image_round_trip(spark, d):
    """Interleaved channels, written as one PNG and read as an image."""
    b, path = cells(spark, d), scratch(spark, "colours") + ".png"
    save_image(b.with_df(b.df.select("i0", "i1", byte("v").alias("r"), (255 - byte("v")).alias("g"), ((F.col("i0") + F.col("i1")) % 256).cast("int").alias("b")), CHANNELS[3]), path)
    return read_image(spark, path).df


@query("select f.range as frame, p_partkey as i0, p_retailprice * pow(2, f.range) as v from part, range(3) f")
def packed_frames(spark, d):
    """A loop's frames in one file with a header."""
    path = scratch(spark, "frames")
    sink, b = FrameSink(path), parts(spark, d)
    for _ in range(3):
        sink.append(b)
        b = b.with_df(b.df.withColumn("v", F.col("v") * 2))
    sink.close()
    pack_frames(spark, path, path + ".bin", kind="<f8")
    return unpack_frames(spark, path + ".bin", sink.extent, "<f8")


@query("select f.range as frame, p_partkey as i0, round(p_retailprice * pow(2, f.range), 4) as v from part, range(3) f")
def frame_sink(spark, d):
    """A loop's frames, appended one after another to one table."""
    path = scratch(spark, "frames")
    sink, b = FrameSink(path), parts(spark, d)
    for _ in range(3):
        sink.append(b)
        b = b.with_df(b.df.withColumn("v", F.col("v") * 2))
    sink.close()
    return read_frames(spark, path).select(F.col("frame").cast("long").alias("frame"), "i0", F.round("v", 4).alias("v"))
