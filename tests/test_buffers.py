"""Buffers, kernels and loops on small arrays against NumPy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import host, kernels
from gridloom.operators.buffer import Buffer, from_columns, from_host, index_space, scalar
from gridloom.operators.groups import Groups
from gridloom.operators.reductions import combined, reduction
from gridloom.plans.loops import iterate, supersteps, until
from gridloom.sources import images
from gridloom.sources.files import decoded_grey
from gridloom.streaming.frames import FrameSink, pack_frames, read_frames, read_header, stream_frames, unpack_frames


def array_of(buffer, shape):
    return Buffer(buffer.df, shape, buffer.values).snapshot()


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(7).random((23, 19))


def test_snapshots(spark):
    a = np.arange(16).reshape(4, 4)
    b = from_host(spark, a)
    assert (b.snapshot() == a).all()
    assert b.snapshot((0, 3), (1, 1)).tolist() == [[3]] and b.snapshot((2, 2), (2, 1)).tolist() == [[10], [14]]
    assert (host.fence(b, (1, 1), (2, 2)).result() == a[1:3, 1:3]).all()
    with pytest.raises(ValueError):
        b.snapshot(most=3)
    b.check_dense()
    for bad in (b.with_df(b.df.where("i0 + i1 > 0")), b.with_df(b.df.union(b.df))):
        with pytest.raises(ValueError):
            bad.check_dense()
    with pytest.raises(ValueError):
        Buffer(b.df, (1, 1, 1, 1))


def test_scalars(spark):
    s = scalar(spark, 13.37, "double")
    assert s.df.collect()[0].v == 13.37 and s.snapshot().tolist() == 13.37
    with pytest.raises(ValueError):
        kernels.with_scalar(s, index_space(spark, (3,), v=F.lit(1)))


@pytest.mark.parametrize("border", ["skip", "edge", "constant"])
@pytest.mark.parametrize("tile", [(4, 4), (8, 256)])
def test_stencils_across_tiles(spark, image, border, tile):
    taps = [(a, b) for a in (-2, 0, 1) for b in (-1, 0, 2)]
    out = kernels.stencil(from_host(spark, image), taps, lambda near: sum(F.coalesce(c, F.lit(0.0)) for c in near.values()), border, 0.5, tile=tile)
    want = np.zeros_like(image)
    n, m = image.shape
    for (i, j), _ in np.ndenumerate(image):
        for a, b in taps:
            x, y = i + a, j + b
            inside = 0 <= x < n and 0 <= y < m
            want[i, j] += image[x, y] if inside else {"skip": 0, "constant": 0.5, "edge": image[min(max(x, 0), n - 1), min(max(y, 0), m - 1)]}[border]
    assert np.allclose(array_of(out, image.shape), want)
    assert out.df.count() == image.size


def test_wrong_stencils(spark, image):
    b = from_host(spark, image)
    with pytest.raises(ValueError):
        kernels.stencil(b, [(0, 0)], lambda near: near[0, 0], "mirror")
    with pytest.raises(ValueError):
        kernels.stencil(b, [(5, 0)], lambda near: near[5, 0], tile=(8, 8))


def test_separable_is_the_product(spark, image):
    w = [0.1, 0.5, 0.3, 0.2]
    out = kernels.separable(from_host(spark, image), [w, w], [-2, -2], tile=(8, 8))
    want = np.zeros_like(image)
    padded = np.pad(image, 4)
    for a in range(4):
        for b in range(4):
            want += w[a] * w[b] * padded[4 + a - 2 : 4 + a - 2 + 23, 4 + b - 2 : 4 + b - 2 + 19]
    assert np.allclose(array_of(out, image.shape), want)


@pytest.mark.parametrize("border", ["skip", "edge", "constant"])
def test_dense_stencils(spark, image, border):
    w = np.random.default_rng(3).normal(size=(3, 6))
    out = kernels.dense_stencil(from_host(spark, image), w, [-2, -1], border, 0.5, tile=(8, 8))
    pad = {"mode": "edge"} if border == "edge" else {"constant_values": 0.5 if border == "constant" else 0.0}
    p = np.pad(image, 6, **pad)
    want = sum(w[a, b] * p[6 + a - 2 : 6 + a - 2 + 23, 6 + b - 1 : 6 + b - 1 + 19] for a in range(3) for b in range(6))
    assert np.allclose(array_of(out, image.shape), want)


def test_products(spark, image):
    a, b = image, image.T[:, :11].copy()
    x, y = from_host(spark, a), from_host(spark, b)
    assert np.allclose(array_of(kernels.contract(x, y), (23, 11)), a @ b)
    assert np.allclose(array_of(kernels.contract_tiled(x, y, tile=8), (23, 11)), a @ b)


def test_scan_in_several_levels(spark):
    df = spark.range(1000).selectExpr("id", "id * 3 % 7 as x", "id % 2 as k")
    out = kernels.scan(df.select("id", "x"), "id", "x", block=5).orderBy("id").collect()
    assert [r.scan for r in out] == np.cumsum([i * 3 % 7 for i in range(1000)]).tolist()
    assert [r.scan for r in kernels.scan(df.select("id", "x"), "id", "x", inclusive=False, block=7).orderBy("id").limit(3).collect()] == [0, 0, 3]


def test_custom_fold(spark):
    df = spark.range(5000).selectExpr("id", "id * id % 97 as x")
    out = combined(df, "id", "x", F.lit(0).cast("long"), lambda a, b: F.greatest(a, b), fan=8).first().v
    assert out == max(i * i % 97 for i in range(5000))
    assert combined(df.where("false"), "id", "x", F.lit(5).cast("long"), lambda a, b: a + b).first().v == 5


def test_reduction_target(spark):
    b = index_space(spark, (10,), v=F.lit(1))
    with pytest.raises(ValueError):
        reduction(b, index_space(spark, (2,), v=F.lit(1)), v=("plus", "v"))
    assert reduction(index_space(spark, (1000,), v=F.col("i0")), v=("plus", F.col("v") + 1), m=("maximum", F.col("v") + 1)).first() == (500500, 1000)


def test_group_sizes(spark):
    with pytest.raises(ValueError):
        Groups(index_space(spark, (10,), v=F.lit(1)), (3,))
    g = Groups(index_space(spark, (64,), v=F.col("i0")), (32,))
    got = [r.r for r in g.df.select("i0", g.select_from("v", 31 - F.col("lane")).alias("r")).orderBy("i0").collect()]
    assert got == [i // 32 * 32 + 31 - i % 32 for i in range(64)]
    g = Groups(index_space(spark, (4, 6), v=F.col("i0") * 6 + F.col("i1")), (2, 3))
    assert {r.b for r in g.df.select(g.broadcast("v", (1, 2)).alias("b")).collect()} == {8, 11, 20, 23}


def test_updates(spark):
    b = from_host(spark, np.zeros(6, np.int64))
    new = from_columns(spark.createDataFrame([(2, 5), (9, 6)], "k long, x long"), ["k"], v="x")
    assert sorted(map(tuple, kernels.update(b, new).df.collect())) == [(0, 0), (1, 0), (2, 5), (3, 0), (4, 0), (5, 0), (9, 6)]
    assert sorted(map(tuple, kernels.discard_write(b, new, [1], [3]).df.collect())) == [(0, 0), (2, 5), (4, 0), (5, 0)]


def test_supersteps_match_single_steps(spark, image):
    def step(near, t):
        return {"v": F.col("v") + 0.1 * (near("v", 0, 1) + near("v", 0, -1) + near("v", 1, 1) + near("v", 1, -1) - 4 * F.col("v"))}

    got = array_of(supersteps(from_host(spark, image), step, 5, per=3, tile=(8, 8)), image.shape)
    want = image
    for _ in range(5):
        p = np.pad(want, 1, mode="edge")
        want = want + 0.1 * (p[2:, 1:-1] + p[:-2, 1:-1] + p[1:-1, 2:] + p[1:-1, :-2] - 4 * want)
    assert np.allclose(got, want)


def test_loops(spark):
    df = spark.range(4).selectExpr("id", "id + 1.0D as v")
    assert [r.v for r in iterate(df, lambda s, t: s.withColumn("v", F.col("v") + t), 5, checkpoint_every=2).orderBy("id").collect()] == [11, 12, 13, 14]
    out, steps, last = until(df, lambda s, t: s.withColumn("v", F.col("v") / 2), lambda s: F.max("v"), lambda m: m < 0.6)
    assert (steps, last) == (3, 0.5) and out.count() == 4


def test_host_objects(spark):
    seen = host.HostObject([])
    for k in range(3):
        seen.run(lambda v, k=k: v.append(k), f"task {k}")
    assert seen.value == [0, 1, 2] and seen.log == ["task 0", "task 1", "task 2"] and host.once(lambda: 5) == 5


def test_images(spark):
    raw = b"P5\n3 2\n255\n" + bytes([0, 1, 2, 253, 254, 255])
    df = spark.createDataFrame([(10, bytearray(raw))], "first long, content binary")
    assert sorted(map(tuple, decoded_grey(df).df.collect())) == [(10, 0, 0), (10, 1, 1), (10, 2, 2), (11, 0, 253), (11, 1, 254), (11, 2, 255)]


@pytest.mark.parametrize("n", [1, 3, 4])
def test_image_files(spark, tmp_path, n, monkeypatch):
    monkeypatch.setattr(images, "STRIP", 19 * 4)  # strips of a few lines, some without any cell
    names, a = images.CHANNELS[n], np.random.default_rng(n).integers(0, 256, (23, 19, n))
    a[8:16] = 0
    i, j = (x.ravel() for x in np.indices((23, 19)))
    rows = [(int(x), int(y), *map(int, a[x, y])) for x, y in zip(i, j, strict=True) if not 8 <= x < 16]
    b = Buffer(spark.createDataFrame(rows, "i0 long, i1 long, " + ", ".join(f"{c} int" for c in names)), (23, 19), names)
    path = str(tmp_path / "a.png")
    images.save_image(b, path)
    got = images.read_image(spark, path, n)
    assert got.extent() == (23, 19)
    for k, c in enumerate(names):
        assert (array_of(got.with_df(got.df.select("i0", "i1", c), [c]), (23, 19)) == a[:, :, k]).all()
    if n == 3:
        grey = array_of(images.read_image(spark, path, 1), (23, 19))
        assert (grey == (a @ np.array(images.LUMA) >> 8)).all()
        assert images.read_image(spark, path, 4).df.where("a <> 255").isEmpty()
    if n == 4:
        with pytest.raises(ValueError):
            images.save_image(b, str(tmp_path / "a.jpg"))
        return
    smooth = b.with_df(b.df.select("i0", "i1", *[(F.col("i0") * 5 + F.col("i1") * 3).cast("int").alias(c) for c in names]), names)
    images.save_image(smooth, str(tmp_path / "a.jpg"))
    back = images.read_image(spark, str(tmp_path / "a.jpg"), 1).df.where("i0 < 7 or i0 > 17").select(F.max(F.abs(F.col("v") - (F.col("i0") * 5 + F.col("i1") * 3)))).first()[0]
    assert back < 25


def test_what_is_no_image(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="no image"):
        images.read_image(spark, str(tmp_path / "a.png")).df.collect()
    with pytest.raises(ValueError):
        images.save_image(index_space(spark, (2, 2), v=F.lit(1)), str(tmp_path / "a.tiff"))


def test_packed_frames(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("gridloom.streaming.frames.PIECE", 5)
    path, file = str(tmp_path / "frames"), str(tmp_path / "frames.bin")
    sink, want = FrameSink(path), np.zeros((3, 3, 4), "<f4")
    for k in range(3):
        b = index_space(spark, (3, 4), v=F.col("i0") * 10 + F.col("i1") + 100 * k)
        sink.append(b.with_df(b.df.where("i0 <> 1" if k else "false")))  # an empty frame, and frames with holes
        i, j = np.indices((3, 4))
        want[k] = np.where((i != 1) & (k > 0), i * 10 + j + 100 * k, 0)
    assert sink.close() == 3 and read_header(spark, path) == ((3, 4), 3)
    pack_frames(spark, path, file)
    raw = (tmp_path / "frames.bin").read_bytes()
    assert np.frombuffer(raw, "<u8", 2).tolist() == [3, 3] and (np.frombuffer(raw, "<f4", offset=16).reshape(3, 3, 4) == want).all()
    got = np.zeros((3, 3, 4))
    for r in unpack_frames(spark, file, (3, 4)).collect():
        got[r["frame"], r["i0"], r["i1"]] = r["v"]
    assert (got == want).all()
    with pytest.raises(Exception, match="no file of frames"):
        unpack_frames(spark, file, (4, 4)).collect()


@pytest.mark.parametrize(("a", "b", "over"), [((4, 3, 5), (5, 6), (2, 0)), ((4, 3), (2, 3, 5), (1, 1)), ((4,), (4, 2, 3), (0, 0)), ((4,), (4,), (0, 0))])
def test_products_of_any_dimensions(spark, a, b, over):
    x, y = (np.random.default_rng(len(s)).normal(size=s) for s in (a, b))
    want = np.tensordot(x, y, axes=([over[0]], [over[1]]))
    got = kernels.contract(from_host(spark, x), from_host(spark, y), *over)
    assert got.shape == want.shape and np.allclose(array_of(got, want.shape) if want.shape else got.df.first()["v"], want)


def test_frames_as_a_stream(spark, tmp_path):
    path = str(tmp_path / "frames")
    sink = FrameSink(path)
    for k in range(3):
        sink.append(index_space(spark, (4,), v=F.col("i0") * k))
    assert sink.close() == 3
    with pytest.raises(ValueError):
        sink.append(index_space(spark, (4,), v=F.col("i0")))
    stream = stream_frames(spark, path, "frame int, i0 long, v long").groupBy("frame").agg(F.sum("v").alias("s"))
    q = stream.writeStream.format("memory").queryName("frames").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("frames").collect())) == [(0, 0), (1, 6), (2, 12)]
    assert read_frames(spark, path).count() == 12


def test_groups_keep_nulls(spark):
    b = index_space(spark, (6,), v=F.when(F.col("i0") % 3 != 1, F.col("i0")))
    g = Groups(b, (3,))
    got = g.df.select("i0", g.tile("v").alias("t"), g.select_from("v", 2 - F.col("lane")).alias("r"), g.select_from("v", F.lit(9)).alias("beyond")).orderBy("i0").collect()
    assert [r.t for r in got] == [[0, None, 2]] * 3 + [[3, None, 5]] * 3
    assert [r.r for r in got] == [2, None, 0, 5, None, 3] and all(r.beyond is None for r in got)


def test_until_says_when_its_steps_are_not_enough(spark):
    df = spark.createDataFrame([(0, 1.0)], "i0 long, v double")
    with pytest.raises(RuntimeError, match="did not end in 2 steps"):
        until(df, lambda s, t: s.withColumn("v", F.col("v") / 2), lambda s: F.max("v"), lambda m: m < 0.2, most=2)


@pytest.mark.parametrize("border", ["skip", "edge", "constant"])
@pytest.mark.parametrize("shape", [(29,), (13, 11), (7, 6, 9)])
def test_stencils_of_any_dimension_over_holes_and_nulls(spark, shape, border):
    """Against plain Python; tiles are small, cells absent, and others null."""
    rng = np.random.default_rng(len(shape))
    dims = len(shape)
    cells = {at: (None if rng.random() < 0.2 else float(round(rng.normal(), 3))) for at in np.ndindex(*shape) if rng.random() < 0.8 or not any(at) or at == tuple(n - 1 for n in shape)}
    kinds = ", ".join(f"i{d} long" for d in range(dims))
    buffer = Buffer(spark.createDataFrame([(*map(int, at), v) for at, v in cells.items()], f"{kinds}, v double"), shape)
    taps = [tuple(int(rng.integers(-2, 3)) for _ in range(dims)) for _ in range(4)]
    out = kernels.stencil(buffer, taps, lambda near: F.array(*[near[t] for t in taps]), border, 9.5, tile=(8, 8, 8))
    got = {tuple(r[:-1]): list(r[-1]) for r in out.df.select(*buffer.keys, "v").collect()}

    def want(at, t):
        there = tuple(a + b for a, b in zip(at, t, strict=True))
        if border == "edge":
            there = tuple(min(n - 1, max(0, x)) for x, n in zip(there, shape, strict=True))
        return cells[there] if there in cells else 9.5 if border == "constant" else None

    assert got == {at: [want(at, t) for t in taps] for at in cells}


def test_separable_over_holes(spark):
    rng = np.random.default_rng(3)
    image = rng.normal(size=(14, 17))
    gone = rng.random(image.shape) < 0.3
    b = from_host(spark, image)
    keep = spark.createDataFrame([(int(i), int(j)) for i, j in np.argwhere(~gone)], "i0 long, i1 long")
    out = kernels.separable(b.with_df(b.df.join(keep, ["i0", "i1"])), [[1.0, 2.0, -1.0], [0.5, 1.0]], [-1, 0], tile=(8, 8))
    full = np.pad(np.where(gone, 0, image), 2)
    want = sum(x * y * full[2 + a : 16 + a, 2 + c : 19 + c] for a, x in ((-1, 1.0), (0, 2.0), (1, -1.0)) for c, y in ((0, 0.5), (1, 1.0)))
    got = {(r.i0, r.i1): r.v for r in out.df.collect()}
    assert got.keys() == {tuple(x) for x in np.argwhere(~gone).tolist()} and all(abs(want[k] - v) < 1e-9 for k, v in got.items())
