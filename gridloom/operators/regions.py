"""Boxes, regions and region maps: set algebra of index spaces on the driver, and as relations."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Interval = tuple[int, int]


@dataclass(frozen=True, order=True)
class Box:
    """Half-open: from ``min`` up to, but not with, ``max`` in each dimension. Every empty box is the same."""

    min: tuple[int, ...]
    max: tuple[int, ...]

    def __post_init__(self):
        for a, b in zip(self.min, self.max, strict=True):
            if a >= b:
                object.__setattr__(self, "min", (0,) * len(self.min))
                object.__setattr__(self, "max", (0,) * len(self.min))
                return

    @classmethod
    def at(cls, offset: Sequence[int], extent: Sequence[int]) -> Box:
        return cls(tuple(offset), tuple(o + n for o, n in zip(offset, extent, strict=True)))

    @classmethod
    def full(cls, shape: Sequence[int]) -> Box:
        return cls((0,) * len(shape), tuple(shape))

    @property
    def range(self) -> tuple[int, ...]:
        return tuple(b - a for a, b in zip(self.min, self.max, strict=True))

    @property
    def area(self) -> int:
        out = 1
        for n in self.range:
            out *= n
        return out

    @property
    def empty(self) -> bool:
        return bool(self.min) and self.min[0] >= self.max[0]  # an empty box is all zeros

    def meets(self, other: Box) -> bool:
        """Whether both share a cell."""
        for a, b, c, d in zip(self.min, self.max, other.min, other.max):  # noqa: B905
            if a >= d or c >= b:
                return False
        return True

    def less(self, other: Box) -> list[Box]:
        """Disjoint boxes of what is outside of another box that meets this one."""
        out, lo, hi = [], self.min, self.max
        for d in range(len(lo)):
            a, b = other.min[d], other.max[d]
            if lo[d] < a:
                out.append(Box(lo, (*hi[:d], a, *hi[d + 1 :])))
                lo = (*lo[:d], a, *lo[d + 1 :])
            if b < hi[d]:
                out.append(Box((*lo[:d], b, *lo[d + 1 :]), hi))
                hi = (*hi[:d], b, *hi[d + 1 :])
        return out

    def covers(self, other: Box) -> bool:
        return other.empty or self & other == other

    def __and__(self, other: Box) -> Box:
        return Box(tuple(map(max, self.min, other.min)), tuple(map(min, self.max, other.max)))

    def cast(self, dims: int) -> Box:
        """Dimensions are dropped, or added with an extent of one."""
        n = len(self.min)
        return Box(self.min[:dims] + (0,) * (dims - n), self.max[:dims] + (1,) * (dims - n))

    def touches(self, other: Box) -> bool:
        """Whether both overlap or share an edge (a face), so that their union is connected."""
        gaps = [max(a, c) - min(b, d) for a, b, c, d in zip(self.min, self.max, other.min, other.max, strict=True)]
        return not self.empty and not other.empty and all(g <= 0 for g in gaps) and sum(g == 0 for g in gaps) <= 1


def bounding_box(boxes: Iterable[Box]) -> Box:
    boxes = [b for b in boxes if not b.empty]
    if not boxes:
        raise ValueError("no box to bound")
    return Box(tuple(map(min, *[b.min for b in boxes], boxes[0].min)), tuple(map(max, *[b.max for b in boxes], boxes[0].max)))


def _sweep(layers: Sequence[Sequence[Box]], keep: Callable[[tuple[bool, ...]], bool]) -> list[Box]:
    """Canonical boxes of the cells for which ``keep`` holds of their membership in each layer.

    It cuts the first dimension where any box begins or ends, solves the
    cross-section of each slab, and joins equal boxes of neighbouring slabs; so
    runs are longest in the last dimension first.
    """
    dims = next((len(b.min) for layer in layers for b in layer), 0)
    if dims == 0:
        return [Box((), ())] if keep(tuple(bool(layer) for layer in layers)) else []
    cuts = sorted({x for layer in layers for b in layer if not b.empty for x in (b.min[0], b.max[0])})
    if not cuts:
        return []
    done: list[Box] = []
    running: dict[tuple[tuple[int, ...], tuple[int, ...]], int] = {}  # cross-section box -> where it began
    for lo, hi in zip(cuts, [*cuts[1:], None], strict=True):
        section = {}
        if hi is not None:
            inside = [[Box(b.min[1:], b.max[1:]) for b in layer if not b.empty and b.min[0] <= lo < b.max[0]] for layer in layers]
            section = {(b.min, b.max): lo for b in _sweep(inside, keep)} if any(inside) else {}
        for key in [k for k in running if k not in section]:
            done.append(Box((running.pop(key), *key[0]), (lo, *key[1])))
        for key in section:
            running.setdefault(key, lo)
    return sorted(done)


@dataclass(frozen=True)
class Region:
    """A set of cells as disjoint boxes in canonical form: equal regions have equal boxes."""

    boxes: tuple[Box, ...]

    @classmethod
    def of(cls, *boxes: Box) -> Region:
        if len(boxes) == 1:
            return cls(() if boxes[0].empty else boxes)
        return cls(tuple(_sweep([list(boxes)], lambda m: m[0])))

    def _with(self, other: Region, keep: Callable[[tuple[bool, ...]], bool]) -> Region:
        return Region(tuple(_sweep([self.boxes, other.boxes], keep)))

    def __or__(self, other: Region) -> Region:
        if self == other or not other.boxes:
            return self
        return self._with(other, any) if self.boxes else other

    def __and__(self, other: Region) -> Region:
        if self == other:
            return self
        if len(self.boxes) == len(other.boxes) == 1:
            return Region.of(self.boxes[0] & other.boxes[0])
        return self._with(other, all) if self.overlaps(other) else Region(())

    def __sub__(self, other: Region) -> Region:
        if self == other:
            return Region(())
        return self._with(other, lambda m: m[0] and not m[1]) if self.overlaps(other) else self

    def overlaps(self, other: Region) -> bool:
        """Whether both share a cell; it compares boxes and makes none."""
        return any(a.meets(b) for a in self.boxes for b in other.boxes)

    @property
    def empty(self) -> bool:
        return not self.boxes

    @property
    def area(self) -> int:
        return sum(b.area for b in self.boxes)


class RegionBuilder:
    """Collects boxes; ``build`` makes them one region."""

    def __init__(self):
        self._boxes: list[Box] = []

    def add(self, box: Box) -> RegionBuilder:
        self._boxes.append(box)
        return self

    def build(self) -> Region:
        return Region.of(*self._boxes)


def merged_intervals(intervals: Iterable[Interval]) -> list[Interval]:
    """One-dimensional union: touching and overlapping intervals become one."""
    out: list[Interval] = []
    for a, b in sorted(i for i in intervals if i[0] < i[1]):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def dissected(boxes: Iterable[Box]) -> list[Box]:
    """All boxes cut at every line on which any of them begins or ends; each piece once."""
    boxes = [b for b in boxes if not b.empty]
    if not boxes:
        return []
    dims = len(boxes[0].min)
    lines = [sorted({x for b in boxes for x in (b.min[d], b.max[d])}) for d in range(dims)]
    out: set[Box] = set()
    for b in boxes:
        parts = [((), ())]
        for d in range(dims):
            at = [x for x in lines[d] if b.min[d] <= x <= b.max[d]]
            parts = [((*lo, x), (*hi, y)) for lo, hi in parts for x, y in zip(at, at[1:], strict=False)]
        out.update(Box(lo, hi) for lo, hi in parts)
    return sorted(out)


def _clusters(boxes: Sequence[Box], linked: Callable[[Box, Box], bool]) -> list[list[Box]]:
    root = list(range(len(boxes)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(boxes):
        for j in range(i):
            if linked(a, boxes[j]):
                root[find(i)] = find(j)
    groups: dict[int, list[Box]] = {}
    for i, b in enumerate(boxes):
        groups.setdefault(find(i), []).append(b)
    return list(groups.values())


def connected_bounding_boxes(region: Region) -> list[Box]:
    """The bounding box of each connected part of a region."""
    return sorted(bounding_box(g) for g in _clusters(region.boxes, Box.touches))


def merged_overlapping(boxes: Iterable[Box]) -> list[Box]:
    """Boxes that overlap are replaced by their bounding box until none do."""
    now = sorted({b for b in boxes if not b.empty})
    while True:
        groups = _clusters(now, lambda a, b: not (a & b).empty)
        if len(groups) == len(now):
            return now
        now = sorted({bounding_box(g) for g in groups})


def split_overlapping(regions: Sequence[Region]) -> list[Region]:
    """Disjoint regions that tile the union, each in the same ones of the given regions throughout."""
    parts: list[Region] = []
    for r in regions:
        cut = [x for p in parts for x in (p & r, p - r) if not x.empty]
        rest = r
        for p in parts:
            rest = rest - p
        parts = cut + ([rest] if not rest.empty else [])
    return sorted(parts, key=lambda r: r.boxes)


class RegionMap:
    """Values of the cells of an extent: the last update of a cell counts. Updates and queries are clamped.

    It keeps disjoint boxes with their values. An update cuts only boxes that it
    meets; boxes of equal values are joined when asked for, or when they have
    become many.
    """

    def __init__(self, shape: Sequence[int], default: object = None):
        self.extent = Box.full(shape)
        self._parts: list[tuple[Box, object]] = [(self.extent, default)]
        self._many = 64

    def update(self, region: Region | Box, value: object) -> None:
        new = [c for b in ((region,) if isinstance(region, Box) else region.boxes) if not (c := b if self.extent.covers(b) else b & self.extent).empty]
        parts = self._parts
        for x in new:
            kept = []
            for part in parts:
                b = part[0]
                if not b.meets(x):
                    kept.append(part)
                elif not x.covers(b):
                    kept += [(c, part[1]) for c in b.less(x)]
            parts = kept
        self._parts = parts + [(x, value) for x in new]
        if len(self._parts) > self._many:
            self.apply(lambda v: v)
            self._many = max(64, 2 * len(self._parts))

    def holders(self, region: Region | Box) -> list[object]:
        """The different values in a region, in the order of their first boxes."""
        boxes = (region,) if isinstance(region, Box) else region.boxes
        found = [(b.min, v) for b, v in self._parts for x in boxes if b.meets(x)]
        return list(dict.fromkeys(v for _, v in (sorted(found, key=lambda f: f[0]) if len(found) > 1 else found)))

    def values(self, region: Region | Box) -> list[tuple[Box, object]]:
        boxes = (region,) if isinstance(region, Box) else region.boxes
        found: dict[object, list[Box]] = {}
        for b, v in self._parts:
            for x in boxes:
                if b.meets(x):
                    found.setdefault(v, []).append(b & x)
        return sorted(((b, v) for v, bs in found.items() for b in Region.of(*bs).boxes), key=lambda x: x[0])

    def apply(self, f: Callable[[object], object]) -> None:
        """Changes every value; parts of equal values become one."""
        found: dict[object, list[Box]] = {}
        for b, v in self._parts:
            found.setdefault(f(v), []).append(b)
        self._parts = [(b, v) for v, bs in found.items() for b in Region.of(*bs).boxes]


def cells_of(boxes: DataFrame, dims: int) -> DataFrame:
    """The cells (i0, …) of ``boxes(min0, max0, …)``, each once."""
    out = boxes
    for d in range(dims):
        out = out.where(f"min{d} < max{d}")
    for d in range(dims):
        out = out.withColumn(f"i{d}", F.explode(F.sequence(F.col(f"min{d}"), F.col(f"max{d}") - 1)))
    return out.select(*[F.col(f"i{d}").cast("long").alias(f"i{d}") for d in range(dims)]).distinct()


#: Intervals that a task sorts at once, about: 250 million make 200 tasks, beyond which Spark sorts in tasks that write a shuffle, too.
TASK_INTERVALS = 1_250_000


def merge_intervals(intervals: DataFrame, by: Sequence[str] = (), width: int | None = None) -> DataFrame:
    """Gaps and islands: the union of ``intervals(lo, hi)`` within each ``by``, as (by…, lo, hi).

    With ``width`` intervals are cut at its multiples and merged in each piece;
    pieces that touch a cut are then joined again. So no task holds more of a
    ``by``, or of a relation without any, than one piece of it and the seams.
    Intervals are counted first: the number of tasks grows with theirs.
    """
    some = intervals.where("lo < hi").select(*by, "lo", "hi")
    if width is None:
        return _islands(some, by, intervals.count())
    first, last = F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width)
    n = int(some.agg(F.sum(last - first + 1)).first()[0] or 0)
    cut = some.select(*by, "lo", "hi", F.explode(F.sequence(first, last)).alias("_p")).select(*by, "_p", F.greatest("lo", F.col("_p") * width).alias("lo"), F.least("hi", (F.col("_p") + 1) * width).alias("hi"))
    inner = _islands(cut, [*by, "_p"], n)
    seam = (F.col("lo") == F.col("_p") * width) | (F.col("hi") == (F.col("_p") + 1) * width)
    return inner.where(~seam).drop("_p").unionByName(_islands(inner.where(seam).drop("_p"), by, n))


def _islands(intervals: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """The islands of at most ``n`` intervals within each ``by``: one shuffle and one sort, whose windows need no sums or groups of islands.

    An island ends where the next interval begins beyond all before; the last
    beginning until there is its own.
    """
    if by and n > TASK_INTERVALS:
        intervals = intervals.repartition(max(-(-n // TASK_INTERVALS), intervals.sparkSession.sparkContext.defaultParallelism), *by)
    order = Window.partitionBy(*by).orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.select("*", reach.alias("_reach"), F.lead("lo").over(order).alias("_next"))
    begins = F.max(F.when(F.col("_reach").isNull() | (F.col("lo") > F.col("_reach")), F.col("lo"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ends = marked.select(*by, begins.alias("lo"), F.greatest("_reach", "hi").alias("hi"), "_next")
    return ends.where("_next is null or _next > hi").drop("_next")


def _slabs(boxes: DataFrame, width: int, by: Sequence[str]) -> DataFrame:
    """Two-dimensional boxes cut along dimension 0 wherever, near them, any begins or ends: ``lo0, hi0`` beside the rest.

    Boxes go to each run of ``width`` coordinates that they reach; cuts are
    those of the boxes of the run, so that a box meets at most ``width`` cuts.
    """
    run = F.explode(F.sequence(F.floor(F.col("min0") / width), F.floor((F.col("max0") - 1) / width))).alias("_run")
    cut = boxes.where("min0 < max0 and min1 < max1").select("*", run)
    cut = cut.withColumn("min0", F.greatest("min0", F.col("_run") * width)).withColumn("max0", F.least("max0", (F.col("_run") + 1) * width))
    ends = cut.select(*by, "_run", F.explode(F.array("min0", "max0")).alias("lo0")).distinct()
    ends = ends.withColumn("hi0", F.lead("lo0").over(Window.partitionBy(*by, "_run").orderBy("lo0"))).where("hi0 is not null")
    return cut.join(ends, [*by, "_run"]).where("lo0 >= min0 and lo0 < max0").drop("min0", "max0", "_run")


def overlay(a: DataFrame, b: DataFrame, width: int = 64, by: Sequence[str] = ()) -> DataFrame:
    """Two relations of two-dimensional boxes cut into disjoint ones that are each inside or outside of both throughout.

    Returns (by…, min0, max0, min1, max1, in_a, in_b) in canonical form: runs are
    longest in dimension 1 first, then in dimension 0. It sweeps boxes, never
    cells: cuts along dimension 0 in runs of about ``width`` coordinates (say,
    ten usual extents), depths along dimension 1 as running sums, and joins of
    equal neighbours. Every window is within a cut or a pair of ends.
    """
    both = a.select(*by, "min0", "max0", "min1", "max1", F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*by, "min0", "max0", "min1", "max1", F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    slabs = _slabs(both, width, by)
    slab = [*by, "lo0", "hi0"]
    steps = slabs.select(*slab, F.explode(F.array(F.struct(F.col("min1").alias("x"), F.col("_a").alias("a"), F.col("_b").alias("b")), F.struct(F.col("max1").alias("x"), (-F.col("_a")).alias("a"), (-F.col("_b")).alias("b")))).alias("e"))
    steps = steps.groupBy(*slab, F.col("e.x").alias("lo1")).agg(F.sum("e.a").alias("a"), F.sum("e.b").alias("b"))
    along = Window.partitionBy(*slab).orderBy("lo1")
    depth = steps.select(*slab, "lo1", F.lead("lo1").over(along).alias("hi1"), (F.sum("a").over(along) > 0).alias("in_a"), (F.sum("b").over(along) > 0).alias("in_b"))
    return _joined(depth.where("in_a or in_b"), by, ["in_a", "in_b"])


def _joined(pieces: DataFrame, by: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Pieces (lo0, hi0, lo1, hi1) with equal labels joined along dimension 1, then 0."""

    def runs(df: DataFrame, group: Sequence[str], lo: str, hi: str) -> DataFrame:
        w = Window.partitionBy(*group).orderBy(lo)
        new = df.withColumn("_new", (F.coalesce(F.lag(hi).over(w) != F.col(lo), F.lit(True))).cast("int")).withColumn("_island", F.sum("_new").over(w))
        return new.groupBy(*group, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")

    flat = runs(pieces, [*by, "lo0", "hi0", *labels], "lo1", "hi1")
    out = runs(flat, [*by, "lo1", "hi1", *labels], "lo0", "hi0")
    return out.select(*by, F.col("lo0").alias("min0"), F.col("hi0").alias("max0"), F.col("lo1").alias("min1"), F.col("hi1").alias("max1"), *labels)


def combine_regions(a: DataFrame, b: DataFrame, keep: Column, width: int = 64, by: Sequence[str] = ()) -> DataFrame:
    """The canonical boxes of the cells for which ``keep`` (of ``in_a`` and ``in_b``) holds: union, intersection, difference."""
    kept = overlay(a, b, width, by).where(keep)
    # Parts that only one label kept apart belong together now: their slabs are cut alike, and joined again.
    again = kept.select(*by, "min0", "max0", "min1", "max1", F.lit(0).alias("_one"))
    slabs = _slabs(again, width, by).select(*by, "lo0", "hi0", F.col("min1").alias("lo1"), F.col("max1").alias("hi1"))
    return _joined(slabs, by, [])


def overlap(a: str, b: str, dims: int = 1) -> Column:
    """Whether the boxes of two aliased relations overlap."""
    out = F.lit(True)
    for d in range(dims):
        out = out & (F.col(f"{a}.min{d}") < F.col(f"{b}.max{d}")) & (F.col(f"{b}.min{d}") < F.col(f"{a}.max{d}"))
    return out


def intersections(a: DataFrame, b: DataFrame, dims: int, width: int | Sequence[int] = 64, by: Sequence[str] = ()) -> DataFrame:
    """The non-empty intersections of boxes of two relations with equal ``by``.

    An equi-join: boxes go to each bucket of ``width`` coordinates (of each
    dimension) that they reach, and two meet in the first that they share.
    """
    widths = [width] * dims if isinstance(width, int) else list(width)

    def dealt(x: DataFrame, mark: str) -> DataFrame:
        for d, w in enumerate(widths):
            x = x.where(f"min{d} < max{d}").withColumn(f"_bucket{d}", F.explode(F.sequence(F.floor(F.col(f"min{d}") / w), F.floor((F.col(f"max{d}") - 1) / w))))
        return x.select(*by, *[f"_bucket{d}" for d in range(dims)], *[F.col(f"{k}{d}").alias(f"{mark}{k}{d}") for d in range(dims) for k in ("min", "max")])

    both = dealt(a, "a_").join(dealt(b, "b_"), [*by, *[f"_bucket{d}" for d in range(dims)]])
    lo = [F.greatest(f"a_min{d}", f"b_min{d}") for d in range(dims)]
    hi = [F.least(f"a_max{d}", f"b_max{d}") for d in range(dims)]
    for d, w in enumerate(widths):
        both = both.where((lo[d] < hi[d]) & (F.floor(lo[d] / w) == F.col(f"_bucket{d}")))
    return both.select(*by, *[c.alias(f"{k}{d}") for d in range(dims) for k, c in (("min", lo[d]), ("max", hi[d]))])


def interval_join(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The overlaps of intervals ``a(by…, lo, hi, …)`` with ``b(by…, lo, hi, …)``: by…, lo, hi of the overlap, and both rests.

    An equi-join instead of a loop over pairs. An interval belongs to the power
    of two that is at least its length, and there lies in one or two buckets of
    that width; two of different size classes meet in buckets of the larger
    width, and two overlap only if they share one. The size classes (64 at most)
    are found first: an interval goes to two buckets for its own class and each
    larger one of the other side, however long the longest is. Columns other than by, lo and hi must
    differ between the two.
    """

    def sized(x: DataFrame, mark: str) -> DataFrame:
        x = x.where("lo < hi").withColumnsRenamed({"lo": f"_lo{mark}", "hi": f"_hi{mark}"})
        return x.withColumn(f"_class{mark}", F.ceil(F.log2((F.col(f"_hi{mark}") - F.col(f"_lo{mark}")).cast("double"))).cast("int"))

    x, y = sized(a, "a"), sized(b, "b")

    def classes(s: DataFrame, mark: str) -> list[int]:
        return sorted(r[0] for r in s.select(f"_class{mark}").distinct().collect())

    def dealt(s: DataFrame, mark: str, others: list[int]) -> DataFrame:
        above = F.filter(F.array(*[F.lit(c) for c in others]).cast("array<int>"), lambda c: c > F.col(f"_class{mark}"))
        s = s.withColumn("_class", F.explode(F.concat(F.array(f"_class{mark}"), above)))
        wide = F.pow(F.lit(2.0), F.col("_class")).cast("long")
        return s.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(f"_lo{mark}") / wide), F.floor((F.col(f"_hi{mark}") - 1) / wide))))

    both = dealt(x, "a", classes(y, "b")).join(dealt(y, "b", classes(x, "a")), [*by, "_class", "_bucket"]).where("_loa < _hib and _lob < _hia and _class = greatest(_classa, _classb)")
    lo = F.greatest("_loa", "_lob")
    first = both.where(F.floor(lo / F.pow(F.lit(2.0), F.col("_class")).cast("long")) == F.col("_bucket"))
    rest = [c for c in (*a.columns, *b.columns) if c not in (*by, "lo", "hi")]
    return first.select(*by, lo.alias("lo"), F.least("_hia", "_hib").alias("hi"), *rest)


def overwrite_runs(updates: DataFrame, order: str, value: str, width: int = 4096, by: Sequence[str] = ()) -> DataFrame:
    """A map of runs: what ``updates(by…, lo, hi, order, value)`` leave, each one overwriting those of lower order, as (by…, lo, hi, value).

    Runs stay runs: each piece of ``width`` coordinates is an array in a task, of
    the parts between the ends of its runs, on which these are painted in their
    order; neighbours with equal values are one run again. ``width`` should be
    many times the usual length of a run. Of equal orders the larger value wins.
    """
    run = F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("_run")
    cut = updates.where("lo < hi").select(*by, "lo", "hi", F.col(order).alias("_at"), F.col(value).alias("_value"), run)
    cut = cut.withColumn("lo", F.greatest("lo", F.col("_run") * width)).withColumn("hi", F.least("hi", (F.col("_run") + 1) * width))
    # Of runs with equal ends only the last writer counts.
    cut = cut.groupBy(*by, "_run", "lo", "hi").agg(F.max(F.struct("_at", "_value")).alias("_last")).select(*by, "_run", "lo", "hi", "_last._at", "_last._value")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields if f.name in by)
    kind = cut.schema["_value"].dataType.simpleString()

    def painted(pdf: pd.DataFrame) -> pd.DataFrame:
        """Runs painted one over another, over the parts between the ends of any."""
        pdf = pdf.sort_values(["_at", "_value"], kind="stable")
        ends = np.unique(np.concatenate([pdf["lo"], pdf["hi"]]))
        lo, hi = np.searchsorted(ends, pdf["lo"]), np.searchsorted(ends, pdf["hi"])
        top = np.full(len(ends) - 1, -1)
        for k, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
            top[a:b] = k
        at = np.flatnonzero(top >= 0)
        return pd.DataFrame({c: pdf[c].iat[0] for c in by} | {"_x": ends[at], "_y": ends[at + 1], value: pdf["_value"].to_numpy()[top[at]]}, index=range(len(at)))

    parts = cut.groupBy(*by, "_run").applyInPandas(painted, f"{kinds + ', ' if kinds else ''}_x long, _y long, `{value}` {kind}")
    w = Window.partitionBy(*by, value).orderBy("_x")
    new = parts.withColumn("_new", F.coalesce(F.lag("_y").over(w) != F.col("_x"), F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(w))
    return new.groupBy(*by, value, "_island").agg(F.min("_x").alias("lo"), F.max("_y").alias("hi")).select(*by, "lo", "hi", value)


def overwrite(current: DataFrame, updates: DataFrame, key: Sequence[str], order: str, value: str = "value") -> DataFrame:
    """Last writer by cell: ``current(key, value)`` overwritten by ``updates(key, order, value)``, clamped to it.

    One shuffle of the updates' latest values, which are combined before it.
    """
    last = updates.groupBy(*key).agg(F.max_by(value, order).alias("_new"), F.lit(True).alias("_hit"))
    return current.join(last, list(key), "left").select(*key, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(value)).alias(value))
