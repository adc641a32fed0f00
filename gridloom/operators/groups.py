"""Work-group algorithms: windows over the lanes of a group."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.combiners import COMBINERS
from ..functions.coordinates import group_columns
from .buffer import Buffer

Pred = Callable[[Column], Column]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


class Groups:
    """A buffer whose cells know their work-group: ``group``, ``lane``, and both by dimension.

    All methods give columns over one partitioning by group, so that any number
    of them share a shuffle. A group is a bounded number of rows.
    """

    def __init__(self, buffer: Buffer, local: Sequence[int], offset: Sequence[int] | None = None):
        shape = buffer.extent()
        self.local = tuple(local)
        self.df = buffer.df.withColumns(group_columns(shape, local, offset))
        by = Window.partitionBy("group").orderBy("lane")
        self.ordered = by
        self.whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        self.upto = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        self.before = by.rowsBetween(Window.unboundedPreceding, -1)

    def lane_of(self, place: int | Sequence[int]) -> int:
        """The lane of a place in the group, given by its number or its coordinates."""
        if isinstance(place, int):
            return place
        out = 0
        for p, n in zip(place, self.local, strict=True):
            out = out * n + p
        return out

    def leader(self) -> Column:
        return F.col("lane") == 0

    def broadcast(self, x: Column | str, place: int | Sequence[int] = 0) -> Column:
        """The value of the lane at ``place``, the leader's by default."""
        return F.nth_value(_c(x), self.lane_of(place) + 1).over(self.whole)

    def any_of(self, x: Column | str, pred: Pred | None = None) -> Column:
        return F.bool_or(pred(_c(x)) if pred else _c(x)).over(self.whole)

    def all_of(self, x: Column | str, pred: Pred | None = None) -> Column:
        return F.bool_and(pred(_c(x)) if pred else _c(x)).over(self.whole)

    def none_of(self, x: Column | str, pred: Pred | None = None) -> Column:
        return ~self.any_of(x, pred)

    def shift_left(self, x: Column | str, delta: int = 1) -> Column:
        """The value of the lane ``delta`` further; null beyond the group."""
        return F.lead(_c(x), delta).over(self.ordered)

    def shift_right(self, x: Column | str, delta: int = 1) -> Column:
        """The value of the lane ``delta`` before; null beyond the group."""
        return F.lag(_c(x), delta).over(self.ordered)

    def tile(self, x: Column | str) -> Column:
        """All values of the group by lane: local memory that every lane may read after a barrier."""
        return F.transform(self._lanes(x), lambda s: s["x"])

    def _lanes(self, x: Column | str) -> Column:
        """The group's values as structs (so that nulls count), in the window's order: made once a group, not once a lane."""
        return F.collect_list(F.struct(_c(x).alias("x"))).over(self.whole)

    def select_from(self, x: Column | str, lane: Column | str) -> Column:
        """The value of the lane with the given number; null if there is none."""
        return F.get(self._lanes(x), _c(lane).cast("int"))["x"]

    def permute_by_xor(self, x: Column | str, mask: int) -> Column:
        """The value of the lane whose number differs in the mask's bits."""
        return self.select_from(x, F.col("lane").bitwiseXOR(F.lit(mask).cast("long")))

    def reduce(self, x: Column | str, op: str, init: Column | None = None) -> Column:
        out = COMBINERS[op].fold(_c(x)).over(self.whole)
        return out if init is None else COMBINERS[op].pair(init, out)

    def inclusive_scan(self, x: Column | str, op: str, init: Column | None = None) -> Column:
        out = COMBINERS[op].fold(_c(x)).over(self.upto)
        return out if init is None else COMBINERS[op].pair(init, out)

    def exclusive_scan(self, x: Column | str, op: str, init: Column | None = None) -> Column:
        """The fold of the lanes before; the first lane has ``init`` or the identity."""
        before = COMBINERS[op].fold(_c(x)).over(self.before)
        if init is not None:
            return F.coalesce(COMBINERS[op].pair(init, before), init)
        return F.coalesce(before, F.lit(COMBINERS[op].identity))


def joint_any_of(a: Column | str, pred: Pred) -> Column:
    """Over the values of an array; false for none."""
    return F.exists(_c(a), pred)


def joint_all_of(a: Column | str, pred: Pred) -> Column:
    return F.forall(_c(a), pred)


def joint_none_of(a: Column | str, pred: Pred) -> Column:
    return ~F.exists(_c(a), pred)


def joint_reduce(a: Column | str, op: str, init: Column) -> Column:
    return F.aggregate(_c(a), init, COMBINERS[op].pair)


def joint_scan(a: Column | str, op: str, init: Column, inclusive: bool = True) -> Column:
    """Running folds of an array from ``init``; exclusive ones begin with ``init`` itself.

    The array is bounded: it is folded in one row.
    """
    pair = COMBINERS[op].pair
    empty = F.struct(F.slice(F.array(init), 1, 0).alias("done"), init.alias("now"))

    def step(s: Column, x: Column) -> Column:
        now = pair(s["now"], x)
        return F.struct(F.concat(s["done"], F.array(now if inclusive else s["now"])).alias("done"), now.alias("now"))

    return F.aggregate(_c(a), empty, step, lambda s: s["done"])
