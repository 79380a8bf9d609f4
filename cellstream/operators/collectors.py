"""Collectors: what a stream is summed up to. They compile to aggregate columns of grouped aggregations.

Collectors nest freely. Each grouping is one aggregation by the keys down to it, over the records that reach it; filters and
partitions below it are conditional aggregates of the same pass. Empty input gives 0 for counts and sums, 0.0 for averages,
nothing for minima.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellstream.functions.expr import Expr, Order, Predicate


@dataclass
class Collector:
    """One of: leaf (columns: aggregate columns by name, given a mask; finish: row -> value), filter, composite, group, part."""

    kind: str = "leaf"
    columns: Callable[[Column | None], dict[str, Column]] | None = None
    finish: Callable[[dict], Any] | None = None
    parts: tuple[Collector, ...] = ()
    condition: Predicate | None = None
    expr: Expr | None = None
    name: str | None = None

    def halves(self) -> dict[bool, Collector]:
        """Of a partition: what collects each side."""
        return {side: filtering(self.condition if side else self.condition.negate_plainly(), self.parts[0]) for side in (False, True)}


def _masked(c: Column, mask: Column | None) -> Column:
    return c if mask is None else F.when(mask, c)


def _one(name: str, made: Callable[[Column | None], Column]) -> Collector:
    return Collector("leaf", lambda mask: {name: made(mask)}, lambda row: row[name])


def counting(name: str = "count") -> Collector:
    return _one(name, lambda mask: F.count(F.lit(1)) if mask is None else F.count(F.when(mask, 1)))


def summing(expr: Expr, name: str = "sum") -> Collector:
    zero = F.lit(0.0) if expr.kind == "double" else F.lit(0).cast("bigint")
    return _one(name, lambda mask: F.coalesce(F.sum(_masked(expr.column(), mask)), zero))


def averaging(expr: Expr, name: str = "avg") -> Collector:
    return _one(name, lambda mask: F.coalesce(F.avg(_masked(expr.column(), mask)), F.lit(0.0)))


def summarizing(expr: Expr, name: str = "stats") -> Collector:
    """Count, sum, min, max and average; of nothing: 0, 0, the type's largest and smallest value, 0.0."""
    low, high = {"int": (-(1 << 31), (1 << 31) - 1), "long": (-(1 << 63), (1 << 63) - 1)}.get(expr.kind, (float("-inf"), float("inf")))

    def columns(mask: Column | None) -> dict[str, Column]:
        c = _masked(expr.column(), mask)
        zero = F.lit(0.0) if expr.kind == "double" else F.lit(0).cast("bigint")
        return {
            f"{name}_count": F.count(c),
            f"{name}_sum": F.coalesce(F.sum(c), zero),
            f"{name}_min": F.coalesce(F.min(c), F.lit(high)),
            f"{name}_max": F.coalesce(F.max(c), F.lit(low)),
            f"{name}_avg": F.coalesce(F.avg(c), F.lit(0.0)),
        }

    return Collector("leaf", columns, lambda row: {k: row[f"{name}_{k}"] for k in ("count", "sum", "min", "max", "avg")})


def variance(expr: Expr, kind: str = "population", name: str = "variance") -> Collector:
    """Absent below one value (population) or two (sample)."""
    aggregate = {"population": F.var_pop, "sample": F.var_samp}[kind]
    return _one(name, lambda mask: aggregate(_masked(expr.column(), mask)))


def _extreme(order: Order, largest: bool, name: str, ties: tuple[Order, ...]) -> Collector:
    up = largest != order.descending
    pick = F.max_by if up else F.min_by

    def made(mask: Column | None) -> Column:
        by = order.expr.column()
        if ties:
            # the first of the ties is the largest of a maximum's structs, the smallest of a minimum's
            by = F.when(by.isNotNull(), F.struct(by, *((t.reversed() if up else t).rank() for t in ties)))
        return pick(F.struct("*"), _masked(by, mask))

    return _one(name, made)


def min_by(order: Order, name: str = "min", ties: tuple[Order, ...] = ()) -> Collector:
    """The record with the smallest value; of several the first by `ties`, without these any of them."""
    return _extreme(order, False, name, ties)


def max_by(order: Order, name: str = "max", ties: tuple[Order, ...] = ()) -> Collector:
    """The record with the largest value; of several the first by `ties`, without these any of them."""
    return _extreme(order, True, name, ties)


def mapping(expr: Expr | Callable, down: Collector | Callable[[Expr], Collector] | None = None) -> Collector:
    """The collector that `down` makes of the mapped expression, as in `mapping(SALARY.value_or(0), summing)`.

    A collector that looks at no value, as counting, may be given itself.
    """
    if down is None:
        return expr() if callable(expr) else expr
    return down if isinstance(down, Collector) else down(expr)


def filtering(predicate: Predicate, down: Collector) -> Collector:
    return Collector("filter", parts=(down,), condition=predicate)


def composite(*parts: Collector) -> Collector:
    return Collector("composite", parts=parts)


def grouping_by(expr: Expr, down: Collector | None = None, name: str | None = None) -> Collector:
    """One entry per present value; an absent one is an error of the classifier, so such records must be filtered before.

    In a frame the key's column is `name`, or `key`, `key_2` and so on by depth.
    """
    return Collector("group", parts=(down or counting(),), expr=expr, name=name)


grouping_by_concurrent = grouping_by


def partitioning_by(predicate: Predicate, down: Collector | None = None, name: str | None = None) -> Collector:
    """Always an entry for true and one for false."""
    return Collector("part", parts=(down or counting(),), condition=predicate, name=name)


# ---- how a tree of collectors runs


def _met(masks: tuple[Predicate, ...]) -> Column | None:
    return reduce(lambda a, b: a & b, (m.column() for m in masks)) if masks else None


def _leaves(c: Collector, masks: tuple[Predicate, ...] = ()) -> Iterator[tuple[Collector, tuple[Predicate, ...]]]:
    """The leaves under a collector but not under a grouping below it, with what records must meet."""
    if c.kind == "leaf":
        yield c, masks
    elif c.kind == "filter":
        yield from _leaves(c.parts[0], (*masks, c.condition))
    elif c.kind == "part":
        for half in c.halves().values():
            yield from _leaves(half, masks)
    elif c.kind == "composite":
        for part in c.parts:
            yield from _leaves(part, masks)


def collected(df: DataFrame, c: Collector, keys: tuple[Expr, ...] = (), masks: tuple[Predicate, ...] = ()) -> Any:
    """The value of a collector over `df`: one aggregation for each grouping (and one for what stands outside of all)."""
    return _Level(df, c, keys, masks).value(())


class _Level:
    """What stands below one grouping (or at the root): its rows by key, and the groupings further below."""

    def __init__(self, df: DataFrame, c: Collector, keys: tuple[Expr, ...], masks: tuple[Predicate, ...]):
        self.df, self.c, self.keys, self.masks = df, c, keys, masks
        self.below: dict[int, _Level] = {}
        self.taken = 0
        leaves = list(_leaves(c))
        columns, self.names = [], []
        for k, (leaf, within) in enumerate(leaves):
            made = leaf.columns(_met(within))
            self.names.append(list(made))
            columns += [v.alias(f"c{k}_{n}") for n, v in made.items()]
        rows = df if not masks else df.where(_met(masks))
        if not keys:
            self.rows = {(): rows.agg(*columns).first()} if columns else {(): None}
        elif c.kind == "group":  # each group of it is one of this level: no pass of its own
            self.rows = None
        else:
            by = [k.column().alias(f"k{n}") for n, k in enumerate(keys)]
            found = rows.groupBy(*by).agg(*columns) if columns else rows.select(*by).distinct()
            self.rows = {tuple(r[f"k{n}"] for n in range(len(keys))): r for r in found.collect()}

    def groups(self, upper: tuple) -> list:
        depth = len(upper)
        if self.rows is None:
            level = self._level(self.c, self.masks)
            return list(dict.fromkeys(k[depth] for k in level.every() if k[:depth] == upper))
        return [k[depth] for k in self.rows if k[:depth] == upper]

    def every(self) -> list[tuple]:
        return [k[: len(self.keys)] for k in self._level(self.c, self.masks).every()] if self.rows is None else list(self.rows)

    def _level(self, c: Collector, masks: tuple[Predicate, ...], place: int = 0) -> _Level:
        if place not in self.below:
            self.below[place] = _Level(self.df, c.parts[0], (*self.keys, c.expr), masks)
        return self.below[place]

    def value(self, key: tuple) -> Any:
        self.leaf = self.place = 0
        return self._value(self.c, key, self.masks)

    def _value(self, c: Collector, key: tuple, masks: tuple[Predicate, ...]) -> Any:
        if c.kind == "leaf":
            names, k = self.names[self.leaf], self.leaf
            self.leaf += 1
            return c.finish({n: self.rows[key][f"c{k}_{n}"] for n in names})
        if c.kind == "filter":
            return self._value(c.parts[0], key, (*masks, c.condition))
        if c.kind == "part":
            return {side: self._value(half, key, masks) for side, half in c.halves().items()}
        if c.kind == "composite":
            return [self._value(part, key, masks) for part in c.parts]
        level = self._level(c, masks, self.place)
        self.place += 1
        out = {}
        for g in level.groups(key):
            if g is None:
                raise ValueError("a group can't have an absent key")
            out[g] = level.value((*key, g))
        return out


def collected_frame(df: DataFrame, c: Collector) -> DataFrame:
    """The entries of a collector as rows: a column for each level of groups and partitions, then those of the leaves.

    Leaves below must stand at one level, else there is no one relation. Halves of a partition under groups, or of leaves
    alone, have their row even if they are empty.
    """
    levels = list(_levels(c))
    names = [name or ("key" if n == 0 else f"key_{n + 1}") for n, name in enumerate(levels)]
    if len(set(names)) < len(names):
        raise ValueError(f"levels share a name: {names}")
    frames = [_rows(df, keys, masks, halves, names) for keys, masks, halves in _flat(c, {}, (), ()).values()]
    return reduce(DataFrame.unionByName, frames)


def _levels(c: Collector) -> Iterator[str | None]:
    """Names of the levels of groups and partitions, outermost first."""
    if c.kind in ("group", "part"):
        yield c.name
    found = [list(_levels(p)) for p in c.parts]
    if sum(map(bool, found)) and len(found) > 1:
        raise ValueError("groups beside other collectors are no one relation: collect them to a value")
    for f in found:
        yield from f


def _flat(c: Collector, sides: dict[int, bool], keys: tuple, masks: tuple, depth: int = 0, within: tuple = ()) -> dict[tuple, tuple]:
    """(grouping keys by level, conditions on the records of that aggregation, its halves): by those keys and conditions.

    A half is (sides of its partitions by level, further conditions, leaves).
    """
    if c.kind == "filter":
        return _flat(c.parts[0], sides, keys, masks, depth, (*within, c.condition))
    if c.kind == "group":
        # what is asked for above a grouping holds for all its records; partitions above are fixed by their conditions
        return _flat(c.parts[0], sides, (*keys, (depth, c.expr)), (*masks, *within), depth + 1)
    if c.kind == "part":
        out: dict[tuple, tuple] = {}
        for side, half in c.halves().items():
            for at, (k, m, halves) in _flat(half, {**sides, depth: side}, keys, masks, depth + 1, within).items():
                held = out.setdefault(at, (k, m, []))
                held[2].extend(halves)
        return out
    return {(keys, masks): (keys, masks, [(sides, within, list(_leaves(c)))])}


def _rows(df: DataFrame, keys: tuple, masks: tuple, halves: list, names: list[str]) -> DataFrame:
    rows = df.where(_met(masks)) if masks else df
    by = [e.column().alias(names[n]) for n, e in keys]
    made = []
    for sides, within, leaves in halves:
        columns: dict[str, Column] = {}
        for leaf, more in leaves:
            found = leaf.columns(_met((*within, *more)))
            if columns.keys() & found.keys():
                raise ValueError(f"names are used twice: {sorted(columns.keys() & found.keys())}")
            columns |= found
        made.append((sides, columns))
    if len(made) == 1:
        sides, columns = made[0]
        out = (rows.groupBy(*by) if by else rows).agg(*(c.alias(n) for n, c in columns.items()))
        return out.select(*(F.lit(sides[n]).alias(x) if n in sides else F.col(x) for n, x in enumerate(names)), *columns)
    # all halves in one pass, so that an empty half has its row
    structs = [
        F.struct(*(F.lit(side).alias(names[n]) for n, side in sides.items()), *(c.alias(n) for n, c in columns.items())).alias(f"half_{k}") for k, (sides, columns) in enumerate(made)
    ]
    out = (rows.groupBy(*by) if by else rows).agg(*structs)
    kept = [names[n] for n, _ in keys]
    out = out.select(*kept, F.explode(F.array(*(f"half_{k}" for k in range(len(made))))).alias("half"))
    return out.select(*(F.col(x) if x in kept else F.col(f"half.{x}") for x in names), *(F.col(f"half.{n}") for n in made[0][1]))
