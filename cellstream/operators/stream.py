"""Lazy record and value streams over DataFrames.

Intermediate operations build the plan; terminal ones run it. `frame()` gives the plan itself, and every terminal that
has a relational result has a `..._frame` form that stays lazy.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from functools import reduce as fold_left
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from cellstream.functions.expr import NUMBERS, TYPES, Always, Derived, Expr, Order, Predicate, over
from cellstream.operators.collectors import Collector, collected, collected_frame, counting, summarizing
from cellstream.operators.update import Update
from cellstream.plans.access import StreamPlan, plan_of

log = logging.getLogger("cellstream")
_NOTHING = object()


class _Stream:
    def __init__(self, df: DataFrame, orders: tuple[Order, ...] = ()):
        self._df, self._orders, self._on_close, self._closes = df, orders, (), False

    def _with(self, df: DataFrame, orders: tuple[Order, ...] | None = None):
        out = object.__new__(type(self))
        out.__dict__ |= self.__dict__
        out._df, out._orders = df, self._orders if orders is None else orders
        return out

    def frame(self) -> DataFrame:
        return self._df

    def _values(self, df: DataFrame, kind: str) -> ValueStream:
        out = ValueStream(df, kind)
        out._on_close, out._closes = self._on_close, self._closes
        return out

    # hints that change nothing here
    def unordered(self):
        return self._with(self._df, ())

    def parallel(self):
        return self

    def sequential(self):
        return self

    def batch(self, n: int):
        return self

    def inline(self):
        return self

    def on_close(self, function: Callable[[], None]):
        out = self._with(self._df)
        out._on_close = (*self._on_close, function)
        return out

    def close(self) -> None:
        for f in self._on_close:
            f()

    def self_close(self):
        """The stream closes itself when a terminal operation has run."""
        out = self._with(self._df)
        out._closes = True
        return out

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def _column(self, made: Callable[[], Any]) -> Any:
        """What `made` compiles to for the records of this stream."""
        with over(self._df):
            return made()

    def filter(self, p: Predicate):
        return self._with(self._df.where(self._column(p.top)))

    def limit(self, n: int):
        return self._with(self._df.limit(n))

    def skip(self, n: int):
        return self._with(self._df.offset(n))

    def peek(self, name: str = "peek", *columns: Column):
        """Counts (or further aggregates) of what passes here, seen as Spark's observed metrics."""
        return self._with(self._df.observe(name, *(columns or (F.count(F.lit(1)).alias("rows"),))))

    def _sorted(self, orders: tuple[Order, ...]):
        # what was sorted before breaks ties
        every = (*orders, *self._orders)
        return self._with(self._df.orderBy(*self._column(lambda: [o.column() for o in every])), every)

    # terminals
    def count(self) -> int:
        return self._df.count()

    def match_frame(self, p: Predicate) -> DataFrame:
        c = self._column(p.column)
        return self._df.agg(
            F.coalesce(F.bool_or(c), F.lit(False)).alias("any_match"), F.coalesce(F.bool_and(c), F.lit(True)).alias("all_match"), F.coalesce(~F.bool_or(c), F.lit(True)).alias("none_match")
        )

    def any_match(self, p: Predicate) -> bool:
        return not self._df.where(self._column(p.top)).limit(1).isEmpty()

    def all_match(self, p: Predicate) -> bool:
        return self._df.where(~self._column(p.column)).limit(1).isEmpty()

    def none_match(self, p: Predicate) -> bool:
        return not self.any_match(p)

    def find_any(self) -> Row | None:
        return self._df.limit(1).first()

    find_first = find_any

    def extreme_frame(self, order: Order, largest: bool = False) -> DataFrame:
        return self._df.orderBy(self._column((order.reversed() if largest else order).column)).limit(1)

    def min(self, order: Order) -> Row | None:
        return self.extreme_frame(order).first()

    def max(self, order: Order) -> Row | None:
        return self.extreme_frame(order, True).first()

    def iterator(self) -> Iterator[Row]:
        return self._df.toLocalIterator(prefetchPartitions=True)

    spliterator = iterator

    def to_array(self) -> list[Row]:
        return self._df.collect()

    def for_each(self, function: Callable[[Row], None]) -> None:
        self._df.foreach(function)

    def for_each_ordered(self, function: Callable[[Row], None]) -> None:
        for row in self.iterator():
            function(row)

    def reduce(self, function: Callable[[Any, Any], Any], identity: Any = None, combiner: Callable[[Any, Any], Any] | None = None) -> Any:
        """A fold by the caller's own associative function: per partition on the executors, then over their results."""

        def part(rows: Iterator[Row]) -> Iterator[Any]:
            first = next(rows, _NOTHING) if identity is None else identity
            return iter([] if first is _NOTHING else [fold_left(function, rows, first)])

        found = self._elements().mapPartitions(part).collect()
        if identity is None:
            return fold_left(combiner or function, found) if found else None
        return fold_left(combiner or function, found, identity)

    def _elements(self):
        return self._df.rdd

    def collect3(self, supplier: Callable[[], Any], accumulate: Callable[[Any, Any], None], combine: Callable[[Any, Any], None]) -> Any:
        def part(rows: Iterator[Row]) -> Iterator[Any]:
            box = supplier()
            for r in rows:
                accumulate(box, r)
            return iter([box])

        out = supplier()
        for box in self._elements().mapPartitions(part).collect():
            combine(out, box)
        return out

    def collect_frame(self, collector: Collector | None = None) -> DataFrame:
        with over(self._df):
            return collected_frame(self._df, collector or counting())

    def collect(self, collector: Collector) -> Any:
        with over(self._df):
            return collected(self._df, collector)


class ValueStream(_Stream):
    """A stream of values in a column `value`."""

    def __init__(self, df: DataFrame, kind: str, orders: tuple[Order, ...] = ()):
        super().__init__(df, orders)
        self.kind = kind

    @property
    def value(self) -> Expr:
        return Derived(self.kind, F.col("value"))

    def _mapped(self, made: Column, kind: str) -> ValueStream:
        return self._values(self._df.select(made.cast(TYPES[kind]).alias("value") if kind in TYPES else made.alias("value")), kind)

    def map(self, function: Callable[[Expr], Expr]) -> ValueStream:
        made = function(self.value)
        return self._mapped(self._column(made.column), made.kind)

    def map_to(self, kind: str, function: Callable[[Expr], Expr] | None = None) -> ValueStream:
        return self._mapped(self._column((function(self.value) if function else self.value).column), kind)

    def as_long_stream(self) -> ValueStream:
        return self.map_to("long")

    def as_double_stream(self) -> ValueStream:
        return self.map_to("double")

    def boxed(self) -> ValueStream:
        return self

    def flat_map(self, made: Column, kind: str) -> ValueStream:
        """`made`: an array column of `value`; one element per entry."""
        return self._values(self._df.select(F.explode(made).alias("value")), kind)

    def distinct(self) -> ValueStream:
        return self._with(self._df.distinct(), ())

    def sorted(self, *orders: Order) -> ValueStream:
        return self._sorted(orders or (Order(self.value),))

    def filter(self, p: Predicate | Callable[[Expr], Predicate]) -> ValueStream:
        return super().filter(p if isinstance(p, Predicate) else p(self.value))

    def _number(self) -> None:
        if self.kind not in NUMBERS:
            raise TypeError(f"{self.kind} is no number")

    def sum_frame(self) -> DataFrame:
        self._number()
        zero = F.lit(0.0) if self.kind == "double" else F.lit(0).cast("bigint")
        return self._df.agg(F.coalesce(F.sum("value"), zero).alias("sum"))

    def sum(self) -> float:
        return self.sum_frame().first()[0]

    def average_frame(self) -> DataFrame:
        self._number()
        return self._df.agg(F.avg("value").alias("average"))

    def average(self) -> float | None:
        return self.average_frame().first()[0]

    def min_frame(self) -> DataFrame:
        return self._df.agg(F.min("value").alias("min"))

    def max_frame(self) -> DataFrame:
        return self._df.agg(F.max("value").alias("max"))

    def min(self, order: Order | None = None) -> Any:
        return self.min_frame().first()[0] if order is None else super().min(order)

    def max(self, order: Order | None = None) -> Any:
        return self.max_frame().first()[0] if order is None else super().max(order)

    def summary_frame(self) -> DataFrame:
        self._number()
        return self.collect_frame(summarizing(self.value, "value"))

    def summary_statistics(self) -> dict:
        return summarizing(self.value, "value").finish(self.summary_frame().first().asDict())

    def find_any(self) -> Any:
        row = self._df.limit(1).first()
        return None if row is None else row[0]

    find_first = find_any

    def _elements(self):
        return self._df.rdd.map(lambda r: r[0])

    def to_array(self) -> list:
        return [r[0] for r in self._df.collect()]

    def iterator(self) -> Iterator:
        return (r[0] for r in super().iterator())


def _closing(terminal: Callable) -> Callable:
    @wraps(terminal)
    def run(self, *args, **kwargs):
        try:
            return terminal(self, *args, **kwargs)
        finally:
            if self._closes:
                self.close()

    return run


class RecordStream(_Stream):
    """A stream of records: distinct by key, without an order of its own."""

    def __init__(self, df: DataFrame, key: str, access: Callable[[Predicate], tuple[DataFrame, StreamPlan]] | None = None):
        super().__init__(df)
        self._key, self._access, self._leading, self._open = key, access, Always(), True

    def _with(self, df: DataFrame, orders: tuple[Order, ...] | None = None):
        out = super()._with(df, orders)
        out._open = False
        return out

    def filter(self, p: Predicate) -> RecordStream:
        """Filters from the start on are joined to one predicate, for which the access path is chosen."""
        if not self._open:
            return super().filter(p)
        leading = p if isinstance(self._leading, Always) else self._leading & p
        base = getattr(self, "_base", self._df)
        source = base
        if self._access is not None:
            source, _ = self._access(leading)
        with over(source):
            out = self._with(source.where(leading.top()))
        out._open, out._leading, out._base = True, leading, base
        return out

    def plan(self) -> StreamPlan:
        return self._access(self._leading)[1] if self._access else plan_of(self._leading, {})

    def explain(self, consumer: Callable[[StreamPlan | str], None] = print, physical: bool = False) -> RecordStream:
        """Tell the access path, and with `physical` what each stage will do on the cluster."""
        consumer(self.plan())
        if physical:
            execution = self._df._jdf.queryExecution()
            consumer(execution.explainString(self._df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")))
        return self

    def distinct(self) -> RecordStream:
        return self

    def sorted(self, *orders: Order) -> RecordStream:
        if not orders:
            raise TypeError("records have no natural order")
        return self._sorted(orders)

    def map(self, expr: Expr) -> ValueStream:
        return self._values(self._df.select(self._column(expr.column).alias("value")), expr.kind)

    def _map_to(self, expr: Expr, kind: str) -> ValueStream:
        if expr.kind not in NUMBERS:
            raise TypeError(f"{expr.kind} is no number")
        return self.map(expr).map_to(kind)

    def map_to_int(self, expr: Expr) -> ValueStream:
        return self._map_to(expr, "int")

    def map_to_long(self, expr: Expr) -> ValueStream:
        return self._map_to(expr, "long")

    def map_to_double(self, expr: Expr) -> ValueStream:
        return self._map_to(expr, "double")

    def flat_map(self, made: Column, kind: str) -> ValueStream:
        return self._values(self._df.select(F.explode(made).alias("value")), kind)

    def log(self, text: str, *exprs: Expr) -> RecordStream:
        """Log a formatted line for every record that passes, on the executors, when a terminal operation runs."""
        line = self._column(lambda: F.format_string(text, *(e.column() for e in exprs)))
        names = self._df.columns

        def each(batches: Iterator) -> Iterator:
            out = logging.getLogger("cellstream")
            for batch in batches:
                for told in batch.column(batch.num_columns - 1).to_pylist():
                    out.info(told)
                yield batch.select(names)

        return self._with(self._df.withColumn("__line", line).mapInArrow(each, self._df.schema))

    # mutation as plans; datasets write them
    def _kinds(self) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self._df.schema}

    def mutate_then(self, update: Update) -> DataFrame:
        """(first, second): each record before and after."""
        new = self._column(lambda: update.columns(self._kinds(), self._key))
        return self._df.select(F.struct(*(F.col(f"`{c}`") for c in self._df.columns)).alias("first"), F.struct(*(c.alias(n) for n, c in new.items())).alias("second"))

    def delete_then(self) -> DataFrame:
        return self._df

    def lookup(self, expr: Expr, other: DataFrame, other_key: str, how: str = "inner") -> DataFrame:
        """For each record the one of another dataset under a key: `on(key).read` of each element as one join."""
        return self._df.join(other, self._column(expr.column) == other[other_key], how)


def mutated(df: DataFrame, key: str, p: Predicate, update: Update) -> DataFrame:
    """All records, those under `p` updated: one projection, no shuffle."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    with over(kinds):
        hit, new = p.column(), update.columns(kinds, key)
    return df.select(*(F.when(hit, c).otherwise(F.col(f"`{n}`") if n in kinds else F.lit(None)).alias(n) for n, c in new.items()))


def without(df: DataFrame, p: Predicate) -> DataFrame:
    with over(df):
        return df.where(~p.column())


for _kind in (_Stream, ValueStream):
    for _name in ("count", "any_match", "all_match", "find_any", "find_first", "min", "max", "to_array", "for_each", "reduce", "collect3", "collect", "sum", "average", "summary_statistics"):
        if _name in vars(_kind):
            setattr(_kind, _name, _closing(vars(_kind)[_name]))
