"""Typed cells and the expression tree over them. Trees compile to Spark columns and stay open to the planner.

An absent cell is NULL. Predicates are two-valued: a gated comparison on an absent cell is false, and so is its negation;
any other negation is the plain opposite. At the top of a filter bare comparisons are emitted, which drop NULL just the
same and reach the Parquet scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPES: dict[str, T.DataType] = {
    "bool": T.BooleanType(),
    "char": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "bytes": T.BinaryType(),
}
NUMBERS = ("int", "long", "double")
COMPARABLE = ("bool", "char", "int", "long", "double", "string")
_OPPOSITE = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}
_APPLY = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}
#: Columns and types of the records that expressions are being compiled for; None where they aren't known.
_KINDS: ContextVar[dict[str, str] | None] = ContextVar("kinds", default=None)


@contextmanager
def over(records: DataFrame | dict[str, str]) -> Iterator[None]:
    """Expressions compiled in here are for these records: a cell that has no column of its type there is absent."""
    kinds = records if isinstance(records, dict) else {f.name: f.dataType.simpleString() for f in records.schema}
    token = _KINDS.set(kinds)
    try:
        yield
    finally:
        _KINDS.reset(token)


#: The struct whose fields cells are read from; None where they are columns.
_RECORD: ContextVar[Column | None] = ContextVar("record", default=None)


@contextmanager
def inside(record: Column) -> Iterator[None]:
    """Cells compiled in here are fields of `record`."""
    token = _RECORD.set(record)
    try:
        yield
    finally:
        _RECORD.reset(token)


def _column(name: str) -> Column:
    record = _RECORD.get()
    return F.col(f"`{name}`") if record is None else record.getField(name)


def physical(name: str, kind: str, kinds: dict[str, str]) -> str:
    """The column for a cell: its name, or `name#type` where the name's column has another type."""
    return name if kinds.get(name, TYPES[kind].simpleString()) == TYPES[kind].simpleString() else f"{name}#{kind}"


def cell_name(column: str) -> str:
    """The cell name that a column is for."""
    name, mark, kind = column.rpartition("#")
    return name if mark and kind in TYPES else column


def siblings(name: str, kinds: dict[str, str]) -> list[str]:
    """All columns that hold cells of a name."""
    return [c for c in kinds if cell_name(c) == name]


PYTHON = {"bool": (bool,), "char": (str,), "int": (int,), "long": (int,), "double": (float, int), "string": (str,), "bytes": (bytes, bytearray)}
_RANGE = {"int": 1 << 31, "long": 1 << 63}


def checked(value: Any, kind: str) -> Any:
    """`value` if it is one of `kind`; null values, other types and numbers out of range are errors."""
    if value is None:
        raise ValueError("a cell value can't be null")
    if not isinstance(value, PYTHON[kind]) or (isinstance(value, bool) and kind != "bool"):
        raise TypeError(f"{value!r} is no {kind}")
    if kind == "char" and len(value) != 1:
        raise ValueError(f"{value!r} is no single character")
    if kind in _RANGE and not -_RANGE[kind] <= value < _RANGE[kind]:
        raise OverflowError(f"{value!r} is out of the range of {kind}")
    return float(value) if kind == "double" else value


class Predicate:
    """A Boolean function of a record."""

    def column(self) -> Column:
        """True or false, never NULL."""
        raise NotImplementedError

    def top(self) -> Column:
        """The same at the top of a filter, where NULL drops a row as false does."""
        return self.column()

    def negate(self) -> Predicate:
        return Not(self)

    def negate_plainly(self) -> Predicate:
        """The opposite, which is true wherever this is false: also for absent cells."""
        return Not(self)

    def and_(self, other: Predicate) -> Predicate:
        return And(self, other)

    def or_(self, other: Predicate) -> Predicate:
        return Or(self, other)

    __and__, __or__, __invert__ = and_, or_, negate


@dataclass(frozen=True)
class Comparison(Predicate):
    op: str
    operand: Expr
    value: Any
    gated: bool

    def _bare(self) -> Column:
        return _APPLY[self.op](self.operand.column(), F.lit(self.value).cast(TYPES[self.operand.kind]))

    def column(self) -> Column:
        return F.coalesce(self._bare(), F.lit(False)) if self.gated else self._bare()

    def top(self) -> Column:
        return self._bare()

    def negate(self) -> Predicate:
        return Comparison(_OPPOSITE[self.op], self.operand, self.value, self.gated)


@dataclass(frozen=True)
class And(Predicate):
    left: Predicate
    right: Predicate

    def column(self) -> Column:
        return self.left.column() & self.right.column()

    def top(self) -> Column:
        return self.left.top() & self.right.top()


@dataclass(frozen=True)
class Or(Predicate):
    left: Predicate
    right: Predicate

    def column(self) -> Column:
        return self.left.column() | self.right.column()

    def top(self) -> Column:
        return self.left.top() | self.right.top()


@dataclass(frozen=True)
class Not(Predicate):
    inner: Predicate

    def column(self) -> Column:
        return ~self.inner.column()

    def negate(self) -> Predicate:
        return self.inner


@dataclass(frozen=True)
class Exists(Predicate):
    cell: Cell

    def column(self) -> Column:
        return self.cell.column().isNotNull()


@dataclass(frozen=True)
class StartsWith(Predicate):
    operand: Expr
    prefix: str

    def column(self) -> Column:
        return F.coalesce(self.operand.column().startswith(self.prefix), F.lit(False))

    def top(self) -> Column:
        return self.operand.column().startswith(self.prefix)


@dataclass(frozen=True)
class Always(Predicate):
    def column(self) -> Column:
        return F.lit(True)


@dataclass(frozen=True)
class Opaque(Predicate):
    """A Boolean column of the caller's own (a UDF, say); NULL counts as false. The planner can't look into it."""

    given: Column = field(compare=False)

    def column(self) -> Column:
        return F.coalesce(self.given, F.lit(False))

    def top(self) -> Column:
        return self.given


@dataclass(frozen=True)
class RecordEquals(Predicate):
    """Key and all cells are those of a given record (pairs of a column name and a value); its absent cells are absent."""

    record: tuple[tuple[str, Any], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, value in self.record:
            out = out & F.col(f"`{name}`").eqNullSafe(F.lit(value))
        return out


@dataclass(frozen=True)
class Order:
    """A comparator: a key of a sort."""

    expr: Expr
    descending: bool = False

    def reversed(self) -> Order:
        return Order(self.expr, not self.descending)

    def column(self) -> Column:
        c = self.expr.column()
        return c.desc_nulls_last() if self.descending else c.asc_nulls_first()

    def rank(self) -> Column:
        """A column that rises along this order, absent values where a sort has them: also where values fall."""
        c, kind = self.expr.column(), self.expr.kind
        if not self.descending:
            return c
        if kind == "bool":
            turned = ~c
        elif kind == "double":  # NaN is above all values, -0.0 equal to 0.0
            turned = F.struct(~F.isnan(c), F.when(F.isnan(c), 0.0).otherwise(-c))
        elif kind in NUMBERS:
            turned = F.bitwise_not(c)
        else:  # by bytes; a text stands behind those that begin with it
            turned = F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~"))
        return F.struct(c.isNull(), turned)


class Expr:
    """A typed function of a record. `optional` says that it may be absent (NULL)."""

    kind: str
    optional: bool = False

    def column(self) -> Column:
        raise NotImplementedError

    def _compare(self, op: str, value: Any) -> Predicate:
        if op != "=" and self.kind not in COMPARABLE:
            raise TypeError(f"{self.kind} has no order")
        return Comparison(op, self, checked(value, self.kind), self.optional)

    def is_(self, value: Any) -> Predicate:
        return self._compare("=", value)

    def is_greater_than(self, value: Any) -> Predicate:
        return self._compare(">", value)

    def is_less_than(self, value: Any) -> Predicate:
        return self._compare("<", value)

    def is_greater_than_or_equal_to(self, value: Any) -> Predicate:
        return self._compare(">=", value)

    def is_less_than_or_equal_to(self, value: Any) -> Predicate:
        return self._compare("<=", value)

    def length(self) -> Expr:
        if self.kind != "string":
            raise TypeError("only strings have a length")
        return Derived("int", lambda: F.length(self.column()), self.optional)

    def starts_with(self, prefix: str) -> Predicate:
        if self.kind != "string":
            raise TypeError("only strings have a prefix")
        return StartsWith(self, prefix)

    def as_comparator(self) -> Order:
        if self.kind not in COMPARABLE:
            raise TypeError(f"{self.kind} has no order")
        return Order(self)

    # numbers; the operand is a constant
    def add(self, n: Any, wrap: bool = False) -> Expr:
        return self._math("+", n, wrap)

    def subtract(self, n: Any, wrap: bool = False) -> Expr:
        return self._math("-", n, wrap)

    def multiply(self, n: Any, wrap: bool = False) -> Expr:
        return self._math("*", n, wrap)

    def divide(self, n: Any) -> Expr:
        return self._math("/", n, False)

    def increment(self) -> Expr:
        return self.add(1)

    def decrement(self) -> Expr:
        return self.subtract(1)

    def _math(self, op: str, n: Any, wrap: bool) -> Expr:
        """Whole numbers overflow with an error, or wrap around if `wrap`; division truncates."""
        if self.kind not in NUMBERS:
            raise TypeError(f"{self.kind} is no number")
        n = checked(n, self.kind)
        if op == "/" and self.kind != "double" and n == 0:
            raise ZeroDivisionError("division of whole numbers by zero")
        return Derived(self.kind, lambda: self._calculated(op, n, wrap), self.optional)

    def _calculated(self, op: str, n: Any, wrap: bool) -> Column:
        c, target = self.column(), TYPES[self.kind]
        if op == "/":
            if self.kind != "double":
                return F.call_function("div", c, F.lit(n)).cast(target)
            # by IEEE: a zero divisor gives an infinity or NaN
            return c / F.lit(n) if n else F.when(c.isNull(), c).when(F.isnan(c) | (c == 0), F.lit(float("nan"))).otherwise(F.signum(c) * F.lit(float("inf")))
        n_col = F.lit(n).cast(target)
        if not wrap or self.kind == "double":
            return c + n_col if op == "+" else c - n_col if op == "-" else c * n_col
        # whole numbers in a wider type, folded to their low bits
        wide = "bigint" if self.kind == "int" else "decimal(38,0)"
        c, n_col = c.cast(wide), F.lit(n).cast(wide)
        if self.kind == "int":
            whole = c + n_col if op == "+" else c - n_col if op == "-" else c * n_col
            low = whole.bitwiseAND(F.lit(0xFFFFFFFF))
            return (low.bitwiseXOR(F.lit(0x80000000)) - F.lit(0x80000000)).cast("int")
        size, half = (F.lit(str(1 << b)).cast(wide) for b in (64, 63))
        if op == "*":  # by halves of the constant, so that no product has more than 38 digits
            low, high = n & 0xFFFFFFFF, n >> 32
            shifted = F.pmod(c * F.lit(high).cast("decimal(11,0)"), size) * F.lit(1 << 32).cast("decimal(11,0)")
            whole = F.pmod(shifted, size) + F.pmod(c * F.lit(low).cast("decimal(11,0)"), size)
        else:
            whole = c + n_col if op == "+" else c - n_col
        low = F.pmod(whole, size)
        return F.when(low >= half, low - size).otherwise(low).cast("bigint")


@dataclass(frozen=True)
class Derived(Expr):
    kind: str
    given: Column | Callable[[], Column] = field(compare=False)
    optional: bool = False

    def column(self) -> Column:
        return self.given() if callable(self.given) and not isinstance(self.given, Column) else self.given


@dataclass(frozen=True)
class Cell(Expr):
    """An optional cell value."""

    name: str
    kind: str
    optional: bool = True

    def column(self) -> Column:
        kinds = _KINDS.get()
        name = self.name if kinds is None else physical(self.name, self.kind, kinds)
        if kinds is not None and name not in kinds and _RECORD.get() is None:
            return F.lit(None).cast(TYPES[self.kind])
        return _column(name).cast(TYPES[self.kind])

    def is_true(self) -> Predicate:
        return self.is_(True)

    def is_false(self) -> Predicate:
        return self.is_(False)


@dataclass(frozen=True)
class CellDefinition:
    """A name and one of seven types. Its column is the name, or `name#type` where a dataset has one name in two types."""

    name: str
    kind: str

    def __post_init__(self):
        if self.kind not in TYPES:
            raise ValueError(f"no such type: {self.kind}")

    def value(self) -> Cell:
        return Cell(self.name, self.kind)

    def value_or(self, default: Any) -> Expr:
        other = F.lit(checked(default, self.kind)).cast(TYPES[self.kind])
        return Derived(self.kind, lambda: F.coalesce(self.value().column(), other))

    def value_or_fail(self) -> Expr:
        told = F.raise_error(F.lit(f"no cell {self.name}")).cast(TYPES[self.kind])
        return Derived(self.kind, lambda: F.coalesce(self.value().column(), told))

    def exists(self) -> Predicate:
        return Exists(self.value())

    def cell(self, value: Any) -> tuple[CellDefinition, Any]:
        return self, checked(value, self.kind)


def define(name: str, kind: str) -> CellDefinition:
    return CellDefinition(name, kind)


def same_record(record: Any) -> RecordEquals:
    """Whether a record is this one as it was read: its key and all its cells."""
    return RecordEquals(tuple(record.asDict().items()))


def identity(kind: str = "record") -> Expr:
    """The record itself (or, of a value stream, the value): what a collector of whole records is fed with."""
    return Derived(kind, F.struct("*") if kind == "record" else F.col("value"))


def key(name: str, kind: str) -> Expr:
    """The record key, which is never absent."""
    return Derived(kind, lambda: _column(name))


def constant(value: Any, kind: str) -> Expr:
    return Derived(kind, F.lit(checked(value, kind)).cast(TYPES[kind]))


def untyped(name: str, columns: list[str]) -> Column:
    """The first present cell of a name in any of its types, as text."""
    return F.coalesce(*(F.col(f"`{c}`").cast("string") for c in siblings(name, dict.fromkeys(columns, ""))))
