"""Update operations: functions from a record to its new cells. All parts read the original record: one projection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellstream.functions.expr import TYPES, CellDefinition, Derived, Expr, cell_name, checked, inside, physical, siblings


@dataclass(frozen=True)
class Update:
    """change: column name -> new value; others stay. replace: others go."""

    change: Callable[[dict[str, str]], dict[str, Column]]
    replace: bool = False

    def columns(self, kinds: dict[str, str], key: str) -> dict[str, Column]:
        made = self.change(kinds)
        if key in made:
            raise ValueError("the key can't change")
        # a cell that is written in another type replaces the one of its name
        for name in list(made):
            for other in siblings(cell_name(name), kinds):
                made.setdefault(other, F.lit(None))
        out = {}
        for name, kind in kinds.items():
            if name == key:
                out[name] = F.col(f"`{name}`")
            elif name in made:
                out[name] = made[name].cast(kind)
            else:
                out[name] = F.lit(None).cast(kind) if self.replace else F.col(f"`{name}`")
        for name in made.keys() - kinds.keys():
            out[name] = made[name]
        return out


class Write:
    def __init__(self, cell: CellDefinition):
        self.cell = cell

    def value(self, value: Any) -> Update:
        made = F.lit(checked(value, self.cell.kind)).cast(TYPES[self.cell.kind])
        return Update(lambda kinds: {_place(self.cell, kinds): made})

    def result_of(self, expr: Expr) -> Update:
        if expr.kind != self.cell.kind:
            raise TypeError(f"{expr.kind} can't be written to {self.cell.kind}")
        return Update(lambda kinds: {_place(self.cell, kinds): expr.column().cast(TYPES[self.cell.kind])})


def _place(cell: CellDefinition, kinds: dict[str, str]) -> str:
    return physical(cell.name, cell.kind, kinds)


def _kind_of(value: Any) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int" if -(1 << 31) <= value < 1 << 31 else "long"
    return {float: "double", str: "string", bytes: "bytes"}[type(value)]


def write(cell: CellDefinition | tuple | str, value: Any = None) -> Write | Update:
    """`write(definition)`, `write(definition, value)`, `write(cell)`, or `write(name, value)` with the value's own type."""
    if isinstance(cell, tuple):
        return Write(cell[0]).value(cell[1])
    if isinstance(cell, str):
        return Write(CellDefinition(cell, _kind_of(value))).value(value)
    return Write(cell) if value is None else Write(cell).value(value)


def remove(cell: CellDefinition) -> Update:
    return Update(lambda kinds: {_place(cell, kinds): F.lit(None).cast(TYPES[cell.kind])})


def install(*cells: tuple[CellDefinition, Any]) -> Update:
    if len({c.name for c, _ in cells}) < len(cells):
        raise ValueError("a cell name stands twice")
    return Update(lambda kinds: {_place(c, kinds): F.lit(checked(v, c.kind)).cast(TYPES[c.kind]) for c, v in cells}, replace=True)


def all_of(*parts: Update) -> Update:
    """Later parts win where two name one cell."""

    def change(kinds: dict[str, str]) -> dict[str, Column]:
        out: dict[str, Column] = {}
        for p in parts:
            if p.replace:
                out = {k: F.lit(None).cast(v) for k, v in kinds.items()}
            made = p.change(kinds)
            for name in made:
                for other in siblings(cell_name(name), {**kinds, **dict.fromkeys(out, "")}):
                    out.pop(other, None)
            out |= made
        return out

    return Update(change)


def custom(function: Callable[[dict[str, str]], dict[str, Column]]) -> Update:
    """Own columns by name, from the column types."""
    return Update(function)


def _of_pair(side: str, part: Expr | str, kind: str | None) -> Expr:
    if isinstance(part, str):
        return Derived(kind, F.col(f"{side}.`{part}`"), True)

    def made() -> Column:
        with inside(F.col(side)):
            return part.column()

    return Derived(part.kind, made, part.optional)


def before(part: Expr | str, kind: str | None = None) -> Expr:
    """Of (before, after) pairs: an expression over the record before the mutation, or its cell of a name and type."""
    return _of_pair("first", part, kind)


def after(part: Expr | str, kind: str | None = None) -> Expr:
    return _of_pair("second", part, kind)
