"""Column expressions as SQL text.

A long expression over arrays is thousands of calls into the JVM when it is built from columns, which takes far longer than planning it. Here it
is put together as text and handed over in one call by ``column``. The names are those of ``pyspark.sql.functions``: a plain
``str`` argument is a column's name, ``lit`` makes a literal, functions take lambdas, and ``x.name`` is a field.
"""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_numbers = count(1)


class Text:
    """An expression; ``name`` is what a struct calls it."""

    __slots__ = ("name", "sql")

    def __init__(self, sql: str, name: str | None = None) -> None:
        self.sql, self.name = sql, name

    def _with(self, mark: str, other: Any, turned: bool = False) -> Text:
        a, b = self.sql, _value(other)
        return Text(f"`{mark}`({b}, {a})" if turned else f"`{mark}`({a}, {b})")

    def __getattr__(self, field: str) -> Text:
        if field.startswith("__"):
            raise AttributeError(field)
        return Text(f"{self.sql}.`{field}`", field)

    def __ne__(self, other: Any) -> Text:  # type: ignore[override]
        return ~(self == other)

    def __invert__(self) -> Text:
        return Text(f"`not`({self.sql})")

    def __neg__(self) -> Text:
        return Text(f"negative({self.sql})")

    def __pow__(self, other: Any) -> Text:
        return Text(f"power({self.sql}, {_value(other)})")

    def alias(self, name: str) -> Text:
        return Text(self.sql, name)

    def cast(self, kind: str) -> Text:
        return Text(f"{kind}({self.sql})" if kind in ("int", "bigint", "double", "string") else f"CAST({self.sql} AS {kind})")

    def isNull(self) -> Text:  # noqa: N802
        return Text(f"isnull({self.sql})")

    def isNotNull(self) -> Text:  # noqa: N802
        return Text(f"isnotnull({self.sql})")

    def isin(self, *values: Any) -> Text:
        return Text(f"array_contains({_value(values)}, {self.sql})")

    def between(self, low: Any, high: Any) -> Text:
        return (self >= low) & (self <= high)

    def contains(self, part: str) -> Text:
        return Text(f"contains({self.sql}, {_value(part)})")

    def endswith(self, part: str) -> Text:
        return Text(f"endswith({self.sql}, {_value(part)})")


for _name, _mark in {"add": "+", "sub": "-", "mul": "*", "truediv": "/", "mod": "%", "and": "and", "or": "or"}.items():
    setattr(Text, f"__{_name}__", lambda self, other, mark=_mark: self._with(mark, other))
    setattr(Text, f"__r{_name}__", lambda self, other, mark=_mark: self._with(mark, other, True))
for _name, _mark in {"eq": "=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    setattr(Text, f"__{_name}__", lambda self, other, mark=_mark: self._with(mark, other))


class Cases(Text):
    """``when`` and what follows it."""

    __slots__ = ("_cases",)

    def __init__(self, cases: str) -> None:
        super().__init__(f"`when`({cases})")
        self._cases = cases

    def when(self, test: Text, value: Any) -> Cases:
        return Cases(f"{self._cases}, {_value(test)}, {_value(value)}")

    def otherwise(self, value: Any) -> Text:
        return Text(f"`when`({self._cases}, {_value(value)})")


def _value(v: Any) -> str:
    """An operand: an expression, or a literal."""
    if isinstance(v, Text):
        return v.sql
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, float):
        return f"{v!r}D"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(v, (list, tuple)):
        return f"array({', '.join(map(_value, v))})"
    raise TypeError(f"no literal of {type(v)}")


def _argument(v: Any) -> str:
    """An argument of a function, where a string is a column and a function a lambda."""
    if isinstance(v, str):
        return col(v).sql
    if callable(v) and not isinstance(v, Text):
        names = [Text(f"v{next(_numbers)}") for _ in inspect.signature(v).parameters]
        head = names[0].sql if len(names) == 1 else f"({', '.join(n.sql for n in names)})"
        return f"{head} -> {_value(v(*names))}"
    return _value(v)


def col(name: str) -> Text:
    return Text(".".join(f"`{p}`" for p in name.split(".")), name.rsplit(".", 1)[-1])


def lit(v: Any) -> Text:
    return v if isinstance(v, Text) else Text(_value(v))


def when(test: Text, value: Any) -> Cases:
    return Cases(f"{_value(test)}, {_value(value)}")


def struct(*fields: Text | str) -> Text:
    fields = [col(f) if isinstance(f, str) else f for f in fields]
    return Text(f"named_struct({', '.join(f'{_value(f.name or f"col{i}")}, {f.sql}' for i, f in enumerate(fields, 1))})")


def create_map(*entries: Text) -> Text:
    return Text(f"map({', '.join(map(_argument, entries))})")


def __getattr__(name: str) -> Callable[..., Text]:
    """Any other function, by its name in SQL."""
    if name.startswith("_"):
        raise AttributeError(name)
    return lambda *arguments: Text(f"{name}({', '.join(map(_argument, arguments))})")


def column(text: Text | Column) -> Column:
    """What Spark takes."""
    return F.expr(text.sql) if isinstance(text, Text) else text


def added(rows: DataFrame, columns: dict[str, Text | Column]) -> DataFrame:
    return rows.withColumns({name: column(c) for name, c in columns.items()})


def functions_of(value: Any) -> Any:
    """This module for expressions as text, ``pyspark.sql.functions`` for columns, so that a helper serves both."""
    import sys

    return sys.modules[__name__] if isinstance(value, Text) else F


def for_columns(made: Callable[..., Text]) -> Callable[..., Any]:
    """Lets a function of texts take columns (names and plain literals) as well; it then gives a column."""

    @functools.wraps(made)
    def run(*arguments: Any, **named: Any) -> Any:
        taken = [Text(v._jc.toString()) if isinstance(v, Column) else v for v in arguments]
        out = made(*taken, **named)
        return column(out) if any(isinstance(v, Column) for v in arguments) else out

    return run
