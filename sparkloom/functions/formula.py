"""Arithmetic formulas compiled to Columns.

The grammar is that of Python arithmetic restricted to names, numbers, ``+ - * /``
and unary signs, plus, where allowed, the whole-table calls ``sum('f')`` and
``count()``.  A formula that can't be evaluated for a row (null, text that is no
number, division by zero) is null there.
"""

from __future__ import annotations

import ast
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_CHARS, MOST_NODES = 1024, 128


@dataclass
class Formula:
    text: str
    tree: ast.expr
    names: list[str] = field(default_factory=list)

    def column(self, value=None, guard_zero: bool = True) -> Column:
        """The value for a row; ``value(name)`` gives a field's Column."""
        return _compile(self.tree, value or number)

    def divisors(self, value=None) -> list[Column]:
        value = value or number
        return [_compile(n.right, value) for n in ast.walk(self.tree) if isinstance(n, ast.BinOp) and isinstance(n.op, ast.Div)]


def number(name: str | Column) -> Column:
    c = F.col(f"`{name}`") if isinstance(name, str) else name
    return c.try_cast("double")


def parse(text: str, aggregates: bool = False) -> Formula:
    if len(text) > MOST_CHARS:
        raise ValueError("formula is too long")
    try:
        tree = ast.parse(text, mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"formula can't be read: {text!r}") from e
    if sum(1 for _ in ast.walk(tree)) > MOST_NODES:
        raise ValueError("formula has too many parts")
    names: list[str] = []
    _check(tree, aggregates, names)
    return Formula(text, tree, names)


def _check(node: ast.expr, aggregates: bool, names: list[str]) -> None:
    match node:
        case ast.BinOp(left, ast.Add() | ast.Sub() | ast.Mult() | ast.Div(), right):
            _check(left, aggregates, names)
            _check(right, aggregates, names)
        case ast.UnaryOp(ast.USub() | ast.UAdd(), operand):
            _check(operand, aggregates, names)
        case ast.Constant(value) if isinstance(value, (int, float)) and not isinstance(value, bool):
            pass
        case ast.Name(name):
            if name not in names:
                names.append(name)
        case ast.Call(ast.Name("sum"), [ast.Constant(str())], []) | ast.Call(ast.Name("count"), [], []) if aggregates:
            pass
        case _:
            raise ValueError(f"not allowed in a formula: {ast.dump(node)[:60]}")


def _compile(node: ast.expr, value) -> Column:
    match node:
        case ast.BinOp(left, op, right):
            a, b = _compile(left, value), _compile(right, value)
            if isinstance(op, ast.Add):
                return a + b
            if isinstance(op, ast.Sub):
                return a - b
            return a * b if isinstance(op, ast.Mult) else F.try_divide(a, b)
        case ast.UnaryOp(op, operand):
            return -_compile(operand, value) if isinstance(op, ast.USub) else _compile(operand, value)
        case ast.Constant(v):
            return F.lit(float(v))
        case ast.Name(name):
            return value(name)
        case ast.Call(ast.Name("sum"), [ast.Constant(name)], []):
            return F.sum(F.coalesce(number(name), F.lit(0.0)))
        case _:
            return F.count("*").cast("double")


def close(a: Column, b: Column, tolerance: float) -> Column:
    """Whether two numbers differ by at most the tolerance; null counts as no."""
    return F.coalesce(F.abs(a.try_cast("double") - b.try_cast("double")) <= tolerance, F.lit(False))
