"""Arithmetic written as text, turned into a column or a number; nothing else is let in."""

from __future__ import annotations

import ast
import math
import operator
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BINARY: dict[type, Callable] = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod, ast.Pow: operator.pow}
NAMES = {"pi": math.pi, "e": math.e}
FUNCTIONS: dict[str, tuple[Callable, Callable]] = {
    "sqrt": (math.sqrt, F.sqrt), "abs": (abs, F.abs), "round": (round, F.bround), "log": (math.log, F.log), "log10": (math.log10, F.log10), "log2": (math.log2, F.log2), "exp": (math.exp, F.exp),
    "sin": (math.sin, F.sin), "cos": (math.cos, F.cos), "tan": (math.tan, F.tan), "asin": (math.asin, F.asin), "acos": (math.acos, F.acos), "atan": (math.atan, F.atan), "floor": (math.floor, F.floor),
    "ceil": (math.ceil, F.ceil), "radians": (math.radians, F.radians), "degrees": (math.degrees, F.degrees), "pow": (math.pow, F.pow), "min": (min, F.least), "max": (max, F.greatest),
}


def parsed(expression: str) -> ast.expr:
    try:
        return ast.parse(expression.strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not an expression: {expression!r}") from e


def evaluate(expression: str, variables: dict[str, float] | None = None) -> tuple[float, list[str]]:
    """The value, and a line for each step, innermost first."""
    names, steps = NAMES | (variables or {}), []

    def walk(n: ast.expr) -> float:
        if isinstance(n, ast.Constant) and isinstance(n.value, int | float) and not isinstance(n.value, bool):
            return float(n.value)
        if isinstance(n, ast.Name) and n.id in names:
            return float(names[n.id])
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.UAdd | ast.USub):
            return walk(n.operand) * (-1 if isinstance(n.op, ast.USub) else 1)
        if isinstance(n, ast.BinOp) and type(n.op) in BINARY:
            value = float(BINARY[type(n.op)](walk(n.left), walk(n.right)))
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in FUNCTIONS and not n.keywords:
            value = float(FUNCTIONS[n.func.id][0](*map(walk, n.args)))
        else:
            raise ValueError(f"not allowed: {ast.unparse(n)}")
        steps.append(f"{ast.unparse(n)} = {value:.6g}")
        return value

    try:
        return walk(parsed(expression)), steps
    except ZeroDivisionError as e:
        raise ValueError("division by zero") from e


def column(expression: str) -> Column:
    """The expression over columns of the same names; null where a divisor is zero."""

    def walk(n: ast.expr) -> Column:
        if isinstance(n, ast.Constant) and isinstance(n.value, int | float) and not isinstance(n.value, bool):
            return F.lit(float(n.value))
        if isinstance(n, ast.Name):
            return F.lit(NAMES[n.id]) if n.id in NAMES else F.col(n.id).cast("double")
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, ast.UAdd | ast.USub):
            return -walk(n.operand) if isinstance(n.op, ast.USub) else walk(n.operand)
        if isinstance(n, ast.BinOp) and type(n.op) in BINARY:
            a, b = walk(n.left), walk(n.right)
            if isinstance(n.op, ast.Pow):
                return F.pow(a, b)
            if isinstance(n.op, ast.FloorDiv | ast.Mod):
                whole = F.floor(F.try_divide(a, b))
                return whole.cast("double") if isinstance(n.op, ast.FloorDiv) else a - b * whole
            return F.try_divide(a, b) if isinstance(n.op, ast.Div) else BINARY[type(n.op)](a, b)
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in FUNCTIONS and not n.keywords:
            return FUNCTIONS[n.func.id][1](*map(walk, n.args)).cast("double")
        raise ValueError(f"not allowed: {ast.unparse(n)}")

    return walk(parsed(expression))
