"""Arithmetic in messages, evaluated without ``eval``."""

from __future__ import annotations

import ast
import operator
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow}
_UNARY = {ast.USub: operator.neg, ast.UAdd: operator.pos}
_EXPRESSION = re.compile(r"[-+*/^().\d\s]+")
#: Larger powers would take any time and memory.
MOST_DIGITS = 400


def evaluate(text: str) -> str | None:
    """The value of the longest expression in ``text``; whole numbers without a fraction, None if there is none."""
    found = [m.strip() for m in _EXPRESSION.findall(text) if re.search(r"\d", m)]
    if not found:
        return None
    try:
        value = _value(ast.parse(max(found, key=len).replace("^", "**"), mode="eval").body)
    except (SyntaxError, ValueError, ZeroDivisionError, OverflowError, RecursionError):
        return None
    return str(int(value)) if isinstance(value, int) or float(value).is_integer() else str(value)


def _value(node: ast.AST) -> float:
    if isinstance(node, ast.Constant) and type(node.value) in (int, float):
        return node.value
    if isinstance(node, ast.UnaryOp) and type(node.op) in _UNARY:
        return _UNARY[type(node.op)](_value(node.operand))
    if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
        left, right = _value(node.left), _value(node.right)
        if isinstance(node.op, ast.Pow) and abs(right) * len(str(abs(left))) > MOST_DIGITS:
            raise ValueError("power too large")
        return _BINARY[type(node.op)](left, right)
    raise ValueError("not arithmetic")


def calculate(text: Column) -> Column:
    """``evaluate`` on a column, in Arrow batches."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else evaluate(t))

    return run(text)
