"""A small predicate language, compiled from text to one Column.

Grammar: ``and``, ``or``, ``not``; chained comparisons; ``+ - * /``; the functions
disjoint, overlap, shared, jaccard and contains; fields ``entity.field``; numbers,
strings and booleans. A missing (null) field makes the predicate abstain unless an
earlier operand already decides it, so ``and`` and ``or`` are asymmetric: they look
at the right operand only if the left one doesn't decide.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from unpaired.functions import sets

FUNCTIONS: dict[str, Callable[[Column, Column], Column]] = {"disjoint": sets.disjoint, "overlap": sets.overlap, "shared": sets.shared, "jaccard": sets.jaccard, "contains": sets.contains}
COMPARISONS: dict[type, Callable[[Column, Column], Column]] = {
    ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b,
}
ARITHMETIC: dict[type, Callable[[Column, Column], Column]] = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide}


class RuleError(ValueError):
    """A rule that the language doesn't allow."""


def all_of(left: Column, right: Column) -> Column:
    return F.when(left.isNull(), None).when(~left, False).otherwise(right)


def any_of(left: Column, right: Column) -> Column:
    return F.when(left.isNull(), None).when(left, True).otherwise(right)


def parse(text: str) -> ast.expr:
    """The checked syntax tree of a predicate."""
    try:
        tree = ast.parse(text, mode="eval").body
    except SyntaxError as e:
        raise RuleError(f"syntax: {text!r}") from e
    _check(tree)
    return tree


def _check(node: ast.expr) -> None:
    if isinstance(node, ast.BoolOp):
        children = node.values
    elif isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        children = [node.operand]
    elif isinstance(node, ast.BinOp) and type(node.op) in ARITHMETIC:
        children = [node.left, node.right]
    elif isinstance(node, ast.Compare) and all(type(op) in COMPARISONS for op in node.ops):
        children = [node.left, *node.comparators]
    elif isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in FUNCTIONS and not node.keywords and len(node.args) == 2:
        children = node.args
        if node.func.id == "contains" and isinstance(node.args[0], ast.Constant):
            raise RuleError("contains needs a set first")
    elif isinstance(node, ast.Attribute) and isinstance(node.value, ast.Name):
        children = []
    elif isinstance(node, ast.Constant) and isinstance(node.value, (bool, int, float, str)):
        children = []
    else:
        raise RuleError(f"not allowed: {ast.unparse(node)}")
    for child in children:
        _check(child)


def fields(text: str) -> set[tuple[str, str]]:
    """The (entity, field) pairs that a predicate reads."""
    return {(n.value.id, n.attr) for n in ast.walk(parse(text)) if isinstance(n, ast.Attribute)}


def compile_rule(text: str, lookup: Callable[[str, str], Column | None]) -> Column:
    """A predicate as a Column; ``lookup(entity, field)`` gives a field's column.

    ``lookup`` gives None for a field that exists nowhere (it counts as missing in
    every row) and raises :class:`RuleError` for an unknown entity.
    """

    def build(node: ast.expr, kind: str = "string") -> Column:
        if isinstance(node, ast.BoolOp):
            join = all_of if isinstance(node.op, ast.And) else any_of
            parts = [build(v) for v in node.values]
            return reduce(lambda right, left: join(left, right), reversed(parts[:-1]), parts[-1])
        if isinstance(node, ast.UnaryOp):
            return ~build(node.operand)
        if isinstance(node, ast.BinOp):
            return ARITHMETIC[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.Compare):
            sides = [build(x) for x in (node.left, *node.comparators)]
            links = [COMPARISONS[type(op)](a, b) for op, a, b in zip(node.ops, sides, sides[1:], strict=False)]
            return reduce(lambda right, left: all_of(left, right), reversed(links[:-1]), links[-1])
        if isinstance(node, ast.Call):
            second = "string" if node.func.id == "contains" else "array<string>"
            return FUNCTIONS[node.func.id](build(node.args[0], "array<string>"), build(node.args[1], second))
        if isinstance(node, ast.Attribute):
            found = lookup(node.value.id, node.attr)
            return F.lit(None).cast(kind) if found is None else found
        return F.lit(node.value)

    return build(parse(text))


def lint(rules: Iterable[tuple[str, str]], available: Iterable[str]) -> list[tuple[str, list[str]]]:
    """(rule id, fields it lacks) of each (id, predicate); no lacking field: ready."""
    known = set(available)
    return [(name, sorted({f for _, f in fields(text)} - known)) for name, text in rules]
