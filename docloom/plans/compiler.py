"""From syntax tree to a Column, so that Catalyst pushes down and prunes.

A leaf is false where the field is missing or of another type than the literal,
and any element of a collection may match. Leaves stay bare predicates outside
``not``, for pushdown; below it nulls become false first.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.analysis import tokens
from .ast import All, And, Cmp, Contains, HasWord, Ne, Node, Not, Or, TokenPrefix
from .parser import parse

_OPS = {"=": operator.eq, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
Test = Callable[[Column, T.DataType], Column | None]


class TypedFields:
    """Fields of a DataFrame: ``name`` or ``:name`` is a column, ``a$b`` a nested one."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def any(self, field: str, test: Test) -> Column:
        for name in (field, field.removeprefix(":")):
            if name in self.schema.names:
                return _any(F.col(f"`{name}`"), self.schema[name].dataType, [], test)
            first, *rest = name.split("$")
            if rest and first in self.schema.names:
                return _any(F.col(f"`{first}`"), self.schema[first].dataType, rest, test)
        return F.lit(False)


class MapFields:
    """Fields of flattened documents: maps from a field's name to its texts, integers and floats."""

    columns = (("s", T.StringType()), ("n", T.LongType()), ("d", T.DoubleType()))

    def any(self, field: str, test: Test) -> Column:
        found = []
        for column, kind in self.columns:
            probe = test(F.lit(None).cast(kind), kind)
            if probe is not None:
                found.append(F.coalesce(F.exists(F.col(column)[field], _of_kind(test, kind)), F.lit(False)))
        return reduce(operator.or_, found) if found else F.lit(False)


def _of_kind(test: Test, kind: T.DataType) -> Callable[[Column], Column]:
    return lambda x: test(x, kind)


def _any(col: Column, kind: T.DataType, path: list[str], test: Test) -> Column:
    if isinstance(kind, T.ArrayType):
        return F.exists(col, lambda x: _any(x, kind.elementType, path, test))
    if isinstance(kind, T.VariantType):
        return _variant(col, path, test)
    if path and isinstance(kind, T.StructType):
        if path[0] not in kind.names:
            return F.lit(False)
        return _any(col[path[0]], kind[path[0]].dataType, path[1:], test)
    if path and isinstance(kind, T.MapType):
        return _any(col[path[0]], kind.valueType, path[1:], test)
    out = None if path else test(col, kind)
    return F.lit(False) if out is None else out


def _variant(col: Column, path: list[str], test: Test) -> Column:
    where = "$" + "".join(f"['{p}']" for p in path)
    part = F.try_variant_get(col, where, "variant")
    shape = F.schema_of_variant(part)
    found = []
    for kind, shapes in ((T.StringType(), ("STRING",)), (T.LongType(), ("BIGINT",)), (T.DoubleType(), ("DOUBLE", "FLOAT", "DECIMAL"))):
        matched = test(F.try_variant_get(col, where, kind.simpleString()), kind)
        if matched is not None:
            right = reduce(operator.or_, [shape.startswith(s) for s in shapes])
            found.append(right & F.coalesce(matched, F.lit(False)))
    return reduce(operator.or_, found) if found else F.lit(False)


def _compare(op: str, value: str | int | float) -> Test:
    def test(col: Column, kind: T.DataType) -> Column | None:
        if isinstance(value, str):
            return _OPS[op](col, F.lit(value)) if isinstance(kind, T.StringType) and op == "=" else None
        return _OPS[op](col, F.lit(value)) if isinstance(kind, T.NumericType) else None

    return test


def _text(predicate: Callable[[Column], Column]) -> Test:
    return lambda col, kind: predicate(col) if isinstance(kind, T.StringType) else None


def compile_node(node: Node, fields: TypedFields | MapFields) -> Column:
    def go(n: Node) -> Column:
        return compile_node(n, fields)

    match node:
        case All():
            return F.lit(True)
        case Cmp(op, field, value):
            return fields.any(field, _compare(op, value))
        case HasWord(field, word):
            return fields.any(field, _text(lambda c: F.array_contains(tokens(c), word)))
        case TokenPrefix(field, prefix, _):
            return fields.any(field, _text(lambda c: F.exists(tokens(c), lambda t: t.startswith(prefix))))
        case Contains(field, part):
            return fields.any(field, _text(lambda c: c.contains(part)))
        case And(args):
            return reduce(operator.and_, map(go, args)) if args else F.lit(False)
        case Or(args):
            return reduce(operator.or_, map(go, args)) if args else F.lit(False)
        case Not(args):
            return reduce(operator.and_, [~F.coalesce(go(a), F.lit(False)) for a in args]) if args else F.lit(True)
        case Ne(field, value):
            return go(Not((Cmp("=", field, value),)))
    raise TypeError(f"not a filter: {node!r}")


def compile_filter(text: str | Node, df: DataFrame) -> Column:
    node = parse(text) if isinstance(text, str) else text
    return compile_node(node, TypedFields(df.schema))


def variable(node: Node) -> bool:
    """Whether documents that match may have different scores."""
    match node:
        case HasWord():
            return True
        case And(args) | Or(args):
            return any(map(variable, args))
    return False
