"""Predicates as values that compile to Spark conditions.

Logic is two-valued: a comparison with what is missing or null is false, and negation turns that to
true. At the top a condition that may be null filters like a false one and stays pushable, so
nulls are only replaced where a condition is negated or shown as a column.

Under the compat profile strings are compared in normalized form and ordered by UTF-16 code
units; negated text matches hold for what is missing or null.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewframe.functions.text import normalize, normalized, utf16_order
from viewframe.sources.schema import Field, Schema

NATIVE, COMPAT = "native", "compat"
MAX_OPERANDS, MAX_CLAUSES, MAX_DEPTH, MAX_NODES = 4096, 64, 32, 256
SEMI_JOIN_ABOVE = 1000


@dataclass(frozen=True)
class Predicate:
    """compile(schema, profile) gives the condition; depth and nodes are bounded."""

    make: Callable[[Schema, str], Column]
    depth: int = 1
    nodes: int = 1

    def compile(self, schema: Schema, profile: str = NATIVE) -> Column:
        if self.depth > MAX_DEPTH or self.nodes > MAX_NODES:
            raise ValueError("the predicate is too deep or has too many nodes")
        return self.make(schema, profile)

    def __and__(self, other: Predicate) -> Predicate:
        return all_of(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return any_of(self, other)

    def __invert__(self) -> Predicate:
        return negated(self)


def total(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def shown(p: Predicate, schema: Schema, profile: str = NATIVE) -> Column:
    """The predicate as a column that is never null."""
    return total(p.compile(schema, profile))


def operand(f: Field, value: Any) -> Column:
    if value is None:
        raise ValueError("null is no operand; use is_null")
    if f.kind == "enum" and isinstance(value, str):
        value = f.domain[value]
    return F.lit(value).cast(f.spark_type)


def orderable(f: Field, c: Column, profile: str) -> Column:
    return utf16_order(c) if f.kind == "string" and profile == COMPAT else c


def _compare(path: str, value: Any, op: Callable[[Column, Column], Column]) -> Predicate:
    def make(schema: Schema, profile: str) -> Column:
        f = schema[path]
        if op in (operator.eq, operator.ne):
            if f.kind == "string" and profile == COMPAT:
                return text(path, "eq" if op is operator.eq else "ne", value).compile(schema, profile)
            return op(f.column, operand(f, value))
        if f.kind == "boolean":
            raise ValueError("Booleans have no order")
        return op(orderable(f, f.column, profile), orderable(f, operand(f, value), profile))

    return Predicate(make)


def eq(path: str, value: Any) -> Predicate:
    return _compare(path, value, operator.eq)


def ne(path: str, value: Any) -> Predicate:
    return _compare(path, value, operator.ne)


def lt(path: str, value: Any) -> Predicate:
    return _compare(path, value, operator.lt)


def le(path: str, value: Any) -> Predicate:
    return _compare(path, value, operator.le)


def gt(path: str, value: Any) -> Predicate:
    return _compare(path, value, operator.gt)


def ge(path: str, value: Any) -> Predicate:
    return _compare(path, value, operator.ge)


def _operands(values: Iterable[Any]) -> list[Any]:
    out = list(dict.fromkeys(values))
    if not 1 <= len(out) <= MAX_OPERANDS:
        raise ValueError("1 to 4096 operands")
    return out


def is_in(path: str, values: Iterable[Any]) -> Predicate:
    chosen = _operands(values)
    return Predicate(lambda schema, _: schema[path].column.isin(*(operand(schema[path], v) for v in chosen)))


def filter_in(df: DataFrame, schema: Schema, path: str, values: Iterable[Any]) -> DataFrame:
    """is_in as a filter; many operands (4096 at most) become a broadcast semi-join."""
    chosen, f = _operands(values), schema[path]
    if len(chosen) <= SEMI_JOIN_ABOVE:
        return df.where(is_in(path, chosen).compile(schema))
    if any(v is None for v in chosen):
        raise ValueError("null is no operand; use is_null")
    right = df.sparkSession.createDataFrame([(v,) for v in chosen], f"__v {f.spark_type.simpleString()}")
    return df.join(F.broadcast(right), f.column == F.col("__v"), "left_semi")


def is_missing(path: str) -> Predicate:
    def make(schema: Schema, _: str) -> Column:
        if not schema[path].optional:
            raise ValueError("only optional fields can be missing")
        return schema[path].missing

    return Predicate(make)


def is_null(path: str) -> Predicate:
    def make(schema: Schema, _: str) -> Column:
        if not schema[path].nullable:
            raise ValueError("only nullable fields can be null")
        return schema[path].null

    return Predicate(make)


def is_value(path: str) -> Predicate:
    return Predicate(lambda schema, _: schema[path].column.isNotNull())


def _joined(clauses: Sequence[Predicate], op: Callable[[Column, Column], Column]) -> Predicate:
    if not 1 <= len(clauses) <= MAX_CLAUSES:
        raise ValueError("1 to 64 clauses")
    make = lambda schema, profile: reduce(op, (c.compile(schema, profile) for c in clauses))
    return Predicate(make, 1 + max(c.depth for c in clauses), 1 + sum(c.nodes for c in clauses))


def all_of(*clauses: Predicate) -> Predicate:
    return _joined(clauses, operator.and_)


def any_of(*clauses: Predicate) -> Predicate:
    return _joined(clauses, operator.or_)


def negated(p: Predicate) -> Predicate:
    return replace(p, make=lambda schema, profile: ~total(p.compile(schema, profile)), depth=p.depth + 1, nodes=p.nodes + 1)


def everything() -> Predicate:
    return Predicate(lambda *_: F.lit(True))


def nothing() -> Predicate:
    return Predicate(lambda *_: F.lit(False))


def grouped(clauses: Sequence[Predicate], how: str, empty: str = "grid") -> Predicate:
    """A group of the grid, where an empty "or" is false and an empty "and" true, or of the product
    grammar ("product"), where an empty group is left out and so matches all."""
    if clauses:
        return any_of(*clauses) if how == "or" else all_of(*clauses)
    return nothing() if how == "or" and empty == "grid" else everything()


def _string(schema: Schema, path: str) -> Field:
    if schema[path].kind != "string":
        raise ValueError("text predicates are for strings")
    return schema[path]


def _matches(c: Column, kind: str, needle: str) -> Column:
    return {"eq": lambda: c == needle, "ne": lambda: c == needle, "contains": lambda: c.contains(needle), "notContains": lambda: c.contains(needle), "startsWith": lambda: c.startswith(needle), "endsWith": lambda: c.endswith(needle)}[kind]()


def _literal(path: str, kind: str, value: str) -> Predicate:
    def make(schema: Schema, profile: str) -> Column:
        f = _string(schema, path)
        return text(path, kind, value).compile(schema, profile) if profile == COMPAT else _matches(f.column, kind, value)

    return Predicate(make)


def contains(path: str, value: str) -> Predicate:
    return _literal(path, "contains", value)


def starts_with(path: str, value: str) -> Predicate:
    return _literal(path, "startsWith", value)


def ends_with(path: str, value: str) -> Predicate:
    return _literal(path, "endsWith", value)


def text(path: str, kind: str, value: str, case_sensitive: bool = False, accent_sensitive: bool = False) -> Predicate:
    """Match of normalized text: eq, ne, contains, notContains, startsWith, endsWith."""

    def make(schema: Schema, profile: str) -> Column:
        f = _string(schema, path)
        if profile != COMPAT:
            raise ValueError("normalized text belongs to the compat profile")
        found = _matches(normalized(f.column, case_sensitive, accent_sensitive), kind, normalize(value, case_sensitive, accent_sensitive))
        return ~total(found) if kind in ("ne", "notContains") else found

    return Predicate(make)


def text_in(path: str, values: Iterable[str], case_sensitive: bool = False, accent_sensitive: bool = False) -> Predicate:
    chosen = _operands(values)

    def make(schema: Schema, profile: str) -> Column:
        if profile != COMPAT:
            raise ValueError("normalized text belongs to the compat profile")
        needles = sorted({normalize(v, case_sensitive, accent_sensitive) for v in chosen})
        return normalized(_string(schema, path).column, case_sensitive, accent_sensitive).isin(*needles)

    return Predicate(make)


def in_range(path: str, start: Any, end: Any) -> Predicate:
    """start <= value < end."""
    return all_of(ge(path, start), lt(path, end))


def blank(path: str) -> Predicate:
    """Missing, null, or the empty string."""

    def make(schema: Schema, _: str) -> Column:
        f = schema[path]
        return f.column.isNull() | (f.column == "") if f.kind == "string" else f.column.isNull()

    return Predicate(make)


def not_blank(path: str) -> Predicate:
    return negated(blank(path))


def equals(path: str, value: Any) -> Predicate:
    """The grid's equals, where null asks for a null (false for a field that has none)."""
    if value is not None:
        return eq(path, value)
    return Predicate(lambda schema, profile: is_null(path).compile(schema, profile) if schema[path].nullable else F.lit(False))


def not_equals(path: str, value: Any) -> Predicate:
    return negated(equals(path, value))


def one_of(path: str, values: Iterable[Any]) -> Predicate:
    """The grid's in, where null may be among the values; no values match nothing."""
    chosen = list(dict.fromkeys(values))
    parts = [equals(path, None)] * (None in chosen)
    if rest := [v for v in chosen if v is not None]:
        parts.append(is_in(path, rest))
    return grouped(parts, "or")


def quick_filter(paths: Sequence[str], needle: str) -> Predicate:
    """Any of the string fields contains the normalized text; an empty text filters nothing."""
    return grouped([text(p, "contains", needle) for p in paths], "or") if needle else everything()


def set_filter(path: str, include: Iterable[Any] | None = None, exclude: Iterable[Any] | None = None) -> Predicate:
    """Exact membership: only the included, or all but the excluded; an empty inclusion matches nothing."""
    if include is not None:
        return one_of(path, include)
    return negated(one_of(path, exclude)) if exclude else everything()


def condition(field: str, op: str, value: Any) -> Predicate:
    """A condition of the product grammar: eq, lt, le, gt, ge on its fields, and blank."""
    if op == "blank":
        return blank(field)
    return {"eq": eq, "lt": lt, "le": le, "gt": gt, "ge": ge}[op](field, value)


def membership(df: DataFrame, schema: Schema, registered: dict[str, Predicate], key: str, profile: str = NATIVE) -> DataFrame:
    """(query_id, key) of all registered queries in one scan: each row makes only the ids of its own queries."""
    ids = F.array_compact(F.array(*(F.when(p.compile(schema, profile), F.lit(q)) for q, p in registered.items())))
    return df.select(F.explode(ids).alias("query_id"), F.col(key))


def changed_queries(changes: DataFrame, before: DataFrame, after: DataFrame, schema: Schema, registered: dict[str, Predicate], key: str) -> DataFrame:
    """Ids of the queries that a batch touches: those of the old or the new image of a changed row."""
    touched = changes.select(key).distinct()
    images = [membership(x.join(touched, key, "left_semi"), schema, registered, key) for x in (before, after)]
    return images[0].union(images[1]).select("query_id").distinct()
