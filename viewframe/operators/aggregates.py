"""Grouped and global aggregates with exact results, presence-aware groups, and HAVING."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewframe.functions import exact
from viewframe.functions.text import utf16_order
from viewframe.sources.schema import Field, Schema

COMPAT = "compat"
MAX_GROUP_FIELDS, MAX_AGGREGATES, MAX_GRID_AGGREGATES = 8, 16, 32


@dataclass(frozen=True)
class Aggregate:
    op: str  # count, countDistinct, sum, avg, min, max
    path: str | None = None


def state_name(path: str) -> str:
    return f"__state_{path.replace('.', '__')}"


def group_columns(schema: Schema, group_by: Sequence[str]) -> list[Column]:
    """Per field its state (only if it may be absent in two ways) and its value, -0 as 0."""
    out = []
    for path in group_by:
        f = schema[path]
        value = F.when(f.column == 0, 0.0).otherwise(f.column) if f.kind == "number" else f.column
        out.append(value.alias(path.replace(".", "__")))
        if f.has_companion:
            out.append(f.state.alias(state_name(path)))
    return out


def distinct_count(f: Field) -> Column:
    """Missing and null count as one more value each. A struct is counted whatever is null in it."""
    return F.count_distinct(F.struct(f.state, f.column)) if f.optional or f.nullable else F.count_distinct(f.column)


def exact_average(f: Field) -> Column:
    """Half-even at 18 fraction digits; null without contributors.

    The sum is taken as an integer of 10^-18 by way of its text: products of wide decimals would
    lose digits to Spark's limit of 38.
    """
    n = F.count(f.column)
    if f.kind in ("int64", "uint64"):
        units = exact.scaled_up(F.sum(f.column.cast("decimal(38,0)")), 18)
    else:
        units = F.regexp_replace(F.format_number(F.sum(f.column), 18), "[.,]", "")
    out = exact.half_even_quotient(units.cast("decimal(38,0)"), F.greatest(n, F.lit(1)))
    return F.when(n > 0, exact.placed(out, 18))


def extreme(f: Field, op: str, profile: str) -> Column:
    if profile != COMPAT:
        return (F.min if op == "min" else F.max)(f.column)
    # missing and null take part, missing lowest; what is absent in the result is null
    order = F.struct(f.state, utf16_order(f.column) if f.kind == "string" else f.column)
    return (F.min_by if op == "min" else F.max_by)(f.column, order)


def checked_sum(f: Field) -> Column:
    """An exact sum; 0 without contributors, an error if it leaves 38 digits."""
    total = F.sum(f.column.cast("decimal(38,0)") if f.kind in ("int64", "uint64") else f.column)
    zero = F.lit(0).cast("decimal(38,0)" if f.kind in ("int64", "uint64") else f.spark_type.simpleString())
    return F.when(F.count(f.column) == 0, zero).otherwise(total)


def aggregate(df: DataFrame, schema: Schema, group_by: Sequence[str], aggregates: Mapping[str, Aggregate], profile: str = "native", most: int = MAX_AGGREGATES) -> DataFrame:
    """One row per group, or exactly one for no group_by, on empty input too.

    All that Spark can aggregate directly is one hash aggregation. Sums of doubles and of wide
    decimals are exact in any order, by partial sums per exponent or limb, joined on the group.
    """
    if len(group_by) > MAX_GROUP_FIELDS or not 1 <= len(aggregates) <= most:
        raise ValueError("at most 8 group fields, and 1 to 16 aggregates")
    if set(aggregates) & {p.replace(".", "__") for p in group_by}:
        raise ValueError("an alias is a group field too")
    plain, later = {}, []
    for alias, a in aggregates.items():
        f = schema[a.path] if a.path else None
        if a.op == "count":
            plain[alias] = F.count(F.lit(1))
        elif a.op == "countDistinct":
            plain[alias] = distinct_count(f)
        elif a.op in ("min", "max"):
            plain[alias] = extreme(f, a.op, profile)
        elif profile == COMPAT and f.nullable:
            raise ValueError("the compat profile has no sum or average of a nullable field")
        elif f.kind in ("number", "wide_decimal") or profile == COMPAT:
            later.append((alias, a, f))
        else:
            plain[alias] = checked_sum(f) if a.op == "sum" else exact_average(f)
    keys = group_columns(schema, group_by)
    named = df.select("*", *(k.alias(f"__g{i}") for i, k in enumerate(keys)))
    inner = [f"__g{i}" for i in range(len(keys))]
    grouped = named.groupBy(*inner) if inner else named.groupBy()
    out = grouped.agg(*(c.alias(n) for n, c in plain.items()), *([F.count(F.lit(1)).alias("__n")] if not plain else []))
    for path in dict.fromkeys(f.path for _, _, f in later):  # sum and average of a field are one pass
        f, wanted = schema[path], [(alias, a.op) for alias, a, g in later if g.path == path]
        if f.kind == "number" and profile != COMPAT:
            sums = exact.double_sums(named, inner, f.column)
            bad = F.raise_error(F.lit("the sum of numbers is out of range"))
            values = {"sum": F.when(F.col("overflow"), bad).otherwise(F.col("total")), "avg": F.when(F.col("overflow"), bad).otherwise(F.col("mean"))}
        else:
            if f.kind == "number":
                sums = exact.shortest_sums(named, inner, f.column)
            else:
                sums = exact.text_sums(named, inner, exact.canonical_wide(f.column.cast("string")) if f.kind == "wide_decimal" else exact.canonical_decimal(f.column))
            half_up = F.when(F.col("n") == 0, F.lit("0")).otherwise(exact.quotient_text("total", "n", F.lit(100), F.lit("half_up")))
            values = {"sum": F.col("total"), "avg": half_up if profile == COMPAT else exact.quotient_text("total", "n", F.lit(18), F.lit("half_even"))}
        out = exact._joined(out, sums.select(*inner, *(values[op].alias(alias) for alias, op in wanted)), inner)
    return out.select(*(F.col(i).alias(n) for i, n in zip(inner, key_names(schema, group_by), strict=True)), *(F.col(a) for a in aggregates))


def key_names(schema: Schema, group_by: Sequence[str]) -> list[str]:
    """The names that group_columns() gives."""
    return [n for p in group_by for n in ([p.replace(".", "__"), state_name(p)] if schema[p].has_companion else [p.replace(".", "__")])]


def group_id(topic: str, schema: Schema, group_by: Sequence[str]) -> Column:
    """Stable text id of a group: topic, schema, and per field its kind, state and value."""
    if not group_by:
        return F.concat(F.lit("global1:"), F.hex(F.encode(F.to_json(F.array(F.lit(topic), F.lit(schema.fingerprint()))), "UTF-8")))
    parts = []
    for p in group_by:
        f, value = schema[p], F.col(p.replace(".", "__"))
        state = F.col(state_name(p)).cast("string") if f.has_companion else F.when(value.isNotNull(), "2").otherwise("0" if f.optional else "1")
        parts += [F.lit(f.kind), state, F.coalesce(value.cast("string"), F.lit(""))]
    return F.concat(F.lit("gid1:"), F.lower(F.hex(F.encode(F.to_json(F.array(F.lit(topic), F.lit(schema.fingerprint()), *parts)), "UTF-8"))))


def grid_groups(df: DataFrame, schema: Schema, group_by: Sequence[str], aggregates: Mapping[str, Aggregate], index: str) -> DataFrame:
    """The grid's variant: sum and avg of no values are null, min and max let what is absent take part (lowest),
    a Rows column, and __first, the index of a group's first row. Sums of doubles are exact, as in aggregate()."""
    columns = {"rows": F.count(F.lit(1)), "__first": F.min(index)}
    for alias, a in aggregates.items():
        f = schema[a.path] if a.path else None
        if a.op in ("sum", "avg") and f.kind == "number":
            continue
        if a.op in ("sum", "avg"):
            columns[alias] = F.when(F.count(f.column) > 0, checked_sum(f) if a.op == "sum" else exact_average(f))
        elif a.op in ("min", "max"):
            columns[alias] = extreme(f, a.op, COMPAT)
        else:
            columns[alias] = distinct_count(f) if a.op == "countDistinct" else F.count(F.lit(1))
    keys = group_columns(schema, group_by)
    named = df.select("*", *(k.alias(f"__g{i}") for i, k in enumerate(keys)))
    inner = [f"__g{i}" for i in range(len(keys))]
    out = named.groupBy(*inner).agg(*(c.alias(n) for n, c in columns.items()))
    numbers = {a.path for a in aggregates.values() if a.op in ("sum", "avg") and schema[a.path].kind == "number"}
    for path in sorted(numbers):
        values = {"sum": "total", "avg": "mean"}
        bad = F.raise_error(F.lit("the sum of numbers is out of range"))
        wanted = [F.when(F.col("overflow"), bad).when(F.col("n") > 0, F.col(values[a.op])).alias(alias) for alias, a in aggregates.items() if a.op in values and a.path == path]
        out = exact._joined(out, exact.double_sums(named, inner, schema[path].column).select(*inner, *wanted), inner)
    return out.select(*(F.col(i).alias(n) for i, n in zip(inner, key_names(schema, group_by), strict=True)), "rows", "__first", *aggregates)


def grid_order(schema: Schema, group_by: Sequence[str], aggregates: Mapping[str, Aggregate], order_by: Sequence[tuple[str, str]]) -> list[Column]:
    """Sort columns of grid_groups() by group fields, aggregates or "rows"; ties stand as their first rows do."""
    out = []
    for name, way in order_by:
        if name in group_by:
            f, column = schema[name], F.col(name.replace(".", "__"))
            state = F.col(state_name(name)) if f.has_companion else F.when(column.isNotNull(), 2).otherwise(0 if f.optional else 1)
            text = f.kind == "string"
        elif name in aggregates or name == "rows":
            column = F.col(name)
            state, a = F.when(column.isNotNull(), 2).otherwise(0), aggregates.get(name)
            text = a is not None and a.op in ("min", "max") and schema[a.path].kind == "string"
        else:
            raise ValueError("groups are sorted by their fields and aggregates")
        out += [c.desc() if way == "desc" else c.asc() for c in (state, utf16_order(column) if text else column)]
    return [*out, F.col("__first").asc()]
