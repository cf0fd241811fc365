"""Queries over a keyed table, as one Spark plan: filter, join, project or group, having, sort, window."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewframe.operators import aggregates as A
from viewframe.operators import joins, order
from viewframe.operators.predicates import Predicate
from viewframe.sources.schema import Field, Schema

MAX_SELECT = 64


@dataclass(frozen=True)
class View:
    """A table under its schema. query() plans a query and runs nothing, but for windows so deep that rows are ranged first."""

    df: DataFrame
    schema: Schema
    topic: str = "table"
    computed: Mapping[str, object] = field(default_factory=dict)

    def where(self, *predicates: Predicate | None, profile: str = "native") -> View:
        """External, column and quick filters together."""
        df = self.df
        for p in predicates:
            if p is not None:
                df = df.where(p.compile(self.schema, profile))
        return replace(self, df=df)

    def with_computed(self, name: str, column) -> View:
        """A computed column: can be selected, not filtered, sorted or grouped by."""
        return replace(self, computed={**self.computed, name: column})

    def enrich(self, right: View, left_key: str, right_key: str, how: str = "left", left_alias: str = "l", right_alias: str = "r", validate: bool = True, per_key: int | None = None, max_output: int | None = None) -> View:
        df = joins.enrich(self.df, right.df, self.schema, right.schema, left_key, right_key, how, left_alias, right_alias, validate, per_key, max_output)
        return View(df, joins.joined_schema(self.schema, right.schema, left_alias, right_alias, how), f"{self.topic}+{right.topic}")

    def select(self, paths: Sequence[str]) -> DataFrame:
        """Distinct fields, the key always beside them. Nested paths keep their parents: an absent parent stays null, an empty one stays an object."""
        if not 1 <= len(paths) <= MAX_SELECT or len(set(paths)) < len(paths):
            raise ValueError("1 to 64 distinct fields")
        columns, nested = [F.col(self.schema.key).alias("row_id")], {}
        for p in paths:
            if p in self.computed:
                columns.append(self.computed[p].alias(p))
                continue
            f = self.schema[p]
            if "." in p:
                nested.setdefault(p.split(".")[0], []).append(p)
            else:
                columns.append(f.column)
            if f.has_companion:
                columns.append(F.col(f.companion))
        for parent, leaves in nested.items():
            columns.append(F.when(F.col(parent).isNotNull(), _struct(parent, leaves)).alias(parent))
        return self.df.select(*columns)

    def total_rows(self) -> int:
        return self.df.count()

    def grouped(self, group_by: Sequence[str], aggregates: Mapping[str, A.Aggregate], having: Predicate | None = None, profile: str = "native", with_id: bool = False) -> View:
        """Groups as a view over keys and aggregates, so that having, sorts and windows use the same words."""
        out = A.aggregate(self.df, self.schema, group_by, aggregates, profile)
        fields = [replace(self.schema[p], path=p.replace(".", "__"), held=A.state_name(p) if self.schema[p].has_companion else None) for p in group_by]
        fields += [Field(a, result_kind(self.schema, x), False, self.may_be_null(x, group_by), type=out.schema[a].dataType) for a, x in aggregates.items()]
        out = out.withColumn("group_id", A.group_id(self.topic, self.schema, group_by)) if with_id else out
        schema = Schema((*fields, Field("group_id", "string")), "group_id")
        if having is not None:
            out = out.where(having.compile(schema, profile))
        return View(out, schema, self.topic)

    def may_be_null(self, a: A.Aggregate, group_by: Sequence[str]) -> bool:
        """Averages and extremes, where a group may be without values."""
        return a.op in ("avg", "min", "max") and (not group_by or self.schema[a.path].optional or self.schema[a.path].nullable)

    def query(self, select: Sequence[str] | None = None, where: Predicate | None = None, group_by: Sequence[str] | None = None, aggregates: Mapping[str, A.Aggregate] | None = None, having: Predicate | None = None, order_by: Sequence[order.Order] = (), offset: int = 0, limit: int | None = None, profile: str = "native", total: bool = False) -> DataFrame:
        """The window of a query; total adds total_rows, the count before pagination."""
        view = self.where(where, profile=profile)
        if aggregates is not None:
            view = view.grouped(group_by or (), aggregates, having, profile, with_id=bool(order_by) or limit is not None)
            rows = view.df
        else:
            rows = view.select(select or [f.path for f in self.schema.fields])
        if limit is None and not order_by:
            return rows
        columns = order.sort_columns(view.schema, order_by, "group_id" if aggregates is not None else self.schema.key, profile)
        if aggregates is not None:
            page = rows.orderBy(*columns) if limit is None else order.window(rows, columns, offset, limit)
        else:
            ordered = view.df.orderBy(*columns) if limit is None else order.window(view.df, columns, offset, limit)
            page = replace(view, df=ordered).select(select or [f.path for f in self.schema.fields])
        return order.with_total(page, view.df) if total else page


def _struct(parent: str, leaves: list[str]):
    groups: dict[str, list[str]] = {}
    out = []
    for p in leaves:
        rest = p[len(parent) + 1 :]
        if "." in rest:
            groups.setdefault(f"{parent}.{rest.split('.')[0]}", []).append(p)
        else:
            out.append(F.col(p).alias(rest))
    for child, deep in groups.items():
        out.append(F.when(F.col(child).isNotNull(), _struct(child, deep)).alias(child.rpartition(".")[2]))
    return F.struct(*out)


def result_kind(schema: Schema, a: A.Aggregate) -> str:
    if a.op in ("count", "countDistinct"):
        return "int64"
    kind = schema[a.path].kind
    if a.op == "avg" and kind in ("int64", "uint64"):
        return "decimal"
    return kind
