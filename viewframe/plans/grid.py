"""A grid's state lowered to queries: filters, quick filter, grouping, sorting, facets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewframe.operators import aggregates as A
from viewframe.operators import facets, order
from viewframe.operators import predicates as P
from viewframe.plans.view import View


@dataclass(frozen=True)
class GridQuery:
    filters: Mapping[str, P.Predicate] = field(default_factory=dict)  # one a column
    external: P.Predicate | None = None
    quick_text: str = ""
    quick_fields: Sequence[str] = ()
    group_by: Sequence[str] = ()
    aggregates: Mapping[str, A.Aggregate] = field(default_factory=dict)
    order_by: Sequence[order.Order] = ()

    def quick(self) -> P.Predicate | None:
        return P.quick_filter(self.quick_fields, self.quick_text) if self.quick_text else None

    def filtered(self, view: View) -> View:
        return view.where(self.external, *self.filters.values(), self.quick(), profile=P.COMPAT)

    def rows(self, view: View, index: str = "source_index") -> DataFrame:
        """Rows in the grid's order, ties by source index (O10); or groups (A22), sorted, ties in the order of their first rows."""
        view = self.filtered(view)
        if self.group_by:
            groups = A.grid_groups(view.df, view.schema, self.group_by, self.aggregates, index)
            return groups.orderBy(*A.grid_order(view.schema, self.group_by, self.aggregates, self.order_by)).drop("__first")
        columns = order.sort_columns(view.schema, self.order_by, index, P.COMPAT)
        return view.df.orderBy(*columns)

    def facet(self, view: View, path: str, selected: Sequence = ()) -> DataFrame:
        base = view.where(self.external, profile=P.COMPAT)
        counts = facets.facet(base.df, view.schema, path, self.filters, self.quick(), P.COMPAT)
        return facets.with_selected(counts, selected) if selected else counts

    def all_facets(self, view: View, paths: list[str]) -> DataFrame:
        base = view.where(self.external, profile=P.COMPAT)
        return facets.all_facets(base.df, view.schema, paths, self.filters, self.quick(), P.COMPAT)


def source_indexed(df: DataFrame, key: str) -> DataFrame:
    """A stable source index: the key's own order."""
    return df.withColumn("source_index", F.col(key))
