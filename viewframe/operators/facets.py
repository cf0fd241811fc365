"""Facets: counts of a column's values under all filters but its own."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewframe.operators.predicates import Predicate, everything, total
from viewframe.sources.schema import Schema


def facet(df: DataFrame, schema: Schema, path: str, filters: Mapping[str, Predicate], quick: Predicate | None = None, profile: str = "native") -> DataFrame:
    """(value, count) ordered by value; what is missing or null is no option. The column's own filter is left out before planning."""
    for name, p in filters.items():
        if name != path:
            df = df.where(p.compile(schema, profile))
    if quick:
        df = df.where(quick.compile(schema, profile))
    value = schema[path].column
    return df.where(value.isNotNull()).groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy("value")


def with_selected(counts: DataFrame, selected: Iterable) -> DataFrame:
    """Selected values stay in the list, with count 0 if no row has them."""
    kind = counts.schema["value"].dataType.simpleString()
    chosen = counts.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(selected)], f"value {kind}").withColumn("none", F.lit(0).cast("long"))
    return counts.join(chosen, "value", "full_outer").select("value", F.coalesce("count", "none").alias("count")).orderBy("value")


def all_facets(df: DataFrame, schema: Schema, paths: list[str], filters: Mapping[str, Predicate], quick: Predicate | None = None, profile: str = "native") -> DataFrame:
    """(field, value, count) of several facets in one scan. A row counts for a column if it passes the other columns' filters."""
    passes = {n: total(p.compile(schema, profile)) for n, p in filters.items()}
    if quick:
        df = df.where(quick.compile(schema, profile))

    def others(path: str):
        out = F.lit(True)
        for n, p in passes.items():
            if n != path:
                out = out & p
        return out

    if passes:  # rows that fail two filters count nowhere
        failed = sum((F.when(p, 0).otherwise(1) for p in passes.values()), F.lit(0))
        df = df.where(failed <= 1)
    options = F.array_compact(F.array(*(F.when(others(p) & schema[p].column.isNotNull(), F.struct(F.lit(p).alias("field"), schema[p].column.cast("string").alias("value"))) for p in paths)))
    return df.select(F.explode(options).alias("x")).groupBy("x.field", "x.value").agg(F.count(F.lit(1)).alias("count"))


def unfiltered() -> Predicate:
    return everything()
