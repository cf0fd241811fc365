"""Rendering of rows, schema evolution, and a generator of demonstration orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viewframe.functions.exact import canonical_decimal
from viewframe.sources.schema import Field, Schema, flat


def rendered_value(f: Field) -> Column:
    """A leaf as a piece of JSON: integers and decimals as strings, null kept."""
    c = f.column
    if f.kind in ("number", "boolean", "enum"):
        text = F.when(c.cast("double") % 1 == 0, c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("string")) if f.kind == "number" else c.cast("string")
    else:
        shown = canonical_decimal(c) if f.kind == "decimal" else c.cast("string")
        text = F.regexp_extract(F.to_json(F.struct(shown.alias("v"))), r'^\{"v":(.*)\}$', 1)
    return F.when(c.isNull(), "null").otherwise(text)


def rendered(schema: Schema) -> Column:
    """The row as JSON: what is missing is left out, null is kept, nested paths are objects again."""

    def members(prefix: str) -> list[Column]:
        out, seen = [], set()
        for f in schema.fields:
            if not f.path.startswith(prefix):
                continue
            head, _, rest = f.path[len(prefix) :].partition(".")
            if head in seen:
                continue
            seen.add(head)
            if rest:
                inner = F.concat(F.lit(f'"{head}":{{'), F.array_join(F.array_compact(F.array(*members(f"{prefix}{head}."))), ","), F.lit("}"))
                out.append(F.when(F.col(f"{prefix}{head}").isNotNull(), inner))
            else:
                out.append(F.when(f.present, F.concat(F.lit(f'"{head}":'), rendered_value(f))))
        return out

    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*members(""))), ","), F.lit("}"))


def may_follow(old: Schema, new: Schema) -> bool:
    """Whether new only adds optional fields at the end."""
    n = len(old.fields)
    return old.key == new.key and new.fields[:n] == old.fields and all(f.optional for f in new.fields[n:])


def read_together(old: DataFrame, new: DataFrame, old_schema: Schema, new_schema: Schema) -> DataFrame:
    """Rows of both versions under the new schema; in old ones the added fields are missing."""
    if not may_follow(old_schema, new_schema):
        raise ValueError("a successor only adds optional fields")
    out = old
    for f in new_schema.fields[len(old_schema.fields) :]:
        if f.has_companion:
            out = out.withColumn(f.companion, F.lit(False))
    return out.unionByName(new, allowMissingColumns=True).select(*new.columns)


#: Fixed values of the demonstration data.
WORDS = ("Zoë", "İstanbul", "東京", "plain")
DEMO = flat("orderId", ("orderId", "string"), ("customer", "string"), ("open", "boolean"), ("units", "uint64"), ("price", "decimal"), ("note", "string", "on"))


def demo_orders(spark: SparkSession, n: int, revision: int = 0) -> DataFrame:
    """Orders with Unicode customers, units beyond 2^53, 18-digit fractions, and notes missing, null, empty and set in turn."""
    return demo_of(spark.range(n), F.col("id"), revision)


def demo_of(rows: DataFrame, i: Column, revision: int = 0) -> DataFrame:
    """The demonstration order of each row, by its number."""
    word = F.element_at(F.array(*map(F.lit, WORDS)), (i % 4 + 1).cast("int"))
    note = F.when(i % 4 == 3, F.concat(F.lit("note "), i.cast("string"))).when(i % 4 == 2, "")
    # of 18 digits before the point, as a sum of wider decimals would lose the last digit behind it
    price = ((i + revision).cast("decimal(18,0)") + F.lit("0.000000000000000001").cast("decimal(19,18)")).cast("decimal(38,18)")
    return rows.select(
        F.concat(F.lit("order-"), i.cast("string")).alias("orderId"), F.concat(word, F.lit(" "), (i % 2048).cast("string")).alias("customer"), (i % 2 == 0).alias("open"),
        (F.lit(9007199254740993) + i).cast("decimal(20,0)").alias("units"), price.alias("price"), note.alias("note"), (i % 4 != 0).alias("__has_note"),
    )
