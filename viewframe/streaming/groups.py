"""Groups that are maintained from what came and went alone (A24): six aggregates over retractable multisets.

Of a view there are four ledgers. `parts` has exact accumulators per group: the rows, and of each summed column the
contributors and integer units, of doubles one accumulator per binary exponent. `values` is a multiset per group and
column, of which countDistinct and the extremes are told; it lies in buckets by group and value. `cells` says
of each of these buckets how many different values a group has in it and which are its extremes. `groups` has the result.
A version adds its signed amounts, looks again at the cells whose values it touches, and at the groups
that it touches, reading the buckets of those alone. Nothing is subtracted from an extreme or a rounded sum, so
every version says what its rows say, whatever came before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewframe.functions import exact
from viewframe.operators import changes as C
from viewframe.streaming.store import BUCKETS, NEW, Ledger, restricted

OPS = ("count", "countDistinct", "sum", "avg", "min", "max")
UNITS = "decimal(38,0)"


@dataclass(frozen=True)
class Measure:
    """An aggregate of a column. present: a companion column that is false where the value is missing; countDistinct tells that from null."""

    op: str
    column: str | None = None
    present: str | None = None

    def __post_init__(self) -> None:
        if self.op not in OPS or (self.column is None) != (self.op == "count"):
            raise ValueError("a measure is a count, or an aggregate of a column")


def kind_of(schema: T.StructType, path: str) -> T.DataType:
    """The type of a column or a nested one."""
    out: T.DataType = schema
    for name in path.split("."):
        out = out[name].dataType
    return out


class GroupView:
    """keys: columns of a table, nested ones too, whose last names name the result's; measures: by alias."""

    def __init__(self, spark: SparkSession, folder: str, row: T.StructType, keys: Sequence[str], measures: Mapping[str, Measure], buckets: int = BUCKETS):
        self.keys, self.measures, self.paths = [k.replace(".", "__") for k in keys], dict(measures), list(keys)
        if set(self.keys) & set(self.measures):
            raise ValueError("an alias is a group field too")
        self.summed = list(dict.fromkeys(m.column for m in measures.values() if m.op in ("sum", "avg")))
        self.valued = list(dict.fromkeys((m.column, m.present) for m in measures.values() if m.op in ("countDistinct", "min", "max")))
        self.kinds = {c: kind_of(row, c) for c in [*self.summed, *(c for c, _ in self.valued)]}
        for c in self.summed:
            if not isinstance(self.kinds[c], T.NumericType):
                raise ValueError("sums and averages are of numbers")
        group = [T.StructField(k, kind_of(row, p)) for k, p in zip(self.keys, self.paths, strict=True)]
        long, int_ = T.LongType(), T.IntegerType()
        fields = lambda **kinds: [T.StructField(n, t) for n, t in kinds.items()]
        values = [T.StructField(f"v{j}", self.kinds[c]) for j, (c, _) in enumerate(self.valued)]
        ends = [T.StructField(f"{side}{j}", self.kinds[c]) for j, (c, _) in enumerate(self.valued) for side in ("low", "high")]
        ledger = lambda name, schema, keys, sums=(), by=None: Ledger(spark, f"{folder}/{name}", T.StructType(schema), keys, sums, by, buckets)
        self.parts = ledger("parts", [*group, *fields(f=int_, at=int_, total=T.DecimalType(38, 0), n=long)], [*self.keys, "f", "at"], ["total", "n"], self.keys)
        self.values = ledger("values", [*group, *fields(f=int_, state=int_), *values, *fields(n=long)], [*self.keys, "f", "state", *(v.name for v in values)], ["n"])
        self.cells = ledger("cells", [*group, *fields(f=int_, cell=int_, different=long), *ends], [*self.keys, "f", "cell"], (), self.keys)
        self.groups = ledger("groups", [*group, *(T.StructField(a, self.kind(m)) for a, m in self.measures.items())], self.keys)
        self.ledgers = {"parts": self.parts, "values": self.values, "cells": self.cells, "groups": self.groups} if self.valued else {"parts": self.parts, "groups": self.groups}

    def kind(self, m: Measure) -> T.DataType:
        if m.op in ("count", "countDistinct"):
            return T.LongType()
        kind = self.kinds[m.column]
        if m.op in ("min", "max"):
            return kind
        if isinstance(kind, (T.FloatType, T.DoubleType)):
            return T.DoubleType()
        return T.DecimalType(38, 18) if m.op == "avg" else T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else T.DecimalType(38, 0)

    def is_double(self, column: str) -> bool:
        return isinstance(self.kinds[column], (T.FloatType, T.DoubleType))

    def clean(self, c: Column, column: str) -> Column:
        """Doubles are finite, without a negative zero; others are null."""
        return exact.canonical_number(c) if self.is_double(column) else c

    def units(self, c: Column, column: str) -> Column:
        """An exact number as an integer of its last place."""
        kind = self.kinds[column]
        if isinstance(kind, T.DecimalType):
            return F.regexp_replace(F.format_number(c, kind.scale), "[.,]", "").cast(UNITS)
        return c.cast(UNITS)

    def signed(self, images: DataFrame) -> DataFrame:
        """Keys, columns s<j> and m<j> (value), p<j> (0 missing, 1 null, 2 there) and weight: a row for each side of a change."""
        sides = []
        for side, weight in (("o", -1), ("n", 1)):
            columns = [self.clean(F.col(f"{side}.{p}"), p) if p in self.kinds else F.col(f"{side}.{p}") for p in self.paths]
            out = [c.alias(k) for c, k in zip(columns, self.keys, strict=True)]
            out += [self.clean(F.col(f"{side}.{c}"), c).alias(f"s{j}") for j, c in enumerate(self.summed)]
            for j, (c, present) in enumerate(self.valued):
                value = self.clean(F.col(f"{side}.{c}"), c)
                absent = F.lit(1) if present is None else F.when(F.coalesce(F.col(f"{side}.{present}"), F.lit(False)), 1).otherwise(0)
                out += [value.alias(f"m{j}"), F.when(value.isNotNull(), 2).otherwise(absent).cast("int").alias(f"p{j}")]
            sides.append(images.where(f"{side} is not null").select(*out, F.lit(weight).cast("long").alias("weight")))
        return sides[0].unionByName(sides[1])

    def part_amounts(self, signed: DataFrame) -> DataFrame:
        part = lambda f, at, total, n: F.struct(F.lit(f).alias("f"), at.cast("int").alias("at"), total.cast(UNITS).alias("total"), n.cast("long").alias("n"))
        zero, weight = F.lit(0), F.col("weight")
        parts = [part(-1, zero, zero, weight)]
        for j, c in enumerate(self.summed):
            value = F.col(f"s{j}")
            if self.is_double(c):
                signed = signed.withColumn(f"x{j}", exact.taken_apart(value.cast("double")))
                one = part(j, F.col(f"x{j}.exponent"), F.col(f"x{j}.mantissa").cast("decimal(20,0)") * weight.cast("decimal(2,0)"), weight)
            else:
                one = part(j, zero, F.when(weight > 0, self.units(value, c)).otherwise(F.lit(0).cast(UNITS) - self.units(value, c)), weight)
            parts.append(F.when(value.isNotNull(), one))
        each = signed.select(*self.keys, F.explode(F.array_compact(F.array(*parts))).alias("p")).select(*self.keys, "p.*")
        return each.groupBy(*self.keys, "f", "at").agg(F.sum("total").cast(UNITS).alias("total"), F.sum("n").alias("n"))

    def value_amounts(self, signed: DataFrame) -> DataFrame:
        kinds = [self.kinds[c] for c, _ in self.valued]
        one = lambda j: F.struct(F.lit(j).alias("f"), F.col(f"p{j}").alias("state"), *((F.col(f"m{j}") if i == j else F.lit(None).cast(k)).alias(f"v{i}") for i, k in enumerate(kinds)))
        each = signed.select(*self.keys, "weight", F.explode(F.array(*(one(j) for j in range(len(kinds))))).alias("p")).select(*self.keys, "p.*", "weight")
        return each.groupBy(*self.values.keys).agg(F.sum("weight").alias("n")).where("n <> 0")

    def apply(self, images: DataFrame, version: int, known: dict[str, dict]) -> dict[str, dict]:
        """Takes in the images of a version. known: of the ledgers before; gives it for after. Given again it writes the same again."""
        known = {n: known.get(n, NEW) for n in self.ledgers}
        signed, changed = self.signed(images), {}
        changed["parts"] = self.parts.put(self.part_amounts(signed), version)
        if self.valued:
            changed["values"] = self.values.put(self.value_amounts(signed), version)
            changed["cells"] = self.cells.put(self.cells_again(version, known["values"]), version)
        changed["groups"] = self.groups.put(self.groups_again(version, known), version)
        return {n: ledger.finish(known[n], version, changed[n]) for n, ledger in self.ledgers.items()}

    def cells_again(self, version: int, known: dict) -> DataFrame:
        """The cells whose values a version touches, as they are now; empty ones are deleted."""
        keys = [*self.keys, "f", "cell"]
        hit = self.values.deltas(version, version).withColumnRenamed("bucket", "cell").select(*keys).distinct()
        now = self.values.state(known, version, self.values.touched(version)).withColumn("cell", self.values.bucket())
        ends = [e for j in range(len(self.valued)) for e in (F.min(f"v{j}").alias(f"low{j}"), F.max(f"v{j}").alias(f"high{j}"))]
        now = restricted(now, hit, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("different"), *ends).withColumn("op", F.lit(C.UPSERT))
        gone = hit.select(*keys, F.lit(C.DELETE).alias("op"))
        both = now.unionByName(gone, allowMissingColumns=True)
        others = [c for c in both.columns if c not in keys]
        return both.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col("op") == C.UPSERT).alias("x")).select(*keys, *(F.col(f"x.{c}").alias(c) for c in others))

    def groups_again(self, version: int, known: dict[str, dict]) -> DataFrame:
        """The groups that a version touches, with op."""
        hit = self.parts.deltas(version, version).select(*self.keys).distinct()
        mine = lambda df: restricted(df, hit, self.keys) if self.keys else df
        buckets = self.parts.touched(version)
        of = lambda j: F.col("f") == j
        sums = [F.coalesce(F.sum(F.when(of(-1), F.col("n"))), F.lit(0)).alias("__rows")]
        for j, c in enumerate(self.summed):
            sums.append(F.coalesce(F.sum(F.when(of(j), F.col("n"))), F.lit(0)).alias(f"n{j}"))
            total = F.collect_list(F.when(of(j), F.struct("at", "total"))) if self.is_double(c) else F.sum(F.when(of(j), F.col("total")))
            sums.append(total.alias(f"t{j}"))  # a double has at most 2,100 exponents
        out = mine(self.parts.state(known["parts"], version, buckets)).groupBy(*self.keys).agg(*sums)
        for j, c in enumerate(self.summed):
            if self.is_double(c):
                out = out.withColumn(f"r{j}", exact.rounded_double(f"t{j}", f"n{j}"))
        if self.valued:
            cells = mine(self.cells.state(known["cells"], version, buckets))
            found = [F.sum(F.when(of(j), F.col("different"))).alias(f"d{j}") for j in range(len(self.valued))]
            found += [f(F.when(of(j), F.col(f"{side}{j}"))).alias(f"{side}{j}") for j in range(len(self.valued)) for f, side in ((F.min, "low"), (F.max, "high"))]
            cells = cells.groupBy(*self.keys).agg(*found)
            cells = cells.select(*(F.col(k).alias(f"__c{i}") for i, k in enumerate(self.keys)), *(c for c in cells.columns if c not in self.keys))
            same = F.lit(True)
            for i, k in enumerate(self.keys):
                same = same & out[k].eqNullSafe(cells[f"__c{i}"])
            out = out.join(cells, same, "left")
        shown = out.select(*self.keys, *(self.shown(m).cast(self.kind(m)).alias(a) for a, m in self.measures.items()), F.when((F.col("__rows") > 0) | F.lit(not self.keys), C.UPSERT).otherwise(C.DELETE).alias("op"))
        if not self.keys:
            return shown
        left = shown.select(*(F.col(k).alias(f"__g{i}") for i, k in enumerate(self.keys)))
        same = F.lit(True)
        for i, k in enumerate(self.keys):
            same = same & hit[k].eqNullSafe(left[f"__g{i}"])
        gone = hit.join(left, same, "left_anti").withColumn("op", F.lit(C.DELETE))
        return shown.unionByName(gone, allowMissingColumns=True)

    def shown(self, m: Measure) -> Column:
        if m.op == "count":
            return F.col("__rows")
        if m.op in ("sum", "avg"):
            j = self.summed.index(m.column)
            if self.is_double(m.column):
                bad = F.raise_error(F.lit("the sum of numbers is out of range")).cast("double")
                value = F.when(F.col(f"r{j}.overflow"), bad)
                return value.otherwise(F.col(f"r{j}.total")) if m.op == "sum" else value.when(F.col(f"n{j}") > 0, F.col(f"r{j}.mean"))
            total = F.coalesce(F.col(f"t{j}"), F.lit(0).cast(UNITS))
            scale = getattr(self.kinds[m.column], "scale", 0)
            if m.op == "sum":
                return exact.placed(total, scale)
            return F.when(F.col(f"n{j}") > 0, exact.placed(exact.half_even_quotient(exact.scaled_up(total, 18 - scale), F.greatest(F.col(f"n{j}"), F.lit(1))), 18))
        j = next(i for i, (c, p) in enumerate(self.valued) if (c, p) == (m.column, m.present))
        return F.coalesce(F.col(f"d{j}"), F.lit(0)) if m.op == "countDistinct" else F.col(f"{'low' if m.op == 'min' else 'high'}{j}")

    def read(self, known: dict[str, dict], version: int) -> DataFrame:
        return self.groups.state(known["groups"], version).select(*self.keys, *self.measures)
