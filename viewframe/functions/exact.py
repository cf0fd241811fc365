"""Exact numbers: canonical texts, rounding of quotients, sums that don't depend on order.

Sums of doubles are exact: an Arrow function takes each double apart into an exponent and an
integer mantissa, Spark sums the mantissas per exponent (at most 2,100 partial sums a group), and
one step per group puts them together and rounds once. Decimals beyond 38 digits ("wide", kept as
text) are summed by limbs in the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Context, Decimal, localcontext
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECIMAL = "decimal(38,18)"
INTEGER_TEXT = r"^(?:0|-?[1-9][0-9]*)$"
DECIMAL_TEXT = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def canonical_number(c: Column) -> Column:
    """Finite doubles with 0 for -0; null for others."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).when(c == 0, 0.0).otherwise(c)


def parse_integer(text: Column) -> Column:
    """Canonical integer text as decimal(38,0), else null."""
    return F.when(text.rlike(INTEGER_TEXT), text.try_cast("decimal(38,0)"))


def parse_decimal(text: Column) -> Column:
    """Decimal text with sign and exponent as decimal(38,18), else null."""
    return F.when(text.rlike(DECIMAL_TEXT), text.try_cast(DECIMAL))


def canonical_decimal(c: Column) -> Column:
    """Text without trailing zeros, and without a point if none follow."""
    text = F.regexp_replace(F.format_number(c, 18), ",", "")  # never with an exponent
    return F.when(c == 0, F.lit("0")).otherwise(F.regexp_replace(text, r"\.?0+$", ""))


def wide_text(value: Decimal) -> str:
    """Canonical text of any decimal, never with an exponent."""
    text = f"{value:f}"
    text = text.rstrip("0").rstrip(".") if "." in text else text
    return "0" if text in ("-0", "") else text


@F.pandas_udf(T.StringType())
def canonical_wide(s: pd.Series) -> pd.Series:
    """Canonical text of decimal texts of any length (X4, wide)."""
    with localcontext(Context(prec=1000)):
        return s.map(lambda t: None if t is None else wide_text(Decimal(t)))


@F.pandas_udf(T.StringType())
def sort_token(s: pd.Series) -> pd.Series:
    """A text that sorts as the decimal does: sign, digits before the point, digits; nines' complement if negative."""

    def token(t: str | None) -> str | None:
        if t is None:
            return None
        whole, _, part = wide_text(Decimal(t).copy_abs()).partition(".")
        body = f"{len(whole):04d}{whole}.{part}"
        if Decimal(t) < 0:
            return "0" + body.translate(str.maketrans("0123456789", "9876543210")) + "~"
        return "1" + body

    with localcontext(Context(prec=1000)):
        return s.map(token)


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), where c is written and computed once however often f names it."""
    return F.transform(F.array(c), f)[0]


def half_even_quotient(units: Column, n: Column) -> Column:
    """Integer units / n to the nearest integer, ties to even, exact in decimal(38,0).

    Spark's integer division gives 64 bits, and its abs(), minus and products round to 34 digits: three limbs of 13 digits
    are divided one after the other, and signs are put on as text.
    """
    wide = "decimal(38,0)"

    def divided(x: Column) -> Column:
        digits = F.lpad(F.regexp_replace(x["text"], "-", ""), 39, "0")
        limbs_ = bound(digits, lambda d: F.array(*(F.substring(d, 1 + 13 * k, 13).cast("decimal(13,0)") for k in range(3))))
        start = F.struct(F.lit(0).cast(wide).alias("rest"), F.lit("").alias("whole"))

        def step(acc: Column, limb: Column) -> Column:
            now = (acc["rest"] * F.lit(10**13).cast("decimal(14,0)") + limb).cast(wide)
            return bound(now, lambda v: F.struct((v % x["by"]).cast(wide).alias("rest"), F.concat(acc["whole"], F.lpad(F.call_function("div", v, x["by"]).cast("string"), 13, "0")).alias("whole")))

        def rounded(acc: Column) -> Column:
            up = (acc["rest"] * 2 > x["by"]) | ((acc["rest"] * 2 == x["by"]) & F.substring(acc["whole"], -1, 1).isin("1", "3", "5", "7", "9"))
            return (acc["whole"].cast(wide) + F.when(up, 1).otherwise(0)).cast(wide)

        return F.concat(F.when(x["text"].startswith("-"), "-").otherwise(""), F.aggregate(limbs_, start, step, rounded).cast("string")).cast(wide)

    return bound(F.struct(units.cast(wide).cast("string").alias("text"), n.cast(wide).alias("by")), divided)


def placed(units: Column, scale: int) -> Column:
    """Integer units of 10^-scale as decimal(38, scale), by way of their text."""
    if not scale:
        return units.cast("decimal(38,0)")

    def pointed(text: Column) -> Column:
        size = F.lpad(F.regexp_replace(text, "-", ""), 38, "0")
        sign = F.when(text.startswith("-"), "-").otherwise("")
        return F.concat(sign, F.substring(size, 1, 38 - scale), F.lit("."), F.substring(size, 39 - scale, scale)).cast(f"decimal(38,{scale})")

    return bound(units.cast("decimal(38,0)").cast("string"), pointed)


def scaled_up(units: Column, digits: int) -> Column:
    """units * 10^digits, by way of their text."""
    return F.concat(units.cast("decimal(38,0)").cast("string"), F.lit("0" * digits)).cast("decimal(38,0)")


@F.pandas_udf(T.StringType())
def quotient_text(total: pd.Series, n: pd.Series, digits: pd.Series, mode: pd.Series) -> pd.Series:
    """Decimal text total / n. mode "half_even": digits after the point; "half_up": significant digits."""

    def one(t: str | None, k: int, d: int, m: str) -> str | None:
        if t is None or not k:
            return None
        if m == "half_up":
            return wide_text(Context(prec=int(d), rounding=ROUND_HALF_UP).divide(Decimal(t), Decimal(int(k))))
        exact, step = Fraction(Decimal(t)) / int(k), Fraction(1, 10 ** int(d))
        return wide_text(Decimal(round(exact / step)).scaleb(-int(d), Context(prec=1000)))

    with localcontext(Context(prec=1000, rounding=ROUND_HALF_EVEN)):
        return pd.Series([one(*x) for x in zip(total, n, digits, mode, strict=True)], dtype=object)


@F.pandas_udf(T.StructType().add("exponent", T.IntegerType()).add("mantissa", T.LongType()))
def taken_apart(s: pd.Series) -> pd.DataFrame:
    """A finite double as mantissa * 2^exponent, both integers; the mantissa has up to 53 bits."""
    m, e = np.frexp(s.to_numpy(float, na_value=0.0))
    return pd.DataFrame({"exponent": (e - 53).astype(np.int32), "mantissa": np.ldexp(m, 53).astype(np.int64)})


@F.pandas_udf(T.StringType())
def shortest_text(s: pd.Series) -> pd.Series:
    """The shortest decimal text of each double, written out."""
    with localcontext(Context(prec=1000)):
        return s.map(lambda x: None if x is None or x != x else wide_text(Decimal(repr(float(x)))))


LIMB = 15


@F.pandas_udf(T.ArrayType(T.StructType().add("place", T.IntegerType()).add("limb", T.LongType())))
def limbs(s: pd.Series) -> pd.Series:
    """A decimal text as limbs of LIMB digits: limb * 10^(place * LIMB)."""

    def one(t: str | None) -> list[dict]:
        if t is None:
            return []
        sign, digits, exponent = Decimal(t).as_tuple()
        low = exponent // LIMB  # the place of the last limb, at or below the last digit
        number, out = int("".join(map(str, digits))) * 10 ** (exponent - low * LIMB), []
        while number:
            number, limb = divmod(number, 10**LIMB)
            if limb:
                out.append({"place": low, "limb": -limb if sign else limb})
            low += 1
        return out

    return s.map(one)


def _put_together(parts: list[dict], base: int, step: int) -> Fraction:
    return sum((Fraction(int(p["total"])) * Fraction(base) ** (step * int(p["at"])) for p in parts), Fraction(0))


@F.pandas_udf(T.StructType().add("total", T.DoubleType()).add("mean", T.DoubleType()).add("overflow", T.BooleanType()))
def rounded_double(parts: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Sum and mean of partial sums of mantissas, each rounded once to the nearest even double."""
    rows = []
    for p, k in zip(parts, n, strict=True):
        exact = _put_together(list(p) if p is not None else [], 2, 1)
        try:
            rows.append((float(exact), float(exact / int(k)) if k else None, False))
        except OverflowError:
            rows.append((None, None, True))
    return pd.DataFrame(rows, columns=["total", "mean", "overflow"])


@F.pandas_udf(T.StringType())
def wide_sum(parts: pd.Series) -> pd.Series:
    """Canonical text of the sum of limbs."""
    out = []
    with localcontext(Context(prec=2000)):
        for p in parts:
            low = min((int(x["at"]) for x in p), default=0)
            units = sum(int(x["total"]) * 10 ** (LIMB * (int(x["at"]) - low)) for x in p)
            out.append(wide_text(Decimal(units).scaleb(LIMB * low)))
    return pd.Series(out, dtype=object)


def _gathered(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Per group its partial sums as parts and n. The places of a group are bounded by the range of exponents, not by its rows."""
    out = parts.groupBy(*keys).agg(F.collect_list(F.when(F.col("total") != 0, F.struct("at", "total"))).alias("parts"), F.sum("n").alias("n"))
    return out.withColumn("n", F.coalesce("n", F.lit(0)))


def double_sums(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Per group of keys: total, mean (null if there are no values), n, overflow (A5, A7). One scan, combined map-side per exponent."""
    rows = df.select(*keys, value.alias("__v")).withColumn("__x", taken_apart("__v"))
    parts = rows.groupBy(*keys, F.col("__x.exponent").alias("at")).agg(F.sum(F.col("__x.mantissa").cast("decimal(38,0)")).alias("total"), F.count("__v").alias("n"))
    return _gathered(parts, keys).withColumn("x", rounded_double("parts", "n")).select(*keys, "x.*", "n")


def text_sums(df: DataFrame, keys: list[str], text: Column, weight: Column | None = None) -> DataFrame:
    """Per group: total (canonical text, "0" if there are no values) and n, of decimal texts of any length.

    weight: of how many values each text is the sum, 1 by default.
    """
    rows = df.select(*keys, text.alias("__t"), (F.lit(1) if weight is None else weight).alias("__n"))
    rows = rows.select(*keys, "__t", "__n", F.posexplode_outer(limbs("__t")).alias("__i", "__x"))
    first = F.when((F.coalesce("__i", F.lit(0)) == 0) & F.col("__t").isNotNull(), F.col("__n"))  # a value counts at its first limb; zero has none
    parts = rows.groupBy(*keys, F.col("__x.place").alias("at")).agg(F.sum(F.col("__x.limb").cast("decimal(38,0)")).alias("total"), F.sum(first).alias("n"))
    return _gathered(parts, keys).withColumn("total", wide_sum("parts")).select(*keys, "total", "n")


def shortest_sums(df: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """text_sums() of the shortest decimal texts of doubles.

    A decimal of at most 15 digits that reads back as the double is its shortest text, as no two such decimals read as the
    same double. Those are summed as decimals, map-side; only the other doubles are written out in Python.
    """
    plain = value.cast("decimal(38,6)")
    short = F.coalesce((F.abs(value) < 1e9) & (plain.cast("double") == value), F.lit(False))
    sums = df.groupBy(*keys).agg(F.sum(F.when(short, plain)).alias("__s"), F.count(F.when(short, 1)).alias("__w"))
    sums = sums.select(*keys, F.when(F.col("__w") > 0, canonical_decimal(F.col("__s"))).alias("__text"), "__w")
    rest = df.where(value.isNotNull() & ~short).select(*keys, shortest_text(value).alias("__text"), F.lit(1).cast("long").alias("__w"))
    return text_sums(sums.unionByName(rest), keys, F.col("__text"), F.col("__w"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return left.withColumns({c: right.select(c).scalar() for c in right.columns})  # one row each
    return left.join(right.withColumnsRenamed({k: f"__r_{i}" for i, k in enumerate(keys)}), _same(left, keys), "left").drop(*(f"__r_{i}" for i in range(len(keys))))


def _same(left: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & left[k].eqNullSafe(F.col(f"__r_{i}"))
    return out


def aggregate_algebra(df: DataFrame, keys: list[str], value: str, zero: object, add: Callable, divide: Callable | None, type: str) -> DataFrame:
    """A user's algebra (A23): add(left, right) folds partials made per task and then per group; divide(total, n) gives a mean.

    Each task folds its own rows first, so a group costs one partial a task, however many rows it has.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def fold(batches):
        partial: dict[tuple, list] = {}
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                *key, v = row
                if v is not None and v == v:
                    cell = partial.setdefault(tuple(key), [zero, 0])
                    cell[0], cell[1] = add(cell[0], v), cell[1] + 1
        yield pd.DataFrame([(*k, t, n) for k, (t, n) in partial.items()], columns=[*keys, "total", "n"])

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        total = zero
        for v in pdf["total"]:
            total = add(total, v)
        n = int(pdf["n"].sum())
        return pd.DataFrame([(*pdf.iloc[0][keys], total, divide(total, n) if divide else None, n)], columns=[*keys, "total", "mean", "n"])

    partials = df.select(*keys, value).mapInPandas(fold, f"{kinds}, total {type}, n long")
    return partials.groupBy(*keys).applyInPandas(combine, f"{kinds}, total {type}, mean {type}, n long")
