"""Row ids made of typed key and value components."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewframe.functions.exact import DECIMAL, canonical_decimal

#: The tag of each kind of component, the version of the form, and its bounds.
TAGS = {"string": "01", "boolean": "02", "number": "03", "int64": "04", "uint64": "05", "decimal": "06"}
PREFIX, VERSION, MAX_COMPONENTS, MAX_LENGTH = "rid2:", "01", 16, 512
DECIMAL_TEXT = r"^(?:0|-?[1-9][0-9]*|-?(?:0|[1-9][0-9]*)\.[0-9]*[1-9])$"


@F.pandas_udf(T.BinaryType())
def double_bits(s: pd.Series) -> pd.Series:
    """The eight bytes of a double, big-endian; -0 as 0."""
    return s.map(lambda x: None if x is None or x != x else struct.pack(">d", x + 0.0))


def payload(kind: str, c: Column) -> Column:
    """The bytes of a component, in hex: text in UTF-8, whole numbers in eight bytes, decimals as their canonical text."""
    if kind == "number":
        bad = F.raise_error(F.lit("an identity has finite numbers only")).cast("string")
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), bad).otherwise(F.lower(F.hex(double_bits(c))))
    if kind == "boolean":
        return F.when(c, "01").otherwise("00")
    if kind in ("int64", "uint64"):
        return F.lower(F.lpad(F.hex(c.cast("long")) if kind == "int64" else F.conv(c.cast("string"), 10, 16), 16, "0"))
    text = canonical_decimal(c.cast(DECIMAL)) if kind == "decimal" else c.cast("string")
    return F.lower(F.hex(F.encode(text, "UTF-8")))


def component(kind: str, c: Column) -> Column:
    """Tag, length of the bytes in four bytes, and the bytes, in hex. A missing or null component fails."""
    if kind not in TAGS:
        raise ValueError("an enum is no part of an identity")
    raw = payload(kind, c)
    size = F.lower(F.lpad(F.hex((F.length(raw) / 2).cast("long")), 8, "0"))
    return F.when(c.isNull(), F.raise_error(F.lit("a component of the identity is absent")).cast("string")).otherwise(F.concat(F.lit(TAGS[kind]), size, raw))


def row_id(components: Sequence[tuple[str, Column]]) -> Column:
    """rid2: and the hex of the form's version, the number of components, and all components in order."""
    if not 1 <= len(components) <= MAX_COMPONENTS:
        raise ValueError("1 to 16 components")
    out = F.concat(F.lit(f"{PREFIX}{VERSION}{len(components):02x}"), *(component(k, c) for k, c in components))
    return F.when(F.length(out) > MAX_LENGTH, F.raise_error(F.lit("an identity has at most 512 characters")).cast("string")).otherwise(out)


def decoded(id: Column) -> Column:
    """Array of (tag, hex) of an id; null if its components don't come out even with what it says of their number."""
    body = F.substring(id, len(PREFIX) + 1, MAX_LENGTH)
    start = F.struct(F.lit(5).alias("at"), F.expr("cast(array() as array<struct<tag:string,hex:string>>)").alias("out"), F.lit(True).alias("ok"))

    def step(acc: Column, _: Column) -> Column:
        more = acc["ok"] & (acc["at"] <= F.length(body))
        size = F.conv(F.substr(body, acc["at"] + 2, F.lit(8)), 16, 10).cast("long")
        tag = F.substr(body, acc["at"], F.lit(2))
        fits = F.coalesce((acc["at"] + 9 + 2 * size <= F.length(body)) & tag.isin(*TAGS.values()), F.lit(False))
        raw = F.substr(body, acc["at"] + 10, F.when(fits, 2 * size).otherwise(0).cast("int"))
        return F.when(more & fits, F.struct((acc["at"] + 10 + 2 * size).cast("int").alias("at"), F.concat(acc["out"], F.array(F.struct(tag.alias("tag"), raw.alias("hex")))).alias("out"), F.lit(True).alias("ok"))).otherwise(
            F.struct(acc["at"].alias("at"), acc["out"].alias("out"), (acc["ok"] & ~more).alias("ok"))
        )

    many = F.conv(F.substring(body, 3, 2), 16, 10).cast("int")
    even = lambda acc: acc["ok"] & (acc["at"] > F.length(body)) & (F.size(acc["out"]) == many)
    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_COMPONENTS)), start, step, lambda acc: F.when(even(acc), acc["out"]))


def valid_row_id(id: Column) -> Column:
    """Whether an id has the one form that row_id() gives its components."""

    def right(p: Column) -> Column:
        tag, raw = p["tag"], p["hex"]
        text = F.unhex(raw).cast("string")
        whole = F.length(raw) == 16
        return (
            F.when(tag == TAGS["string"], F.is_valid_utf8(text)).when(tag == TAGS["boolean"], raw.isin("00", "01"))
            .when(tag == TAGS["number"], whole & ~raw.rlike("^[7f]ff") & (raw != "8" + "0" * 15)).when(tag == TAGS["decimal"], text.rlike(DECIMAL_TEXT)).otherwise(whole)
        )

    parts = decoded(id)
    shaped = id.rlike(f"^{PREFIX}{VERSION}(?:[0-9a-f]{{2}})+$") & (F.length(id) <= MAX_LENGTH)
    return F.coalesce(F.when(shaped, (F.size(parts) > 0) & F.forall(parts, right)), F.lit(False))
