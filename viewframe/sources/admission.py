"""Strict admission of rows: from JSON text or loose columns to the declared schema, with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewframe.functions.exact import DECIMAL_TEXT, INTEGER_TEXT, canonical_number
from viewframe.sources.schema import MAX_KEY_BYTES, MAX_ROW_BYTES, MAX_STRING_BYTES, Field, Schema

ERRORS = "_errors"


def _raw(f: Field) -> Column:
    return F.expr(f"try_variant_get(__v, '$.{f.path}', 'string')")


def _at(f: Field) -> Column:
    return F.expr(f"variant_get(__v, '$.{f.path}', 'variant')")


def _type(f: Field) -> Column:
    return F.schema_of_variant(_at(f))


def problems(f: Field) -> list[Column]:
    """Reasons against a field of a parsed row, each null if there is none."""
    missing, null, raw = _at(f).isNull(), F.is_variant_null(_at(f)), _raw(f)
    there = ~missing & ~null
    say = lambda bad, why: F.when(bad, F.lit(f"{f.path}: {why}"))
    out = [] if f.optional else [say(missing, "missing")]
    if not f.nullable:
        out.append(say(~missing & null, "null"))
    kind = _type(f)
    if f.kind in ("string", "enum") and not f.domain:
        out.append(say(there & (kind != "STRING"), "not a string") if f.kind == "string" else say(there & ~raw.rlike(INTEGER_TEXT), "not a code"))
    if f.kind == "string":
        out.append(say(there & (F.octet_length(raw) > MAX_STRING_BYTES), "too long"))
    elif f.kind == "boolean":
        out.append(say(there & (kind != "BOOLEAN"), "not a Boolean"))
    elif f.kind == "number":
        out.append(say(there & (~kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") | raw.try_cast("double").isNull()), "not a finite number"))
    elif f.kind in ("int64", "uint64"):
        out.append(say(there & ((kind != "STRING") | ~raw.rlike(INTEGER_TEXT) | raw.try_cast(f.spark_type).isNull() | (F.lit(f.kind == "uint64") & (raw.startswith("-") | (raw.try_cast("decimal(38,0)") > F.lit("18446744073709551615").cast("decimal(38,0)"))))), "not a canonical integer"))
    elif f.kind in ("decimal", "wide_decimal"):
        fits = F.lit(True) if f.kind == "wide_decimal" else raw.try_cast("decimal(38,18)").isNotNull()
        out.append(say(there & ((kind != "STRING") | ~raw.rlike(DECIMAL_TEXT) | ~fits | (F.length(raw) > 256)), "not a decimal"))
    elif f.kind == "enum" and f.domain:
        out.append(say(there & ~raw.isin(*f.domain) & ~raw.rlike(INTEGER_TEXT), "unknown label"))
    return out


def value_of(f: Field) -> Column:
    raw = _raw(f)
    if f.kind == "enum" and f.domain:
        labels = F.create_map(*(F.lit(x) for pair in f.domain.items() for x in pair))
        return F.coalesce(F.element_at(labels, raw), raw.try_cast("int"))
    out = raw.try_cast(f.spark_type)
    return canonical_number(out) if f.kind == "number" else out


def admitted(df: DataFrame, schema: Schema, json: str = "value") -> DataFrame:
    """JSON objects as rows of the schema plus _errors, an empty array if the row is good.

    Repeated members and broken JSON fail as a whole. Nested parents are structs, null where absent.
    """
    parsed = df.withColumn("__v", F.try_parse_json(json))
    known = [F.lit(f.path.split(".")[0]) for f in schema.fields]
    keys = F.json_object_keys(F.col(json))
    unknown = F.transform(F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*known)), lambda k: F.concat(k, F.lit(": unknown field")))
    key = schema[schema.key]
    whole = [
        F.when(F.col("__v").isNull(), "not a JSON object of distinct members"),
        F.when(F.octet_length(json) > MAX_ROW_BYTES, "row too large"),
        F.when(F.octet_length(_raw(key)) > MAX_KEY_BYTES, "key too long"),
    ]
    errors = F.concat(F.array_compact(F.array(*whole[1:], *(p for f in schema.fields for p in problems(f)))), unknown)
    errors = F.when(F.col("__v").isNull(), F.array_compact(F.array(*whole[:2]))).otherwise(errors)  # fields of what can't be read are not judged
    values = {f.path: value_of(f) for f in schema.fields}
    companions = [(~_at(f).isNull()).alias(f.companion) for f in schema.fields if f.has_companion]

    def built(prefix: str) -> list[Column]:
        out, seen = [], set()
        for f in schema.fields:
            if not f.path.startswith(prefix):
                continue
            head, _, rest = f.path[len(prefix) :].partition(".")
            if head in seen:
                continue
            seen.add(head)
            if rest:
                there = ~F.expr(f"variant_get(__v, '$.{prefix}{head}', 'variant')").isNull()
                out.append(F.when(there, F.struct(*built(f"{prefix}{head}."))).alias(head))
            else:
                out.append(values[f.path].alias(head))
        return out

    return parsed.select(*df.columns, *built(""), *companions, errors.alias(ERRORS))


def rejecting(df: DataFrame) -> DataFrame:
    """Fails on the first bad row."""
    ok = F.when(F.size(ERRORS) > 0, F.raise_error(F.array_join(ERRORS, "; "))).otherwise(F.lit(True))
    return df.where(ok).drop(ERRORS)


def quarantined(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with their reasons)."""
    return df.where(F.size(ERRORS) == 0).drop(ERRORS), df.where(F.size(ERRORS) > 0)


def with_null_marker(df: DataFrame, field: str, marker: str) -> DataFrame:
    """A Boolean marker says "there and null" (S7): the companion is set; marker and value together fail."""
    both = F.coalesce(F.col(marker), F.lit(False)) & F.col(field).isNotNull()
    there = F.when(both, F.raise_error(F.lit(f"{field}: value and null marker"))).otherwise(F.col(field).isNotNull() | F.coalesce(F.col(marker), F.lit(False)))
    return df.withColumn(f"__has_{field}", there).drop(marker)
