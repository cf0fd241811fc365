"""Nested fields, enum codes, and strict texts of Booleans and numbers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_TEXT = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"


def nested(path: str) -> Column:
    """The leaf at a dotted path; null where a parent is absent."""
    return F.col(path)


def with_nested(path: str, value: Column) -> Column:
    """The top column of a dotted path with its leaf set; absent parents stay absent."""
    top, _, rest = path.partition(".")
    return F.col(top).withField(rest, value) if rest else value


def enum_code(label: Column, domain: Mapping[str, int]) -> Column:
    """The code of a label; several labels may share one; null for an unknown label."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in domain.items() for x in pair)), label)


def enum_label(code: Column, domain: Mapping[str, int]) -> Column:
    """The first label of a code; an unknown code is shown as its number."""
    first: dict[int, str] = {}
    for label, c in domain.items():
        first.setdefault(c, label)
    known = F.element_at(F.create_map(*(F.lit(x) for pair in first.items() for x in pair)), code)
    return F.coalesce(known, code.cast("string"))


def parse_boolean(text: Column) -> Column:
    """true or false, exactly so written."""
    return F.when(text == "true", True).when(text == "false", False)


def parse_number(text: Column) -> Column:
    """A finite number in its plain form."""
    value = F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))
    return F.when(F.abs(value) != float("inf"), value)
