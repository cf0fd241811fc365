"""Many-to-one enrichment of keyed tables: inner and left, each side under its alias."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viewframe.sources.schema import Schema

MAX_LEFT_PER_KEY, MAX_OUTPUT = 1024, 100_000


def joined_schema(left: Schema, right: Schema, left_alias: str, right_alias: str, how: str) -> Schema:
    """Fields l.x and r.y. After a left join right fields can be null."""
    if left_alias == right_alias:
        raise ValueError("the aliases are equal")
    fields = [replace(f, path=f"{left_alias}.{f.path}") for f in left.fields]
    fields += [replace(f, path=f"{right_alias}.{f.path}", nullable=f.nullable or how == "left") for f in right.fields]
    return Schema(tuple(fields), f"{left_alias}.{left.key}")


def side(df: DataFrame, schema: Schema, alias: str, how: str = "inner", is_right: bool = False) -> DataFrame:
    """One struct column named by the alias, and the companions that the joined schema asks for."""
    names = [c for c in df.columns if not c.startswith("__has_")]
    out = [F.struct(*(F.col(f"`{n}`") for n in names)).alias(alias)]
    for f in schema.fields:
        if f.has_companion:
            out.append(F.col(f.companion).alias(f"__has_{alias}__{f.path.replace('.', '__')}"))
        elif is_right and how == "left" and f.optional:
            out.append(f.present.alias(f"__has_{alias}__{f.path.replace('.', '__')}"))
    return df.select(*out)


RIGHT_TWICE, LEFT_MANY = "right key is not unique", "too many left rows for a key"


def repeated(df: DataFrame, key: str, most: int) -> DataFrame:
    """One row: bad is 1 if a key has more than so many rows."""
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce((F.max("n") > most).cast("int"), F.lit(0)).alias("bad"))


def contract_errors(left: DataFrame, right: DataFrame, left_key: str, right_key: str, per_key: int = MAX_LEFT_PER_KEY) -> DataFrame:
    """Rows (key, reason): right keys that are not unique, and left keys with too many rows. Counts on keys alone."""
    rights = right.groupBy(F.col(right_key).alias("key")).agg(F.count("*").alias("n")).where("key is not null and n > 1").select("key", F.lit(RIGHT_TWICE).alias("reason"))
    lefts = left.groupBy(F.col(left_key).alias("key")).agg(F.count("*").alias("n")).where(F.col("key").isNotNull() & (F.col("n") > per_key)).select("key", F.lit(LEFT_MANY).alias("reason"))
    return rights.unionByName(lefts)


def enrich(left: DataFrame, right: DataFrame, left_schema: Schema, right_schema: Schema, left_key: str, right_key: str, how: str = "left", left_alias: str = "l", right_alias: str = "r", validate: bool = True, per_key: int | None = None, max_output: int | None = None) -> DataFrame:
    """Rows of left with their one row of right. Keys that are missing or null match nothing.

    validate: right keys must be unique. per_key, max_output: most left rows of a key, and rows of the join
    (the limits of a server are MAX_LEFT_PER_KEY and MAX_OUTPUT); off by default, as a hot key is no error. The
    checks are subqueries on keys alone: planning runs nothing, and a join that breaks the contract fails when it runs.

    An unmatched right side is null as a whole; its optional leaves then count as null, not
    missing, so their companions turn true. The strategy of the join is Spark's to choose.
    """
    a, b = left_schema[left_key], right_schema[right_key]
    if how not in ("inner", "left") or a.kind != b.kind or dict(a.domain) != dict(b.domain):
        raise ValueError("an inner or left join of keys of one kind and domain")
    checks = []
    if validate:
        checks.append((repeated(right, right_key, 1), RIGHT_TWICE))
    if per_key is not None:
        checks.append((repeated(left, left_key, per_key), LEFT_MANY))
    if max_output is not None:
        rows = left if how == "left" else left.join(right.select(F.col(right_key).alias("__k")), F.col(left_key) == F.col("__k"), "left_semi")
        checks.append((rows.agg((F.count("*") > max_output).cast("int").alias("bad")), "too many rows in the join"))
    for bad, reason in checks:
        left = left.where(F.assert_true(bad.scalar() == 0, reason).isNull())
    l_side, r_side = side(left, left_schema, left_alias), side(right, right_schema, right_alias, how, True)
    out = l_side.join(r_side, F.col(f"{left_alias}.{left_key}") == F.col(f"{right_alias}.{right_key}"), how)
    if how == "left":
        for name in r_side.columns[1:]:
            out = out.withColumn(name, F.coalesce(name, F.col(right_alias).isNull()))
    return out


def joined_id(definition: str, left_id: Column) -> Column:
    """Stable identity of a joined row: of the definition and the left row, so the same before and after a match."""
    return F.concat(F.lit("jid1:"), F.sha2(F.to_json(F.array(F.lit(definition), left_id.cast("string"))), 256))


def refreshed(view: DataFrame, left: DataFrame, right: DataFrame, left_changes: DataFrame, right_changes: DataFrame, id: str, left_key: str, right_key: str, join) -> DataFrame:
    """A joined view after changes: only left rows of touched ids and join keys are joined again.

    view, left, right: the view before and the tables after the changes; join(left, right) makes view rows.
    """
    ids = left_changes.select(F.col(id).alias("__id")).union(
        left.join(right_changes.select(F.col(right_key).alias("__k")).distinct(), F.col(left_key) == F.col("__k"), "left_semi").select(F.col(id).alias("__id"))
    ).distinct()
    again = join(left.join(ids, F.col(id) == F.col("__id"), "left_semi"), right)
    return view.join(ids, F.col(id) == F.col("__id"), "left_anti").unionByName(again)


def ready_version(left: int | None, right: int | None) -> int | None:
    """The version a joined view may show: none until both inputs have one, then the smaller."""
    return None if left is None or right is None else min(left, right)
