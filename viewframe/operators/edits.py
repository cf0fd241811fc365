"""Edits: compare-and-set batches, versioned cell changes, and three-way merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from viewframe.operators.changes import UPSERT, applied


def conflicts(table: DataFrame, edits: DataFrame, columns: Sequence[str], id: str = "row_id", identity: Sequence[str] = ()) -> DataFrame:
    """(id, reason) of edits whose expected row is not the current one, which change what a row is known by, or whose id comes twice.

    edits: id, expected (struct of columns; null expects no row), the columns' new values, and perhaps op (upsert or
    delete). identity: those columns of which the id is made.
    """
    now = table.select(F.col(id).alias("__id"), F.struct(*columns).alias("__now"))
    wrong = edits.join(now, F.col(id) == F.col("__id"), "left").where(~F.col("expected").eqNullSafe(F.col("__now"))).select(id, F.lit("mismatch").alias("reason"))
    twice = edits.groupBy(id).agg(F.count("*").alias("n")).where("n > 1").select(id, F.lit("duplicate").alias("reason"))
    out = wrong.unionByName(twice)
    if identity:
        moved = F.col("expected").isNotNull() & ~F.struct(*(F.col(c) for c in identity)).eqNullSafe(F.struct(*(F.col(f"expected.{c}").alias(c) for c in identity)))
        out = out.unionByName(edits.where(moved & (operation(edits) == UPSERT)).select(id, F.lit("identity").alias("reason")))
    return out


def operation(edits: DataFrame) -> Column:
    return F.col("op") if "op" in edits.columns else F.lit(UPSERT)


def compare_and_set(table: DataFrame, edits: DataFrame, columns: Sequence[str], id: str = "row_id", identity: Sequence[str] = ()) -> DataFrame:
    """The table after all edits, or an error that leaves it as it is: one conflict rejects the whole batch."""
    bad = conflicts(table, edits, columns, id, identity).first()
    if bad:
        raise ValueError(f"edit of {bad[id]}: {bad['reason']}")
    return applied(table, edits.select(id, *columns, operation(edits).alias("op"), F.lit(0).alias("offset")), id)


def versioned_edits(table: DataFrame, cells: DataFrame, id: str = "row_id", version: str = "row_version") -> DataFrame:
    """Checks of cell changes (E2). cells: id, expected_version, path, before, after (as texts). Adds accepted: the
    row is at that version, the cell holds before, and no other change of the row fails or names the same cell."""
    fields = [c for c in table.columns if c not in (id, version)]
    held = F.create_map(*(x for f in fields for x in (F.lit(f), F.col(f).cast("string"))))
    now = table.select(F.col(id).alias("__id"), F.col(version).alias("__version"), held.alias("__cells"))
    both = cells.join(now, F.col(id) == F.col("__id"), "left")
    good = F.col("expected_version").eqNullSafe(F.col("__version")) & F.col("path").isin(fields) & F.col("before").eqNullSafe(F.col("__cells")[F.col("path")])
    row = Window.partitionBy(id)  # the cells of one row
    both = both.withColumn("__good", good).withColumn("__twice", F.count("*").over(Window.partitionBy(id, "path")) > 1)
    return both.withColumn("accepted", F.min(F.col("__good") & ~F.col("__twice")).over(row)).drop("__id", "__version", "__cells", "__good", "__twice")


def cells_applied(table: DataFrame, cells: DataFrame, id: str = "row_id", version: str = "row_version") -> DataFrame:
    """The table after the accepted cell changes of versioned_edits(); a changed row's version goes up by one."""
    fields = [c for c in table.columns if c not in (id, version)]
    new = cells.where("accepted").groupBy(F.col(id).alias("__id")).agg(*(F.max(F.when(F.col("path") == f, F.struct(F.col("after").alias("v")))).alias(f"__{f}") for f in fields))
    both = table.join(new, F.col(id) == F.col("__id"), "left")
    cell = lambda f: F.when(F.col(f"__{f}").isNotNull(), F.col(f"__{f}.v").cast(table.schema[f].dataType)).otherwise(F.col(f)).alias(f)
    step = F.col("__id").isNotNull().cast("int")
    return both.select(*((F.col(c) + step).cast(table.schema[c].dataType).alias(c) if c == version else F.col(c) if c == id else cell(c) for c in table.columns))


def stacked(df: DataFrame, fields: Sequence[str], id: str, name: str) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(f).alias("path"), F.col(f).cast("string").alias(name)) for f in fields))
    return df.select(F.col(id), F.explode(cells).alias("c")).select(id, "c.*")


def three_way(base: DataFrame, mine: DataFrame, server: DataFrame, fields: Sequence[str], id: str = "row_id") -> DataFrame:
    """(id, path, base, mine, server, state) of cells that I changed (E3): clean, converged or conflict."""
    out = stacked(base, fields, id, "base").join(stacked(mine, fields, id, "mine"), [id, "path"]).join(stacked(server, fields, id, "server"), [id, "path"])
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    state = F.when(same("mine", "server"), "converged").when(same("base", "server"), "clean").otherwise("conflict")
    return out.where(~same("base", "mine")).withColumn("state", state)


def resolved(cells: DataFrame, choices: Mapping[str, str] | None = None, default: str = "server") -> DataFrame:
    """Adds value: mine for clean cells; for conflicts what the choice per path says, mine or server."""
    choice = F.lit(default)
    for path, c in (choices or {}).items():
        choice = F.when(F.col("path") == path, c).otherwise(choice)
    return cells.withColumn("value", F.when((F.col("state") == "conflict") & (choice == "server"), F.col("server")).otherwise(F.col("mine")))
