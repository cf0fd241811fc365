"""Tables from changes, and changes between versions.

A change is (row_id, op, payload..., partition, offset): a full after-image ("upsert") or a
tombstone ("delete").
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from viewframe.sources.scratch import written

UPSERT, DELETE = "upsert", "delete"
HORIZON = 256
MAX_OPERATIONS, FEW_PAYLOADS, WINDOW_ROWS = 4096, 8, 4096  # of a window's delta, and of a window


def change_source(df: DataFrame, payload: Sequence[str], value_identity: bool = False) -> DataFrame:
    """Adds op: a record without a value is a tombstone (S6). An identity made of values can't take one."""
    empty = F.lit(True)
    for c in payload:
        empty = empty & F.col(c).isNull()
    op = F.when(empty, F.raise_error(F.lit("a tombstone has no value to identify it by")) if value_identity else F.lit(DELETE)).otherwise(UPSERT)
    return df.withColumn("op", op)


def latest(changes: DataFrame, id: str = "row_id", order: Sequence[str] = ("offset",)) -> DataFrame:
    """The last change per id. max_by combines map-side, so a hot id costs one row a task."""
    others = [c for c in changes.columns if c != id]
    last = changes.groupBy(id).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("x"))
    return last.select(id, *(F.col(f"x.{c}").alias(c) for c in others)).select(*changes.columns)


def applied(table: DataFrame, changes: DataFrame, id: str = "row_id", order: Sequence[str] = ("offset",)) -> DataFrame:
    """The table after a batch (S8): last write per id wins; deletes of absent ids do nothing."""
    last = latest(changes, id, order)
    return table.join(last.select(id), id, "left_anti").unionByName(last.where(F.col("op") == UPSERT).select(*table.columns))


def folded(changes: DataFrame, id: str = "row_id", order: Sequence[str] = ("offset",), as_of: Column | None = None) -> DataFrame:
    """The state that a log of changes leads to, whole or up to a version."""
    log = changes.where(as_of) if as_of is not None else changes
    return latest(log, id, order).where(F.col("op") == UPSERT).drop("op")


def snapshot_and_tail(snapshot: DataFrame, tail: DataFrame, snapshot_version: int, version: str = "version", id: str = "row_id", order: Sequence[str] = ()) -> DataFrame:
    """Snapshot plus ordered tail; the tail must go on where the snapshot ends, without a gap."""
    numbers = tail.select(version).distinct().agg(F.min(version), F.max(version), F.count(version)).first()
    if numbers[2] and (numbers[0] != snapshot_version + 1 or numbers[1] - numbers[0] + 1 != numbers[2]):
        raise ValueError("the tail does not follow the snapshot")
    return applied(snapshot, tail, id, (version, *order))


def unchanged(table: DataFrame, changes: DataFrame, columns: Sequence[str], id: str = "row_id") -> DataFrame:
    """Changes that change nothing: upserts equal to the row, deletes of absent ids."""
    now = table.select(F.col(id).alias("__id"), F.struct(*columns).alias("__now"))
    both = changes.join(now, F.col(id) == F.col("__id"), "left")
    same = F.when(F.col("op") == DELETE, F.col("__id").isNull()).otherwise(F.struct(*columns).eqNullSafe(F.col("__now")) & F.col("__id").isNotNull())
    return both.where(same).drop("__id", "__now")


def preceding(df: DataFrame, group: str, order: Sequence[str], name: str, value: Column, newest: bool = False) -> DataFrame:
    """df with name: the value of the row before in its group's order, or (newest) the largest value of all before.

    Rows are dealt by ranges of group and order, so a long group has many tasks; what a range passes on to the next one
    of its group is one row per range and group.
    """
    parts = written(df.withColumn("__value", value).repartitionByRange(group, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    own = Window.partitionBy("__part", group).orderBy(*order)
    before = F.max("__value").over(own.rowsBetween(Window.unboundedPreceding, -1)) if newest else F.lag("__value").over(own)
    edges = parts.groupBy("__part", group).agg((F.max("__value") if newest else F.max_by("__value", F.struct(*order))).alias("__last"))
    earlier = Window.partitionBy(group).orderBy("__part")
    handed = F.max("__last").over(earlier.rowsBetween(Window.unboundedPreceding, -1)) if newest else F.lag("__last").over(earlier)
    edges = edges.select(F.col("__part").alias("__p"), F.col(group).alias("__g"), handed.alias("__handed"))
    both = parts.withColumn("__inside", before).join(edges, (F.col("__part") == F.col("__p")) & F.col(group).eqNullSafe(F.col("__g")))
    known = F.greatest("__inside", "__handed") if newest else F.coalesce("__inside", "__handed")
    return both.withColumn(name, known).select(*df.columns, name)


def audited(log: DataFrame, payload: Sequence[str], partition: str = "partition", offset: str = "offset") -> DataFrame:
    """Adds audit to each record (S10): first, next, gap, replay or conflict, by offset and payload; stale beyond the horizon.

    A column arrival tells in which order the records came; without it they came in the order of their offsets.
    """
    out = log.withColumn("__digest", F.sha2(F.to_json(F.struct(*payload)), 256))
    order = (offset, "arrival") if "arrival" in log.columns else (offset,)
    out = preceding(out, partition, order, "__before", F.struct(F.col(offset).alias("offset"), F.col("__digest").alias("digest")))
    if "arrival" in log.columns:
        out = preceding(out, partition, ("arrival",), "__newest", F.col(offset), newest=True)
    else:
        out = out.withColumn("__newest", F.col("__before.offset"))
    verdict = (
        F.when(F.col("__newest") - F.col(offset) > HORIZON, "stale")
        .when(F.col("__before").isNull(), "first")
        .when(F.col("__before.offset") == F.col(offset), F.when(F.col("__before.digest") == F.col("__digest"), "replay").otherwise("conflict"))
        .when(F.col("__before.offset") + 1 == F.col(offset), "next")
        .otherwise("gap")
    )
    return out.withColumn("audit", verdict).drop("__digest", "__before", "__newest")


def moved_keys(log: DataFrame, id: str = "row_id", partition: str = "partition") -> DataFrame:
    """Ids that more than one partition claims."""
    out = log.groupBy(id).agg(F.min(partition).alias("low"), F.max(partition).alias("high"))
    return out.where("low <> high").select(id, F.col("low").alias("partition_a"), F.col("high").alias("partition_b"))


def repeated_ids(table: DataFrame, id: str = "row_id") -> DataFrame:
    """Ids that a snapshot holds more than once."""
    return table.groupBy(id).agg(F.count("*").alias("rows")).where("rows > 1")


def export_epochs(log: DataFrame, cut: int, version: str = "version", id: str = "row_id", payload: Sequence[str] = ()) -> DataFrame:
    """What follows an export's cut (S13): one final change per id and epoch with its payload, deletes before upserts by rank."""
    last = log.where(F.col(version) > cut).groupBy(version, id).agg(F.max_by(F.struct("op", "offset", *payload), "offset").alias("x"))
    return last.select(F.col(version).alias("epoch"), id, F.col("x.op").alias("op"), F.when(F.col("x.op") == DELETE, 0).otherwise(1).alias("rank"), *(F.col(f"x.{c}").alias(c) for c in payload))


def patched(table: DataFrame, patches: DataFrame, fields: Mapping[str, tuple[bool, bool]], id: str = "row_id") -> DataFrame:
    """Sparse patches (S14). patches: id, and per field <f>__op (unchanged, set, null, clear) and <f>__value.

    fields: per field whether it is optional and nullable; a field that is both has its companion
    set too. Clearing a required field or nulling one that has no null fails.
    """
    both = table.join(patches.withColumnRenamed(id, "__id"), F.col(id) == F.col("__id"), "left")
    for f, (optional, nullable) in fields.items():
        op = F.coalesce(f"{f}__op", F.lit("unchanged"))
        bad = F.raise_error(F.lit(f"{f} can't be cleared or null"))
        none = F.lit(None).cast(table.schema[f].dataType)
        cleared, nulled = (none if optional else bad.cast(table.schema[f].dataType)), (none if nullable else bad.cast(table.schema[f].dataType))
        both = both.withColumn(f, F.when(op == "set", F.col(f"{f}__value")).when(op == "clear", cleared).when(op == "null", nulled).otherwise(F.col(f)))
        if optional and nullable:
            both = both.withColumn(f"__has_{f}", F.when(op.isin("set", "null"), True).when(op == "clear", False).otherwise(F.col(f"__has_{f}")))
    return both.select(*table.columns)


# ---- between versions -------------------------------------------------------------------------


def membership_delta(old: DataFrame, new: DataFrame, columns: Sequence[str], id: str = "row_id") -> DataFrame:
    """(id, columns, weight): -1 for what a query's result lost, +1 for what it won."""
    a = old.select(F.col(id), F.struct(*columns).alias("o"))
    b = new.select(F.col(id).alias("__id"), F.struct(*columns).alias("n"))
    both = a.join(b, F.col(id) == F.col("__id"), "full_outer").where(~F.col("o").eqNullSafe(F.col("n")))
    change = lambda x, w: F.when(F.col(x).isNotNull(), F.struct(F.coalesce(id, "__id").alias(id), F.col(x).alias("x"), F.lit(w).alias("weight")))
    out = both.select(F.explode(F.array_compact(F.array(change("o", -1), change("n", 1)))).alias("c"))
    return out.select(f"c.{id}", *(F.col(f"c.x.{c}").alias(c) for c in columns), "c.weight")


def consolidated(deltas: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weights summed per key, zeros left out (D2); orders of retraction come from sorting by weight."""
    return deltas.groupBy(*keys).agg(F.sum("weight").alias("weight")).where("weight <> 0")


def window_operations(script: DataFrame, window: DataFrame, shape_changed: bool = False) -> DataFrame:
    """One row: operations, payloads, rows, and whether the full window is sent."""
    counts = script.agg(F.count("*").alias("operations"), F.count(F.when(F.col("change").isin("insert", "update"), 1)).alias("payloads"))
    both = counts.withColumn("rows", window.agg(F.count("*")).scalar())
    whole = F.lit(shape_changed) | (F.col("operations") > MAX_OPERATIONS) | ((F.col("payloads") > FEW_PAYLOADS) & (2 * F.col("payloads") >= F.col("rows")))
    return both.withColumn("snapshot", whole)


def script_of(old: Sequence[int], new: Sequence[int], updated: Sequence[bool]) -> list[tuple[int, str, int | None, int | None]]:
    """(item, change, from, to) in order. old and new: an item's place in either window, -1 if it has none.

    Places are those of the working order at that time: removals from the end, then place by place what must be there. What
    comes next stands behind the items before it that still wait, whose number a Fenwick tree over the old order tells.
    """
    gone = sorted((k for k, n in enumerate(new) if n < 0), key=lambda k: -old[k])
    out: list[tuple[int, str, int | None, int | None]] = [(k, "remove", old[k], None) for k in gone]
    stay = sorted((k for k in range(len(old)) if old[k] >= 0 and new[k] >= 0), key=lambda k: old[k])
    rank = {k: r for r, k in enumerate(stay, 1)}
    tree = [r & -r for r in range(len(stay) + 1)]  # all wait
    for k in sorted((k for k, n in enumerate(new) if n >= 0), key=lambda k: new[k]):
        if old[k] < 0:
            out.append((k, "insert", None, new[k]))
            continue
        before, r = 0, rank[k] - 1
        while r:
            before, r = before + tree[r], r & (r - 1)
        r = rank[k]
        while r < len(tree):
            tree[r] -= 1
            r += r & -r
        if before:
            out.append((k, "move", new[k] + before, new[k]))
        if updated[k]:
            out.append((k, "update", None, new[k]))
    return out


def window_diff(old: DataFrame, new: DataFrame, columns: Sequence[str], id: str = "row_id", by: Sequence[str] = ()) -> DataFrame:
    """(by, id, seq, change, from_index, to_index): the script that makes one numbered window of the other, step by step (D3).

    remove, insert, move and update at places of the working order; a row that is moved and updated has both steps. by: columns
    that tell windows apart, so that many are compared at once, each in a group of its own of at most WINDOW_ROWS rows.
    """
    keys = [*by, id]
    a = old.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("index").alias("old"), F.struct(*columns).alias("o"))
    b = new.select(*keys, F.col("index").alias("new"), F.struct(*columns).alias("n"))
    same = F.lit(True)
    for k in keys:
        same = same & (b[k] == a[f"__{k}"])
    both = b.join(a, same, "full_outer").select(*(F.coalesce(k, f"__{k}").alias(k) for k in keys), "old", "new", (~F.col("o").eqNullSafe(F.col("n"))).alias("updated"))
    kinds = ", ".join(f"`{k}` {both.schema[k].dataType.simpleString()}" for k in keys)

    def steps(pdf: pd.DataFrame) -> pd.DataFrame:
        if max(pdf["old"].count(), pdf["new"].count()) > WINDOW_ROWS:
            raise ValueError("a window has at most 4096 rows")
        script = script_of(pdf["old"].fillna(-1).astype(int).tolist(), pdf["new"].fillna(-1).astype(int).tolist(), pdf["updated"].tolist())
        out = pdf[keys].iloc[[k for k, *_ in script]].reset_index(drop=True)
        out["seq"] = range(len(script))
        out["change"] = pd.Series([c for _, c, _, _ in script], dtype=object)
        for name, at in (("from_index", 2), ("to_index", 3)):
            out[name] = pd.array([s[at] for s in script], dtype="Int64")
        return out

    return both.groupBy(*by).applyInPandas(steps, f"{kinds}, seq int, change string, from_index long, to_index long")


def field_patches(old: DataFrame, new: DataFrame, fields: Sequence[str], id: str = "row_id") -> DataFrame:
    """(id, path, op, value): each changed field as set or remove (D4). fields may be nested: a parent that comes is an object,
    one that goes is one remove, and otherwise only its changed fields count. A parent is missing where its struct is null.
    A field that can be null has a companion __has_<field> beside it: null is then a value that is set."""
    a = old.select(F.col(id).alias("__id"), F.struct("*").alias("o"))
    b = new.select(F.col(id), F.struct("*").alias("n"))
    both = b.join(a, F.col(id) == F.col("__id"))
    patch = lambda path, op, value: F.struct(F.lit(path).alias("path"), op.alias("op"), value.cast("string").alias("value"))
    none, patches, parents = F.lit(None), [], {}
    for path in fields:
        above = [".".join(path.split(".")[: k + 1]) for k in range(path.count("."))]
        for p in above:
            if p not in parents:
                outer = parents[above[above.index(p) - 1]][0] if above.index(p) else F.lit(True)
                was, is_ = F.col(f"o.{p}").isNotNull(), F.col(f"n.{p}").isNotNull()
                parents[p] = (outer & is_, was)
                patches.append(F.when(outer & was & ~is_, patch(p, F.lit("remove"), none)).when(outer & ~was & is_, patch(p, F.lit("object"), none)))
        inside = parents[above[-1]][0] if above else F.lit(True)
        head, _, name = path.rpartition(".")
        companion = f"{head}.__has_{name}" if head else f"__has_{name}"
        kind = b.schema["n"].dataType
        for part in head.split(".") if head else []:
            kind = kind[part].dataType
        there = F.col(f"n.{companion}") if f"__has_{name}" in kind.names else F.col(f"n.{path}").isNotNull()
        was = F.col(f"o.{companion}") if f"__has_{name}" in kind.names else F.col(f"o.{path}").isNotNull()
        differs = ~F.col(f"o.{path}").eqNullSafe(F.col(f"n.{path}")) | ~F.coalesce(was, F.lit(False)).eqNullSafe(F.coalesce(there, F.lit(False)))
        patches.append(F.when(inside & differs, patch(path, F.when(F.coalesce(there, F.lit(False)), "set").otherwise("remove"), F.col(f"n.{path}"))))
    return both.select(id, F.explode(F.array_compact(F.array(*patches))).alias("p")).select(id, "p.*")


def reconstructed(baseline: DataFrame, script: DataFrame, rows: DataFrame, base_version: int, delta_base: int, id: str = "row_id") -> DataFrame:
    """The window that a baseline and a script lead to (D6). script: window_diff's rows; rows: id and columns of inserted or updated ones.

    What a script has put at a place stays there, so inserted and moved rows have their last places; the others fill the places left, in
    their old order.
    """
    if base_version != delta_base:
        raise ValueError("the delta does not start at this baseline")
    columns = [c for c in baseline.columns if c not in (id, "index")]
    put = script.where("change in ('insert', 'move')").select(F.col(id).alias("__id"), "to_index", "change")
    removed_ids = script.where("change = 'remove'").select(id)
    survivors = baseline.join(removed_ids, id, "left_anti")
    waiting = survivors.join(put.select(F.col("__id").alias(id)), id, "left_anti").withColumn("__r", F.row_number().over(Window.orderBy("index")))
    size = F.coalesce(survivors.agg(F.count("*")).scalar() + put.where("change = 'insert'").agg(F.count("*")).scalar(), F.lit(0))
    places = baseline.sparkSession.range(1).where(size > 0).select(F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("place"))
    free = places.join(put.select(F.col("to_index").alias("place")), "place", "left_anti").withColumn("__f", F.row_number().over(Window.orderBy("place")))
    at = waiting.join(free, F.col("__r") == F.col("__f")).select(F.col(id), F.col("place").alias("index"))
    at = at.unionByName(put.select(F.col("__id").alias(id), F.col("to_index").alias("index")))
    fresh = rows.select(id, *columns)
    values = survivors.select(id, *columns).join(fresh.select(id), id, "left_anti").unionByName(fresh)
    return values.join(at, id).select(id, *columns, "index")
