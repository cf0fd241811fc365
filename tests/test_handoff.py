"""Handoffs with a gap, writers who meet, exports that stop and go on."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from viewframe.sources.scratch import scratch
from viewframe.streaming import store
from viewframe.streaming.export import Export
from viewframe.streaming.tables import MaintainedTable

SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("v", T.StringType()), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType())])
CHANGES = T.StructType([*SCHEMA.fields, T.StructField("op", T.StringType())])


def rows(spark, *given):
    return spark.createDataFrame([(i, v, p, o, "delete" if v is None else "upsert") for i, v, p, o in given], CHANGES)


def read(table):
    return {r.row_id: r.v for r in table.read("table", table.version()).collect()}


def test_a_tail_follows_its_snapshot(spark):
    new = lambda: MaintainedTable(spark, scratch(spark, "t"), SCHEMA, source=("partition", "offset"))
    out = new()
    out.seed(rows(spark, (1, "a", 0, 4), (2, "b", 1, 7)).drop("op"), {"0": 4, "1": 7})
    out.apply(rows(spark, (1, "old", 0, 3), (1, "a2", 0, 5), (3, "c", 0, 6), (2, "b", 1, 7), (9, "n", 2, 0)), 1)  # 3 and 7 come again, partition 2 is new
    assert read(out) == {1: "a2", 2: "b", 3: "c", 9: "n"} and out.store.known(1)["positions"] == {"0": 6, "1": 7, "2": 0}
    for bad in (rows(spark, (1, "x", 0, 8)), rows(spark, (1, "x", 1, 8), (1, "y", 1, 10)), rows(spark, (1, "x", 3, 1))):
        with pytest.raises(ValueError, match="missing"):
            out.apply(bad, 2)
    assert out.version() == 1
    out.apply(rows(spark, (1, None, 0, 7), (2, "b2", 1, 8)), 2)
    assert read(out) == {2: "b2", 3: "c", 9: "n"}
    with pytest.raises(ValueError, match="more than once"):
        new().seed(rows(spark, (1, "a", 0, 4), (1, "b", 0, 5)).drop("op"), {"0": 5})
    with pytest.raises(ValueError, match="begins"):
        out.seed(rows(spark, (1, "a", 0, 4)).drop("op"), {"0": 4})


def test_one_of_two_writers_is_refused(spark):
    folder = scratch(spark, "t")
    one, two = MaintainedTable(spark, folder, SCHEMA), MaintainedTable(spark, folder, SCHEMA)
    one.apply(rows(spark, (1, "a", 0, 0), (2, "b", 0, 1)), 0)
    edit = lambda i, was, v: rows(spark, (i, v, 0, 9)).withColumn("expected", F.struct(F.lit(was).alias("v")))
    one.store.claim(1, "one")  # the first writer has begun
    with pytest.raises(ValueError, match="another writer"):
        two.edit(edit(2, "b", "b2"), ["v"], "two")
    assert one.edit(edit(1, "a", "a2"), ["v"], "one") == 1
    with pytest.raises(ValueError, match="mismatch"):
        two.edit(edit(1, "a", "a3"), ["v"], "two")
    assert two.version() == 1 and two.edit(edit(1, "a2", "a3").unionByName(edit(2, "b", None)), ["v"], "two") == 2
    assert read(one) == {1: "a3"}
    with pytest.raises(ValueError, match="there already"):
        one.store.claim(2, "one")


def test_an_export_is_the_table_at_each_epoch(spark, monkeypatch):
    monkeypatch.setattr(store, "KEPT", 3)
    out, folder = MaintainedTable(spark, scratch(spark, "t"), SCHEMA), scratch(spark, "x")
    with pytest.raises(ValueError, match="no version"):
        Export(out.store, folder).open()
    batches = [[(1, "a", 0, 0), (2, "b", 0, 1)], [(1, None, 0, 2), (3, "c", 0, 3)], [(3, "d", 0, 4), (3, "e", 0, 5), (2, "b", 0, 6)], [(1, "z", 0, 7), (2, None, 0, 8)]]
    states = []
    for k, batch in enumerate(batches):
        out.apply(rows(spark, *batch), k)
        states.append(read(out))
        if k in (0, 2, 3):
            Export(out.store, folder).advance()
    sink = Export(out.store, folder)
    for k, state in enumerate(states):
        assert {r.row_id: r.v for r in sink.restored(k).collect()} == state
    assert sink.manifests.known(0)["kind"] == "snapshot" and sink.manifests.known(3) == {"kind": "epoch", "upserts": 1, "deletes": 1}
    first = sink.epochs().where("epoch = 1").collect()
    assert {(r.row_id, r.op, r.rank, r.v) for r in first} == {(1, "delete", 0, None), (3, "upsert", 1, "c")}
    for k in range(4, 9):
        out.apply(rows(spark, (k, "x", 0, 10 + k)), k)
    with pytest.raises(ValueError, match="does not keep"):
        sink.advance()
