"""A maintained join takes what its left table changed from that table's images."""

import pytest
from pyspark.sql import types as T

from viewframe.sources.scratch import scratch
from viewframe.streaming.tables import MaintainedJoin, MaintainedTable

LEFT = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("k", T.LongType()), T.StructField("offset", T.LongType())])
RIGHT = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("offset", T.LongType())])


@pytest.mark.parametrize("how", ["left", "inner"])
def test_left_rows_of_images(spark, monkeypatch, how):
    left, right = MaintainedTable(spark, f"{scratch(spark, 'l')}/t", LEFT), MaintainedTable(spark, f"{scratch(spark, 'r')}/t", RIGHT)
    view = MaintainedJoin(left, right, f"{scratch(spark, 'v')}/t", "k", how)
    ours, theirs, offset = {}, {}, 0

    def put(table, mine, rows, deleted=()):
        nonlocal offset
        offset += 1
        mine.update(rows)
        for k in deleted:
            mine.pop(k, None)
        batch = [(k, v, offset, "upsert") for k, v in rows.items()] + [(k, None, offset, "delete") for k in deleted]
        table.apply(spark.createDataFrame(batch, T.StructType([*table.schema.fields, T.StructField("op", T.StringType())])), table.version() + 1)

    def check():
        found = {r["row_id"]: (r["l"]["k"], r["r"] and r["r"]["name"]) for r in view.read(view.refresh()).collect()}
        wanted = {i: (k, theirs.get(k)) for i, k in ours.items()}
        assert found == {i: v for i, v in wanted.items() if how == "left" or v[1] is not None}

    put(left, ours, {i: i % 5 if i % 7 else None for i in range(40)})
    put(right, theirs, {k: f"n{k}" for k in range(4)})
    check()
    with monkeypatch.context() as m:  # the left table itself is read no more
        m.setattr(left.store, "state", lambda *a, **k: pytest.fail("the left table was read"))
        put(left, ours, {1: 3, 2: None, 50: 0}, deleted=[5])
        put(left, ours, {1: 4, 5: 2, 51: 9}, deleted=[6, 50])
        check()
    put(left, ours, {3: 0, 52: 3}, deleted=[8])
    put(right, theirs, {0: "m0", 4: "n4", 9: "n9"}, deleted=[3])
    check()
