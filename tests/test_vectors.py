"""Hand vectors: orders, texts, exact numbers, windows, counts, joins, retention."""

import math
import random
from decimal import Decimal
from fractions import Fraction





import pytest
from pyspark.sql import functions as F

from viewframe.functions import exact
from viewframe.functions.text import normalize
from viewframe.operators import aggregates as A
from viewframe.operators import audit, edits, joins, order
from viewframe.operators import changes as C
from viewframe.operators import predicates as P
from viewframe.operators import retention as R
from viewframe.plans.grid import GridQuery
from viewframe.plans.view import View
from viewframe.sources import identity
from viewframe.sources.admission import admitted, rejecting
from viewframe.sources.rows import DEMO, demo_orders, may_follow, rendered
from viewframe.sources.schema import Field, Schema, flat

TEXTS = flat("id", ("id", "string"), ("text", "string", "on"), ("n", "number", "o"), ("g", "string"))


@pytest.fixture(scope="module")
def texts(spark):
    rows = [("a", "ÉCOLE", True), ("b", "école", True), ("c", "", True), ("d", "\U00010000", True), ("e", None, True), ("f", None, False)]
    df = spark.createDataFrame([(i, t, h, 1.0, "x") for i, t, h in rows], "id string, text string, __has_text boolean, n double, g string")
    return View(df, TEXTS)


def ids(df):
    return "".join(r[0] for r in df.collect())


def test_compat_order_and_text(texts):
    assert ids(texts.query(["id"], order_by=[("text", "asc")], profile=P.COMPAT)) == "efbadc"
    found = lambda p: "".join(sorted(ids(texts.where(p, profile=P.COMPAT).df)))
    assert found(P.eq("text", "école")) == "ab"
    assert found(P.text("text", "eq", "école", True, True)) == "b"
    assert found(P.text("text", "notContains", "école")) == "cdef"
    assert found(P.ne("text", "école")) == "cdef"
    assert ids(texts.query(["id"], order_by=[("text", "desc")])) == "dcabef"  # native: bytes, then null, then missing


def test_compat_extremes_and_distinct(texts):
    aggregates = {"low": A.Aggregate("min", "text"), "high": A.Aggregate("max", "text"), "d": A.Aggregate("countDistinct", "text")}
    row = texts.grouped(["g"], aggregates, profile=P.COMPAT).df.first()
    assert (row["low"], row["high"], row["d"]) == (None, "", 6)


def numbers(spark, values):
    return View(spark.createDataFrame([(str(i), None, False, v, "x") for i, v in enumerate(values)], "id string, text string, __has_text boolean, n double, g string"), TEXTS)


@pytest.mark.parametrize(("values", "total", "mean"), [([0.1, 0.2], "0.3", "0.15"), ([1.0, 0.0, 0.0], "1", "0." + "3" * 100), ([1e20, 0.1, -1e20], "0.1", None), ([None, None], "0", "0")])
def test_compat_sums(spark, values, total, mean):
    row = numbers(spark, values).grouped(["g"], {"s": A.Aggregate("sum", "n"), "a": A.Aggregate("avg", "n")}, profile=P.COMPAT).df.first()
    assert row["s"] == total and (mean is None or row["a"] == mean)


def test_exact_double_sums(spark):
    assert numbers(spark, [1e16, 1.0, -1e16]).grouped([], {"s": A.Aggregate("sum", "n")}).df.first()["s"] == 1.0
    assert numbers(spark, [0.1] * 10).grouped([], {"s": A.Aggregate("sum", "n")}).df.first()["s"] == math.fsum([0.1] * 10)
    with pytest.raises(Exception, match="out of range"):
        numbers(spark, [1.7976931348623157e308] * 2).grouped([], {"s": A.Aggregate("sum", "n")}).df.collect()


def test_half_even(spark):
    df = spark.createDataFrame([(1,), (3,), (5,), (-3,)], "u long")
    assert [int(r[0]) for r in df.select(exact.half_even_quotient(F.col("u"), F.lit(2))).collect()] == [0, 2, 2, -2]


def test_exact_average(spark):
    schema = flat("k", ("k", "string"), ("i", "int64", "n"), ("d", "decimal"))
    df = spark.createDataFrame([("a", 1, "1.5"), ("b", 2, "2"), ("c", None, "0.000000000000000001")], "k string, i long, d string").withColumn("d", F.col("d").cast("decimal(38,18)"))
    row = View(df, schema).grouped([], {"i": A.Aggregate("avg", "i"), "d": A.Aggregate("avg", "d"), "s": A.Aggregate("sum", "d"), "none": A.Aggregate("countDistinct", "i")}).df.first()
    assert (str(row["i"]), str(row["d"]), str(row["s"]), row["none"]) == ("1.500000000000000000", "1.166666666666666667", "3.500000000000000001", 3)


def test_ties_go_up_by_key(spark):
    schema = flat("id", ("id", "string"), ("price", "number"))
    v = View(spark.createDataFrame([("b", 2.0), ("a", 1.0), ("ab", 1.0)], "id string, price double"), schema)
    assert [r.id for r in v.query(["id"], order_by=[("price", "asc"), ("id", "desc")]).collect()] == ["ab", "a", "b"]
    assert [r.id for r in v.query(["id"], order_by=[("price", "desc")]).collect()] == ["b", "a", "ab"]


def test_wide_order(spark):
    values = ["-1", "-1.0", "-1.01", "0", "0.0000000000000000000000000001", "9007199254740992.5", "123456789012345678901234567890123456789012345"]
    df = spark.createDataFrame([(v,) for v in reversed(values)], "v string")
    got = [r.v for r in df.orderBy(exact.sort_token("v"), F.desc("v")).collect()]
    assert [float(v) for v in got] == sorted(map(float, values))


def test_wide_sum(spark):
    big = "9" * 60 + ".000000000000000000000000000000000000000001"
    df = spark.createDataFrame([("g", big), ("g", "1"), ("h", "-1e-30"), ("h", None)], "k string, v string")
    got = {r.k: r.total for r in exact.text_sums(df, ["k"], exact.canonical_wide("v")).collect()}
    assert got == {"g": "1" + "0" * 60 + "." + "0" * 41 + "1", "h": "-0." + "0" * 29 + "1"}


def test_windows(spark):
    v = View(spark.range(10).selectExpr("cast(id as string) id", "cast(id as double) n"), flat("id", ("id", "string"), ("n", "number")))
    assert v.query(["n"], limit=0).count() == 0 and v.query(["n"], offset=99, limit=5).count() == 0 and v.total_rows() == 10
    assert v.query(["n"], order_by=[("n", "desc")], offset=2, limit=3, total=True).collect()[0].total_rows == 10
    assert order.start_of("end", 10, 4) == 6 and order.start_of("scroll", 10, 4, 99) == 6 and order.anchored_start(1, 5, 3, 10, 4) == 0 and order.anchored_start(None, 8, 2, 10, 4) == 6
    with pytest.raises(ValueError):
        order.start_of("seek", 10, 4, 10)
    assert order.rank_of(v.df, v.schema, [("n", "desc")], "id", "7") == 2 and order.rank_of(v.df, v.schema, [("n", "desc")], "id", "77") is None


def test_predicate_bounds(texts):
    with pytest.raises(ValueError):
        P.all_of()
    with pytest.raises(ValueError):
        P.is_missing("g").compile(TEXTS)
    with pytest.raises(ValueError):
        P.eq("g", None).compile(TEXTS)
    deep = P.eq("g", "x")
    for _ in range(40):
        deep = ~deep
    with pytest.raises(ValueError):
        deep.compile(TEXTS)
    assert ids(texts.where(P.negated(P.eq("text", "zzz"))).df.orderBy("id")) == "abcdef"


def test_normalize():
    assert normalize("Straße ÉÅ") == "straße ea" and normalize("É", True) == "E" and normalize("É", False, True) == "é"


def test_join_contract_and_ids(spark):
    left_schema, right_schema = flat("id", ("id", "string"), ("k", "string", "on")), flat("id", ("id", "string"), ("v", "string", "o"))
    left = spark.createDataFrame([("a", "x", True), ("b", None, True)], "id string, k string, __has_k boolean")
    right = spark.createDataFrame([("x", None)], "id string, v string")
    out = joins.enrich(left, right, left_schema, right_schema, "k", "id", "left", "l", "r").orderBy("l.id").collect()
    assert out[0]["r"] is not None and out[1]["r"] is None
    assert not out[0]["__has_r__v"] and out[1]["__has_r__v"]  # missing where matched, null where unmatched
    with pytest.raises(Exception, match="not unique"):
        joins.enrich(left, right.union(right), left_schema, right_schema, "k", "id").collect()
    assert joins.ready_version(3, None) is None and joins.ready_version(3, 2) == 2


def test_retention_rules():
    assert R.minutes_to_ms(1440) == 86_400_000 and R.minutes_to_ms(0.00001) == 1
    for bad in (0, -1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            R.minutes_to_ms(bad)
    for bad in ({}, {"max_rows": 1, "max_rows_per_key": 1}, {"max_rows": 1, "cleanup": "compact"}, {"max_rows_per_key": 1}):
        with pytest.raises(ValueError):
            R.Policy(**bad)
    assert R.reference_time(5, 9) == 9


def test_age_boundary(spark):
    df = spark.createDataFrame([(1, 8), (2, 9)], "id long, ms long")
    assert [r.id for r in R.by_age(df, F.col("ms"), 2, 10).collect()] == [2]


def test_changes(spark):
    state = spark.createDataFrame([("a", 1), ("b", 2)], "row_id string, v int")
    batch = spark.createDataFrame([("a", "upsert", 5, 1), ("a", "upsert", 6, 2), ("b", "delete", None, 3), ("zz", "delete", None, 4)], "row_id string, op string, v int, offset long")
    assert {tuple(r) for r in C.applied(state, batch).collect()} == {("a", 6)}
    log = spark.createDataFrame([(0, 1, "x", 0), (0, 2, "y", 1), (0, 2, "y", 2), (0, 2, "z", 3), (0, 4, "w", 4), (0, 900, "w", 5), (0, 5, "w", 6)], "partition int, offset long, v string, arrival int")
    assert [r.audit for r in C.audited(log, ["v"]).orderBy("arrival").collect()] == ["first", "next", "replay", "conflict", "gap", "gap", "stale"]
    with pytest.raises(ValueError):
        C.snapshot_and_tail(state, batch.withColumn("version", F.lit(9)), 3)
    sent = lambda operations, payloads, rows, shape=False: C.window_operations(spark.createDataFrame([("update" if k < payloads else "move",) for k in range(operations)], "change string"), spark.range(rows), shape).first().snapshot
    assert sent(10, 9, 18) and not sent(10, 9, 19) and sent(0, 0, 0, True)


def test_edits(spark):
    state = spark.createDataFrame([("a", 1), ("b", 2)], "row_id string, v int")
    good = spark.createDataFrame([("a", (1,), 9)], "row_id string, expected struct<v:int>, v int")
    assert {tuple(r) for r in edits.compare_and_set(state, good, ["v"]).collect()} == {("a", 9), ("b", 2)}
    with pytest.raises(ValueError, match="mismatch"):
        edits.compare_and_set(state, good.withColumn("expected", F.struct(F.lit(7).alias("v"))), ["v"])
    with pytest.raises(ValueError, match="duplicate"):
        edits.compare_and_set(state, good.union(good), ["v"])


def test_digest_is_updatable(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string"), spark.createDataFrame([(2, None), (3, "z")], "i int, s string")
    old = audit.table_digest(a, ["i", "s"]).first()["digest"]
    assert audit.updated_digest(old, a.where("i = 1"), b.where("i = 3"), ["i", "s"]) == audit.table_digest(b.orderBy(F.desc("i")), ["i", "s"]).first()["digest"]


def test_identity(spark):
    df = spark.createDataFrame([("t", 5, -0.0, True, Decimal("10.50")), ("é", -1, 1.5, False, Decimal("-3"))], "s string, i long, d double, b boolean, m decimal(10,4)")
    kinds = [("string", "s"), ("int64", "i"), ("number", "d"), ("boolean", "b"), ("decimal", "m"), ("uint64", "u")]
    df = df.withColumn("u", F.lit("18446744073709551615").cast("decimal(20,0)"))
    got = df.select(identity.row_id([(k, F.col(c)) for k, c in kinds]).alias("r")).withColumn("ok", identity.valid_row_id(F.col("r"))).collect()
    assert got[0].r == "rid2:0106" + "010000000174" + "0400000008" + "0" * 15 + "5" + "0300000008" + "0" * 16 + "020000000101" + "0600000004" + b"10.5".hex() + "0500000008" + "f" * 16
    assert all(r.ok for r in got) and "0400000008" + "f" * 16 in got[1].r
    one = lambda kind, value, type: spark.range(1).select(identity.row_id([(kind, F.lit(value).cast(type))]).alias("r")).first().r
    assert one("string", "a", "string") == "rid2:0101010000000161"
    assert one("decimal", "10.5", "decimal(38,18)") == one("decimal", "10.500", "decimal(10,3)")
    bad = ["", "x", "rid2:", "rid2:010101000000016A", "rid2:0101010000000261", "rid2:010101000000016100", "rid2:010103000000088000000000000000", "rid2:0101020000000102", "rid2:01010600000003312e30", "rid2:0102010000000161", "rid2:01010100000001ff", None]
    assert not any(r[0] for r in spark.createDataFrame([(x,) for x in bad], "r string").select(identity.valid_row_id(F.col("r"))).collect())
    for kind, value, type in (("string", None, "string"), ("number", "NaN", "double"), ("number", "Infinity", "double"), ("string", "a" * 300, "string")):
        with pytest.raises(Exception, match="identity"):
            one(kind, value, type)


def test_admission_and_rendering(spark):
    schema = Schema((Field("id", "string"), Field("n", "uint64", True), Field("d.price", "decimal", True, True), Field("d.e", "enum", True, domain={"OPEN": 1, "ACTIVE": 1, "CLOSED": 2})), "id")
    lines = ['{"id":"a","n":"18446744073709551615","d":{"price":null,"e":"ACTIVE"}}', '{"id":"b","d":{}}', '{"id":"c","n":"-1"}', '{"id":null}', '{"id":"e","n":"01"}', '{"id":"f","d":{"price":"1.50","e":"WHAT"}}']
    df = admitted(spark.createDataFrame([(x,) for x in lines], "value string"), schema)
    got = df.select("id", "_errors", rendered(schema).alias("json")).collect()
    assert [bool(r._errors) for r in got] == [False, False, True, True, True, True]
    assert got[0].json == '{"id":"a","n":"18446744073709551615","d":{"price":null,"e":1}}' and got[1].json == '{"id":"b","d":{}}'
    with pytest.raises(Exception, match="USER_RAISED"):
        rejecting(df).collect()


def test_evolution_and_demo(spark):
    new = Schema((*DEMO.fields, Field("memo", "string", True, True)), "orderId")
    assert may_follow(DEMO, new) and not may_follow(new, DEMO) and not may_follow(DEMO, Schema((*DEMO.fields, Field("m", "string")), "orderId"))
    df = demo_orders(spark, 8)
    assert View(df, DEMO).where(P.is_missing("note")).total_rows() == 2 and View(df, DEMO).where(P.blank("note")).total_rows() == 6
    assert df.agg(F.min("units")).first()[0] == 9007199254740993


def test_nested_projection(spark):
    schema = Schema((Field("id", "string"), Field("d.a", "string", True), Field("d.b", "string", True)), "id")
    df = spark.createDataFrame([("x", (None, None)), ("y", None)], "id string, d struct<a:string,b:string>")
    rows = View(df, schema).select(["d.a"]).orderBy("row_id").collect()
    assert rows[0].d is not None and rows[1].d is None


def test_groups_know_what_is_missing(spark):
    """HAVING and orders of groups tell missing, null and value apart; counts are never null."""
    schema = Schema((Field("id", "string"), Field("note", "string", True, True), Field("v", "int64", False, True)), "id")
    rows = [("a", None, True, 1), ("b", None, False, 2), ("c", "x", True, None), ("d", "y", True, 4)]
    v = View(spark.createDataFrame(rows, "id string, note string, __has_note boolean, v long"), schema)
    measures = {"n": A.Aggregate("count"), "low": A.Aggregate("min", "v")}
    ordered = lambda way: [(r.note, r["__state_note"]) for r in v.query(group_by=["note"], aggregates=measures, order_by=[("note", way)]).collect()]
    assert ordered("asc") == [(None, 0), (None, 1), ("x", 2), ("y", 2)] and ordered("desc") == ordered("asc")[::-1]
    assert [r.n for r in v.grouped(["note"], measures, P.is_missing("note")).df.collect()] == [1]
    assert [r.note for r in v.grouped(["note"], measures, P.is_null("low")).df.collect()] == ["x"]
    with pytest.raises(ValueError, match="nullable"):
        v.grouped(["note"], measures, P.is_null("n"))
    with pytest.raises(KeyError):
        v.grouped(["note"], measures, P.eq("id", "a"))


def test_sums_of_doubles_are_rounded_once(spark):
    values = [r.l_extendedprice / 3 for r in spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_extendedprice").collect()] + [1e16, 1.0, -1e16]
    df = spark.createDataFrame([(x, k) for k, x in enumerate(values)], "v double, source_index int")
    total = math.fsum(values)
    assert exact.double_sums(df, [], F.col("v")).first().total == total
    grid = GridQuery(group_by=["g"], aggregates={"v": A.Aggregate("sum", "v"), "m": A.Aggregate("avg", "v")}).rows(View(df.withColumn("g", F.lit(1)), flat("source_index", ("source_index", "int64"), ("g", "int64"), ("v", "number")))).first()
    assert grid.v == total and grid.m == float(Fraction(*sum(map(Fraction, values), Fraction(0)).as_integer_ratio()) / len(values))


def test_newest_of_equals(spark):
    df = spark.createDataFrame([(k, 7) for k in range(10)], "id int, o int")
    assert sorted(r.id for r in R.newest(df, "o", 3, "id").collect()) == [0, 1, 2] and R.newest(df, "o", 99, "id").count() == 10


def test_deep_windows(spark, monkeypatch):
    df = spark.range(500).selectExpr("id", "id % 7 as k").repartition(6)
    columns = [F.col("k").desc(), F.col("id").asc()]
    whole = [r.id for r in df.orderBy(*columns).collect()]
    monkeypatch.setattr(order, "TOP_ROWS", 10)
    assert [r.id for r in order.window(df, columns, 300, 40).collect()] == whole[300:340] and order.window(df, columns, 600, 5).count() == 0


def test_join_limits(spark):
    left, right = spark.createDataFrame([(k, 1) for k in range(5)], "id int, k int"), spark.createDataFrame([(1, "x")], "id int, v string")
    schemas = flat("id", ("id", "int64"), ("k", "int64")), flat("id", ("id", "int64"), ("v", "string"))
    assert joins.enrich(left, right, *schemas, "k", "id").count() == 5
    for limit in ({"per_key": 4}, {"max_output": 4}):
        with pytest.raises(Exception, match="too many"):
            joins.enrich(left, right, *schemas, "k", "id", **limit).collect()


def test_edits_of_identity_and_cells(spark):
    state = spark.createDataFrame([("a", 1, "k1"), ("b", 2, "k2")], "row_id string, v int, key string")
    edit = spark.createDataFrame([("a", (1, "k1"), 9, "kX", "upsert")], "row_id string, expected struct<v:int,key:string>, v int, key string, op string")
    with pytest.raises(ValueError, match="identity"):
        edits.compare_and_set(state, edit, ["v", "key"], identity=["key"])
    gone = edits.compare_and_set(state, edit.withColumn("op", F.lit("delete")), ["v", "key"], identity=["key"])
    assert [r.row_id for r in gone.collect()] == ["b"]
    table = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "row_id string, row_version int, s string")
    cells = spark.createDataFrame([("a", 1, "s", "x", "new"), ("b", 1, "s", "other", "new"), ("a", 1, "zz", None, "?")][:2], "row_id string, expected_version int, path string, before string, after string")
    told = edits.versioned_edits(table, cells)
    assert {r.row_id: r.accepted for r in told.collect()} == {"a": True, "b": False}
    assert {tuple(r) for r in edits.cells_applied(table, told).collect()} == {("a", 2, "new"), ("b", 1, "y")}


def test_shared_folder_is_asked_for(spark):
    from viewframe.sources.scratch import shared_folder

    class Unset:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                sc = staticmethod(lambda: type("", (), {"getCheckpointDir": staticmethod(lambda: type("", (), {"isDefined": staticmethod(lambda: False)}))}))

    assert shared_folder(spark)
    with pytest.raises(ValueError):
        shared_folder(Unset)


def test_sums_of_shortest_texts(spark):
    rng = random.Random(5)
    values = [0.1, 0.2, 1e22, 1e-9, 123456789.123456, 5e-324, -0.3, 999999999.9999999, 1 / 3, 0.0, -0.0, 1e9, 12345.67] + [rng.uniform(-1e6, 1e6) for _ in range(200)] + [round(rng.uniform(0, 1e5), 2) for _ in range(500)]
    df = spark.createDataFrame([(k % 3, x) for k, x in enumerate(values)] + [(1, None), (9, None)], "k int, v double")
    got = {r.k: (r.total, r.n) for r in exact.shortest_sums(df, ["k"], F.col("v")).collect()}
    for k in range(3):
        own = [Fraction(repr(x)) for j, x in enumerate(values) if j % 3 == k]
        assert Fraction(got[k][0]) == sum(own) and got[k][1] == len(own)
    assert got[9] == ("0", 0) and exact.shortest_sums(df, [], F.col("v")).first().n == len(values)


def test_quotients_beyond_64_bits(spark):
    rows = [(10**37 + 1, 2), (4611686018427387904 * 10**18, 2), (-(10**36) * 7, 3), (99999999999999999999999999999999999999, 1), (5, 10), (15, 10), (0, 7), (10**30 + 5, 10)]
    df = spark.createDataFrame([(Decimal(u), n) for u, n in rows], "u decimal(38,0), n long")
    got = [int(r.q) for r in df.select(exact.half_even_quotient(F.col("u"), F.col("n")).alias("q")).collect()]
    assert got == [round(Fraction(u, n)) for u, n in rows]
