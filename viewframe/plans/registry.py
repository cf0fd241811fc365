"""Registered queries over the given tables, each with SQL for the same rows where SQL can say it."""

from __future__ import annotations

import operator
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewframe.functions import exact, scalars
from viewframe.functions.text import normalized, utf16_order
from viewframe.operators import aggregates as A
from viewframe.operators import facets, joins, order
from viewframe.operators import predicates as P
from viewframe.plans.grid import GridQuery
from viewframe.plans.view import View
from viewframe.sources.schema import Field, Schema, flat

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINEITEM = flat(
    "l_orderkey", ("l_orderkey", "int64"), ("l_partkey", "int64"), ("l_suppkey", "int64"), ("l_linenumber", "int64"), ("l_quantity", "number"), ("l_extendedprice", "number"),
    ("l_discount", "number"), ("l_tax", "number"), ("l_returnflag", "string"), ("l_linestatus", "string"),
)
ORDERS = flat("o_orderkey", ("o_orderkey", "int64"), ("o_custkey", "int64"), ("o_orderstatus", "string"), ("o_totalprice", "number"), ("o_orderpriority", "string"), ("note", "string", "on"), ("rush", "boolean", "o"))
CUSTOMER = flat("c_custkey", ("c_custkey", "int64"), ("c_name", "string"), ("c_nationkey", "int64"), ("c_acctbal", "number"), ("c_mktsegment", "string"))
PART = flat("p_partkey", ("p_partkey", "int64"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int64"), ("p_retailprice", "number"))
EVENTS = flat("event_id", ("event_id", "int64"), ("user_id", "int64"), ("event_type", "string"), ("value", "number"))
DOCUMENTS = flat("doc_id", ("doc_id", "int64"), ("text", "string", "n"), ("lang", "string"), ("source", "string"))


def view(spark: SparkSession, sf_dir: str, name: str) -> View:
    schema: Schema = {"lineitem": LINEITEM, "customer": CUSTOMER, "part": PART, "events": EVENTS, "documents": DOCUMENTS}[name]
    return View(table(spark, sf_dir, name), schema, name)


def orders(spark: SparkSession, sf_dir: str) -> View:
    """Orders with a note that is missing, null, empty or text in turn, and an optional flag."""
    n = F.col("o_orderkey") % 4
    df = table(spark, sf_dir, "orders").withColumn("note", F.when(n == 3, F.concat(F.lit("note "), F.col("o_orderpriority"))).when(n == 2, ""))
    df = df.withColumn("__has_note", n != 0).withColumn("rush", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus") == "O"))
    return View(df, ORDERS, "orders")


O_SQL = """o as (select *, case o_orderkey % 4 when 3 then 'note ' || o_orderpriority when 2 then '' end as note, o_orderkey % 4 <> 0 as has_note,
  case when o_orderkey % 3 = 0 then o_orderstatus = 'O' end as rush from orders)"""

# ---- filters (F1-F21) -------------------------------------------------------------------------


def counted(v: View, registered: dict[str, P.Predicate], profile: str = "native") -> DataFrame:
    return P.membership(v.df, v.schema, registered, v.schema.key, profile).groupBy("query_id").agg(F.count("*").alias("rows"))


def counts_sql(conditions: dict[str, str], source: str, head: str = "") -> str:
    return head + " union all ".join(f"select '{q}' as query_id, count(*) as \"rows\" from {source} where {c} having count(*) > 0" for q, c in conditions.items())


@query(counts_sql({"eq": "o_orderstatus = 'O'", "ne": "o_orderstatus <> 'O'", "lt": "o_totalprice < 100000", "le": "o_custkey <= 500", "gt": "o_orderpriority > '3'", "ge": "o_totalprice >= 250000", "in": "o_orderstatus in ('F', 'P')"}, "orders"))
def filters_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(orders(spark, sf_dir), {
        "eq": P.eq("o_orderstatus", "O"), "ne": P.ne("o_orderstatus", "O"), "lt": P.lt("o_totalprice", 100000.0), "le": P.le("o_custkey", 500),
        "gt": P.gt("o_orderpriority", "3"), "ge": P.ge("o_totalprice", 250000.0), "in": P.is_in("o_orderstatus", ["F", "P"]),
    })


@query(counts_sql({"missing": "not has_note", "null": "has_note and note is null", "value": "note is not null", "blank": "coalesce(note, '') = ''", "not_blank": "note <> ''", "ne_absent": "note <> ''", "not_eq_absent": "note is null or note <> ''", "rush_missing": "rush is null"}, "o", f"with {O_SQL} "))
def filters_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(orders(spark, sf_dir), {
        "missing": P.is_missing("note"), "null": P.is_null("note"), "value": P.is_value("note"), "blank": P.blank("note"), "not_blank": P.not_blank("note"),
        "ne_absent": P.ne("note", ""), "not_eq_absent": ~P.eq("note", ""), "rush_missing": P.is_missing("rush"),
    })


@query(counts_sql({"and": "o_orderstatus = 'O' and o_totalprice > 200000", "or": "o_orderstatus = 'O' or o_totalprice > 200000", "not": "not (o_orderstatus = 'O' and o_totalprice > 200000)", "not_null": "note is null or note <> 'note 5-LOW'", "range": "o_custkey >= 10 and o_custkey < 100", "empty_and": "true", "product_or": "true"}, "o", f"with {O_SQL} "))
def filters_boolean(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = (P.eq("o_orderstatus", "O"), P.gt("o_totalprice", 200000.0))
    return counted(orders(spark, sf_dir), {
        "and": P.all_of(*both), "or": P.any_of(*both), "not": ~P.all_of(*both), "not_null": ~P.eq("note", "note 5-LOW"), "range": P.in_range("o_custkey", 10, 100),
        "empty_and": P.grouped([], "and"), "empty_or": P.grouped([], "or"), "product_or": P.grouped([], "or", "product"), "false": P.nothing(),
    })


@query(counts_sql({"contains": "contains(p_name, 'e b')", "starts": "starts_with(p_name, 'red')", "ends": "ends_with(p_name, 'bolt')", "percent": "contains(p_name, 'ring')"}, "part"))
def filters_text_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(view(spark, sf_dir, "part"), {"contains": P.contains("p_name", "e b"), "starts": P.starts_with("p_name", "red"), "ends": P.ends_with("p_name", "bolt"), "percent": P.contains("p_name", "ring"), "literal": P.contains("p_name", "%")})


@query(counts_sql({"contains": "contains(t, 'etre')", "not_contains": "not coalesce(contains(t, 'etre'), false)", "starts": "starts_with(t, 'e')", "case": "contains(strip_accents(text), 'Etre')", "accent": "contains(lower(text), 'être')", "lang_in": "lang in ('fr', 'de')", "lang_ne": "lang <> 'fr'"}, "d", "with d as (select *, lower(strip_accents(text)) as t from documents) "))
def filters_text_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(view(spark, sf_dir, "documents"), {
        "contains": P.text("text", "contains", "ÊTRE"), "not_contains": P.text("text", "notContains", "être"), "starts": P.text("text", "startsWith", "É"),
        "case": P.text("text", "contains", "Être", case_sensitive=True), "accent": P.text("text", "contains", "être", accent_sensitive=True),
        "lang_in": P.text_in("lang", ["FR", "dé"]), "lang_ne": P.ne("lang", "FR"),
    }, P.COMPAT)


@query(counts_sql({"equals_null": "has_note and note is null", "not_equals_null": "not (has_note and note is null)", "in_null": "(has_note and note is null) or note = ''", "include": "o_orderstatus in ('F')", "exclude": "o_orderstatus <> 'F'", "condition": "o_totalprice <= 50000"}, "o", f"with {O_SQL} "))
def filters_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(orders(spark, sf_dir), {
        "equals_null": P.equals("note", None), "not_equals_null": P.not_equals("note", None), "in_null": P.one_of("note", [None, ""]), "include": P.set_filter("o_orderstatus", include=["F"]),
        "exclude": P.set_filter("o_orderstatus", exclude=["F"]), "include_none": P.set_filter("o_orderstatus", include=[]), "condition": P.condition("o_totalprice", "le", 50000.0),
    })


@query("select o_orderkey as row_id, o_orderstatus, o_totalprice from orders where o_custkey in (select unnest(range(0, 3600, 3)))")
def filter_in_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = orders(spark, sf_dir)
    chosen = P.filter_in(v.df, v.schema, "o_custkey", range(0, 3600, 3))
    return View(chosen, v.schema).select(["o_orderstatus", "o_totalprice"])


@query("select c_custkey as row_id, c_name, c_mktsegment from customer where c_acctbal > 0 and c_nationkey < 10 and (contains(lower(c_name), '11') or contains(lower(c_mktsegment), '11'))")
def quick_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "customer")
    return v.where(P.gt("c_acctbal", 0.0), P.lt("c_nationkey", 10), P.quick_filter(["c_name", "c_mktsegment"], "11"), profile=P.COMPAT).select(["c_name", "c_mktsegment"])


# ---- projection and order (P1-P3, O1-O10) -----------------------------------------------------


@query("select o_orderkey as row_id, o_orderpriority, o_totalprice, round(o_totalprice * 2, 2) as double_price from orders where o_totalprice > 400000")
def select_computed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = orders(spark, sf_dir).with_computed("double_price", F.round(F.col("o_totalprice") * 2, 2))
    return v.where(P.gt("o_totalprice", 400000.0)).select(["o_orderpriority", "o_totalprice", "double_price"])


@query("select o_orderkey as row_id, o_orderkey % 5 <> 0 as has_parent, case when o_orderkey % 15 not in (0, 5, 10, 3, 6, 9, 12) then o_orderstatus end as status from orders")
def nested_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parent that is absent stays null; one that is there without the chosen leaf stays an object."""
    n = F.col("o_orderkey")
    parent = F.struct(F.when(n % 3 != 0, F.col("o_orderstatus")).alias("status"), F.col("o_custkey").alias("customer"))
    schema = Schema((Field("o_orderkey", "int64"), Field("d.status", "string", True), Field("d.customer", "int64", True)), "o_orderkey")
    out = View(table(spark, sf_dir, "orders").select("o_orderkey", F.when(n % 5 != 0, parent).alias("d")), schema).select(["d.status"])
    return out.select("row_id", F.col("d").isNotNull().alias("has_parent"), F.col("d.status").alias("status"))


@query("select o_orderkey as row_id, o_totalprice from orders order by o_totalprice, o_orderkey limit 20 offset (select count(*) - 15 from orders)")
def deep_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window near the end, found by counting ranges whatever its depth."""
    v = orders(spark, sf_dir)
    ranks = order.ranked(v.df.select("o_orderkey", "o_totalprice"), order.sort_columns(v.schema, [("o_totalprice", "asc")], "o_orderkey"))
    return ranks.where(F.col("__rank") >= v.total_rows() - 15).select(F.col("o_orderkey").alias("row_id"), "o_totalprice")


PAGE = f"""with {O_SQL}, f as (select * from o where o_orderstatus = 'O')
select o_orderkey as row_id, o_orderpriority, note, has_note as __has_note, (select count(*) from f) as total_rows from f
order by case when note is not null then 2 when has_note then 1 else 0 end desc, note desc, o_totalprice asc, o_orderkey asc limit 40 offset 25"""


@query(PAGE)
def orders_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).query(["o_orderpriority", "note"], P.eq("o_orderstatus", "O"), order_by=[("note", "desc"), ("o_totalprice", "asc")], offset=25, limit=40, total=True)


@query("select o_orderkey as row_id, o_totalprice from orders where false")
def orders_window_past_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).query(["o_totalprice"], order_by=[("o_totalprice", "asc")], offset=100_000_000, limit=10)


@query("select doc_id as row_id, lang, source from documents order by lang desc, source, doc_id limit 60")
def documents_window_compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "documents").query(["lang", "source"], order_by=[("lang", "desc"), ("source", "asc")], offset=0, limit=60, profile=P.COMPAT)


RANKED = "r as (select c_custkey, row_number() over (order by c_acctbal desc, c_custkey) - 1 as rank, count(*) over () as total from customer)"


@query(f"""with {RANKED}, a as (select rank from r where c_custkey = 77), t as (select max(total) as total from r)
select 'rank_of' as what, rank::bigint as value from a union all select 'row_at_10', c_custkey from r where rank = 10
union all select 'end', greatest(total - 20, 0) from t union all select 'scroll', greatest(least(1000000, greatest(total - 20, 0)), 0) from t
union all select 'anchored', least(greatest(rank - 5, 0), greatest(total - 20, 0)) from a, t""")
def navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "customer")
    by = [("c_acctbal", "desc")]
    columns, total = order.sort_columns(v.schema, by, "c_custkey"), v.total_rows()
    rank = order.rank_of(v.df, v.schema, by, "c_custkey", 77)
    at = order.at_rank(v.df, columns, 10).select(F.lit("row_at_10").alias("what"), F.col("c_custkey").alias("value"))
    places = {"rank_of": rank, "end": order.start_of("end", total, 20), "scroll": order.start_of("scroll", total, 20, 1_000_000), "anchored": order.anchored_start(rank, 0, 5, total, 20)}
    return at.unionByName(spark.createDataFrame([(k, v) for k, v in places.items()], "what string, value long"))


@query(f"with {RANKED} select c_custkey, rank as \"index\" from r where rank >= 30 and rank < 55")
def numbered_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "customer")
    return order.numbered(v.df.select("c_custkey", "c_acctbal"), order.sort_columns(v.schema, [("c_acctbal", "desc")], "c_custkey"), 30, 25).select("c_custkey", F.col("index").cast("long").alias("index"))


@query("select p_partkey, p_name, p_size from part where contains(lower(p_name), 'ring') and p_size >= 20")
def grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "part")
    v = View(v.df.withColumn("source_index", F.col("p_partkey")), v.schema, "part")
    grid = GridQuery(filters={"p_size": P.ge("p_size", 20)}, quick_text="RING", quick_fields=["p_name"], order_by=[("p_size", "desc"), ("p_name", "asc")])
    return grid.rows(v).select("p_partkey", "p_name", "p_size")


# ---- aggregates (A1-A25) ----------------------------------------------------------------------

MEASURES = {
    "orders": A.Aggregate("count"), "suppliers": A.Aggregate("countDistinct", "l_suppkey"), "sum_qty": A.Aggregate("sum", "l_quantity"), "avg_qty": A.Aggregate("avg", "l_quantity"),
    "min_price": A.Aggregate("min", "l_extendedprice"), "max_price": A.Aggregate("max", "l_extendedprice"), "lines": A.Aggregate("sum", "l_linenumber"),
}


@query("""select l_returnflag, l_linestatus, count(*) as orders, count(distinct l_suppkey) as suppliers, round(sum(l_quantity), 2) as sum_qty, round(sum(l_quantity) / count(*), 6) as avg_qty,
 min(l_extendedprice) as min_price, max(l_extendedprice) as max_price, sum(l_linenumber)::bigint as lines from lineitem
 where l_returnflag in ('A', 'R') and l_quantity >= 10 group by all having count(*) > 0 order by sum_qty desc limit 10""")
def grid_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "lineitem")
    out = v.query(
        where=P.is_in("l_returnflag", ["A", "R"]) & P.ge("l_quantity", 10.0), group_by=["l_returnflag", "l_linestatus"], aggregates=MEASURES,
        having=P.gt("orders", 0), order_by=[("sum_qty", "desc")], offset=0, limit=10,
    )
    return out.select("l_returnflag", "l_linestatus", "orders", "suppliers", F.round("sum_qty", 2).alias("sum_qty"), F.round("avg_qty", 6).alias("avg_qty"), "min_price", "max_price", F.col("lines").cast("long").alias("lines"))


@query("select 0::bigint as n, 0::bigint as suppliers, 0::bigint as lines, null::double as avg_qty, null::double as max_price")
def global_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "lineitem").where(P.nothing())
    out = v.grouped([], {"n": A.Aggregate("count"), "suppliers": A.Aggregate("countDistinct", "l_suppkey"), "lines": A.Aggregate("sum", "l_linenumber"), "avg_qty": A.Aggregate("avg", "l_quantity"), "max_price": A.Aggregate("max", "l_extendedprice")})
    return out.df.withColumn("lines", F.col("lines").cast("long"))


@query("select count(*) as n, round(sum(l_extendedprice::decimal(18,2))::double, 2) as price, round(avg(l_linenumber)::double, 9) as line from lineitem")
def global_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = view(spark, sf_dir, "lineitem").grouped([], {"n": A.Aggregate("count"), "price": A.Aggregate("sum", "l_extendedprice"), "line": A.Aggregate("avg", "l_linenumber")}).df
    return out.select("n", F.round("price", 2).alias("price"), F.round(F.col("line").cast("double"), 9).alias("line"))


@query(f"""with {O_SQL} select note, case when note is not null then 2 when has_note then 1 else 0 end as state, count(*) as n,
 count(distinct rush) + max(case when rush is null then 1 else 0 end) as rushes, min(o_custkey) as low from o group by 1, 2""")
def groups_by_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = orders(spark, sf_dir).grouped(["note"], {"n": A.Aggregate("count"), "rushes": A.Aggregate("countDistinct", "rush"), "low": A.Aggregate("min", "o_custkey")})
    return v.df.withColumnRenamed("__state_note", "state")


@query("select o_orderpriority, count(*) as n, sum(o_custkey)::bigint as total from orders group by 1 having count(*) > 10 and not (sum(o_custkey) < 100) and o_orderpriority <> '5-LOW'")
def having(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = orders(spark, sf_dir).grouped(["o_orderpriority"], {"n": A.Aggregate("count"), "total": A.Aggregate("sum", "o_custkey")}, P.gt("n", 10) & ~P.lt("total", 100) & P.ne("o_orderpriority", "5-LOW"))
    return v.df.withColumn("total", F.col("total").cast("long"))


@query("select l_returnflag, rtrim(rtrim(sum(l_extendedprice::decimal(18,2))::varchar, '0'), '.') as total, rtrim(rtrim(sum(l_discount::decimal(18,2))::varchar, '0'), '.') as discount from lineitem group by 1")
def compat_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "lineitem").grouped(["l_returnflag"], {"total": A.Aggregate("sum", "l_extendedprice"), "discount": A.Aggregate("sum", "l_discount")}, profile=P.COMPAT).df


@query("select l_linestatus, (sum(round(l_extendedprice * 100)::hugeint) * 10000000000000000000000::hugeint // count(*))::varchar as mean, count(*) as n from lineitem group by 1")
def compat_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means have 100 significant digits; 24 digits after the point are compared."""
    out = view(spark, sf_dir, "lineitem").grouped(["l_linestatus"], {"mean": A.Aggregate("avg", "l_extendedprice"), "n": A.Aggregate("count")}, profile=P.COMPAT).df
    parts = F.split("mean", r"\.")
    return out.select("l_linestatus", F.concat(parts[0], F.substring(F.rpad(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), 24, "0"), 1, 24)).alias("mean"), "n")


@query(f"with {O_SQL} select o_orderstatus, min(coalesce(note, '')) filter (false) as low, max(note) as high, min(o_orderpriority) as first, max(o_orderpriority) as last from o group by 1")
def compat_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).grouped(["o_orderstatus"], {"low": A.Aggregate("min", "note"), "high": A.Aggregate("max", "note"), "first": A.Aggregate("min", "o_orderpriority"), "last": A.Aggregate("max", "o_orderpriority")}, profile=P.COMPAT).df


@query("select l_returnflag, (sum(l_orderkey::hugeint) * 1000000007)::varchar as total, count(*) as n from lineitem group by 1")
def wide_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (F.col("l_orderkey").cast("decimal(38,0)") * 1000000007).cast("string")
    return exact.text_sums(table(spark, sf_dir, "lineitem"), ["l_returnflag"], exact.canonical_wide(text))


@query("select l_linestatus, round(sum(l_quantity), 2) as total, round(sum(l_quantity) / count(*), 6) as mean, count(*) as n from lineitem group by 1")
def double_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.double_sums(table(spark, sf_dir, "lineitem"), ["l_linestatus"], F.col("l_quantity"))
    return out.select("l_linestatus", F.round("total", 2).alias("total"), F.round("mean", 6).alias("mean"), "n")


BITS = "case when l_orderkey % 50 = 1 then 36028797018963968 when l_orderkey % 50 = 3 then -36028797018963968 else l_orderkey % 1000 end"


@query(f"select l_linestatus, sum({BITS})::bigint::double as total, count(*) as n from lineitem group by 1")
def double_sums_to_the_bit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums whose large parts cancel: added up as doubles they would lose the small ones."""
    return exact.double_sums(table(spark, sf_dir, "lineitem"), ["l_linestatus"], F.expr(BITS).cast("double")).select("l_linestatus", "total", "n")


@query("select event_type, sum(round(value * 100))::double as total, sum(round(value * 100)) / count(*) as mean, count(*) as n from events where value is not null group by 1")
def user_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = table(spark, sf_dir, "events").where("value is not null").select("event_type", F.round(F.col("value") * 100).alias("cents"))
    return exact.aggregate_algebra(cents, ["event_type"], "cents", 0.0, operator.add, operator.truediv, "double")


@query(f"""with {O_SQL} select note, case when note is not null then 2 when has_note then 1 else 0 end as state, count(*) as n from o
 group by 1, 2 order by 2 desc, 1 desc limit 2 offset 5""")
def groups_descending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixth and seventh group of a descending order: the empty note, then null; missing ones would come last."""
    out = orders(spark, sf_dir).query(group_by=["note"], aggregates={"n": A.Aggregate("count")}, order_by=[("note", "desc")], offset=5, limit=2)
    return out.select("note", F.col("__state_note").alias("state"), "n")


@query(f"with {O_SQL} select note, case when has_note then 1 else 0 end as state, count(*) as n from o where note is null group by 1, 2")
def having_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = orders(spark, sf_dir).grouped(["note"], {"n": A.Aggregate("count")}, P.is_missing("note") | P.is_null("note"))
    return v.df.withColumnRenamed("__state_note", "state")


@query("""select p_type, count(*) as "rows", sum(p_size)::bigint as size, round(sum(p_retailprice::decimal(18,2))::double, 6) as price from part
 group by 1 order by sum(p_size) desc, 1 desc limit 7""")
def grid_groups_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "part")
    v = View(v.df.withColumn("source_index", F.col("p_partkey")), v.schema)
    grid = GridQuery(group_by=["p_type"], aggregates={"size": A.Aggregate("sum", "p_size"), "price": A.Aggregate("sum", "p_retailprice")}, order_by=[("size", "desc"), ("p_type", "desc")])
    return grid.rows(v).limit(7).withColumn("size", F.col("size").cast("long")).withColumn("price", F.round("price", 6))


@query("select p_brand, count(*) as \"rows\", sum(p_size)::bigint as size, min(p_name) as first_name from part where p_size > 5 group by 1")
def grid_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "part")
    v = View(v.df.withColumn("source_index", F.col("p_partkey")), v.schema)
    grid = GridQuery(filters={"p_size": P.gt("p_size", 5)}, group_by=["p_brand"], aggregates={"size": A.Aggregate("sum", "p_size"), "first_name": A.Aggregate("min", "p_name")})
    return grid.rows(v).withColumn("size", F.col("size").cast("long"))


@query("select event_type, count(*) as n from events where value >= 5 group by 1")
def grouped_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "events").where(P.ge("value", 5.0)).grouped(["event_type"], {"n": A.Aggregate("count")}).df


# ---- joins (J1-J9) ----------------------------------------------------------------------------


def orders_customers(spark: SparkSession, sf_dir: str, how: str = "left") -> View:
    chosen = view(spark, sf_dir, "customer").where(P.ge("c_acctbal", 0.0))
    return orders(spark, sf_dir).enrich(chosen, "o_custkey", "c_custkey", how, "o", "c")


@query("select o_orderkey as order_id, c_name as name, c_mktsegment as segment, c_custkey is not null as matched from orders left join (select * from customer where c_acctbal >= 0) on o_custkey = c_custkey")
def enrich_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = orders_customers(spark, sf_dir)
    return v.df.select(F.col("o.o_orderkey").alias("order_id"), F.col("c.c_name").alias("name"), F.col("c.c_mktsegment").alias("segment"), F.col("c").isNotNull().alias("matched"))


@query("select o_orderkey as order_id, c_name as name from orders join customer on o_custkey = c_custkey where c_acctbal >= 0 and c_nationkey < 5 and o_totalprice > 100000")
def enrich_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = orders_customers(spark, sf_dir, "inner").where(P.lt("c.c_nationkey", 5), P.gt("o.o_totalprice", 100000.0))
    return v.df.select(F.col("o.o_orderkey").alias("order_id"), F.col("c.c_name").alias("name"))


@query("select c_mktsegment as c__c_mktsegment, count(*) as n, round(sum(o_totalprice::decimal(18,2))::double, 2) as total from orders left join (select * from customer where c_acctbal >= 0) on o_custkey = c_custkey group by 1 having count(*) > 5")
def group_over_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = orders_customers(spark, sf_dir).grouped(["c.c_mktsegment"], {"n": A.Aggregate("count"), "total": A.Aggregate("sum", "o.o_totalprice")}, P.gt("n", 5))
    return v.df.withColumn("total", F.round("total", 2))


@query("""select o_orderkey as order_id, 'jid1:' || sha256('["orders+customer","' || o_orderkey || '"]') as joined_id from orders""")
def joined_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).df.select(F.col("o_orderkey").alias("order_id"), joins.joined_id("orders+customer", F.col("o_orderkey")).alias("joined_id"))


@query("select l_orderkey as key, 'right key is not unique' as reason from lineitem group by 1 having count(*) > 1 union all select o_orderkey, 'too many left rows for a key' from orders group by 1 having count(*) > 1")
def join_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.contract_errors(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey", 1)


@query("""with c2 as (select c_custkey, case when c_custkey % 50 = 0 then 'MOVED' else c_mktsegment end as segment from customer),
 o2 as (select o_orderkey, case when o_orderkey % 100 = 1 then 7 else o_custkey end as o_custkey from orders)
 select o_orderkey, o_custkey, segment from o2 left join c2 on o_custkey = c_custkey""")
def join_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A joined view kept up to date: only rows of touched ids and keys are joined again."""
    o, c = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment"))
    join = lambda a, b: a.join(b, a["o_custkey"] == b["c_custkey"], "left").select("o_orderkey", "o_custkey", "segment")
    o2 = o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 100 == 1, F.lit(7).cast("long")).otherwise(F.col("o_custkey")))
    c2 = c.withColumn("segment", F.when(F.col("c_custkey") % 50 == 0, "MOVED").otherwise(F.col("segment")))
    return joins.refreshed(join(o, c), o2, c2, o.where("o_orderkey % 100 = 1"), c.where("c_custkey % 50 = 0"), "o_orderkey", "o_custkey", "c_custkey", join)


# ---- facets (A19-A21) -------------------------------------------------------------------------

FACET_FILTERS = {"event_type": P.is_in("event_type", ["click", "view"]), "value": P.ge("value", 10.0), "user_id": P.lt("user_id", 50)}


@query("select event_type as value, count(*) as count from events where value >= 10 and user_id < 50 group by 1")
def facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "events")
    return facets.facet(v.df, v.schema, "event_type", FACET_FILTERS)


@query("with c as (select event_type as value, count(*) as n from events where value >= 10 and user_id < 50 group by 1), s as (select unnest(['click', 'refund']) as value) select value, coalesce(n, 0) as count from c full join s using (value)")
def facet_with_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "events")
    return facets.with_selected(facets.facet(v.df, v.schema, "event_type", FACET_FILTERS), ["click", "refund"])


@query("""select 'event_type' as field, event_type as value, count(*) as count from events where value >= 10 and user_id < 50 group by 2
 union all select 'user_id', user_id::varchar, count(*) from events where event_type in ('click', 'view') and value >= 10 group by 2""")
def all_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "events")
    return facets.all_facets(v.df, v.schema, ["event_type", "user_id"], FACET_FILTERS)


# ---- scalar functions (X1-X9) -----------------------------------------------------------------


@query("select doc_id, md5(lower(strip_accents(text))) as plain, md5(strip_accents(text)) as cased from documents")
def normalized_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents")
    return df.select("doc_id", F.md5(normalized(F.col("text"))).alias("plain"), F.md5(normalized(F.col("text"), case_sensitive=True)).alias("cased"))


@query("select event_id, case when value = floor(value) then value::bigint::varchar else rtrim(value::decimal(18,4)::varchar, '0') end as shown, user_id::bigint as whole, length(event_type) * 2 as units from events")
def canonical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    value = exact.parse_decimal(exact.canonical_number(F.col("value")).cast("decimal(18,4)").cast("string"))
    return df.select("event_id", exact.canonical_decimal(value).alias("shown"), exact.parse_integer(F.col("user_id").cast("string")).cast("long").alias("whole"), F.octet_length(utf16_order(F.col("event_type"))).alias("units"))


@query("select l_suppkey, round(round_even(sum(l_linenumber) * 1.0 / 8, 0), 0)::bigint as eighth from lineitem group by 1")
def half_even(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum("l_linenumber").alias("t"))
    return total.select("l_suppkey", exact.half_even_quotient(F.col("t"), F.lit(8)).cast("long").alias("eighth"))


@query("with r as (select o_orderkey, row_number() over (order by o_totalprice - 200000, o_orderkey) as rank from orders) select o_orderkey from r where rank <= 50")
def wide_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("wide", (F.col("o_totalprice").cast("decimal(18,2)") - 200000).cast("string"))
    return df.orderBy(exact.sort_token("wide"), "o_orderkey").limit(50).select("o_orderkey")


STATUS = {"OPEN": 1, "O": 1, "F": 2, "P": 3}


@query("""select o_orderkey, case o_orderstatus when 'O' then 1 when 'F' then 2 else 3 end as code, case o_orderstatus when 'O' then 'OPEN' else o_orderstatus end as label,
 o_orderkey % 2 = 0 as flag, case when o_orderkey % 3 <> 0 then o_totalprice end as price, o_custkey + 1 as next from orders""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("d", F.struct("o_custkey", "o_orderstatus"))
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("0"), F.col("o_totalprice").cast("string"))).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    code = scalars.enum_code(scalars.nested("d.o_orderstatus"), STATUS)
    return df.withColumn("d", scalars.with_nested("d.o_custkey", F.col("o_custkey") + 1)).select(
        "o_orderkey", code.alias("code"), scalars.enum_label(code, STATUS).alias("label"), scalars.parse_boolean((F.col("o_orderkey") % 2 == 0).cast("string")).alias("flag"),
        scalars.parse_number(text).alias("price"), F.col("d.o_custkey").alias("next"),
    )


@query(f"""select 'gid1:' || lower(hex('["orders","{ORDERS.fingerprint()}","string","2","' || o_orderpriority || '"]')) as group_id, count(*) as n, true as stable from orders group by o_orderpriority""")
def group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of groups, which are the same whatever rows a group holds."""
    v = orders(spark, sf_dir)
    ids = lambda v: v.grouped(["o_orderpriority"], {"n": A.Aggregate("count")}, with_id=True).df.select("group_id", "n")
    part = ids(v.where(P.gt("o_totalprice", 1000.0))).select(F.col("group_id").alias("again"))
    return ids(v).join(part, F.col("group_id") == F.col("again"), "left").select("group_id", "n", F.col("again").isNotNull().alias("stable"))
