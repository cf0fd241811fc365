"""Operator 1: mixing sources to target weights, with DataFrame functions only.

Sizes are summed per source, targets follow the weights (a target stops at MOST times its
source's size and the excess is shared out again), and each document is emitted floor(rate)
times plus one copy with the probability of the fraction. The draw is a hash of the seed, the
document's id and its text, so reruns and retried tasks agree.

Defined results: a null text has size 0; a null source is a source of its own and comes last; a
source without words has target 0 and rate 0; repeated rows draw alike; an empty table gives an
empty result. Other columns of the documents stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from viewframe.llm.common import WORD, attach, table, text_of, written

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix-1"


def n_words(text: str) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def draw(id: str, text: str, seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of an MD5."""
    key = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id).cast("string"), F.lit("")), F.md5(text_of(text)))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank, from 0, by code point, null last. A range partitioning with offsets per partition: no task sees all of them."""
    parts = sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    parts = written(parts, "sources")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))  # a row per partition
    offsets = counts.withColumn("offset", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("own", own).join(offsets, "part").withColumn("rank", F.coalesce("offset", F.lit(0)) + F.col("own") - 1).drop("part", "own", "n", "offset")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sized has source and size. Per source: source, source_size, target, rate."""
    sums = ranked(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sums = written(sums.withColumn("weight", weight.cast("long")).withColumn("cap", most * F.col("source_size")), "weights")
    total, all_weights = sums.agg(F.sum("source_size"), F.sum("weight")).first()
    # A source is held at its cap once the common level times its weight is above that. The level only rises,
    # so this ends after at most as many rounds as there are sources; each brings three sums to the driver.
    level, held = (total / all_weights if all_weights else 0.0), 0
    while True:
        above = F.col("cap") < F.lit(level) * F.col("weight")
        n, caps, weight_held = sums.where(above).agg(F.count("*"), F.sum("cap"), F.sum("weight")).first()
        if n == held or weight_held == all_weights:
            break
        level, held = (total - caps) / (all_weights - weight_held), n
    target = F.when(above, F.col("cap").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    rate = F.when(above, F.lit(float(most))).when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    return sums.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def with_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with __size, __source_size, __target and __copies, how often the mix takes the document."""
    sized = docs.select(F.col(source).cast("string").alias("source"), n_words(text).alias("size"))
    targets = source_targets(sized).select("source", *(F.col(c).alias(f"__{c}") for c in ("source_size", "target", "rate")))
    keyed = docs.withColumn("__source_key", F.col(source).cast("string"))
    joined = attach(keyed, targets.withColumnRenamed("source", "__source_key"), "__source_key").drop("__source_key")
    whole = F.floor("__rate")
    copies = whole + (draw(id, text) < F.col("__rate") - whole).cast("long")
    return joined.withColumn("__size", n_words(text)).withColumn("__copies", copies).drop("__rate")


def mixed(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs."""
    if any(c.lower().startswith("__") for c in docs.columns):  # names that with_copies() adds or could add
        names = [f"c{k}" for k in range(len(docs.columns))]
        at = [names[docs.columns.index(c)] for c in (id, text, source)]
        return mixed(docs.toDF(*names), *at).toDF(*docs.columns)
    taken = with_copies(docs, id, text, source).where("__copies > 0")
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return with_copies(docs).select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).cast(T.LongType()).alias("taken"),
    )


OP1_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint / 4503599627370496.0::double as u
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight from s),
c as (select *, 3 * source_size as cap from w),
o as (select *, sum(source_size) over () as total, sum(weight) over () as weights,
             coalesce(sum(cap) over (order by cap / weight::double, source nulls last rows between unbounded preceding and 1 preceding), 0) as caps_before,
             coalesce(sum(weight) over (order by cap / weight::double, source nulls last rows between unbounded preceding and 1 preceding), 0) as weights_before
      from c),
h as (select *, cap < (total - caps_before)::double / (weights - weights_before)::double * weight as held from o),
l as (select *, (total - coalesce(sum(cap) filter (held) over (), 0))::double / (weights - coalesce(sum(weight) filter (held) over (), 0))::double as level from h),
t as (select source, source_size, case when held then cap::double else level * weight end as target,
             case when held then 3.0::double when source_size > 0 then least(3.0::double, level * weight / source_size) else 0.0 end as rate from l)
select doc_id, size, source_size, target, (size * (floor(rate) + (u < rate - floor(rate))::int))::bigint as taken
from d join t on d.source is not distinct from t.source
"""
