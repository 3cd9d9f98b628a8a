"""Mixing sources to target weights by a low-discrepancy schedule (DataFrame functions only)."""

from __future__ import annotations

from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyport.llm.common import WORD, store

#: The golden ratio's fraction times 2^31, made odd: i -> i * STEP mod 2^31 is a low-discrepancy sequence.
STEP, BITS, CELL_BITS = 1327217885, 31, 19


def source_targets(sized: DataFrame, weights=(1, 2, 3), most=3) -> DataFrame:
    """One row per source: ``source, srank, source_size, target, quota``.

    Sources in code-point order, null last, take ``weights`` in turn. A target stops at ``most`` times the
    source's size and the excess is shared again by weight (water filling). With sources sorted by cap over
    weight, the level is the largest of (rest of all words) / (rest of all weight).
    """
    common = lcm(*weights)
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").isNull(), "source")
    per = per.withColumn("srank", F.row_number().over(by_name).cast("long"))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), ((F.col("srank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * most)
    up = W.orderBy(F.col("cap") * (F.lit(common) / F.col("weight")).cast("long"), "srank")
    per = per.withColumn("below", F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    per = per.withColumn("left", F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing)))
    whole = W.orderBy("srank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumn("level", F.max((F.sum("source_size").over(whole) - F.col("below")) / F.col("left")).over(whole))
    per = per.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
    per = per.withColumn("quota", F.least("cap", F.floor(F.col("target") + 0.5)))
    return per.select("source", "srank", "source_size", "target", "quota")


def _positions(df: DataFrame, group: str, part: str, order: list, value) -> DataFrame:
    """Adds ``pos``: the sum of ``value`` over the group's earlier rows, by (part, order).

    Two levels: a running sum within (group, part) and one over the parts' totals, so that no task
    orders all rows of a hot group.
    """
    own = W.partitionBy(group, part).orderBy(*order)
    totals = df.groupBy(group, part).agg(F.sum(value).alias("_t"))
    before = W.partitionBy(group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    df = df.withColumn("rn", F.row_number().over(own))
    df = df.withColumn("_own", F.coalesce(F.sum(value).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return df.join(totals, [group, part]).withColumn("pos", F.col("_before") + F.col("_own")).drop("_before", "_own")


def schedule(spark, targets: DataFrame, slots: int, block: int) -> DataFrame:
    """``(srank, block, upto, slot)``: each granted block of a source, the word at which it ends, and its slot.

    Slot i has the point i * golden ratio mod 1; the cumulative targets map it to a source (an equi-join on a
    grid of 4,096 cells, then the exact bounds); its rank among the source's slots is the block it takes. Blocks that
    the slots leave out, as of a source whose quota is about a block or less, are granted after them.
    """
    run = W.orderBy("srank")
    t = targets.where("quota > 0").withColumn("hi_q", F.sum("quota").over(run))
    t = t.withColumn("all_q", F.sum("quota").over(run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    edge = lambda q: F.floor(q / F.col("all_q") * float(1 << BITS))
    t = t.withColumn("lo", edge(F.col("hi_q") - F.col("quota"))).withColumn("hi", edge(F.col("hi_q"))).where("hi > lo")
    cells = t.select("srank", "quota", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", CELL_BITS), F.shiftright(F.col("hi") - 1, CELL_BITS))).alias("cell"))
    s = spark.range(slots).select(F.col("id").alias("slot"), ((F.col("id") % (1 << BITS)) * STEP % (1 << BITS)).alias("point"))
    s = s.withColumn("cell", F.shiftright("point", CELL_BITS)).join(cells, "cell").where("point >= lo and point < hi")
    s = s.select("srank", "quota", "slot", F.expr("slot div 8192").alias("part"))
    s = _positions(s, "srank", "part", ["slot"], F.lit(1))
    s = store(s.where(F.col("pos") * block < F.col("quota")).select("srank", "quota", F.col("pos").cast("long").alias("block"), "slot"), "slots")
    got = s.groupBy("srank").agg(F.count(F.lit(1)).alias("got"))
    rest = targets.join(got, "srank", "left").withColumn("got", F.coalesce("got", F.lit(0))).where(F.col("got") * block < F.col("quota"))
    rest = rest.select("srank", "quota", F.explode(F.expr(f"sequence(got, (quota - 1) div {block}L)")).alias("block"))
    rest = rest.withColumn("slot", F.lit(slots).cast("long") + F.col("block"))
    return s.union(rest).select("srank", "block", F.least((F.col("block") + 1) * block, "quota").alias("upto"), "slot")


def mix_sources(docs: DataFrame, weights=(1, 2, 3), most=3, least_slots=65536, largest_block=4096, digits=3) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken, slots`` for every row of ``docs`` (doc_id, source, text).

    Each source is shuffled by the md5 of the id, read again from its start as often as its quota asks
    (``most`` times at most), and cut into blocks of equal word counts: the total over ``least_slots``, at least 1
    and at most ``largest_block`` words. The schedule grants blocks; a row's ``taken`` is the number of its words
    in granted blocks. Slots are drawn with a small reserve and stop at the quota; what they leave of it is granted too,
    which makes a source's taken words its rounded target, however small the source. ``slots`` holds, for each time
    that the mix starts the row, the slot that first takes words of it, ascending: the order of the mix.

    Null or empty text has size 0 and takes nothing; a null source is a source of its own, after the others; a
    null id shuffles like empty text. Repeated rows count each for itself. An empty table gives an empty result.
    Other columns of ``docs`` are ignored.
    """
    spark = docs.sparkSession
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), h.alias("h"))
    sized = store(sized, "sized")
    total = sized.agg(F.sum("size")).first()[0] or 0
    targets = store(source_targets(sized, weights, most), "targets")
    rows = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    if total == 0:
        return rows.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.array().cast("array<bigint>").alias("slots"))
    block = max(1, min(largest_block, total // least_slots))
    slots = -(-total // block)
    granted = schedule(spark, targets, slots + slots // 64 + 1024, block)
    rows = rows.withColumn("part", F.substring("h", 1, digits))
    rows = _positions(rows, "srank", "part", ["h", "doc_id", "size"], F.col("size"))
    passes = rows.where("size > 0 and quota > 0").select("srank", "part", "rn", "size", "quota", F.explode(F.expr(f"sequence(0, {most - 1})")).alias("again"), "pos", "source_size")
    passes = passes.withColumn("start", F.col("again") * F.col("source_size") + F.col("pos")).where("start < quota")
    passes = passes.withColumn("end", F.least(F.col("start") + F.col("size"), "quota"))
    pieces = passes.select("srank", "part", "rn", "again", "start", "end", F.explode(F.expr(f"sequence(start div {block}L, (end - 1) div {block}L)")).alias("block"))
    pieces = pieces.join(granted, ["srank", "block"]).withColumn("words", F.least("end", "upto") - F.greatest("start", F.col("block") * block))
    taken = pieces.where("words > 0").groupBy("srank", "part", "rn", "again").agg(F.sum("words").alias("taken"), F.min("slot").alias("slot"))
    taken = taken.groupBy("srank", "part", "rn").agg(F.sum("taken").alias("taken"), F.array_sort(F.collect_list("slot")).alias("slots"))
    out = rows.join(taken, ["srank", "part", "rn"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", F.array().cast("array<bigint>")).alias("slots"))


OP3_SQL = r"""
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), '')) as h from documents),
per as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source is null, source) as srank from sized group by source),
capped as (select *, (srank - 1) % 3 + 1 as weight, 3 * source_size as cap from per),
filled as (
  select *, coalesce(sum(cap) over (order by cap * (6 // weight), srank rows between unbounded preceding and 1 preceding), 0) as below,
         sum(weight) over (order by cap * (6 // weight), srank rows between current row and unbounded following) as rest,
         sum(source_size) over () as total from capped),
targets as (
  select source, srank, source_size, total, least(cast(cap as double), weight * max(cast(total - below as double) / rest) over ()) as target, cap from filled),
quotas as (select *, least(cap, cast(floor(target + 0.5) as bigint)) as quota from targets),
granted as (select *, quota as upto from quotas),
placed as (
  select s.doc_id, s.size, g.source_size, g.target, g.upto,
         coalesce(sum(s.size) over (partition by g.srank order by s.h, s.doc_id, s.size rows between unbounded preceding and 1 preceding), 0) as pos
  from sized s join granted g on s.source is not distinct from g.source)
select doc_id, size, source_size, target,
       cast(greatest(0, least(pos + size, upto) - pos) + greatest(0, least(source_size + pos + size, upto) - source_size - pos)
            + greatest(0, least(2 * source_size + pos + size, upto) - 2 * source_size - pos) as bigint) as taken
from placed
"""
