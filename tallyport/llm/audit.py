"""Filter interaction audit: what each of five filters removes in every order of application."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyport.llm.common import store

#: The filters' letters; the filter at place i fails a document in bit i of its mask.
FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def content_mask(text: Column, words: Column) -> Column:
    """Bits of the filters A to D, which look at one text alone: few words, few distinct words, many capitals, marks."""
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    fails = [F.size(words) < 50, 100 * F.size(F.array_distinct(words)) < 65 * F.size(words), 100 * capitals > 5 * F.length(text), text.rlike(r"[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def failure_masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask``: one row per row of ``docs`` (doc_id, text, source) with its five failure bits.

    The texts are read once: what stays of them is a SHA-256, whose groups (combined before they are shuffled, so a
    group of copies is one row a task) give each text's smallest id. A row passes E if it holds that id; the join that
    tells so is keyed by text and id, so copies of one text are spread. Null text counts as empty; rows of a null id
    come after all others: they pass E only where no row with an id has their text.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.filter(F.split("text", SPACE), lambda w: w != ""))
    rows = store(rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("name"), content_mask(F.col("text"), F.col("words")).alias("mask")), "masks")
    first = rows.groupBy("name").agg(F.min("doc_id").alias("first"))
    first = first.select(F.col("name").alias("_name"), "first", F.lit(True).alias("is_first"))
    same = (F.col("name") == F.col("_name")) & F.col("doc_id").eqNullSafe(F.col("first"))
    repeat = F.when(F.col("is_first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    return rows.join(first, same, "left").select("doc_id", "part", (F.col("mask") + repeat).alias("mask"))


def mask_cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, cells``: each part's histogram of masks, at most 32 cells of (mask, n, good, toxic).

    A document is good (toxic) if any row of ``labels`` (doc_id, quality, toxic) with its id says 1.
    """
    said = labels.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(*[F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")])
    rows = masks.join(said, F.col("doc_id") == F.col("_id"), "left")
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long")
    cells = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))
    return cells.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))


def audit_orders(cells: DataFrame) -> DataFrame:
    """Every order and step of each part, worked out from its cells (part, cells).

    A cell's documents go at the first filter of the order that fails them. Over all orders, each of the s filters that
    fail a cell comes first among them equally often, 120 / s times, which gives ``shapley``.
    """
    orders = ["".join(p) for p in permutations(FILTERS)]
    rows = cells.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders))))
    rows = rows.withColumn("step", F.explode(F.array(*[F.lit(i + 1) for i in range(len(FILTERS))])))
    place = lambda letter: F.instr("filter_order", letter)
    at = lambda when: sum((F.when(when(place(x)), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumns({"_bit": at(lambda p: p == F.col("step")), "_before": at(lambda p: p < F.col("step"))})
    fails, gone = lambda c: c["mask"].bitwiseAND(F.col("_bit")) > 0, lambda c: c["mask"].bitwiseAND(F.col("_before")) > 0
    here = lambda c: fails(c) & ~gone(c)
    total = lambda test, value: F.aggregate(F.filter("cells", test), F.lit(0).cast("long"), lambda a, c: a + value(c))
    n = lambda c: c["n"]
    measures = {
        "kept": total(lambda c: ~fails(c) & ~gone(c), n), "removed": total(here, n), "redundant": total(lambda c: fails(c) & gone(c), n),
        "unique_fails": total(lambda c: c["mask"] == F.col("_bit"), n), "good_lost": total(here, lambda c: c["good"]), "toxic_lost": total(here, lambda c: c["toxic"]),
        "shapley": total(fails, lambda c: c["n"] * (F.lit(len(orders)) / F.bit_count(c["mask"])).cast("long")),
    }
    return rows.select("part", "filter_order", "step", *[v.alias(k) for k, v in measures.items()])


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    Five filters over ``docs`` (doc_id, text, source); see :func:`content_mask` for A to D, and E fails a text that a
    smaller id has too. One row per source, order (all 120) and step (1 to 5), zeros included. A null source is the
    part with the empty name, together with an empty one. Null text is empty; ties and repeated rows count each for
    themselves, and rows of one id and text all pass E if it is the text's smallest id. Labels of unknown documents,
    null labels and other columns are ignored; an empty table gives an empty result. What is gathered of a part is at
    most 32 cells, whatever its size.
    """
    return audit_orders(mask_cells(failure_masks(docs), labels))


OP11_SQL = r"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
said as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by doc_id),
firsts as (select t, min(doc_id) as first from d group by t),
m as (
  select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
         case when len(w) < 50 then 1 else 0 end + case when 100 * len(list_distinct(w)) < 65 * len(w) then 2 else 0 end
         + case when 100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 5 * length(d.t) then 4 else 0 end
         + case when regexp_matches(d.t, '[#$%&*|]') then 8 else 0 end + case when d.doc_id is distinct from first then 16 else 0 end as mask
  from d join firsts using (t) left join said on said.doc_id = d.doc_id),
cells as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by part, mask),
f as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order from f a, f b, f c, f d, f e
  where a.f not in (b.f, c.f, d.f, e.f) and b.f not in (c.f, d.f, e.f) and c.f not in (d.f, e.f) and d.f <> e.f),
steps as (
  select filter_order, step, substr(filter_order, step, 1) as f,
         cast(list_sum(list_transform(['A', 'B', 'C', 'D', 'E'], lambda x: case when instr(filter_order, x) < step then 1 << (ascii(x) - 65) else 0 end)) as integer) as before,
         1 << (ascii(substr(filter_order, step, 1)) - 65) as bit
  from orders, (select unnest([1, 2, 3, 4, 5]) as step)),
r as (
  select part, filter_order, step, f,
         sum(case when mask & (before | bit) = 0 then n else 0 end) as kept, sum(case when mask & before = 0 and mask & bit > 0 then n else 0 end) as removed,
         sum(case when mask & before > 0 and mask & bit > 0 then n else 0 end) as redundant, sum(case when mask = bit then n else 0 end) as unique_fails,
         sum(case when mask & before = 0 and mask & bit > 0 then good else 0 end) as good_lost, sum(case when mask & before = 0 and mask & bit > 0 then toxic else 0 end) as toxic_lost
  from steps, cells group by part, filter_order, step, f)
select part, filter_order, step, cast(kept as bigint) as kept, cast(removed as bigint) as removed, cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails,
       cast(good_lost as bigint) as good_lost, cast(toxic_lost as bigint) as toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley
from r
"""
