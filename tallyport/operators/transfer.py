"""What a transfer needs, has and sends: set difference, plans, state, reports, commits, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def transfer_set(need: DataFrame, have: DataFrame, pinned: DataFrame | None = None, key: str = "digest") -> DataFrame:
    """pinned + (need - have), distinct: a pinned key is sent even if it is there, or wasn't asked for."""
    rest = need.select(key).join(have.select(key), key, "left_anti")
    return (rest if pinned is None else pinned.select(key).unionByName(rest)).distinct()


def union_keys(*sets: DataFrame) -> DataFrame:
    """Distinct rows of one-column sets."""
    return reduce(DataFrame.union, sets).distinct()


def have_set(enumerated: DataFrame, assumed: DataFrame | None = None, assumed_keys: list | None = None, key: str = "digest") -> DataFrame:
    """The keys that the peer is taken to have: a given set (even an empty one), else a non-empty list, else what was
    enumerated."""
    if assumed is not None:
        return assumed.select(key).distinct()
    if assumed_keys:
        return enumerated.sparkSession.createDataFrame([(k,) for k in assumed_keys], enumerated.select(key).schema).distinct()
    return enumerated.select(key).distinct()


def image_report(need: DataFrame, have: DataFrame, image: str = "ref", key: str = "digest", size: str = "size") -> DataFrame:
    """``image, sent, reused, bytes``: what each image would send and what the peer already has."""
    marked = need.join(have.select(key).distinct().withColumn("_has", F.lit(True)), key, "left")
    new = F.col("_has").isNull()
    total = lambda c: F.sum(c).cast("bigint")
    return marked.groupBy(image).agg(total(new.cast("int")).alias("sent"), total((~new).cast("int")).alias("reused"), total(F.when(new, F.col(size)).otherwise(0)).alias("bytes"))


def plan_order(plan: DataFrame, image: str, key: str) -> DataFrame:
    """Adds ``ordinal``: the place of each key of an image in byte order, from 1."""
    return plan.withColumn("ordinal", F.row_number().over(W.partitionBy(image).orderBy(key)).cast("bigint"))


def first_occurrence(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def until_first_error(rows: DataFrame, group: str, order: list[str], failed: Column) -> DataFrame:
    """Rows up to and including each group's first failure: what runs without keep-going."""
    before = W.partitionBy(group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("_f", F.sum(failed.cast("int")).over(before)).where(F.coalesce("_f", F.lit(0)) == 0).drop("_f")


def argument_order(rows: DataFrame, order: str = "pos") -> DataFrame:
    """Rows in the order in which their images were asked for."""
    return rows.orderBy(order)


def running_bytes(plan: DataFrame, image: str, order: str, size: str) -> DataFrame:
    """Adds ``done``: the bytes of an image's plan up to and including each row (for progress; an extension)."""
    run = W.partitionBy(image).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return plan.withColumn("done", F.sum(size).over(run).cast("bigint"))


def request_error(kind: str, images: Column, transport: Column, base: Column, read_only: Column) -> Column:
    """Null if a push or pull may start: it needs images, a transport and a store; a push needs a peer that can be written."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    error = F.when(F.coalesce(F.size(images), F.lit(0)) <= 0, "no images").when(~some(transport), "no transport").when(~some(base), "no store")
    return error.when(F.coalesce(read_only, F.lit(False)), "peer is read-only") if kind == "push" else error


def report_lines(report: DataFrame, verb: str = "pushed") -> DataFrame:
    """Adds ``line``: what a transfer did, would do, or why it failed."""
    body = F.format_string(f"%s {verb} (new: %d, reused: %d, bytes: %d)", "ref", "sent", "reused", "bytes")
    line = F.when(F.col("error").isNotNull(), F.concat(F.col("ref"), F.lit(" ERROR: "), F.col("error"))).when(F.col("dry_run"), F.concat(F.lit("DRY-RUN would: "), body)).otherwise(body)
    return report.withColumn("line", line)


def failed_count(report: DataFrame) -> DataFrame:
    return report.agg(F.count("error").alias("failed"))


def blob_state(committed: Column, part: Column, size: Column) -> Column:
    """``struct<current_size, status>``: complete; partial for a part file strictly between 0 and the size; absent
    otherwise, also for a part file of full size or more."""
    partial = (part > 0) & (part < size)
    return F.struct(F.coalesce(committed, F.when(partial, part)).alias("current_size"), F.when(committed.isNotNull(), F.when(committed == size, "complete").otherwise("wrong size")).when(partial, "partial").otherwise("absent").alias("status"))


def chunk_state(chunks: DataFrame, group: str, index: str, length: str) -> DataFrame:
    """``group, resume_offset, present``: bytes of the unbroken run of chunks from the first, and how many there are."""
    run = chunks.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(index)) - 1)
    prefix = F.sum(F.when(F.col(index) == F.col("_rn"), F.col(length)).otherwise(0))
    return run.groupBy(group).agg(prefix.cast("bigint").alias("resume_offset"), F.count(F.lit(1)).alias("present"))


def complete_blobs(chunks: DataFrame, group: str, ok: Column) -> DataFrame:
    """A blob is complete iff all its chunks are right."""
    return chunks.groupBy(group).agg(F.bool_and(ok).alias("complete"))


def chunk_rows(blobs: DataFrame, size: str, chunk: int) -> DataFrame:
    """One row per chunk, ``i`` from 0 and its length ``len``; an empty blob has one empty chunk."""
    n = F.greatest(F.expr(f"({size} + {chunk - 1}) div {chunk}"), F.lit(1).cast("bigint"))
    rows = blobs.withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    return rows.withColumn("len", F.least(F.lit(chunk).cast("bigint"), F.col(size) - F.col("i") * chunk))


def chunk_size_of(blobs: DataFrame, metas: DataFrame, default: int) -> DataFrame:
    """Adds ``chunk_size``: the last one that metadata recorded for a digest (the largest of several with one ``seq``),
    else the default."""
    last = metas.groupBy("digest").agg(F.max_by("chunk_size", F.struct("seq", "chunk_size")).alias("_c"))
    return blobs.join(last, "digest", "left").withColumn("chunk_size", F.when(F.col("_c") > 0, F.col("_c")).otherwise(F.lit(default).cast("bigint"))).drop("_c")


def latest(rows: DataFrame, key: str, value: str, order: Column, name: str) -> DataFrame:
    """The last writer's value of each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(name))


def both_halves(rows: DataFrame, key: str, first: Column, second: Column, value: str) -> DataFrame:
    """``key, a, b`` for the keys of which both halves have arrived, in either order."""
    halves = rows.groupBy(key).agg(F.max(F.when(first, F.col(value))).alias("a"), F.max(F.when(second, F.col(value))).alias("b"))
    return halves.where("a is not null and b is not null")


def commit_rows(plan: DataFrame, done: DataFrame, pointers: DataFrame, key: str = "digest", image: str = "ref") -> DataFrame:
    """The pointers of images none of whose planned blobs is missing: pointers go last, and only then."""
    missing = plan.join(done.select(key), key, "left_anti").select(image).distinct()
    return pointers.join(missing, image, "left_anti")


def dangling(closures: DataFrame, inventory: DataFrame, image: str, key: str) -> DataFrame:
    """``image, missing``: distinct blobs that an image refers to and the pool lacks."""
    lost = closures.select(image, key).join(inventory.select(key), key, "left_anti")
    return lost.groupBy(image).agg(F.count_distinct(key).alias("missing"))


def pool_copies(blobs: DataFrame, order: str) -> DataFrame:
    """``digest, copies, saved, first``: how often each blob (digest, size) occurs, the bytes that keeping it once saves,
    and its first occurrence."""
    saved = (F.sum("size") - F.max("size")).cast("bigint")
    return blobs.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), saved.alias("saved"), F.min(order).alias("first"))


def dry_and_real(need: DataFrame, image: str = "ref", key: str = "digest") -> DataFrame:
    """``image, dry_sent, real_sent``: a dry run counts each image's blobs alone; in a real run the first image (by name)
    sends a blob for all others."""
    once = need.select(image, key).distinct()
    first = once.groupBy(key).agg(F.min(image).alias("_first"))
    marked = once.join(first, key).withColumn("_new", (F.col(image) == F.col("_first")).cast("int"))
    return marked.groupBy(image).agg(F.count(F.lit(1)).alias("dry_sent"), F.sum("_new").cast("bigint").alias("real_sent"))


def overlay(*layers: Column) -> Column:
    """The first layer that is given; an explicit zero, false or empty text counts as given."""
    return F.coalesce(*layers)
