"""Transfers as they run: plans against what is there, verified writes of blobs and chunks, pointers last."""

from __future__ import annotations

import hashlib
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyport.functions.text import digest_error
from tallyport.operators.transfer import chunk_size_of
from tallyport.sources.store import PARTS, file_system, put_in_place

#: Transfers that run at once in a push and in a pull. Fixed values.
PUSH_TASKS, PULL_TASKS = 3, 4


def most_tasks(spark: SparkSession) -> int:
    """Tasks that work is dealt out to where a coalesced shuffle would make too few."""
    return max(8 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def planned_state(plan: DataFrame, state: DataFrame) -> DataFrame:
    """``plan`` (digest, size) with ``current_size`` from ``state`` (digest, current_size) and ``complete``."""
    held = state.groupBy("digest").agg(F.max("current_size").alias("current_size"))
    return plan.join(held, "digest", "left").withColumn("complete", F.coalesce(F.col("current_size") == F.col("size"), F.lit(False)))


def push_totals(need: DataFrame, have: DataFrame, pinned: DataFrame, state: DataFrame, image: str = "ref") -> DataFrame:
    """``image, sent, reused, bytes`` of each image (image, digest, size): what a push finds, dry or real.

    Pinned digests (image, digest) are planned even if the peer is said to have them; what is planned but found
    complete counts as reused, like all that isn't planned.
    """
    # what is needed and what is pinned meet in one aggregate, over tasks whose number isn't coalesced: a table of groups is
    # many times as large in memory as its shuffled rows, whose size decides how many a coalesced task would hold
    yes, no = F.lit(True), F.lit(False)
    rows = need.select(image, "digest", "size", yes.alias("_needed"), no.alias("_pinned"))
    pins = pinned.where(F.col(image).isNotNull() & F.col("digest").isNotNull())
    rows = rows.unionByName(pins.select(image, "digest", no.alias("_needed"), yes.alias("_pinned")), allowMissingColumns=True)
    one = rows.repartition(most_tasks(need.sparkSession), image, "digest").groupBy(image, "digest")
    one = one.agg(F.max("size").alias("size"), F.bool_or("_needed").alias("_needed"), F.bool_or("_pinned").alias("_pinned")).where("_needed")
    marked = one.join(have.select("digest").distinct().withColumn("_had", yes), "digest", "left")
    marked = planned_state(marked, state)
    sent = (F.col("_had").isNull() | F.col("_pinned")) & ~F.col("complete")
    total = lambda c: F.sum(c).cast("bigint")
    return marked.groupBy(image).agg(total(sent.cast("int")).alias("sent"), total((~sent).cast("int")).alias("reused"), total(F.when(sent, F.col("size")).otherwise(0)).alias("bytes"))


def server_state(blobs: DataFrame, chunks: DataFrame, metas: DataFrame, default: int) -> DataFrame:
    """``digest, size, current_size, status`` of blobs (digest, size) on a file server, from their chunk objects
    (digest, idx, length); the chunk size is the one that metadata recorded last (digest, chunk_size, seq), else the default.

    Whole right-sized chunks from the first on count; a blob is complete only if all are there. A run that isn't
    complete never counts as long as the blob.
    """
    sized = chunk_size_of(blobs, metas, default)
    got = sized.join(chunks, "digest", "left")
    last = F.expr("greatest((size + chunk_size - 1) div chunk_size, 1) - 1")
    want = F.when(F.col("idx") == last, F.col("size") - last * F.col("chunk_size")).when(F.col("idx") < last, F.col("chunk_size"))
    right = got.withColumn("_last", last).where((F.col("length") == want)).select("digest", "size", "idx", "length", "_last").distinct()
    run = right.withColumn("_n", F.row_number().over(W.partitionBy("digest", "size").orderBy("idx")) - 1).where("idx = _n")
    held = run.groupBy("digest", "size").agg(F.sum("length").cast("bigint").alias("held"), (F.count(F.lit(1)) == F.max("_last") + 1).alias("whole"))
    rows = blobs.join(held, ["digest", "size"], "left")
    partial = (F.col("held") > 0) & (F.col("held") < F.col("size"))
    whole = F.coalesce("whole", F.lit(False))
    return rows.select("digest", "size", F.when(whole, F.col("size")).when(partial, F.col("held")).alias("current_size"), F.when(whole, "complete").when(partial, "partial").otherwise("absent").alias("status"))


def pull_actions(plan: DataFrame, local: DataFrame, verify: bool = False) -> DataFrame:
    """Adds ``action`` to ``plan`` (digest, size): reuse what is there in full size; fetch what isn't; with ``verify``,
    refetch what is there (digest, length, content) but hasn't its digest."""
    held = local.groupBy("digest").agg(F.min(F.struct("length", "content")).alias("_b")) if verify else local.groupBy("digest").agg(F.struct(F.min("length").alias("length")).alias("_b"))
    rows = plan.join(held, "digest", "left")
    bad = digest_error(F.col("_b.content"), F.col("digest")).isNotNull() if verify else F.lit(False)
    action = F.when(F.coalesce(F.col("_b.length") != F.col("size"), F.lit(True)), "fetch").when(bad, "refetch").otherwise("reuse")
    return rows.withColumn("action", action).drop("_b")


def read_from(blobs: DataFrame, offset: Column) -> DataFrame:
    """``blobs`` (digest, length, content) with ``rest``: the bytes from ``offset`` on, and ``error`` if the blob is
    missing or the offset lies outside it; ``length`` stays the whole blob's."""
    error = F.when(F.col("length").isNull(), "missing blob").when((offset < 0) | (offset > F.col("length")), "offset outside the blob")
    return blobs.withColumn("rest", F.when(error.isNull(), F.substring(F.col("content"), (offset + 1).cast("int"), F.lit(2147483647)))).withColumn("error", error)


def chunks_from(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``digest, idx, skip, length``: the chunk objects (digest, idx, length) to read of each wanted blob (digest,
    offset), and how many bytes of the first to skip."""
    before = F.coalesce(F.sum("length").over(W.partitionBy("digest").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = chunks.withColumn("_at", before).join(wanted, "digest")
    left = F.greatest(F.col("offset") - F.col("_at"), F.lit(0))
    rows = rows.where(F.col("_at") + F.col("length") > F.col("offset"))
    return rows.select("digest", "idx", left.cast("bigint").alias("skip"), (F.col("length") - left).cast("bigint").alias("length"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, which ``spark.checkpoint.dir`` names; only a session on one machine may
    lack that, and gets a temporary one."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tallyport-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """``df`` worked out once, and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def slices(batches, rows: int = 256):
    """Arrow's batches in small parts, so that few contents are Python values at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def write_blobs(pieces: DataFrame, root: str, verify: bool = True, tasks: int | None = None) -> DataFrame:
    """Writes blobs into the pool under ``root`` and returns ``digest, status, length``; an action writes.

    ``pieces`` (digest, size, idx, content) are a blob's consecutive parts, so that a blob may be larger than a row; of
    pieces with one place the first counts. A
    blob is one task's: its parts, sorted, go to a part file named by digest and attempt; then size and, with
    ``verify``, hash decide, and only a right blob is renamed into place. Part files lie in a folder of ``PARTS`` that few
    tasks share: in the pool's own, which a file system locks for each new name, all tasks would wait for one another. A lost task leaves a part file that nothing
    reads, and its retry starts anew; a blob already there in full size is ``reused``. ``tasks`` bounds how many run.

    ``root`` must be storage that all executors reach: a local path in tests, any URI that Arrow's file systems take.
    """

    def run(batches):
        from uuid import uuid4

        from pyarrow import fs

        store, base = file_system(root)
        made, aside = set(), f"{PARTS}/{uuid4().hex[:2]}"
        now = last = None  # digest, size, hash, bytes so far, part file, stream; the last piece's place

        def done():
            digest, size, h, n, part, out, status = now
            algo, hex_ = digest.split(":", 1)
            final = f"{base}/share/{algo}/{hex_}"
            if out is not None:
                out.close()
                status = "wrong size" if n != size else "digest mismatch" if verify and h.hexdigest() != hex_ else "sent"
                put_in_place(store, part, final) if status == "sent" else store.delete_file(part)
            return digest, status, n if status == "sent" else 0

        def begin(digest, size):
            algo, hex_ = (digest or "").split(":", 1) if ":" in (digest or "") else ("", "")
            if algo not in ("sha256", "sha384", "sha512") or len(hex_) != 2 * hashlib.new(algo).digest_size or set(hex_) - set("0123456789abcdef"):
                return digest, size, None, 0, None, None, "malformed digest"
            final = f"{base}/share/{algo}/{hex_}"
            info = store.get_file_info(final)
            if info.type == fs.FileType.File and info.size == size:
                return digest, size, None, 0, None, None, "reused"
            if algo not in made:
                store.create_dir(f"{base}/share/{algo}/{aside}", recursive=True)
                made.add(algo)
            part = f"{base}/share/{algo}/{aside}/{hex_}.{uuid4().hex}.part"
            return digest, size, hashlib.new(algo), 0, part, store.open_output_stream(part), ""

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.string(), pa.int64()))], names=["digest", "status", "length"])

        for batch in slices(batches):
            found = []
            for digest, size, content, idx in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if now is None or digest != now[0]:
                    if now is not None:
                        found.append(done())
                    now, last = begin(digest, size), None
                if idx is not None and idx == last:
                    continue  # another peer's or image's copy of the same piece
                last = idx
                if now[5] is not None and content:
                    now[5].write(content)
                    now[2].update(content)
                    now = (*now[:3], now[3] + len(content), *now[4:])
            if found:
                yield rows(found)
        if now is not None:
            yield rows([done()])

    keyed = pieces.select("digest", F.col("size").cast("bigint").alias("size"), "content", "idx")
    # a number of its own: coalesced to a size of texts, few tasks of many small files would leave cores without work
    dealt = keyed.repartition(tasks or most_tasks(pieces.sparkSession), "digest")
    return dealt.sortWithinPartitions("digest", "idx").select("digest", "size", "content", "idx").mapInArrow(run, "digest string, status string, length bigint")


def write_objects(objects: DataFrame, root: str) -> DataFrame:
    """Writes small objects (name, content) under ``root``, each in one move, and returns ``name, length``: chunks of a
    file server, metadata, tag files. The last move wins; a retry writes the same bytes."""

    def run(batches):
        from uuid import uuid4

        store, base = file_system(root)
        made = None  # the last folder
        for batch in slices(batches):
            names, contents = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name, content in zip(names, contents):
                if any(x in ("", ".", "..") for x in name.split("/")):
                    raise ValueError(f"bad object name {name!r}")
                at = f"{base}/{name}"
                if (above := at.rsplit("/", 1)[0]) != made:
                    store.create_dir(above, recursive=True)
                    made = above
                with store.open_output_stream(part := f"{at}.{uuid4().hex}.part") as out:
                    out.write(content)
                store.move(part, at)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(list(map(len, contents)), pa.int64())], names=["name", "length"])

    return objects.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(run, "name string, length bigint")


def missing_chunks(wanted: DataFrame, there: DataFrame) -> DataFrame:
    """The chunk objects (name, len) to send: those that aren't there in their size (name, length)."""
    return wanted.join(there.select("name", F.col("length").alias("len")), ["name", "len"], "left_anti")


def outcomes(plan: DataFrame, refs: DataFrame, done: DataFrame) -> DataFrame:
    """``ref, sent, reused, bytes, error`` from what became of each blob (digest, first, status); every image of the plan
    and of ``refs`` has a row."""
    rows = plan.groupBy("ref", "digest").agg(F.max("size").alias("size")).join(done, "digest", "left")
    sent = F.coalesce((F.col("status") == "sent") & (F.col("ref") == F.col("first")), F.lit(False))
    bad = ~F.coalesce(F.col("status").isin("sent", "reused"), F.lit(False))
    total = lambda c: F.sum(c).cast("bigint")
    why = F.min(F.when(bad, F.concat("digest", F.lit(": "), F.coalesce("status", F.lit("no such blob")))))
    per = rows.groupBy("ref").agg(total(sent.cast("int")).alias("sent"), total((~sent & ~bad).cast("int")).alias("reused"), total(F.when(sent, F.col("size")).otherwise(0)).alias("bytes"), why.alias("error"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return plan.select("ref").union(refs.select("ref")).distinct().join(per, "ref", "left").select("ref", zero("sent"), zero("reused"), zero("bytes"), "error")


def transfer_images(plan: DataFrame, pieces: DataFrame, pointers: DataFrame, root: str, tasks: int | None = None, verify: bool = True) -> DataFrame:
    """Runs a transfer whose blobs come as rows: blobs first, and then the tag files of the images that miss none.
    Returns ``ref, sent, reused, bytes, error``. Between stores that tasks can open themselves,
    :func:`tallyport.operators.moving.transfer_store` moves no bytes that are there already.

    ``plan``: (ref, digest, size); ``pieces``: the blobs' parts (digest, size, idx, content); ``pointers``: (ref, name,
    content, step), written step by step. A blob of several images is written once and counts as sent for the first
    of them (by ref). An image with tag files and no blobs is committed too. What was committed stays if another image
    fails; running again sends what is missing.
    """
    need = plan.select("ref", "digest", "size").distinct()
    asked = pieces.join(need.select("digest").distinct(), "digest", "left_semi")
    got = settled(write_blobs(asked, root, verify, tasks))
    first = need.groupBy("digest").agg(F.min("ref").alias("first"))
    report = settled(outcomes(need, pointers, first.join(got.select("digest", "status"), "digest", "left")))
    ready = pointers.join(report.where("error is null").select("ref"), "ref", "left_semi")
    for step in sorted(r.step for r in ready.select("step").distinct().collect()):
        write_objects(ready.where(F.col("step") == step), root).count()
    return report
