"""Readers of image stores on any storage that Arrow's file systems take, and of engines' image listings."""

from __future__ import annotations

import json
import os
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyport.functions.text import parse_dump_dir

MARKERS, POOL = ("_tags", "_digests"), "share"
TAG_FILES = ("index.json", "oci-layout")
#: The folder in a pool for blobs that are being written, in at most 256 folders of its own; readers don't see it.
PARTS = ".parts"
#: What a configuration layer may give; what it doesn't is null.
CONFIG = "struct<local:string,localDumpDir:string,compression:struct<format:string,level:int,force:boolean>,fileServer:struct<auth:string,headers:array<string>,chunkSize:string,namingPrefix:string>>"


def file_system(root: str):
    """The Arrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if "://" not in root and not root.startswith("file:"):
        return fs.LocalFileSystem(), root
    return fs.FileSystem.from_uri(root if "://" in root else root.replace("file:", "file://", 1))


def put_in_place(store, part: str, final: str) -> None:
    """Gives a file that was written in another folder its final name. A local file system renames between folders for one
    task at a time, so there the file gets its name by a link, and loses the other one."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        try:
            os.link(part, final)
        except OSError:  # something lies there, which a move replaces, or the storage has no links
            pass
        else:
            os.unlink(part)
            return
    store.move(part, final)


def names(store, base: str):
    """``(name, whether it is a directory)`` of what lies in a directory, in any order; none if there is no such directory.
    A local one is read as a stream, since a pool or a repository may hold millions."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        try:
            with os.scandir(base) as found:
                yield from ((x.name, x.is_dir()) for x in found)
        except FileNotFoundError:
            return
    else:
        for i in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            yield i.base_name, i.type == fs.FileType.Directory


def children(store, base: str) -> list[tuple[str, bool]]:
    return sorted(names(store, base))


def _level(store, base: str, at: str):
    """``(path, open)`` of what lies in a directory: dump directories (those under a marker), and those still to look into."""
    for name, is_dir in names(store, f"{base}/{at}" if at else base):
        path = f"{at}/{name}" if at else name
        if is_dir and name in MARKERS:
            yield from ((f"{path}/{leaf}", False) for leaf, leaf_dir in names(store, f"{base}/{path}") if leaf_dir)
        elif is_dir and (at or name != POOL):
            yield path, True


def walk_dumps(root: str) -> list[str]:
    """Dump directories under a store's root, relative to it; a missing root has none. For stores that one machine
    reads; :func:`list_dumps` deals the work out."""
    store, base = file_system(root)
    found, left = [], [""]
    while left:
        level = [x for at in left for x in _level(store, base, at)]
        found += [path for path, still in level if not still]
        left = [path for path, still in level if still]
    return found


def walk(spark: SparkSession, root: str, level=_level, start: str = "") -> DataFrame:
    """``path``: what ``level`` (file system, root, directory -> paths, and whether each is to be looked into) finds under
    a root, breadth first.

    A round is a job over the open directories, dealt out anew each time, so one wide repository is as well spread as
    many small ones; rounds end when no directory is open. The rows found are dealt over all cores.
    """
    from tallyport.operators.execution import settled

    def run(batches):
        store, base = file_system(root)
        for batch in batches:
            for at in batch.column(0).to_pylist():
                found = iter(level(store, base, at))
                while some := list(islice(found, 10_000)):
                    path, still = zip(*some)
                    yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(still, pa.bool_())], names=["path", "open"])

    cores = spark.sparkContext.defaultParallelism
    rounds, left, n, found = [], spark.createDataFrame([(start,)], "path string"), 1, 0
    while n:
        got = settled(left.repartition(min(n, 8 * cores)).mapInArrow(run, "path string, open boolean"))
        rounds.append(got.where(~F.col("open")).select("path"))
        left = got.where("open").select("path")
        n, more = got.agg(F.count_if("open"), F.count_if(~F.col("open"))).first()
        found += more
    return reduce(DataFrame.unionAll, rounds).repartition(max(1, min(8 * cores, found // 16)))


def _third_level(store, base: str, at: str):
    """What lies in a directory; directories down to the third level are opened."""
    for name, is_dir in names(store, f"{base}/{at}" if at else base):
        path = f"{at}/{name}" if at else name
        yield path, is_dir and path.count("/") < 2


def remove_folder(spark: SparkSession, root: str) -> None:
    """Deletes a folder and all that lies in it: tasks look for what lies on its third level, which they then share. For folders
    that a job made for itself; a missing one is no error."""
    from pyarrow import fs

    def run(batches):
        own, base = file_system(root)
        for batch in batches:
            for i in own.get_file_info([f"{base}/{path}" for path in batch.column(0).to_pylist()]):
                if i.type == fs.FileType.Directory:
                    own.delete_dir(i.path)
                elif i.type != fs.FileType.NotFound:
                    own.delete_file(i.path)
            yield batch

    walk(spark, root, _third_level).mapInArrow(run, "path string").count()
    own, base = file_system(root)
    if own.get_file_info(base).type == fs.FileType.Directory:
        own.delete_dir(base)


def list_dumps(spark: SparkSession, root: str) -> DataFrame:
    """``dump``: the same as rows, looked for by tasks. Spark's own listing hides names with a leading underscore, as the
    markers have."""
    return walk(spark, root).select(F.col("path").alias("dump"))


def read_dumps(spark: SparkSession, root: str, store: str = "local", dumps: DataFrame | None = None) -> DataFrame:
    """``store, ref, index_raw, layout_raw``: the tag files' bytes as they are, read by tasks; null where one is missing.
    ``dumps``: what :func:`list_dumps` has found, if that is known already."""

    def run(batches):
        own, base = file_system(root)

        def raw(path):
            try:
                with own.open_input_stream(path) as f:
                    return f.read()
            except FileNotFoundError:
                return None

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.column(0).slice(at, 256)
                files = [pa.array([raw(f"{base}/{d}/{name}") for d in part.to_pylist()], pa.binary()) for name in TAG_FILES]
                yield pa.RecordBatch.from_arrays([pa.array([store] * len(part)), part, *files], names=["store", "ref", "index_raw", "layout_raw"])

    return (list_dumps(spark, root) if dumps is None else dumps.select("dump")).mapInArrow(run, "store string, ref string, index_raw binary, layout_raw binary")


def list_images(dumps: DataFrame) -> DataFrame:
    """``dump, ref, error`` of dump directories (dump): the canonical reference of each, or why its name is none."""
    rows = dumps.select("dump", parse_dump_dir(F.col("dump")).alias("d"))
    tail = F.when(F.col("d.marker") == "_tags", F.concat(F.lit(":"), F.col("d.leaf"))).otherwise(F.concat(F.lit("@sha256:"), F.col("d.leaf")))
    return rows.select("dump", F.concat("d.host", F.lit("/"), "d.repo", tail).alias("ref"), F.col("d.error").alias("error"))


#: Bytes of the largest blob that becomes a value of one row. Larger ones are streamed, never read whole.
LARGEST_VALUE = 1 << 30


def _pool_level(store, base: str, at: str):
    yield from ((f"{at}/{name}", False) for name, is_dir in names(store, f"{base}/{at}") if not is_dir and name[:1] not in "._")


def list_files(spark: SparkSession, root: str, folder: str) -> DataFrame:
    """``name, length`` of the files in a folder: one task streams the names, and tasks look their sizes up."""
    from tallyport.operators.execution import settled

    def run(batches):
        from pyarrow import fs

        own, base = file_system(root)
        for batch in batches:
            paths = batch.column(0).to_pylist()
            got = [(p.rsplit("/", 1)[1], i.size) for p, i in zip(paths, own.get_file_info([f"{base}/{p}" for p in paths])) if i.type == fs.FileType.File]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.int64())], names=["name", "length"])

    return settled(walk(spark, root, _pool_level, folder).mapInArrow(run, "name string, length bigint"))


def read_pool(spark: SparkSession, root: str, store: str = "local", content: bool = True, folder: str = POOL, algo: str = "sha256", strict: bool = False) -> DataFrame:
    """``store, digest, length, content`` of a blob pool: names of the digest's length, so no part files.

    ``folder`` is share for a shared pool, or blobs for a plain image directory; ``strict`` takes hex names only.
    Without ``content`` only names and sizes are read, and ``path`` is in its place: :func:`fetch_files` opens what is
    still wanted of the rows then.
    """
    if content:
        own, base = file_system(f"{root}/{folder}/{algo}")
        if next(names(own, base), None) is None:
            return spark.createDataFrame([], "store string, digest string, length bigint, content binary")
        files = spark.read.format("binaryFile").load(f"{root}/{folder}/{algo}")
        files = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    else:
        files = list_files(spark, root, f"{folder}/{algo}")
    rows = files.where(F.length("name") == {"sha256": 64, "sha384": 96, "sha512": 128}[algo])
    rows = rows.where(F.col("name").rlike("^[0-9a-f]+$")) if strict else rows
    body = F.col("content") if content else F.concat(F.lit(f"{root}/{folder}/{algo}/"), "name").alias("path")
    return rows.select(F.lit(store).alias("store"), F.concat(F.lit(f"{algo}:"), "name").alias("digest"), "length", body)


def fetch_files(rows: DataFrame, most: int = LARGEST_VALUE) -> DataFrame:
    """``rows`` (store, digest, length, path) with ``content`` and ``error`` in place of the path: the files are opened by
    tasks. One that is gone, or longer than a value may be, is a row with its error."""

    def read(path, length):
        if length > most:
            return None, "blob too large"
        own, at = file_system(path)
        try:
            with own.open_input_stream(at) as f:
                return f.read(), None
        except FileNotFoundError:
            return None, "missing blob"

    def run(batches):
        for batch in batches:
            size, at = 0, 0
            lengths, paths = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            got = []
            for i, (path, length) in enumerate(zip(paths, lengths)):
                got.append(read(path, length))
                size += length
                if size >= 1 << 24 or i + 1 == batch.num_rows:  # a few large values a batch, or many small ones
                    body, why = zip(*got)
                    part = batch.slice(at, len(got))
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(body, pa.binary()), pa.array(why, pa.string())], names=["store", "digest", "length", "content", "error"])
                    size, at, got = 0, i + 1, []

    return rows.select("store", "digest", "length", "path").mapInArrow(run, "store string, digest string, length bigint, content binary, error string")


def read_image_dir(spark: SparkSession, root: str, store: str = "dir", algo: str = "sha256") -> tuple[DataFrame, DataFrame]:
    """``(dumps, blobs)`` of a plain image directory, which holds one image: its tag files at the top, its blobs under
    ``blobs``. Its reference is the directory's path; blobs are names, sizes and paths."""
    own, base = file_system(root)

    def raw(name):
        try:
            with own.open_input_stream(f"{base}/{name}") as f:
                return f.read()
        except FileNotFoundError:
            return None

    dumps = spark.createDataFrame([(store, root, *map(raw, TAG_FILES))], "store string, ref string, index_raw binary, layout_raw binary")
    return dumps, read_pool(spark, root, store, content=False, folder="blobs", algo=algo)


def _listed(rows: DataFrame, ref: Column, keep: Column) -> DataFrame:
    """``ref, pos``: each name once, at its first place."""
    return rows.select(ref.alias("ref"), "pos").where(F.coalesce(keep, F.lit(False))).groupBy("ref").agg(F.min("pos").alias("pos"))


def docker_refs(rows: DataFrame) -> DataFrame:
    """``ref, pos`` of listed images (pos, Repository, Tag): those with both parts, each once."""
    some = lambda c: ~F.coalesce(F.col(c), F.lit("")).isin("", "<none>")
    return _listed(rows.where(some("Repository") & some("Tag")), F.concat_ws(":", "Repository", "Tag"), F.lit(True))


def podman_refs(rows: DataFrame) -> DataFrame:
    """``ref, pos`` of listed images (pos, Names): every name, each once; ``pos`` is the image's place and the name's."""
    names = rows.select(F.col("pos").alias("row"), F.posexplode(F.coalesce("Names", F.array().cast("array<string>"))).alias("n", "ref"))
    return _listed(names.withColumn("pos", F.struct("row", "n")), F.col("ref"), F.col("ref") != "")


def inspect_refs(rows: DataFrame) -> DataFrame:
    """``ref, pos`` of inspected images (pos, RepoTags), each once."""
    tags = rows.select(F.col("pos").alias("row"), F.posexplode(F.coalesce("RepoTags", F.array().cast("array<string>"))).alias("n", "ref"))
    return _listed(tags.withColumn("pos", F.struct("row", "n")), F.col("ref"), ~F.col("ref").isin("", "<none>:<none>"))


def _listing(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """The JSON objects of a listing with their places: a sequence of objects, whatever lies between them, or one array; a
    malformed one fails the job. Objects are split in a task as the text streams in, so a listing is no row of its own."""

    def objects(stream):
        decoder, left, done = json.JSONDecoder(), "", False
        import codecs

        text = codecs.getincrementaldecoder("utf-8")()
        opened = lines  # an array's bracket is behind us
        while True:
            while True:
                left = left.lstrip(" \t\r\n" if lines else " \t\r\n,")
                if not opened and left.startswith("["):
                    left, opened = left[1:], True
                    continue
                if not left or (not lines and left.startswith("]")):
                    break
                try:
                    _, end = decoder.raw_decode(left)
                except ValueError:
                    if done:
                        raise
                    break
                yield left[:end]
                left = left[end:]
            if done:
                if (lines and left) or (not lines and left.strip() != "]"):
                    raise ValueError("malformed listing")
                return
            block = stream.read(1 << 16)
            done = not block
            left += text.decode(block, final=done)

    def run(batches):
        own, at = file_system(path)
        for _ in batches:
            with own.open_input_stream(at) as f:
                for pos, raw in enumerate(objects(f)):
                    yield pa.RecordBatch.from_arrays([pa.array([pos], pa.int64()), pa.array([raw], pa.string())], names=["pos", "raw"])

    raw = spark.range(1).mapInArrow(run, "pos bigint, raw string")
    return raw.select("pos", F.from_json("raw", schema, {"mode": "FAILFAST"}).alias("x")).select("pos", "x.*")


def read_docker_images(spark: SparkSession, path: str) -> DataFrame:
    """``ref, pos`` of a docker ``image ls`` listing (JSON objects behind each other, on one line or many), in its order."""
    return docker_refs(_listing(spark, path, "Repository string, Tag string", True))


def read_podman_images(spark: SparkSession, path: str) -> DataFrame:
    """``ref, pos`` of a podman listing (one JSON array), in its order."""
    return podman_refs(_listing(spark, path, "Id string, Names array<string>", False))


def read_image_inspect(spark: SparkSession, path: str) -> DataFrame:
    """``ref, pos`` of a docker ``image inspect`` array."""
    return inspect_refs(_listing(spark, path, "Id string, RepoTags array<string>", False))


def config_layer(raw: Column) -> Column:
    """A configuration layer from its JSON; null text is a layer that gives nothing, malformed text fails the job."""
    return F.from_json(F.coalesce(raw, F.lit("{}")), CONFIG, {"mode": "FAILFAST"})


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """One row ``config`` from a file; a missing file gives nothing."""
    own, base = file_system(path)
    try:
        with own.open_input_stream(base) as f:
            raw = f.read().decode()
    except FileNotFoundError:
        raw = None
    return spark.createDataFrame([(raw,)], "raw string").select(config_layer(F.col("raw")).alias("config"))


def ensure_layout(root: str) -> None:
    """Makes a store's folders; they may be there."""
    store, base = file_system(root)
    store.create_dir(f"{base}/{POOL}", recursive=True)


def write_pointer(root: str, dump_dir: str, name: str, raw: bytes) -> None:
    """Commits one tag file: written beside the tree, then moved into place."""
    from uuid import uuid4

    store, base = file_system(root)
    store.create_dir(f"{base}/__temp__", recursive=True)
    store.create_dir(f"{base}/{dump_dir}", recursive=True)
    part = f"{base}/__temp__/{uuid4().hex}.{name}"
    with store.open_output_stream(part) as f:
        f.write(raw)
    store.move(part, f"{base}/{dump_dir}/{name}")
