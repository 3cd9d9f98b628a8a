"""Image layouts, indexes, manifests and file-server metadata: parse, validate, flatten."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyport.functions import documents as doc
from tallyport.functions.text import digest_error, packed_digest, split_digest, unpacked_digest
from tallyport.operators.execution import settled
from tallyport.sources.store import fetch_files

_DESC = "struct<mediaType:string,digest:string,size:bigint>"
#: Media types of indexes, which can't stand where a manifest is expected.
NESTED = ("application/vnd.oci.image.index.v1+json", "application/vnd.docker.distribution.manifest.list.v2+json")


def _empty(raw: Column) -> Column:
    return F.coalesce(F.octet_length(raw), F.lit(0)) == 0


_FIELDS = ("mediaType", "digest", "size", "artifactType", "annotations", "urls", "data", "platform")
_PLATFORM = ("architecture", "os")
_NAMES = ("schemaVersion", "config", "layers", "manifests", "imageLayoutVersion", *_FIELDS, *_PLATFORM)


def _descriptor(value: Column) -> Column:
    """``struct<value, ok>`` of a descriptor; null is one without anything."""

    def made(v: Column) -> Column:
        texts = [doc.fits(v[n], "STRING") for n in ("mediaType", "digest", "artifactType", "data")]
        platform = doc.is_null(v["platform"]) | F.coalesce(doc.let(doc.opened(v["platform"], _PLATFORM), lambda p: doc.fits(p["architecture"], "STRING") & doc.fits(p["os"], "STRING")), F.lit(False))
        ok = reduce(Column.__and__, texts) & doc.fits(v["size"], "BIGINT") & doc.texts_fit(v["annotations"]) & doc.all_fit(doc.elements(v["urls"]), "STRING") & platform
        got = F.struct(doc.text_of(v["mediaType"]).alias("mediaType"), doc.text_of(v["digest"]).alias("digest"), doc.count_of(v["size"]).alias("size"))
        return F.struct(got.alias("value"), (doc.is_null(value) | (v.isNotNull() & ok)).alias("ok"))

    return doc.let(doc.opened(value, _FIELDS), made)


def _descriptors(value: Column) -> Column:
    """``struct<value, ok>`` of a list of descriptors."""
    got = lambda x: F.struct(F.transform(x, lambda d: d["value"]).alias("value"), F.coalesce(F.forall(x, lambda d: d["ok"]), F.lit(False)).alias("ok"))
    return doc.let(F.transform(doc.elements(value), _descriptor), got)


def _parsed(raw: Column, empty: str, names: tuple[str, ...], value, error, canonical: bool = True) -> Column:
    """``struct<value, error>`` of a document: ``value`` (its members as a struct of VARIANTs -> ``struct<value, ok>``);
    ``error`` looks at the value. An empty text, bad JSON and a wrong type come before."""

    def told(x: Column) -> Column:
        why = F.when(~F.coalesce(x["ok"], F.lit(False)), "bad type").otherwise(error(x["value"]))
        return F.struct(F.when(x["ok"], x["value"]).alias("value"), why.alias("error"))

    def whole(v: Column) -> Column:
        why = lambda f: F.when(_empty(raw), empty).when(v.isNull(), "bad json").otherwise(f["error"])
        found = doc.let(doc.let(doc.opened(v, names, "$[0]"), value), told)
        return doc.let(found, lambda f: F.struct(f["value"].alias("value"), why(f).alias("error")))

    return doc.let(doc.enclosed(doc.canonical(raw, _NAMES) if canonical else raw.cast("string")), whole)


def parse_index(raw: Column) -> Column:
    """``struct<value, error>`` of index bytes: empty, bad JSON, a wrong type and an empty list are errors."""

    def value(m: Column) -> Column:
        plain = doc.fits(m["schemaVersion"], "BIGINT") & doc.fits(m["mediaType"], "STRING")
        got = lambda d: F.struct(F.struct(doc.count_of(m["schemaVersion"]).alias("schemaVersion"), doc.text_of(m["mediaType"]).alias("mediaType"), d["value"].alias("manifests")).alias("value"), (m.isNotNull() & plain & d["ok"]).alias("ok"))
        return doc.let(_descriptors(m["manifests"]), got)

    return _parsed(raw, "empty index", ("schemaVersion", "mediaType", "manifests"), value, lambda v: F.when(F.size(v["manifests"]) == 0, "no manifests"))


def parse_manifest(raw: Column) -> Column:
    """``struct<value, error>``: a wrong type, an index in a manifest's place and a missing config digest are errors; no
    layers is fine."""

    def value(m: Column) -> Column:
        plain = doc.fits(m["schemaVersion"], "BIGINT") & doc.fits(m["mediaType"], "STRING")

        def got(d: Column) -> Column:
            fields = (doc.count_of(m["schemaVersion"]).alias("schemaVersion"), doc.text_of(m["mediaType"]).alias("mediaType"), d["config"]["value"].alias("config"), d["layers"]["value"].alias("layers"), F.size(d["listed"]).alias("listed"))
            return F.struct(F.struct(*fields).alias("value"), (m.isNotNull() & plain & d["config"]["ok"] & d["layers"]["ok"]).alias("ok"))

        return doc.let(F.struct(_descriptor(m["config"]).alias("config"), _descriptors(m["layers"]).alias("layers"), doc.elements(m["manifests"]).alias("listed")), got)

    nested = lambda v: v["mediaType"].isin(*NESTED) | ((v["listed"] > 0) & (v["mediaType"] == ""))
    return _parsed(raw, "empty manifest", ("schemaVersion", "mediaType", "config", "layers", "manifests"), value, lambda v: F.when(nested(v), "index in place of a manifest").when(v["config"]["digest"] == "", "missing config digest"))


def _with_parsed(rows: DataFrame, parsed: Column, out: str) -> DataFrame:
    """``rows`` with ``out``: a parsed document, behind a generator, which the optimizer doesn't merge with what uses its
    fields: each document is parsed once, not once a field."""
    return rows.withColumn(out, F.explode(F.array(parsed)))


def parse_layout(raw: Column) -> Column:
    got = lambda m: F.struct(F.struct(doc.text_of(m["imageLayoutVersion"]).alias("imageLayoutVersion")).alias("value"), (m.isNotNull() & doc.fits(m["imageLayoutVersion"], "STRING")).alias("ok"))
    return _parsed(raw, "empty layout", ("imageLayoutVersion",), got, lambda v: F.when(v["imageLayoutVersion"] == "", "no layout version"))


def parse_meta(raw: Column) -> Column:
    """File-server metadata: version 1, a positive chunk size and both halves, which are given as JSON text;
    descriptors' digests aren't checked. Its names count in their own case alone, since the halves stay as they are."""

    def value(m: Column) -> Column:
        half = lambda n: F.coalesce(F.to_json(m[n]), F.lit("")).alias(n)

        def got(d: Column) -> Column:
            listed = F.transform(d["value"], lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size")))
            fields = F.struct(doc.count_of(m["version"]).alias("version"), doc.count_of(m["chunkSize"]).alias("chunkSize"), half("ociLayout"), half("indexJSON"), listed.alias("descriptors"))
            return F.struct(fields.alias("value"), (m.isNotNull() & doc.fits(m["version"], "BIGINT") & doc.fits(m["chunkSize"], "BIGINT") & d["ok"]).alias("ok"))

        return doc.let(_descriptors(m["descriptors"]), got)

    error = lambda v: (
        F.when(v["version"] != 1, "bad version").when(v["chunkSize"] <= 0, "bad chunk size").when(v["ociLayout"] == "", "no layout").when(v["indexJSON"] == "", "no index")
    )
    return _parsed(raw, "bad json", ("version", "chunkSize", "ociLayout", "indexJSON", "descriptors"), value, error, canonical=False)


def single_manifest_class(index: Column) -> Column:
    """OK, or why an index isn't of exactly one plain manifest; checked in this order."""
    m = index["manifests"]
    return (
        F.when(F.coalesce(F.size(m), F.lit(0)) <= 0, "EMPTY").when(F.size(m) > 1, "MULTI")
        .when(F.get(m, F.lit(0))["mediaType"].isin(*NESTED), "NESTED").when(F.coalesce(F.get(m, F.lit(0))["digest"], F.lit("")) == "", "NO_DIGEST").otherwise("OK")
    )


@dataclass(frozen=True)
class Made:
    """Blobs whose contents follow from narrower columns: ``rows`` (store, digest, length, and those columns) and the
    ``content`` made of them. It is made where it is used, so no shuffle or stage holds it. Of rows with one digest the
    shortest counts, then the least of those columns."""

    rows: DataFrame
    content: Column


def one_per_digest(blobs: DataFrame) -> DataFrame:
    """One row per store and digest, the shortest blob (then the least content): a digest names one blob."""
    rest = [c for c in ("length", "content", "path") if c in blobs.columns]
    length, *body = rest
    # an aggregate of its own for the length: who asks for no more shuffles no content
    return blobs.groupBy("store", "digest").agg(F.min(length).alias(length), *[F.min(F.struct(*rest))[c].alias(c) for c in body])


def named_blobs(blobs: DataFrame, named: DataFrame) -> DataFrame:
    """``store, digest, length, content, error`` of the blobs that ``named`` (store, digest) asks for.

    ``blobs`` holds contents, or only names, sizes and paths (``read_pool`` without content): then the named files alone
    are opened, by tasks, once it is known which they are, however large the others may be. It may also be a function
    that returns the blobs of the rows it is given, which reads no others.
    """
    if callable(blobs):
        blobs = blobs(named.select("store", "digest").distinct())
    found = one_per_digest(blobs.join(named.select("store", "digest").distinct(), ["store", "digest"], "left_semi"))
    if "path" in found.columns:
        return fetch_files(found)
    return found.withColumn("error", F.lit(None).cast("string"))


def read_manifests(dumps: DataFrame, blobs: DataFrame | Made, keep: tuple[str, ...] = (), made: dict[str, Column] | None = None) -> DataFrame:
    """``store, ref, manifest_digest, manifest_size, raw, m, error`` for each dump (store, ref, index_raw), and the
    dumps' columns in ``keep``. ``made``: columns that follow from those and from the manifest's digest, by name; they are made
    behind the join with the blobs, whose shuffle needn't hold them.

    The index must hold one plain manifest; its blob must exist in the store, have its digest, and parse. An
    unreadable image is a row with its error, so one bad image never stops the others. ``blobs`` as in
    :func:`named_blobs`, of the pool only the manifests are read; or :class:`Made`.
    """
    idx = _with_parsed(dumps.select("store", "ref", "index_raw", *keep), parse_index(F.col("index_raw")), "i")
    idx = idx.select("store", "ref", *keep, "i.error", single_manifest_class(F.col("i.value")).alias("class"), F.get("i.value.manifests", F.lit(0)).alias("d"))
    index_error = F.coalesce("error", F.when(F.col("class") != "OK", F.lower("class")))
    idx = idx.select("store", "ref", *keep, index_error.alias("index_error"), F.when(index_error.isNull(), F.col("d.digest")).alias("digest"))
    content = F.col("content")
    if isinstance(blobs, Made):
        rest = [c for c in blobs.rows.columns if c not in ("store", "digest", "length")]
        rows = blobs.rows.select("store", packed_digest(F.col("digest")).alias("_key"), F.struct("length", *rest).alias("_b"))
        pool = rows.groupBy("store", "_key").agg(F.min("_b").alias("_b")).select("store", "_key", "_b.*", F.lit(None).cast("string").alias("read_error"))
        content = blobs.content
    else:
        if callable(blobs) or "path" in blobs.columns:
            idx = settled(idx)  # both the files to open and the rows to join come of it
            pool = named_blobs(blobs, idx.where("digest is not null"))
        else:
            pool = one_per_digest(blobs).withColumn("error", F.lit(None).cast("string"))
        pool = pool.select("store", packed_digest(F.col("digest")).alias("_key"), "content", "length", F.col("error").alias("read_error"))
    # the dumps' own columns are aside, since the pool's may be called as they are
    idx = idx.select("store", "ref", F.struct(*keep).alias("_kept") if keep else F.lit(None).alias("_kept"), "index_error", packed_digest(F.col("digest")).alias("_key"))
    got = idx.withColumnRenamed("ref", "_ref").join(pool, ["store", "_key"], "left")
    got = got.select("store", "_ref", "_kept", "index_error", "read_error", unpacked_digest(F.col("_key")).alias("manifest_digest"), F.col("length").alias("manifest_size"), F.when(F.col("length").isNotNull(), content).alias("raw"))
    got = got.select(F.col("store"), F.col("_ref").alias("ref"), *[F.col("_kept")[c].alias(c) for c in keep], *got.columns[3:])
    got = _with_parsed(got, parse_manifest(F.col("raw")), "p")
    error = F.coalesce("index_error", "read_error", F.when(F.col("raw").isNull(), "missing manifest blob"), digest_error(F.col("raw"), F.col("manifest_digest")), "p.error")
    more = [c.alias(n) for n, c in (made or {}).items()]
    return got.select("store", "ref", *keep, *more, "manifest_digest", "manifest_size", "raw", F.when(error.isNull(), F.col("p.value")).alias("m"), error.alias("error"))


def closure(manifests: DataFrame) -> DataFrame:
    """``store, ref, ordinal, role, digest, size``: manifest, config and layers in order, repeats kept."""
    d = lambda role, digest, size: F.struct(F.lit(role).alias("role"), digest.alias("digest"), size.alias("size"))
    head = F.array(d("manifest", F.col("manifest_digest"), F.col("manifest_size")), d("config", F.col("m.config.digest"), F.col("m.config.size")))
    layers = F.transform(F.coalesce("m.layers", F.array().cast(f"array<{_DESC}>")), lambda x: d("layer", x["digest"], x["size"]))
    rows = manifests.where("error is null").select("store", "ref", F.posexplode(F.concat(head, layers)).alias("ordinal", "x"))
    return rows.select("store", "ref", "ordinal", "x.role", "x.digest", "x.size")


def descriptors(manifest_digest: Column, manifest_size: Column, manifest: Column) -> Column:
    """``array<struct<digest, size>>`` of a manifest, its config and its layers in order, repeats kept."""
    d = lambda digest, size: F.struct(digest.alias("digest"), size.alias("size"))
    layers = F.transform(F.coalesce(manifest["layers"], F.array().cast(f"array<{_DESC}>")), lambda x: d(x["digest"], x["size"]))
    return F.concat(F.array(d(manifest_digest, manifest_size), d(manifest["config"]["digest"], manifest["config"]["size"])), layers)


def index_descriptor(index: Column, digest: Column) -> Column:
    """The first descriptor of a parsed index that has ``digest``; null if none has."""
    return F.get(F.filter(index["manifests"], lambda m: m["digest"] == digest), F.lit(0))


def image_view(dumps: DataFrame, blobs: DataFrame, wanted: DataFrame, content: bool = True) -> DataFrame:
    """``store, ref, digest, size, content, error`` of the blobs (store, ref, digest) that images are asked for.

    An index names its manifest, whose size it gives; any other digest is a blob of the pool. A digest is one blob,
    however often the pool lists it. Without ``content`` no blob is opened and the column is null.
    """
    idx = _with_parsed(dumps.select("store", "ref", "index_raw"), parse_index(F.col("index_raw")), "i").drop("index_raw")
    if content:
        pool = named_blobs(blobs, wanted)
    else:
        pool = one_per_digest(blobs.drop("content", "path")).withColumns({"content": F.lit(None).cast("binary"), "error": F.lit(None).cast("string")})
    pool = pool.select("store", "digest", "length", "content", F.col("error").alias("read_error"))
    # what an index says of the digest is taken from it here, so that no parsed index goes into the blobs' shuffle
    said = index_descriptor(F.col("i.value"), F.col("digest"))["size"]
    index_error = F.when(F.col("i").isNull(), "no such image").otherwise(F.col("i.error"))
    named = wanted.join(idx, ["store", "ref"], "left").select("store", "ref", "digest", said.alias("_said"), index_error.alias("_index_error"))
    rows = named.join(pool, ["store", "digest"], "left")
    error = F.coalesce("_index_error", F.when(F.col("length").isNull(), "missing blob"), "read_error")
    size = F.coalesce("_said", "length")
    return rows.select("store", "ref", "digest", F.when(error.isNull(), size).alias("size"), F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"))


def blobs_of_images(read, refs: DataFrame) -> DataFrame:
    """``ref, digest, error``: the closure of each asked image (ref). ``read``: what :func:`read_manifests` gives, or a function
    that gives it for the images (ref) that it is given, and reads no others.

    An image that isn't there, or whose manifest blob isn't, has no rows; any other failure is one row with its error.
    """
    refs = refs.select("ref").distinct()
    got = read(refs) if callable(read) else read.join(refs, "ref", "left_semi")
    listed = F.transform(descriptors(F.col("manifest_digest"), F.col("manifest_size"), F.col("m")), lambda x: x["digest"])
    none = F.array(F.lit(None).cast("string"))
    # one generator for both: a union would read all images twice
    return got.select("ref", F.explode(F.when(F.col("error").isNull(), listed).when(F.col("error") != "missing manifest blob", none)).alias("digest"), "error")


def enumerate_store(read: DataFrame, inventory: DataFrame, skipped: bool = False) -> DataFrame:
    """``digest``: what a store has: the closures of all images that can be read, and its pool. With ``skipped``,
    the images that can't be read instead, with their errors."""
    if skipped:
        return read.where("error is not null").select("ref", "error")
    packed = [rows.select(packed_digest(F.col("digest")).alias("_key")) for rows in (closure(read), inventory)]
    return packed[0].unionByName(packed[1]).distinct().select(unpacked_digest(F.col("_key")).alias("digest"))


def enumerate_images(transport: str, read=None, inspected=None, inventory=None) -> DataFrame:
    """The digests of a local store by its transport: an oci store is read (``read``: what :func:`read_manifests`
    gives), an engine's is inspected (``inspected``: ref, raw manifest bytes). Providers are called when needed."""
    if transport == "oci":
        return enumerate_store(read(), inventory())
    if transport not in ("containers-storage", "docker-daemon"):
        raise ValueError(f"{transport} can't be enumerated")
    if inspected is None:
        raise ValueError(f"{transport} needs its images inspected")
    return enumerate_store(inspected_manifests(inspected()), inventory())


def inspected_manifests(images: DataFrame) -> DataFrame:
    """Raw manifests (store, ref, raw) as :func:`read_manifests` returns them; a bad one is a row with its error."""
    got = _with_parsed(images, parse_manifest(F.col("raw")), "p")
    digest, size = F.concat(F.lit("sha256:"), F.sha2("raw", 256)), F.octet_length("raw").cast("bigint")
    error = F.col("p.error")
    return got.select("store", "ref", digest.alias("manifest_digest"), size.alias("manifest_size"), "raw", F.when(error.isNull(), F.col("p.value")).alias("m"), error.alias("error"))


def meta_json(layout_raw: Column, index_raw: Column, chunk: Column, descs: Column) -> Column:
    """``struct<json, error>`` of an image's metadata.

    Both tag files go in as they are, byte for byte, and so must be whole JSON documents themselves; descriptors are
    written by the JSON writer, and each must have a well-formed digest, so that no name can add fields of its own. A
    missing size is written as 0.
    """
    whole = doc.enclosed(layout_raw.cast("string")).isNotNull() & doc.enclosed(index_raw.cast("string")).isNotNull()
    formed = lambda listed: F.forall(listed, lambda d: split_digest(d["digest"])["error"].isNull())
    error = lambda listed: (
        F.when(F.coalesce(chunk, F.lit(0)) <= 0, "bad chunk size").when(_empty(layout_raw), "no layout").when(_empty(index_raw), "no index")
        .when(~F.coalesce(whole, F.lit(False)), "bad json").when(~F.coalesce(formed(listed), F.lit(False)), "malformed digest")
    )

    def made(listed: Column) -> Column:
        items = F.to_json(F.transform(listed, lambda d: F.struct(d["digest"].alias("digest"), F.coalesce(d["size"], F.lit(0)).alias("size"))))
        return F.concat(F.lit('{"version":1,"chunkSize":'), chunk.cast("string"), F.lit(',"ociLayout":'), layout_raw.cast("string"), F.lit(',"indexJSON":'), index_raw.cast("string"), F.lit(',"descriptors":'), items, F.lit("}"))

    return doc.let(descs, lambda listed: doc.let(error(listed), lambda e: F.struct(F.when(e.isNull(), made(listed)).alias("json"), e.alias("error"))))


def commit_metas(dumps: DataFrame, blobs: DataFrame | Made, chunk: int, name: Column, keep: tuple[str, ...] = ("index_raw", "layout_raw"), made: dict[str, Column] | None = None) -> DataFrame:
    """``ref, name, json, error``: the metadata object of each image (store, ref, index_raw, layout_raw), written last. Tag files
    that follow from narrower columns may be ``made`` of those that ``keep`` names; see :func:`read_manifests`.

    The manifest must be there, verified and of a single-image index; then its descriptors are taken from it.
    """
    rows = read_manifests(dumps, blobs, keep, made)
    descs = descriptors(F.col("manifest_digest"), F.col("manifest_size"), F.col("m"))
    made = meta_json(F.col("layout_raw"), F.col("index_raw"), F.lit(chunk).cast("bigint"), descs)
    rows = _with_parsed(rows, F.when(F.col("error").isNull(), made), "_meta")
    error = F.coalesce("error", "_meta.error")
    return rows.select("ref", name.alias("name"), F.when(error.isNull(), F.col("_meta.json")).alias("json"), error.alias("error"))


def meta_blobs(metas: DataFrame) -> DataFrame:
    """``ref, digest, size, chunk_size, error`` from metadata objects (ref, raw): one read gives an image's closure.
    No object, no rows; a broken one is one row with its error."""
    got = metas.where("raw is not null").select("ref", parse_meta(F.col("raw")).alias("p"))
    d = F.explode_outer(F.when(F.col("p.error").isNull(), F.col("p.value.descriptors")))
    rows = got.select("ref", "p", d.alias("d")).where("p.error is not null or d is not null")
    return rows.select("ref", F.col("d.digest").alias("digest"), F.col("d.size").alias("size"), F.when(F.col("p.error").isNull(), F.col("p.value.chunkSize")).alias("chunk_size"), F.col("p.error").alias("error"))


def inspect_image(raw: Column, digest: Column, verify: bool = True) -> Column:
    """``struct<raw, error>``: an image's raw manifest, checked against its digest unless a live engine gave it."""
    error = F.when(raw.isNull(), "missing manifest blob").otherwise(digest_error(raw, digest) if verify else F.lit(None).cast("string"))
    return F.struct(F.when(error.isNull(), raw).alias("raw"), error.alias("error"))


def sizes(descriptors: DataFrame) -> DataFrame:
    """``digest, size``: sizes above zero, the last of a repeated digest."""
    return descriptors.where("size > 0").groupBy("digest").agg(F.max_by("size", "ordinal").alias("size"))
