"""What keeps the queries' cost in proportion to their input: what is shuffled, parsed, listed and opened, and how work is dealt out."""


from pyspark.sql import functions as F

from tallyport.operators import execution, manifests, moving
from tallyport.sources import peers, store

DUMPS, BLOBS = "store string, ref string, index_raw binary", "store string, digest string, length bigint, content binary"


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_index_is_parsed_once(spark):
    read = manifests.read_manifests(spark.createDataFrame([], DUMPS), spark.createDataFrame([], BLOBS).where("length > 0"))
    assert plan_of(read.select("ref", "error")).count("Generate explode") <= 2  # an index and a manifest


def test_a_view_without_contents_aggregates_none(spark):
    blobs = spark.range(1).selectExpr("'s' store", "'d' digest", "id length", "cast(cast(id as string) as binary) content")
    wanted = spark.createDataFrame([("s", "i", "d")], "store string, ref string, digest string")
    dumps = spark.createDataFrame([("s", "i", b'{"manifests":[{"digest":"d","size":7}]}')], DUMPS)
    got = manifests.image_view(dumps, blobs, wanted)
    assert [tuple(r) for r in got.select("size", "error").collect()] == [(7, None)]
    assert "content" not in plan_of(got.select("ref", "digest", "size", "error"))


def test_few_slots_have_a_task_each(spark):
    work = spark.range(1600).select(F.lit("all").alias("ref"), (F.col("id") % 16).cast("int").alias("slot"))
    dealt = moving._dealt_slots(work)
    sizes = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("slot").alias("slots")).collect()
    assert [(r.n, r.slots) for r in sizes] == [(100, 1)] * 16


def test_a_pool_is_listed_in_few_tasks(spark, tmp_path):
    pool = tmp_path / "share/sha256"
    pool.mkdir(parents=True)
    for i in range(300):
        (pool / f"{i:064x}").write_bytes(b"x" * i)
    for name in ("_" * 64, "a" * 64 + ".part", "g" * 64):
        (pool / name).write_bytes(b"?")
    (pool / ("b" * 64)).mkdir()
    got = store.read_pool(spark, str(tmp_path), content=False, strict=True)
    assert got.rdd.getNumPartitions() <= 8 * spark.sparkContext.defaultParallelism  # of 4 MiB a file, as Spark packs them, 30 would fill one
    assert sorted((int(r.digest[7:], 16), r.length) for r in got.collect()) == [(i, i) for i in range(300)]
    assert store.read_pool(spark, str(tmp_path / "none"), content=False).count() == 0


def test_directories_are_read_as_a_stream(tmp_path):
    for i in range(5):
        (tmp_path / f"d{i}").mkdir()
    own, base = store.file_system(str(tmp_path))
    found = store.names(own, base)
    assert iter(found) is found and sorted(found) == [(f"d{i}", True) for i in range(5)]
    assert list(store.names(own, f"{base}/none")) == []


def test_only_named_blobs_of_a_server_are_opened(spark, tmp_path):
    server = peers.ServerPeer(str(tmp_path), chunk=4)
    meta = b'{"version":1,"chunkSize":4,"ociLayout":{"imageLayoutVersion":"1"},"indexJSON":{"manifests":[]},"descriptors":[{"digest":"sha256:%s","size":5},{"digest":"sha256:%s","size":6}]}' % (b"a" * 64, b"b" * 64)
    names = [("images/h/i/_tags/t.json", meta)] + [(f"blobs/sha256/{'a' * 64}/0000000{i}", body) for i, body in enumerate((b"body", b"."))]
    execution.write_objects(spark.createDataFrame(names, "name string, content binary"), str(tmp_path)).count()
    wanted = spark.createDataFrame([("server", "sha256:" + "a" * 64)], "store string, digest string")
    got = manifests.named_blobs(lambda named: server.blobs(spark, wanted=named), wanted).collect()
    assert [(r.digest[7:9], r.length, bytes(r.content)) for r in got] == [("aa", 5, b"body.")]
    assert "left_semi" in plan_of(server.blobs(spark, wanted=wanted)).lower().replace("leftsemi", "left_semi")


def test_push_totals_bound_their_groups(spark):
    """Needed and pinned blobs meet in one aggregate whose tasks aren't coalesced; null keys pin nothing, and what is pinned
    without being needed counts nowhere."""
    rows = lambda x, schema: spark.createDataFrame(x, schema)
    need = rows([("a", "d1", 3), ("a", "d1", 5), ("a", None, 7), ("b", "d1", None)], "ref string, digest string, size long")
    have = rows([("d1",), (None,)], "digest string")
    pinned = rows([("a", "d1"), ("a", None), ("a", "d2"), ("c", "d1")], "ref string, digest string")
    state = rows([("d9", 1)], "digest string, current_size long")
    got = execution.push_totals(need, have, pinned, state)
    assert {tuple(r) for r in got.collect()} == {("a", 2, 0, 12), ("b", 0, 1, 0)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_image_view_shuffles_no_index(spark):
    """The blobs' join gets sizes and errors of the indexes, not the parsed indexes."""
    dumps = spark.createDataFrame([("s", "a", b'{"manifests":[{"digest":"d","size":9}]}'), ("s", "b", b"")], "store string, ref string, index_raw binary")
    blobs = spark.createDataFrame([("s", "d", 3), ("s", "e", 4)], "store string, digest string, length long")
    wanted = spark.createDataFrame([("s", "a", "d"), ("s", "a", "e"), ("s", "a", "f"), ("s", "b", "d"), ("s", "c", "d")], "store string, ref string, digest string")
    got = manifests.image_view(dumps, blobs, wanted, content=False)
    assert {(r.ref, r.digest, r.size, r.error) for r in got.collect()} == {
        ("a", "d", 9, None), ("a", "e", 4, None), ("a", "f", None, "missing blob"), ("b", "d", None, "empty index"), ("c", "d", None, "no such image"),
    }
    plan = got._jdf.queryExecution().optimizedPlan()
    assert [str(c) for c in (plan.children().head().children().head().output().mkString(","),)][0].count("i#") == 0


def test_images_stage_holds_no_tag_files(spark):
    """Tag files come of the stage as they are read, and a view that asks for no manifest keeps none."""
    from tallyport.plans import images

    got = images._images(spark, "/root/testdata/sf0.001", manifests_too=False)
    assert "m" not in got.columns and {"index_raw", "layout_raw"} <= set(got.columns)
    assert "index_raw" not in got._jdf.queryExecution().optimizedPlan().collectLeaves().head().output().mkString(",")


def test_stores_of_a_wave_are_removed_before_the_next(spark, tmp_path, monkeypatch):
    """Texts whose stores would take too much disk go wave by wave: each text in one, equal texts together, one wave's folders at a time."""
    import os

    from tallyport.plans import stores

    rows = [(i, f"text {i % 40}") for i in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(stores, "WAVE", 30 * stores.BLOCK)
    kept, waves = [], []

    def run(docs, folder):
        assert not any(map(os.path.exists, kept))
        root = folder()
        kept.append(root.removeprefix("file://").removeprefix("file:"))
        got = docs.collect()
        waves.append({r.text for r in got})
        execution.write_objects(docs.select(F.concat(F.lit("a/b/c/d"), "doc_id").alias("name"), F.col("text").alias("content")), root).count()
        assert os.path.isdir(kept[-1])
        return docs.select("doc_id")

    got = stores._in_waves(spark, str(tmp_path), stores._blocks(1000), run)
    assert not any(map(os.path.exists, kept))
    assert sorted(r.doc_id for r in got.collect()) == list(range(100))
    assert len(waves) == 4 and sum(map(len, waves)) == 40 == len(set.union(*waves))


def test_a_folder_is_removed_by_tasks(spark, tmp_path):
    for at in ("x/y/z/deep", "x/y", "p"):
        (tmp_path / "s" / at).mkdir(parents=True, exist_ok=True)
        (tmp_path / "s" / at / "file").write_bytes(b"1")
    (tmp_path / "s" / "file").write_bytes(b"1")
    (tmp_path / "other").write_bytes(b"1")
    store.remove_folder(spark, str(tmp_path / "s"))
    store.remove_folder(spark, str(tmp_path / "none"))
    assert [x.name for x in tmp_path.iterdir()] == ["other"]


def test_ranged_reads_leave_no_store(spark, monkeypatch):
    import glob

    from tallyport.plans import stores

    left = lambda: set(glob.glob(f"{execution.shared_folder(spark).removeprefix("file:").replace("//", "/")}/tallyport-store-*"))
    before = left()
    monkeypatch.setattr(stores, "WAVE", 3 << 20)
    got = stores.ranged_reads(spark, "/root/testdata/sf0.001")
    assert left() == before
    assert all(r.from_file == r.from_chunks and r.n_sent for r in got.collect())


def test_packed_digests_are_told_apart(spark):
    from tallyport.functions import text

    odd = ["sha256:" + "0a" * 32, "sha256:" + "0A" * 32, "sha256:" + "0a" * 31, "sha512:" + "0a" * 64, "", "d", "\x01" + "a" * 32, "sha256:" + "0a" * 32 + "\n", None]
    rows = spark.createDataFrame([(x,) for x in odd], "d string").withColumn("p", text.packed_digest(F.col("d")))
    got = rows.select("d", "p", text.unpacked_digest(F.col("p")).alias("u")).collect()
    assert all(r.d == r.u for r in got) and len({r.p and bytes(r.p) for r in got}) == len(odd)
    assert [len(r.p) for r in got if r.d == odd[0]] == [33]


def test_made_contents_are_in_no_stage(spark):
    """Contents and tag files that follow from narrower columns give the same rows, and the images' stage holds none of them."""
    from tallyport.plans import images

    found = images._images(spark, "/root/testdata/sf0.001")
    plain = manifests.read_manifests(found.select("store", "ref", "index_raw"), images._blobs(found), keep=("index_raw",))
    kept = found.select("store", "ref", "index_raw", "kind", F.when(F.col("kind").isin(2, 3), F.col("digest")).alias("own"), "size")
    index = images._index(F.col("kind"), F.coalesce("own", "manifest_digest"), F.col("size"))
    made = manifests.read_manifests(kept, images._made(found), keep=("kind", "own", "size"), made={"index_raw": index})
    columns = ("ref", "manifest_digest", "manifest_size", "raw", "m", "error")
    same = lambda df: {str(r.asDict(True)) for r in df.select(*columns).collect()}
    assert same(plain) == same(made) and made.where("error is null").count() > 0
    tags = lambda df: {(r.ref, bytes(r.index_raw)) for r in df.where("error is null").select("ref", "index_raw").collect()}
    assert tags(plain) == tags(made)
    wide = {"raw", "content", "m", "index_raw"}
    stage = images._images(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().collectLeaves().head().output().mkString(",")
    assert not wide & {c.split("#")[0] for c in stage.split(",")}


def test_only_asked_images_are_read(spark):
    asked = spark.createDataFrame([("a",), ("a",), ("c",)], "ref string")
    rows = [("s", "a", "d1", 3, None), ("s", "c", None, None, "bad json"), ("s", "d", None, None, "missing manifest blob")]
    m = "struct<config:struct<digest:string,size:bigint>,layers:array<struct<mediaType:string,digest:string,size:bigint>>>"
    read = spark.createDataFrame(rows, "store string, ref string, manifest_digest string, manifest_size long, error string")
    read = read.withColumn("m", F.when(F.col("error").isNull(), F.from_json(F.lit('{"config":{"digest":"c","size":1},"layers":[{"digest":"l"},{"digest":"l"}]}'), m)))
    given = []

    def found(refs):
        given.extend(sorted(r.ref for r in refs.collect()))
        return read.join(refs, "ref", "left_semi")

    got = lambda x: sorted(map(tuple, manifests.blobs_of_images(x, asked).collect()), key=repr)
    want = sorted([("a", "d1", None), ("a", "c", None), ("a", "l", None), ("a", "l", None), ("c", None, "bad json")], key=repr)
    assert got(read) == want and got(found) == want and given == ["a", "c"]


def test_a_blob_of_one_write_gets_no_token(spark, tmp_path):
    """It is sent though its token couldn't be written, and replaces whatever part another attempt has left."""
    import hashlib

    body, other = b"small", b"other"
    hexes = [hashlib.sha256(x).hexdigest() for x in (body, other)]
    source, target = tmp_path / "a/share/sha256", tmp_path / "b/share/sha256"
    source.mkdir(parents=True)
    for x, hex_ in zip((body, other), hexes):
        (source / hex_).write_bytes(x)
    (target / f"{hexes[0]}{moving.TOKEN}").mkdir(parents=True)
    (target / f"{hexes[1]}{moving.PART}").write_bytes(b"left")
    (target / f"{hexes[1]}{moving.TOKEN}").write_bytes(b"sha256:another")
    plan = spark.createDataFrame([("i", f"sha256:{h}", 5) for h in hexes], "ref string, digest string, size long")
    actions = moving.transfer_actions(plan, moving.blob_files(plan, str(tmp_path / "b")))
    got = moving.move_files(actions, str(tmp_path / "a"), str(tmp_path / "b")).collect()
    assert [(r.status, r.start, r.written) for r in got] == [("sent", 0, 5)] * 2
    assert [(target / h).read_bytes() for h in hexes] == [body, other]
    assert not [x for x in target.iterdir() if x.is_file() and x.name not in hexes]
