import hashlib
import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tallyport.operators import execution, manifests, moving, transfer
from tallyport.sources import peers, store


def sha(b: bytes) -> str:
    return "sha256:" + hashlib.sha256(b).hexdigest()


def put(root, *blobs):
    (root / "share/sha256").mkdir(parents=True, exist_ok=True)
    for b in blobs:
        (root / "share/sha256" / sha(b)[7:]).write_bytes(b)


def image(root, ref, layers):
    """Makes an image in a store; returns its plan rows and tag files."""
    config = b"config of " + ref.encode()
    desc = lambda b: {"mediaType": "x", "digest": sha(b), "size": len(b)}
    manifest = json.dumps({"config": desc(config), "layers": [desc(b) for b in layers]}).encode()
    index = json.dumps({"manifests": [desc(manifest)]}).encode()
    put(root, config, manifest, *layers)
    store.write_pointer(str(root), ref, "oci-layout", b'{"imageLayoutVersion":"1.0.0"}')
    store.write_pointer(str(root), ref, "index.json", index)
    tags = [(ref, f"{ref}/oci-layout", b'{"imageLayoutVersion":"1.0.0"}', 1), (ref, f"{ref}/index.json", index, 2)]
    return [(ref, sha(b), len(b)) for b in dict.fromkeys([manifest, config, *layers])], tags


def frames(spark, plan, tags):
    return spark.createDataFrame(plan, "ref string, digest string, size bigint"), spark.createDataFrame(tags, "ref string, name string, content binary, step int")


def report_of(df):
    return {r.ref: tuple(r)[1:] for r in df.collect()}


@pytest.fixture()
def two_images(spark, tmp_path):
    src, dst = tmp_path / "a", tmp_path / "b"
    shared, own = b"shared layer" * 50, b"own layer" * 70
    one, tags1 = image(src, "h/a/_tags/t", [shared])
    two, tags2 = image(src, "h/b/_tags/t", [shared, own])
    return src, dst, frames(spark, one + two, tags1 + tags2), (shared, own)


def test_second_push_opens_nothing(spark, two_images):
    src, dst, (plan, tags), (shared, own) = two_images
    first = report_of(moving.transfer_store(plan, tags, str(src), str(dst)))
    assert {k: (v[0], v[1], v[3]) for k, v in first.items()} == {"h/a/_tags/t": (3, 0, None), "h/b/_tags/t": (3, 1, None)}
    assert (dst / "h/b/_tags/t/index.json").exists() and sorted(os.listdir(dst / "share/sha256")) == sorted(os.listdir(src / "share/sha256"))
    shutil.rmtree(src / "share")  # whoever opened a blob now would fail
    assert {k: v[:2] + v[3:] for k, v in report_of(moving.transfer_store(plan, tags, str(src), str(dst))).items()} == {"h/a/_tags/t": (0, 3, None), "h/b/_tags/t": (0, 4, None)}


def test_resume_and_its_refusals(spark, tmp_path):
    src, dst = tmp_path / "a", tmp_path / "b"
    blobs = [bytes([65 + i]) * (100 + i) for i in range(7)]
    put(src, *blobs[:6])
    pool = dst / "share/sha256"
    pool.mkdir(parents=True)
    part = lambda i, body, token: ((pool / (sha(blobs[i])[7:] + ".part")).write_bytes(body), token and (pool / (sha(blobs[i])[7:] + ".part.etag")).write_text(token))
    part(0, blobs[0][:40], sha(blobs[0]))  # resumed
    part(1, blobs[1][:40], sha(b"another"))  # a foreign token
    part(2, blobs[2][:40], None)  # no token
    part(3, b"x" * 40, sha(blobs[3]))  # spoilt: the hash finds it, the next run starts anew
    part(4, blobs[4], sha(blobs[4]))  # full, never committed
    part(5, blobs[5] + b"more", sha(blobs[5]))  # longer than the blob
    plan, tags = frames(spark, [("i", sha(b), len(b)) for b in blobs] + [("j", "sha256:x", 3)], [("i", "i/_tags/t/index.json", b"{}", 1), ("k", "k/_tags/t/index.json", b"{}", 1)])
    state = moving.blob_files(plan, str(dst))
    actions = {r.digest: (r.action, r.offset) for r in moving.transfer_actions(plan, state).collect()}
    assert [actions[sha(b)] for b in blobs] == [("resume", 40), ("send", 0), ("send", 0), ("resume", 40), ("resume", 104), ("send", 0), ("send", 0)] and actions["sha256:x"] == ("refuse", 0)
    got = {r.digest: (r.status, r.start, r.written) for r in moving.move_files(moving.transfer_actions(plan, state), str(src), str(dst)).collect()}
    assert [got[sha(b)] for b in blobs] == [("sent", 40, 60), ("sent", 0, 101), ("sent", 0, 102), ("digest mismatch", 40, 0), ("sent", 104, 0), ("sent", 0, 105), ("no such blob", None, 0)]
    assert sorted(os.listdir(pool)) == sorted(sha(b)[7:] for i, b in enumerate(blobs[:6]) if i != 3)
    put(src, blobs[6])
    report = report_of(moving.transfer_store(plan, tags, str(src), str(dst)))
    assert report == {"i": (2, 5, 209, None), "j": (0, 0, 0, "sha256:x: malformed digest"), "k": (0, 0, 0, None)}
    assert all((pool / sha(b)[7:]).read_bytes() == b for b in blobs) and (dst / "k/_tags/t/index.json").exists()
    # a pull that verifies what it reuses fetches spoilt files again
    (pool / sha(blobs[2])[7:]).write_bytes(b"?" * len(blobs[2]))
    assert report_of(moving.transfer_store(plan, tags, str(src), str(dst), verify_reused=True))["i"] == (1, 6, 102, None) and (pool / sha(blobs[2])[7:]).read_bytes() == blobs[2]


def test_killed_attempt_is_resumed_by_its_retry(spark, tmp_path, monkeypatch):
    src, dst = tmp_path / "a", tmp_path / "b"
    body = os.urandom(3_500_000)
    put(src, body)
    plan, _ = frames(spark, [("i", sha(body), len(body))], [("i", "x/y", b"", 1)])
    actions = execution.settled(moving.transfer_actions(plan, moving.blob_files(plan, str(dst))))
    # an attempt that ended after 2 MiB: what its task would have left
    pool = dst / "share/sha256"
    pool.mkdir(parents=True)
    (pool / (sha(body)[7:] + ".part")).write_bytes(body[: 2 << 20])
    (pool / (sha(body)[7:] + ".part.etag")).write_text(sha(body))
    got = moving.move_files(actions, str(src), str(dst)).first()
    assert (got.status, got.start, got.written) == ("sent", 2 << 20, len(body) - (2 << 20)) and (pool / sha(body)[7:]).read_bytes() == body


def test_images_go_in_parallel_within_their_bound(spark, tmp_path):
    src, dst = tmp_path / "a", tmp_path / "b"
    plan = []
    for i in range(12):
        blobs = [b"%d of %d " % (j, i) * 2000 for j in range(7)]
        put(src, *blobs)
        plan += [(f"i{i:02}", sha(b), len(b)) for b in blobs]
    df, _ = frames(spark, plan, [("x", "x/y", b"", 1)])
    actions = execution.settled(moving.transfer_actions(df, moving.blob_files(df, str(dst)), bound=3))
    assert {r.n for r in actions.groupBy("ref").agg(F.count_distinct("slot").alias("n")).collect()} == {3}
    rows = moving.move_files(actions, str(src), str(dst))
    assert rows.rdd.getNumPartitions() == min(36, 8 * spark.sparkContext.defaultParallelism)
    times = rows.join(actions.select("digest", "ref"), "digest").collect()
    assert len(times) == 84 and all(r.status == "sent" for r in times)
    for ref in {r.ref for r in times}:
        marks = sorted([(r.began, 1) for r in times if r.ref == ref] + [(r.ended, -1) for r in times if r.ref == ref], key=lambda m: (m[0], m[1]))
        at = most = 0
        for _, step in marks:
            at += step
            most = max(most, at)
        assert most <= 3


def test_sweep(spark, tmp_path):
    put(tmp_path, b"kept")
    pool = tmp_path / "share/sha256"
    for name in ("a" * 64 + ".part", "a" * 64 + ".part.etag", "b" * 64 + ".part", "c" * 64 + ".0f.part"):
        (pool / name).write_bytes(b"zz")
    wanted = spark.createDataFrame([("sha256:" + "a" * 64,)], "digest string")
    assert moving.sweep_parts(spark, str(tmp_path), wanted, older_than=3600).count() == 0
    assert sorted(r.name[0] for r in moving.sweep_parts(spark, str(tmp_path), wanted).collect()) == ["b", "c"]
    assert sorted(n[:1] for n in os.listdir(pool)) == sorted(["a", "a", sha(b"kept")[7]]) and moving.sweep_parts(spark, str(tmp_path / "none")).count() == 0


def test_parts_lie_aside(spark, tmp_path):
    """Blobs are written in folders of few tasks, not in the pool's own; what a lost task leaves there is swept."""
    bodies = [b"body %d" % i for i in range(40)]
    rows = [(sha(b), len(b), 0, b) for b in bodies] + [(sha(b"wrong"), 5, 0, b"other")]
    pieces = spark.createDataFrame(rows, "digest string, size long, idx int, content binary")
    pool = tmp_path / "share/sha256"
    assert sorted(r.status for r in execution.write_blobs(pieces, str(tmp_path)).collect()) == ["digest mismatch", *["sent"] * 40]
    (aside,) = [x for x in os.listdir(pool) if len(x) != 64]
    assert 0 < len(os.listdir(pool / aside)) <= 256 and not [x for x in (pool / aside).rglob("*") if x.is_file()]
    left = pool / aside / os.listdir(pool / aside)[0] / f"{'d' * 64}.0f.part"
    left.write_bytes(b"zz")
    for content in (True, False):
        assert {r.digest for r in store.read_pool(spark, str(tmp_path), content=content).collect()} == set(map(sha, bodies))
    assert [(r.name, r.length) for r in moving.sweep_parts(spark, str(tmp_path)).collect()] == [(left.name, 2)] and not left.exists()
    none = spark.createDataFrame(rows[-1:], pieces.schema)
    execution.write_blobs(none, str(tmp_path / "none")).collect()
    assert store.read_pool(spark, str(tmp_path / "none")).count() == 0
    assert not (pool / sha(b"wrong")[7:]).exists()


def test_chunks_of_a_new_blob_come_in_one_folder(spark, tmp_path):
    """Only a folder beside the blobs' is worked in, however many tasks share a blob; what is there is sent no more."""
    blobs = [b"", b"one", os.urandom(300), os.urandom(20)]
    put(tmp_path / "a", *blobs)
    plan = spark.createDataFrame([(sha(b), len(b)) for b in blobs] + [(sha(b"none"), 4)], "digest string, size bigint")
    send = lambda: {(r.digest, r.idx): (r.status, r.length) for r in moving.send_chunks(plan, str(tmp_path / "a"), str(tmp_path / "s"), 2).collect()}
    first, there = send(), tmp_path / "s/blobs/sha256"
    assert first == {(sha(b), i): ("sent", len(b[2 * i : 2 * i + 2])) for b in blobs for i in range(max(1, -(-len(b) // 2)))} | {(sha(b"none"), i): ("no such blob", 0) for i in range(2)}
    assert set(os.listdir(there)) == {store.PARTS, *(sha(b)[7:] for b in blobs)}
    assert not [x for x in (there / store.PARTS).rglob("*") if len(x.name) > 2]
    for b in blobs:
        assert b"".join(x.read_bytes() for x in sorted((there / sha(b)[7:]).iterdir())) == b
    (there / sha(blobs[2])[7:] / "00000003").unlink()
    (there / sha(blobs[1])[7:] / "00000001").write_bytes(b"long")
    shutil.rmtree(there / sha(blobs[3])[7:])
    again = send()
    assert {k for k, v in again.items() if v[0] == "sent"} == {(sha(blobs[2]), 3), (sha(blobs[1]), 1), *((sha(blobs[3]), i) for i in range(10))}
    assert (there / sha(blobs[1])[7:] / "00000001").read_bytes() == b"e"
    for b in blobs:
        (tmp_path / "a/share/sha256" / sha(b)[7:]).unlink()
    assert {v[0] for k, v in send().items() if k[0] != sha(b"none")} == {"reused"}


def test_files_get_their_names_by_links(tmp_path):
    own, base = store.file_system(str(tmp_path))
    for old in (None, b"old"):
        (tmp_path / "x.part").write_bytes(b"new")
        inode = os.stat(tmp_path / "x.part").st_ino
        if old:
            (tmp_path / "x").write_bytes(old)
        store.put_in_place(own, f"{base}/x.part", f"{base}/x")
        found = os.stat(tmp_path / "x")
        assert (tmp_path / "x").read_bytes() == b"new" and os.listdir(tmp_path) == ["x"] and (found.st_ino, found.st_nlink) == (inode, 1)
        (tmp_path / "x").unlink()


@pytest.mark.parametrize("chunk", [1, 4, 1000])
def test_ranged_reads(spark, tmp_path, chunk):
    blobs = [b"", b"x", b"hello world, again", os.urandom(2500) if chunk > 1 else b"short"]
    put(tmp_path / "a", *blobs)
    plan = spark.createDataFrame([(sha(b), len(b)) for b in blobs], "digest string, size bigint")
    moving.send_chunks(plan, str(tmp_path / "a"), str(tmp_path / "s"), chunk, "p").count()
    names = [n for b in blobs for n in os.listdir(tmp_path / "s/p/blobs/sha256" / sha(b)[7:])]
    assert len(names) == sum(max(1, -(-len(b) // chunk)) for b in blobs)
    asked = [(b, o) for b in blobs for o in {0, 1, len(b) // 2, len(b)} if o <= len(b)]
    wanted = spark.createDataFrame([(sha(b), len(b), o, chunk) for b, o in asked], "digest string, size bigint, offset bigint, chunk_size bigint")
    for ranges in (wanted.withColumn("length", F.col("size") - F.col("offset")), moving.split_ranges(wanted, 7)):
        for got in (moving.read_ranges(ranges, str(tmp_path / "a"), piece=5), moving.read_chunks(ranges, str(tmp_path / "s"), "p")):
            rows = got.collect()
            assert all(r.error is None for r in rows)
            for b in blobs:
                pieces = {(r.at, bytes(r.content)) for r in rows if r.digest == sha(b)}
                assert all(b[at : at + len(c)] == c for at, c in pieces)
                covered = {at + i for at, c in pieces for i in range(len(c))}
                assert covered == set(range(len(b)))
    bad = spark.createDataFrame([(sha(blobs[2]), 18, -1, chunk, 5), (sha(blobs[2]), 18, 19, chunk, 5), (sha(b"none"), 4, 0, chunk, 4)], "digest string, size bigint, offset bigint, chunk_size bigint, length bigint")
    assert sorted(r.error for r in moving.read_ranges(bad, str(tmp_path / "a")).collect()) == ["missing blob", "offset outside the blob", "offset outside the blob"]
    assert {r.error for r in moving.read_chunks(bad, str(tmp_path / "s"), "p").collect()} == {"missing chunk", "offset outside the blob"}
    if chunk == 4:
        other = spark.createDataFrame([(sha(blobs[2]), 18, 0, 10, 18)], "digest string, size bigint, offset bigint, chunk_size bigint, length bigint")
        assert "chunk of another size" in {r.error for r in moving.read_chunks(other, str(tmp_path / "s"), "p").collect()}
        said, objects = other.select("digest", "size", "chunk_size"), spark.createDataFrame([(sha(blobs[2]), i, 4 if i < 4 else 2) for i in range(5)], "digest string, idx bigint, length bigint")
        assert [(r.idx, r.want) for r in moving.chunk_conflicts(said, objects).orderBy("idx").collect()] == [(0, 10), (1, 8), (2, None), (3, None), (4, None)]
        assert moving.chunk_conflicts(said.withColumn("chunk_size", F.lit(4)), objects).count() == 0


def test_file_server(spark, tmp_path):
    src = tmp_path / "a"
    layers = [b"layer one" * 40, b"layer two" * 33]
    plan1, _ = image(src, "h/a/_tags/t", layers)
    plan2, _ = image(src, "h/deep/er/_digests/" + "d" * 64, layers[:1])
    local, server = peers.FolderPeer(str(src)), peers.open_peer("file-server", root=str(tmp_path / "s"), chunk=100, naming=peers.Naming("p/"))
    assert isinstance(server, peers.Peer)
    plan = spark.createDataFrame(plan1 + plan2, "ref string, digest string, size bigint")
    (tmp_path / "s/p/images").mkdir(parents=True)
    first = report_of(server.push(plan, local))
    assert {k: (v[0], v[1], v[3]) for k, v in first.items()} == {"h/a/_tags/t": (4, 0, None), "h/deep/er/_digests/" + "d" * 64: (2, 1, None)}
    again = report_of(server.push(plan, local))
    assert {v[0] for v in again.values()} == {0} and {v[3] for v in again.values()} == {None}
    dumps = {r.ref: (bytes(r.index_raw), bytes(r.layout_raw)) for r in server.dumps(spark).collect()}
    assert dumps == {ref: ((src / ref / "index.json").read_bytes(), (src / ref / "oci-layout").read_bytes()) for ref in first}
    whole = {r.digest: bytes(r.content) for r in server.blobs(spark).collect()}
    assert whole == {d: (src / "share/sha256" / d[7:]).read_bytes() for _, d, _ in plan1 + plan2}
    read = manifests.read_manifests(server.dumps(spark), server.blobs(spark))
    assert {r.digest for r in manifests.closure(read).collect()} == set(whole)
    # another chunk size would cut stored chunks at wrong places
    other = peers.ServerPeer(str(tmp_path / "s"), chunk=64, naming=peers.Naming("p/"))
    assert {v[3] for v in report_of(other.push(plan, local)).values()} == {"chunk size conflict"}
    with pytest.raises(PermissionError):
        peers.ServerPeer(str(tmp_path / "s"), read_only=True).push(plan, local)


def test_layers_are_never_loaded(spark, tmp_path):
    image(tmp_path, "h/a/_tags/t", [b"x" * 5000])
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)
    try:
        got = manifests.read_manifests(store.read_dumps(spark, str(tmp_path)), store.read_pool(spark, str(tmp_path), content=False))
        assert [(r.error, len(r.m.layers)) for r in got.collect()] == [(None, 1)]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    plain = tmp_path / "plain"
    (plain / "blobs").mkdir(parents=True)
    shutil.copytree(tmp_path / "share/sha256", plain / "blobs/sha256")
    for name in store.TAG_FILES:
        shutil.copy(tmp_path / "h/a/_tags/t" / name, plain / name)
    assert [r.error for r in manifests.read_manifests(*store.read_image_dir(spark, str(plain))).collect()] == [None]
    assert [r.error for r in manifests.read_manifests(*store.read_image_dir(spark, str(tmp_path / "none"))).collect()] == ["empty index"]


def test_repeated_blobs_and_pieces(spark, tmp_path):
    dumps = spark.createDataFrame([("s", "a", json.dumps({"manifests": [{"digest": sha(b"m"), "size": 1}]}).encode())], "store string, ref string, index_raw binary")
    pool = spark.createDataFrame([("s", sha(b"m"), 1, b"m")] * 3, "store string, digest string, length bigint, content binary")
    asked = spark.createDataFrame([("s", "a", sha(b"m")), ("s", "a", sha(b"n"))], "store string, ref string, digest string")
    assert sorted((r.digest == sha(b"m"), r.error) for r in manifests.image_view(dumps, pool, asked).collect()) == [(False, "missing blob"), (True, None)]
    assert manifests.image_view(dumps, pool, asked, content=False).where("content is not null").count() == 0
    pieces = spark.createDataFrame([(sha(b"hello"), 5, 0, b"hel"), (sha(b"hello"), 5, 1, b"lo")] * 2, "digest string, size bigint, idx int, content binary")
    assert [(r.status, r.length) for r in execution.write_blobs(pieces, str(tmp_path)).collect()] == [("sent", 5)]


def test_wide_repository_is_listed_by_all(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"h/a/_tags/t{i}").mkdir(parents=True)
    (tmp_path / "h/a/b/_digests/x/_tags").mkdir(parents=True)
    (tmp_path / "share/_tags/no").mkdir(parents=True)
    dumps = store.list_dumps(spark, str(tmp_path))
    assert sorted(r.dump for r in dumps.collect()) == sorted(store.walk_dumps(str(tmp_path))) and dumps.count() == 301
    assert dumps.rdd.getNumPartitions() == min(301 // 16, 8 * spark.sparkContext.defaultParallelism)
    assert store.list_dumps(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("gap", ["\n", "", "  \r\n\t "])
def test_listings_split_anywhere(spark, tmp_path, gap):
    rows = [{"Repository": "a}{", "Tag": "1"}, {"Repository": "b\\\"", "Tag": "é"}, {"Repository": "a}{", "Tag": "1"}] + [{"Repository": f"r{i}", "Tag": "x" * 300} for i in range(400)]
    path = tmp_path / "docker"
    path.write_text(gap.join(json.dumps(r, ensure_ascii=False) for r in rows))
    got = store.read_docker_images(spark, str(path)).orderBy("pos").collect()
    assert [(r.ref, r.pos) for r in got] == [(f"{r['Repository']}:{r['Tag']}", i) for i, r in enumerate(rows) if i != 2]
    path.write_text(json.dumps(rows[0]) + gap + '{"Repository":')
    with pytest.raises(Exception):
        store.read_docker_images(spark, str(path)).collect()
    listing = tmp_path / "podman"
    listing.write_text("[" + f"{gap},{gap}".join(json.dumps({"Id": str(i), "Names": [f"n{i}", "same"]}) for i in range(50)) + "]")
    assert store.read_podman_images(spark, str(listing)).count() == 51


DESC = '{"mediaType":"x","digest":"sha256:%s","size":3}' % ("a" * 64)
MANIFESTS = {
    '{"config":%s,"layers":[%s]}' % (DESC, DESC): None,
    '{"Config":%s,"LAYERS":[%s]}' % (DESC.replace("digest", "Digest"), DESC): None,
    '{"config":%s,"layers":[null]}' % DESC: None,
    '{"config":%s,"layers":null,"extra":{"a":[1]}} \n' % DESC: None,
    '{"config":{"digest":5}}': "bad type",
    '{"config":%s,"layers":[{"size":"x"}]}' % DESC: "bad type",
    '{"config":%s,"layers":[{"size":1.5}]}' % DESC: "bad type",
    '{"config":%s,"layers":[{"size":1e3}]}' % DESC: "bad type",
    '{"config":%s,"layers":{}}' % DESC: "bad type",
    '{"config":[]}': "bad type",
    '{"config":%s,"mediaType":7}' % DESC: "bad type",
    '{"config":{"digest":"d","annotations":{"a":1}}}': "bad type",
    '{"config":{"digest":"d","platform":{"os":1}}}': "bad type",
    '{"config":{"digest":"d","urls":["u",1]}}': "bad type",
    '{"config":{"digest":"d","annotations":{"a":null},"platform":null,"urls":["u"]}}': None,
    '{"config":%s} x' % DESC: "bad json",
    '{"config":%s}}' % DESC: "bad json",
    '{"config":%s},"end":1}' % DESC: "bad json",
    '{"config":%s' % DESC: "bad json",
    '{"config":%s}{}' % DESC: "bad json",
    "": "empty manifest",
    "{}": "missing config digest",
    '{"config":{"digest":"text \\"Digest\\": 5"}}': None,
    '{"manifests":[%s]}' % DESC: "index in place of a manifest",
    '{"manifests":[%s],"config":%s,"mediaType":"application/x"}' % (DESC, DESC): None,
}


def test_strict_documents(spark):
    df = spark.createDataFrame([(k,) for k in MANIFESTS], "raw string").withColumn("p", manifests.parse_manifest(F.col("raw").cast("binary")))
    got = {r.raw: r.p for r in df.collect()}
    assert {k: v.error for k, v in got.items()} == MANIFESTS
    texts = list(MANIFESTS)
    assert got[texts[1]].value.config.digest == "sha256:" + "a" * 64 and got[texts[1]].value.layers[0]["size"] == 3
    assert [tuple(x) for x in got[texts[2]].value.layers] == [("", "", 0)]
    assert got['{"config":{"digest":"text \\"Digest\\": 5"}}'].value.config.digest == 'text "Digest": 5'


def test_metadata_cannot_be_forged(spark):
    descs = F.array(F.struct(F.col("digest"), F.col("size")))
    rows = [('sha256:x","size":1},{"digest":"evil', 1, "{}"), ("sha256:" + "a" * 64, None, "{}"), ("sha256:" + "a" * 64, 2, '{},"version":2,"x":{}'), ("sha256:" + "a" * 64, 2, "{")]
    df = spark.createDataFrame(rows, "digest string, size bigint, layout string")
    got = [r.x for r in df.select(manifests.meta_json(F.col("layout").cast("binary"), F.lit('{"manifests":[1]}').cast("binary"), F.lit(5).cast("bigint"), descs).alias("x")).collect()]
    assert [x.error for x in got] == ["malformed digest", None, "bad json", "bad json"]
    assert json.loads(got[1].json)["descriptors"] == [{"digest": "sha256:" + "a" * 64, "size": 0}]
