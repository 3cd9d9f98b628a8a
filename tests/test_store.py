import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyport.functions import commands, refs, text
from tallyport.operators import execution, manifests, transfer
from tallyport.sources import peers, store
from tallyport.streaming import commit

HEX = "a" * 64
GOOD_REFS = [
    ("nginx", "docker.io/library/nginx:latest"),
    ("nginx:1.25", "docker.io/library/nginx:1.25"),
    ("user/app", "docker.io/user/app:latest"),
    ("ghcr.io/org/app:v1", "ghcr.io/org/app:v1"),
    ("GHCR.IO/org/app", "ghcr.io/org/app:latest"),
    ("localhost/x", "localhost/x:latest"),
    ("registry:5000/a/b/c:t", "registry:5000/a/b/c:t"),
    (f"q.io/a@sha256:{HEX}", f"q.io/a@sha256:{HEX}"),
    ("LOCALHOST/x", "docker.io/LOCALHOST/x:latest"),
    ("localhost:5000", "docker.io/library/localhost:5000"),
    (f"nginx:1.0@sha256:{HEX}", f"docker.io/library/nginx:1.0@sha256:{HEX}"),
]
BAD_REFS = ["", None, "a@md5:00", "a@sha256:xyz", f"a@sha256:{HEX.upper()}", "a:", "q.io/", "q.io/a//b", "q.io/_tags/b", "q.io/../b", "a:.x", "a:b c", "a:" + "x" * 129, "q.io/a\\b"]


def test_references(spark):
    df = spark.createDataFrame([(r, w) for r, w in GOOD_REFS], "s string, want string")
    for r in refs.parse_refs(df, "s").collect():
        assert r.ref.error is None and r.ref.canonical == r.want
    bad = refs.parse_refs(spark.createDataFrame([(r,) for r in BAD_REFS], "s string"), "s").collect()
    assert [r.s for r in bad if r.ref.error is None] == []


def test_sizes_and_names(spark):
    cases = {"100MiB": 104857600, "1G": 1 << 30, "2GB": 2 * 10**9, "7": 7, "3B": 3, "5K": 5120, "0": None, "-1": None, "1.5M": None, "x": None, "": None, "1Gi": None, "99999999999999999999": None}
    rows = spark.createDataFrame(list(cases.items()), "s string, want long").withColumn("got", text.parse_size(F.col("s"))).collect()
    assert [(r.s, r.got) for r in rows if r.got != r.want] == []
    r = spark.range(1).select(
        text.chunk_name(F.lit("p/"), F.lit("sha256:ab"), F.lit(7)).alias("a"), text.chunk_name(F.lit(""), F.lit("sha512:ab"), F.lit(123456789)).alias("b"),
        text.meta_name(F.lit("p"), F.lit("h"), F.lit("a/b"), F.lit("t"), F.lit("")).alias("c"), text.dump_dir(F.lit("h"), F.lit("a"), F.lit(""), F.lit("ff")).alias("d"),
        text.redact_url(F.lit("https://u:p@h/x?q#f")).alias("e"), text.shell_quote(F.array(F.lit("a'b"), F.lit("c"))).alias("f"),
        text.redact_argv(F.array(*map(F.lit, ["x", "--creds", "me:pw", "--password=1", "--creds2=3"]))).alias("g"),
        text.has_authorization(F.array(F.lit("X: 1"), F.lit(" AUTHORIZATION : b"))).alias("h"), text.parse_dump_dir(F.lit("h/a/b/_tags/t")).alias("i"),
        text.parse_remote_spec(F.lit("ssh://u@h:22/oci:/p")).alias("j"), text.parse_remote_spec(F.lit("file-server:ftp://x")).alias("k"), text.parse_local_spec(F.lit("oci:")).alias("l"),
    ).first()
    assert (r.a, r.b) == ("p/blobs/sha256/ab/00000007", "blobs/sha512/ab/123456789")
    assert (r.c, r.d, r.e) == ("p/images/h/a/b/_tags/t.json", "h/a/_digests/ff", "https://h/x")
    assert r.f == "'a'\\''b' 'c'" and r.g == ["x", "--creds", "<redacted>", "--password=<redacted>", "--creds2=3"] and r.h
    assert (r.i.host, r.i.repo, r.i.leaf) == ("h", "a/b", "t") and (r.j.kind, r.j.port, r.j.transport, r.j.path) == ("ssh", 22, "oci", "/p")
    assert r.k.error and r.l.error


@pytest.mark.parametrize("need,have,pinned,want", [("ab", "b", "", "a"), ("ab", "ab", "", ""), ("ab", "ab", "a", "a"), ("a", "", "z", "az"), ("", "", "", "")])
def test_transfer_set(spark, need, have, pinned, want):
    df = lambda s: spark.createDataFrame([(c,) for c in s], "digest string")
    assert sorted(r.digest for r in transfer.transfer_set(df(need), df(have), df(pinned)).collect()) == sorted(want)


def _sha(b: bytes) -> str:
    return "sha256:" + hashlib.sha256(b).hexdigest()


def test_store_end_to_end(spark, tmp_path):
    layer, config = b"L1", b"CFG"
    desc = lambda b: {"mediaType": "x", "digest": _sha(b), "size": len(b)}
    manifest = json.dumps({"schemaVersion": 2, "config": desc(config), "layers": [desc(layer), desc(layer)]}).encode()
    pool = tmp_path / "share/sha256"
    pool.mkdir(parents=True)
    for b in (layer, config, manifest):
        (pool / _sha(b)[7:]).write_bytes(b)
    (pool / (_sha(b"x")[7:] + ".part")).write_bytes(b"x")
    for tag, index in (("ok", {"manifests": [desc(manifest)]}), ("two", {"manifests": [desc(manifest)] * 2}), ("gone", {"manifests": [desc(b"nope")]}), ("none", {"manifests": []})):
        store.write_pointer(str(tmp_path), f"reg:5000/a/_tags/{tag}", "index.json", json.dumps(index).encode())
    store.write_pointer(str(tmp_path), "reg:5000/a/_tags/bad", "index.json", b"{not json")
    assert len(store.walk_dumps(str(tmp_path))) == 5 and store.walk_dumps(str(tmp_path / "missing")) == []
    dumps, blobs = store.read_dumps(spark, str(tmp_path)), store.read_pool(spark, str(tmp_path))
    assert blobs.count() == 3
    read = manifests.read_manifests(dumps, blobs)
    errors = {r.ref.rsplit("/", 1)[1]: r.error for r in read.collect()}
    assert errors == {"ok": None, "two": "multi", "gone": "missing manifest blob", "none": "no manifests", "bad": "bad json"}
    rows = manifests.closure(read).orderBy("ordinal").collect()
    assert [(r.role, r.size) for r in rows] == [("manifest", len(manifest)), ("config", 3), ("layer", 2), ("layer", 2)]
    need = manifests.closure(read).select("ref", "digest", "size").distinct()
    for have, want in ((blobs.limit(0), (3, 0)), (blobs, (0, 3)), (blobs.where(F.col("digest") != _sha(layer)), (1, 2))):
        r = transfer.image_report(need, have).first()
        assert (r.sent, r.reused) == want
    assert r.bytes == 2


def test_state_and_reports(spark):
    chunks = spark.createDataFrame([(1, 0, 5), (1, 1, 5), (1, 3, 5), (2, 1, 9)], "d long, i long, n long")
    assert {r.d: r.resume_offset for r in transfer.chunk_state(chunks, "d", "i", "n").collect()} == {1: 10, 2: 0}
    rows = spark.createDataFrame([(None, 3, 10), (None, 10, 10), (10, None, 10), (None, None, 10), (None, 0, 10)], "c long, p long, s long")
    got = rows.select(transfer.blob_state(F.col("c"), F.col("p"), F.col("s")).alias("x")).collect()
    assert [r.x.status for r in got] == ["partial", "absent", "complete", "absent", "absent"]
    report = spark.createDataFrame([("a", 1, 2, 3, True, None), ("b", 0, 0, 0, False, "boom"), ("c", 1, 0, 5, False, None)], "ref string, sent int, reused int, bytes long, dry_run boolean, error string")
    lines = [r.line for r in transfer.report_lines(report).orderBy("ref").collect()]
    assert lines == ["DRY-RUN would: a pushed (new: 1, reused: 2, bytes: 3)", "b ERROR: boom", "c pushed (new: 1, reused: 0, bytes: 5)"]
    assert transfer.failed_count(report).first().failed == 1
    assert transfer.chunk_rows(spark.createDataFrame([(25,), (0,)], "s long"), "s", 10).count() == 4


def test_listings(spark, tmp_path):
    (tmp_path / "d").write_text('{"Repository":"a","Tag":"1"}\n{"Repository":"a","Tag":"<none>"}\n{"Repository":"a","Tag":"1"}\n')
    (tmp_path / "p").write_text(json.dumps([{"Id": "1", "Names": ["x:1", "y:2"]}, {"Id": "2"}, {"Id": "3", "Names": ["x:1", ""]}]))
    assert [r.ref for r in store.read_docker_images(spark, str(tmp_path / "d")).collect()] == ["a:1"]
    assert sorted(r.ref for r in store.read_podman_images(spark, str(tmp_path / "p")).collect()) == ["x:1", "y:2"]


HEX64 = "a" * 64
REMOTES = [
    ("ssh://host", ("ssh", "host", None, None, "containers-storage", None)),
    ("ssh://host/", ("ssh", "host", None, None, "containers-storage", None)),
    ("ssh://host/containers-storage:", ("ssh", "host", None, None, "containers-storage", None)),
    ("ssh://host/containers-storage", ("ssh", "host", None, None, "containers-storage", None)),
    ("ssh://user@host:2222/oci:/srv/oci", ("ssh", "host", 2222, "user", "oci", "/srv/oci")),
    ("ssh://host/docker-daemon:", ("ssh", "host", None, None, "docker-daemon", None)),
    ("ssh://u:p@w@[::1]:22/oci:a%20b", ("ssh", "::1", 22, "u", "oci", "a b")),
    ("file-server:https://host/bucket/prefix", ("file-server", None, None, None, None, "https://host/bucket/prefix")),
    ("file-server:HTTP://minio.local:9000/b", ("file-server", None, None, None, None, "HTTP://minio.local:9000/b")),
    ("oci:/path/to/dir", ("local-dir", None, None, None, None, "/path/to/dir")),
    ("oci:relative/path", ("local-dir", None, None, None, None, "relative/path")),
]
BAD_REMOTES = ["", None, "bogus", "containers-storage:", "docker-daemon:", "oci:", "file-server:", "file-server:ftp://x", "file-server:s3://x", "ssh://", "ssh:///", "ssh://host/docker:", "ssh://host/oci:", "ssh://host/docker-daemon:arg", "ssh://host:99999999999999999999", "ssh://ho st", "ssh://host:x", "ssh://host/oci:%zz"]


def test_remote_and_local_specs(spark):
    rows = spark.createDataFrame([(s, list(map(str, w))) for s, w in REMOTES] + [(s, None) for s in BAD_REMOTES], "s string, want array<string>")
    for r in rows.withColumn("x", text.parse_remote_spec(F.col("s"))).collect():
        if r.want is None:
            assert r.x.error and r.x.kind is None and r.x.path is None, r
        else:
            assert r.x.error is None and [str(x) for x in r.x[:-1]] == r.want, r
    local = {"containers-storage": True, "containers-storage:": True, "docker:": True, "docker-daemon": True, "oci:/x": True, "oci:": False, "docker::": False, "x": False, "": False}
    got = spark.createDataFrame([(s,) for s in local], "s string").select("s", text.parse_local_spec(F.col("s")).alias("x")).collect()
    assert {r.s: r.x.error is None for r in got} == local


def test_dump_dirs_from_a_peer(spark):
    good = {"ghcr.io/a/b/_tags/v1": ("ghcr.io", "a/b", "v1"), f"ghcr.io/a/b/_digests/{HEX64}": ("ghcr.io", "a/b", HEX64)}
    bad = ["ghcr.io/a/../b/_tags/v1", "ghcr.io/a/b/_tags/" + "x" * 129, "ghcr.io/a/b/_tags/.bad", "ghcr.io/a/_tags/b/_tags/v1", "ghcr.io/a/b/_digests/abc", "ghcr.io/a/b/_digests/" + "z" * 64, "h/../../etc/_tags/x", "h/_tags/x", "/a/_tags/x", "h/a/_tags/", "h/a/b", ""]
    rows = spark.createDataFrame([(s,) for s in [*good, *bad]], "s string").select("s", text.parse_dump_dir(F.col("s")).alias("x")).collect()
    for r in rows:
        assert (r.x.error is None) == (r.s in good) and (r.x.host, r.x.repo, r.x.leaf) == good.get(r.s, (None, None, None)), r


def test_redaction_and_sizes_of_hostile_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    argv = lambda *a: F.array(*map(F.lit, a))
    urls = {"https://u:p@ss@h/x": "https://h/x", "https://u:p@h?t=1": "https://h", "https://h/a@b#f": "https://h/a@b", "https://u@h": "https://h", "x": "x"}
    assert {u: one(text.redact_url(F.lit(u))) for u in urls} == urls
    assert one(text.redact_argv(argv("--authfile", "/secret", "--password-stdin=x", "--creds", "--password", "y", "=z"))) == ["--authfile", "<redacted>", "--password-stdin=<redacted>", "--creds", "<redacted>", "y", "=z"]
    assert one(text.redact_header(F.lit("  X-Auth \t: s:ecret"))) == "X-Auth: [redacted]" and one(text.redact_header(F.lit("nocolon"))) == "[redacted header]"
    assert tuple(one(text.split_header(F.lit("A:  b: c")))) == ("A", " b: c") and one(text.split_header(F.lit("a"))) is None
    assert [one(text.parse_size(F.lit(s))) for s in ("9999999999GiB", " 7MiB", "7 MiB", "+7K", "-7K", "K", "8B")] == [None, None, None, 7168, None, None, 8]
    assert bytes(one(text.tail(F.lit("aé"), 2))) == "é".encode() and bytes(one(text.tail(F.lit("ab"), 0))) == b"ab" and bytes(one(text.tail(F.lit("ab"), 9))) == b"ab"
    got = one(text.redact_config(F.from_json(F.lit('{"auth":"s","chunkSize":"1"}'), "struct<auth:string,chunkSize:string>")))
    assert (got.auth, got.chunkSize) == ("[REDACTED]", "1")


def test_commands(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    end = lambda t, a, b="": F.struct(F.lit(t).alias("transport"), F.lit(a).alias("arg1"), F.lit(b).alias("arg2"))
    copy = lambda a, b, shared="", fmt="", level=0, force=False: one(commands.copy_args(a, b, F.lit(shared), F.lit(fmt), F.lit(level), F.lit(force)))
    live, oci = end("containers-storage", "h/a:t"), end("oci", "/d", "h/a:t")
    assert copy(live, oci, "/s", "zstd", 20, True).args == ["copy", "--dest-compress-format", "zstd", "--dest-force-compress-format", "--dest-compress-level", "20", "--dest-shared-blob-dir", "/s", "containers-storage:h/a:t", "oci:/d:h/a:t"]
    assert copy(oci, live, "/s", level=3, force=True).args == ["copy", "--dest-compress-level", "3", "--src-shared-blob-dir", "/s", "oci:/d:h/a:t", "containers-storage:h/a:t"]
    assert copy(live, live).error and copy(live, end("docker", "x"), "/s").error and copy(end("oci", "/d"), live).error == "empty tag" and copy(end("x", "y"), live).error == "unknown transport"
    assert one(commands.inspect_args(live, F.lit(True), F.lit("/s"))).args == ["inspect", "--raw", "--shared-blob-dir", "/s", "containers-storage:h/a:t"]
    target = [F.lit(""), F.lit("u"), F.lit("h"), F.lit(2222)]
    assert one(commands.ssh_target(*target)) == "u@h:2222" and one(commands.ssh_target(F.lit("n"), *target[1:])) == "n" and one(commands.ssh_target(*target[:3], F.lit(22))) == "u@h"
    assert one(commands.ssh_args(*target, F.lit("/c"))) == ["-F", "/c", "-p", "2222", "u@h"] and one(commands.ssh_command_args(*target, F.lit("")))[:4] == ["-p", "2222", "u@h", "-n"]
    assert [one(commands.log_level(F.lit(x))) for x in ("WARN", "x")] == [4, None] and one(commands.log_format(F.lit("JSON"))) == "json"
    assert one(commands.env_prefix(F.lit("a-b"))) == "A_B" and one(commands.lookup_env(F.array(F.lit("A=1"), F.lit("AB=2"), F.lit("A=3=4")), "A")) == "3=4"
    tags = {"v0.2.0": "v0.2.1-devel", "v0.2.0-rc1": "v0.2.1-devel", "sub/v0.2.9": "sub/v0.2.10-devel", "v1.2": None, "v1.2.x": None}
    assert {t: one(commands.next_dev(F.lit(t))) for t in tags} == tags
    assert [one(commands.is_release_tag(F.lit(t))) for t in ("v1.2.3", "a/b/v1.2.3-rc.1", "1.2.3", "/v1.2.3", "v1.2")] == [True, True, False, False, False]
    assert one(commands.rewrite_version(F.lit('package x\nconst Version = "v1"\n'), F.lit("v2"))) == 'package x\nconst Version = "v2"\n' and one(commands.rewrite_version(F.lit("x"), F.lit("v2"))) is None
    assert one(commands.dump_refs(F.lit("docker"), F.lit("i"), F.lit("/t"), F.lit("/s"))).dst.arg2 == "i" and one(commands.local_ref(F.lit("oci"), F.lit("/o"), F.lit("i"))).arg1 == "/o"


def _image(spark, layer=b"L" * 10, config=b"CFG"):
    desc = lambda b: {"digest": _sha(b), "size": len(b)}
    manifest = json.dumps({"schemaVersion": 2, "config": desc(config), "layers": [desc(layer)]}).encode()
    index, layout = json.dumps({"manifests": [desc(manifest)]}).encode(), b'{"imageLayoutVersion":"1.0.0"}'
    parts = [(_sha(b), len(b), i, b[i * 4 : i * 4 + 4]) for b in (manifest, config, layer) for i in range(-(-len(b) // 4))]
    plan = spark.createDataFrame([("h/a:t", _sha(b), len(b)) for b in (manifest, config, layer)], "ref string, digest string, size long")
    pieces = spark.createDataFrame(parts, "digest string, size long, idx int, content binary")
    tags = spark.createDataFrame([("h/a:t", "h/a/_tags/t/oci-layout", layout, 0), ("h/a:t", "h/a/_tags/t/index.json", index, 1)], "ref string, name string, content binary, step int")
    return manifest, config, layer, plan, pieces, tags


def test_transfer_runs(spark, tmp_path):
    """Everything goes once, nothing twice; broken content is never committed, nor is its image's pointer."""
    manifest, config, layer, plan, pieces, tags = _image(spark)
    root = str(tmp_path / "s")
    store.ensure_layout(root)
    run = lambda p=pieces: tuple(execution.transfer_images(plan, p, tags, root).first())[1:]
    bad = pieces.withColumn("content", F.when((F.col("digest") == _sha(layer)) & (F.col("idx") == 0), F.lit(bytearray(b"XXXX"))).otherwise(F.col("content")))
    sent, reused, size, error = run(bad)
    assert (sent, reused) == (2, 0) and "digest mismatch" in error and store.walk_dumps(root) == []
    assert run() == (1, 2, len(layer), None) and store.walk_dumps(root) == ["h/a/_tags/t"]
    assert run() == (0, 3, 0, None) and not list((tmp_path / "s").rglob("*.part"))
    dumps, pool = store.read_dumps(spark, root), store.read_pool(spark, root, strict=True)
    read = manifests.read_manifests(dumps, pool)
    assert manifests.closure(read).count() == 3 and manifests.enumerate_store(read, pool).count() == 3
    assert [(r.ref, r.error) for r in store.list_images(store.list_dumps(spark, root)).collect()] == [("h/a:t", None)]
    (tmp_path / "s/share/sha256" / _sha(layer)[7:]).write_bytes(b"M" * 10)
    assert {r.digest: r.action for r in execution.pull_actions(plan, pool, verify=True).collect()} == {_sha(manifest): "reuse", _sha(config): "reuse", _sha(layer): "refetch"}
    assert {r.action for r in execution.pull_actions(plan, pool.limit(0)).collect()} == {"fetch"}
    with pytest.raises(PermissionError):
        peers.FolderPeer(root, read_only=True).put(pieces)
    assert isinstance(peers.open_peer("local-dir", root=root), peers.Peer) and peers.FolderPeer(root).blobs(spark, content=False).count() == 3
    wanted = spark.createDataFrame([("h/a/_tags/t", _sha(manifest)), ("h/a/_tags/t", _sha(b"no")), ("gone", _sha(b"x"))], "ref string, digest string").withColumn("store", F.lit("local"))
    assert {(r.ref, r.size, r.error) for r in manifests.image_view(dumps, pool, wanted).collect()} == {("h/a/_tags/t", len(manifest), None), ("h/a/_tags/t", None, "missing blob"), ("gone", None, "no such image")}


def test_dry_runs_and_server_state(spark):
    """The plan against an empty server, a full one, and one that lost a layer's chunk and the metadata."""
    manifest, config, layer, plan, _, _ = _image(spark)
    pinned = plan.where(F.col("digest").isin(_sha(manifest), _sha(config))).select("ref", "digest")
    chunk = transfer.chunk_rows(plan.select("digest", "size").distinct(), "size", 4).select("digest", F.col("i").alias("idx"), F.col("len").alias("length"))
    metas = spark.createDataFrame([], "digest string, chunk_size long, seq long")
    blobs, nothing = plan.select("digest", "size"), plan.select("digest").limit(0)
    dry = lambda have, there: tuple(execution.push_totals(plan, have, pinned, execution.server_state(blobs, there, metas, 4)).first())[1:]
    assert dry(nothing, chunk.limit(0)) == (3, 0, len(manifest) + 13)
    assert dry(blobs.select("digest"), chunk) == (0, 3, 0)
    lost = chunk.where(~((F.col("digest") == _sha(layer)) & (F.col("idx") == 1)))
    assert dry(nothing, lost) == (1, 2, 10)
    state = {r.digest: (r.current_size, r.status) for r in execution.server_state(blobs, lost, metas, 4).collect()}
    assert state[_sha(layer)] == (4, "partial") and state[_sha(config)] == (3, "complete")
    other = spark.createDataFrame([(_sha(layer), 10, 1)], "digest string, chunk_size long, seq long")
    assert execution.server_state(blobs, lost, other, 4).where(F.col("digest") == _sha(layer)).first().status == "absent"
    read = execution.chunks_from(chunk, spark.createDataFrame([(_sha(layer), 6)], "digest string, offset long")).orderBy("idx").collect()
    assert [(r.idx, r.skip, r.length) for r in read] == [(1, 2, 2), (2, 0, 2)]
    content = spark.createDataFrame([(5, 2, b"hello"), (5, 6, b"hello"), (5, -1, b"hello"), (None, 0, None)], "length long, at long, content binary")
    assert [(r.rest and bytes(r.rest), r.error) for r in execution.read_from(content, F.col("at")).collect()] == [(b"llo", None), (None, "offset outside the blob"), (None, "offset outside the blob"), (None, "missing blob")]


def test_metadata_commit(spark, tmp_path):
    manifest, config, layer, plan, _, _ = _image(spark)
    index = json.dumps({"manifests": [{"digest": _sha(manifest), "size": len(manifest)}], "x": 1.50}).encode()
    dumps = spark.createDataFrame([("s", "a", index, b'{"imageLayoutVersion": "1"}'), ("s", "b", index, b""), ("s", "c", b"{}", b"{}")], "store string, ref string, index_raw binary, layout_raw binary")
    blobs = spark.createDataFrame([("s", _sha(b), len(b), b) for b in (manifest, config, layer)], "store string, digest string, length long, content binary")
    rows = {r.ref: r for r in manifests.commit_metas(dumps, blobs, 100, F.col("ref")).collect()}
    assert index.decode() in rows["a"].json and json.loads(rows["a"].json)["descriptors"][2] == {"digest": _sha(layer), "size": 10}
    assert (rows["b"].error, rows["c"].error) == ("no layout", "no manifests")
    metas = spark.createDataFrame([("a", rows["a"].json.encode()), ("x", b"{"), ("none", None)], "ref string, raw binary")
    got = manifests.meta_blobs(metas).collect()
    assert [(r.ref, r.size, r.chunk_size) for r in got if r.error is None] == [("a", len(manifest), 100), ("a", 3, 100), ("a", 10, 100)] and [r.ref for r in got if r.error] == ["x"]
    put = execution.write_objects(spark.createDataFrame([("images/a.json", rows["a"].json)], "name string, content string"), str(tmp_path))
    assert put.first().length == len(rows["a"].json) and (tmp_path / "images/a.json").read_text() == rows["a"].json
    with pytest.raises(Exception):
        execution.write_objects(spark.createDataFrame([("../x", "y")], "name string, content string"), str(tmp_path)).count()
    config = store.read_config(spark, str(tmp_path / "none.json")).first().config
    assert config.local is None and manifests.enumerate_images("oci", lambda: manifests.read_manifests(dumps, blobs), None, lambda: blobs).count() == 3
    with pytest.raises(ValueError):
        manifests.enumerate_images("docker")


def test_streaming_commit(spark, tmp_path):
    source, out, ckpt = tmp_path / "in", [], str(tmp_path / "ckpt")
    schema, seq = "ref string, kind string, body string, seq long", iter(range(100))

    def run(*rows, **options):
        spark.createDataFrame([(*r, next(seq)) for r in rows], schema).coalesce(1).write.mode("append").json(str(source))
        query = commit.start_commits(spark.readStream.schema(schema).json(str(source)), lambda df: out.extend(sorted(map(tuple, df.collect()))), ckpt, **options)
        query.awaitTermination()
        said = [p for p in query.recentProgress if p["stateOperators"]]
        got, out[:] = list(out), []
        return got, said[-1]["stateOperators"][0]["numRowsTotal"] if said else None

    assert run(("a", "layout", "L1"), ("b", "index", "I2"), ("a", "other", "x"), (None, "layout", "x"), ("c", "layout", None)) == ([], 2)
    assert run(("b", "layout", "L2")) == ([("b", "L2", "I2")], 1)
    assert run(("a", "layout", "L3"), ("a", "index", "I1")) == ([("a", "L3", "I1")], 0)
    # a pair was taken out: one more half waits for a partner, and commits nothing twice
    assert run(("a", "layout", "L4")) == ([], 1)
    assert run(("a", "index", "I4"), ("a", "index", "I5"), ("a", "layout", "L5")) == ([("a", "L4", "I4"), ("a", "L5", "I5")], 0)


def test_streaming_halves_expire(spark, tmp_path):
    import time

    source, schema, got = tmp_path / "in", "ref string, kind string, body string, seq long", []
    spark.createDataFrame([("a", "layout", "L", 1)], schema).write.json(str(source))
    rows = commit.consume_halves(spark.readStream.schema(schema).json(str(source)), expire_ms=500)
    query = rows.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").foreachBatch(lambda df, _: got.extend(map(tuple, df.collect()))).start()
    try:
        end = time.time() + 60
        while not got and time.time() < end:
            time.sleep(0.3)
    finally:
        query.stop()
    assert got == [("a", "L", None, "expired")]
