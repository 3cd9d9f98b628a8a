"""Arguments of copy and shell tools, log settings and release tags, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Levels that a log setting may name, with their order. Fixed values.
LOG_LEVELS = {"trace": -8, "debug": -4, "info": 0, "warn": 4, "error": 8, "fatal": 12}
#: A release tag: an optional path of a submodule, then vMAJOR.MINOR.PATCH with an optional suffix. Fixed value.
RELEASE_TAG = r"^(?:[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)*/)?v[0-9]+\.[0-9]+\.[0-9]+(?:-[0-9A-Za-z.-]+)?$"
#: Options of every one-shot remote command: no standard input, no questions, and an end to silent channels.
REMOTE_OPTIONS = ("-n", "-o", "BatchMode=yes", "-o", "ServerAliveInterval=15", "-o", "ServerAliveCountMax=3")


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _args(*parts: tuple[Column, tuple]) -> Column:
    """One array of the words of each part whose condition holds."""
    none = F.array().cast("array<string>")
    word = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.concat(*[F.when(F.coalesce(cond, F.lit(False)), F.array(*map(word, words))).otherwise(none) for cond, words in parts])


def transport_ref(transport: Column, arg1: Column, arg2: Column) -> Column:
    """``struct<ref, error>``: the copy tool's name of an image. ``arg1`` is a reference or, for dir, docker-archive
    and oci, a path; ``arg2`` is oci's tag, which it needs, or an archive's reference, which it may have."""
    joined = F.concat_ws(":", transport, arg1, F.when(_given(arg2), arg2))
    known = transport.isin("containers-storage", "dir", "docker-daemon", "docker", "docker-archive", "oci")
    error = F.when(~_given(arg1), "empty ref").when((transport == "oci") & ~_given(arg2), "empty tag").when(~F.coalesce(known, F.lit(False)), "unknown transport")
    ref = F.when(transport.isin("docker-archive", "oci"), joined).when(transport == "docker", F.concat(F.lit("docker://"), arg1)).otherwise(F.concat_ws(":", transport, arg1))
    return F.struct(F.when(error.isNull(), ref).alias("ref"), error.alias("error"))


def local_ref(transport: Column, oci_path: Column, image: Column) -> Column:
    """``struct<transport, arg1, arg2>`` of an image in a local store: oci takes its path and the image as tag."""
    oci = transport == "oci"
    return F.struct(transport.alias("transport"), F.when(oci, oci_path).otherwise(image).alias("arg1"), F.when(oci, image).otherwise("").alias("arg2"))


def dump_refs(transport: Column, image: Column, dump_dir: Column, share: Column) -> Column:
    """``struct<src, dst, shared>`` of a dump: a live image, the oci directory that takes it, and the blob pool."""
    end = lambda t, a, b: F.struct(t.alias("transport"), a.alias("arg1"), b.alias("arg2"))
    return F.struct(end(transport, image, F.lit("")).alias("src"), end(F.lit("oci"), dump_dir, image).alias("dst"), share.alias("shared"))


def inspect_args(src: Column, raw: Column, shared: Column) -> Column:
    """``struct<args, error>`` of the copy tool's inspect."""
    s = transport_ref(src["transport"], src["arg1"], src["arg2"])
    args = _args((F.lit(True), ("inspect",)), (raw, ("--raw",)), (_given(shared), ("--shared-blob-dir", shared)), (F.lit(True), (s["ref"],)))
    return F.struct(F.when(s["error"].isNull(), args).alias("args"), s["error"].alias("error"))


def copy_args(src: Column, dst: Column, shared: Column, fmt: Column, level: Column, force: Column) -> Column:
    """``struct<args, error>`` of the copy tool's copy.

    A shared blob pool belongs to the destination if that is an oci directory, else to the source, and is an error if
    neither is one. The level goes along without a format; force needs a format.
    """
    a, b = (transport_ref(x["transport"], x["arg1"], x["arg2"]) for x in (src, dst))
    to, of = dst["transport"] == "oci", src["transport"] == "oci"
    error = F.coalesce(a["error"], b["error"], F.when(a["ref"] == b["ref"], "source and destination are the same"), F.when(_given(shared) & ~to & ~of, "a shared pool needs an oci side"))
    args = _args(
        (F.lit(True), ("copy",)), (_given(fmt), ("--dest-compress-format", fmt)), (_given(fmt) & force, ("--dest-force-compress-format",)),
        (F.coalesce(level, F.lit(0)) != 0, ("--dest-compress-level", level.cast("string"))), (_given(shared) & to, ("--dest-shared-blob-dir", shared)),
        (_given(shared) & ~to & of, ("--src-shared-blob-dir", shared)), (F.lit(True), (a["ref"], b["ref"])),
    )
    return F.struct(F.when(error.isNull(), args).alias("args"), error.alias("error"))


def _login(user: Column, host: Column) -> Column:
    return F.when(_given(user), F.concat(user, F.lit("@"), host)).otherwise(host)


def _own_port(port: Column) -> Column:
    return ~F.coalesce(port, F.lit(0)).isin(0, 22)


def ssh_target(name: Column, user: Column, host: Column, port: Column) -> Column:
    """A target as one text: its name, or user, host and a port other than the usual one."""
    dst = _login(user, host)
    return F.when(_given(name), name).when(_own_port(port), F.concat(dst, F.lit(":"), port.cast("string"))).otherwise(dst)


def ssh_args(name: Column, user: Column, host: Column, port: Column, config: Column) -> Column:
    """The arguments that select a target."""
    named = _given(name)
    return _args((_given(config), ("-F", config)), (named, (name,)), (~named & _own_port(port), ("-p", port.cast("string"))), (~named, (_login(user, host),)))


def ssh_command_args(name: Column, user: Column, host: Column, port: Column, config: Column) -> Column:
    return F.concat(ssh_args(name, user, host, port, config), F.array(*map(F.lit, REMOTE_OPTIONS)))


def log_format(text: Column) -> Column:
    """text or json in any case; null for anything else."""
    return F.when(F.lower(text).isin("text", "json"), F.lower(text))


def log_level(text: Column) -> Column:
    """A level's number, by its name in any case; null for anything else."""
    return F.create_map(*[F.lit(x) for kv in LOG_LEVELS.items() for x in kv])[F.lower(text)]


def env_prefix(app: Column) -> Column:
    return F.replace(F.upper(app), F.lit("-"), F.lit("_"))


def lookup_env(env: Column, key: str) -> Column:
    """The last value of a variable in an array of KEY=value; null if it isn't there."""
    own = F.filter(env, lambda e: F.startswith(e, F.lit(f"{key}=")))
    return F.when(F.size(own) > 0, F.substr(F.element_at(own, -1), F.lit(len(key) + 2)))


def is_release_tag(tag: Column) -> Column:
    return tag.rlike(RELEASE_TAG)


def is_devel(version: Column) -> Column:
    return F.endswith(version, F.lit("-devel")) | F.contains(version, F.lit("-devel."))


def split_tag(tag: Column) -> Column:
    """``struct<prefix, version>``: cut at the last slash."""
    version = F.substring_index(tag, "/", -1)
    prefix = F.when(F.contains(tag, F.lit("/")), F.left(tag, F.length(tag) - F.length(version) - 1)).otherwise("")
    return F.struct(prefix.alias("prefix"), version.alias("version"))


def next_dev(tag: Column) -> Column:
    """The next patch's development version behind a release; null if the release has no three numbers."""
    t = split_tag(tag)
    base = F.split_part(F.regexp_replace(t["version"], "^v", ""), F.lit("-"), F.lit(1))
    parts = F.split(base, r"\.")
    patch = F.when(F.size(parts) == 3, F.when(F.get(parts, F.lit(2)).rlike("^[+-]?[0-9]+$"), F.get(parts, F.lit(2)).try_cast("bigint")))
    made = F.concat(F.lit("v"), F.get(parts, F.lit(0)), F.lit("."), F.get(parts, F.lit(1)), F.lit("."), (patch + 1).cast("string"), F.lit("-devel"))
    return F.when(t["prefix"] == "", made).otherwise(F.concat(t["prefix"], F.lit("/"), made))


#: The line that holds a source's version constant. A fixed value.
VERSION_LINE = r'(?m)^const\s+Version\s*=\s*"[^"]*"'


def rewrite_version(source: Column, version: Column) -> Column:
    """A source text with its one version constant set; null unless it has exactly one."""
    made = F.concat(F.lit('const Version = "'), version, F.lit('"'))
    return F.when(F.regexp_count(source, F.lit(VERSION_LINE)) == 1, F.regexp_replace(source, F.lit(VERSION_LINE), made))
