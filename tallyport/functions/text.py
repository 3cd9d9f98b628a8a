"""Sizes, object names, paths, redaction and quoting as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyport.functions.refs import host_path_tag_error, is_digest_hex

#: Multiplier of each size suffix: binary for iB and for the bare letter, decimal for B pairs. Fixed values.
SIZE_SUFFIXES = {"GiB": 1 << 30, "MiB": 1 << 20, "KiB": 1 << 10, "GB": 10**9, "MB": 10**6, "KB": 10**3, "G": 1 << 30, "M": 1 << 20, "K": 1 << 10, "B": 1}
#: Flags whose values stay out of logs. Fixed values.
SECRET_FLAGS = ("--creds", "--src-creds", "--dest-creds", "--authfile", "--password", "--password-stdin")


def parse_size(text: Column) -> Column:
    """Bytes of a size such as ``100MiB``; null if it isn't one, isn't above zero, or doesn't fit in 63 bits."""
    pattern = rf"^([+-]?[0-9]+)({'|'.join(SIZE_SUFFIXES)})?$"
    factors = F.create_map(*[F.lit(x) for kv in SIZE_SUFFIXES.items() for x in kv])
    suffix = F.regexp_extract(text, pattern, 2)
    n = F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("bigint")
    size = F.try_multiply(n, F.when(suffix == "", F.lit(1)).otherwise(factors[suffix]).cast("bigint"))
    return F.when(size > 0, size)


def digest_of(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def split_digest(digest: Column) -> Column:
    """``struct<algo, hex, error>`` of a sha256, sha384 or sha512 digest; anything else is malformed."""
    formed = F.coalesce(digest.rlike("^(sha256:[0-9a-f]{64}|sha384:[0-9a-f]{96}|sha512:[0-9a-f]{128})$"), F.lit(False))
    part = lambda n: F.when(formed, F.split_part(digest, F.lit(":"), F.lit(n)))
    return F.struct(part(1).alias("algo"), part(2).alias("hex"), F.when(~formed, "malformed digest").alias("error"))


def packed_digest(digest: Column) -> Column:
    """A digest as bytes, for shuffles, where its hex digits would take twice the room: 1 and the hash of a sha256 digest, 0 and the
    text of anything else."""
    formed = digest.rlike(r"\Asha256:[0-9a-f]{64}\z")
    return F.when(formed, F.concat(F.lit(b"\x01"), F.unhex(F.substr(digest, F.lit(8))))).otherwise(F.concat(F.lit(b"\x00"), digest.cast("binary")))


def unpacked_digest(packed: Column) -> Column:
    rest = F.substr(packed, F.lit(2))
    return F.when(F.substr(packed, F.lit(1), F.lit(1)) == F.lit(b"\x01"), F.concat(F.lit("sha256:"), F.lower(F.hex(rest)))).otherwise(rest.cast("string"))


def digest_error(content: Column, digest: Column) -> Column:
    """Null if ``content`` has ``digest`` by the digest's own algorithm, else ``malformed digest`` or ``digest mismatch``."""
    d = split_digest(digest)
    real = F.when(d["algo"] == "sha256", F.sha2(content, 256)).when(d["algo"] == "sha384", F.sha2(content, 384)).otherwise(F.sha2(content, 512))
    return F.coalesce(d["error"], F.when(real != d["hex"], "digest mismatch"))


def chunk_name(prefix: Column, digest: Column, index: Column) -> Column:
    """``<prefix>/blobs/<algo>/<hex>/<index>``, the index with eight digits at least."""
    base = F.rtrim(prefix, F.lit("/"))
    name = F.concat(F.lit("blobs/"), F.replace(digest, F.lit(":"), F.lit("/")), F.lit("/"), F.format_string("%08d", index))
    return F.when(base == "", name).otherwise(F.concat(base, F.lit("/"), name))


def dump_dir(host: Column, path: Column, tag: Column, digest_hex: Column) -> Column:
    """``<host>/<path>/_tags/<tag>``, or under ``_digests`` for a digest."""
    leaf = F.when(F.coalesce(digest_hex, F.lit("")) != "", F.concat(F.lit("_digests/"), digest_hex)).otherwise(F.concat(F.lit("_tags/"), tag))
    return F.concat_ws("/", host, path, leaf)


def meta_name(prefix: Column, host: Column, path: Column, tag: Column, digest_hex: Column) -> Column:
    base = F.rtrim(prefix, F.lit("/"))
    name = F.concat(F.lit("images/"), dump_dir(host, path, tag, digest_hex), F.lit(".json"))
    return F.when(base == "", name).otherwise(F.concat(base, F.lit("/"), name))


def blob_path(digest: Column) -> Column:
    """``share/<algo>/<hex>``; null for a malformed digest."""
    d = split_digest(digest)
    return F.concat(F.lit("share/"), d["algo"], F.lit("/"), d["hex"])


def base_dir(xdg: Column, home: Column, app: str) -> Column:
    """``struct<path, error>`` of the default store: under the data home if that is set, else under the home."""
    some = lambda c: F.nullif(c, F.lit(""))
    path = F.coalesce(F.concat(F.rtrim(some(xdg), F.lit("/")), F.lit(f"/{app}")), F.concat(F.rtrim(some(home), F.lit("/")), F.lit(f"/.local/share/{app}")))
    return F.struct(path.alias("path"), F.when(path.isNull(), "no home").alias("error"))


def parse_dump_dir(path: Column) -> Column:
    """``struct<host, repo, marker, leaf, error>`` of a dump directory: cut at its first ``_tags`` or else ``_digests``.

    Names come from a peer, so host, path and tag must be as in a reference, and a digest must be one; with an error
    the other fields are null.
    """
    cut = lambda m: F.instr(path, f"/{m}/")
    marker = F.when(cut("_tags") > 0, "_tags").when(cut("_digests") > 0, "_digests")
    at = F.when(cut("_tags") > 0, cut("_tags")).otherwise(cut("_digests"))
    before, leaf = F.left(path, at - 1), F.substr(path, at + F.length(marker) + 2)
    host = F.split_part(before, F.lit("/"), F.lit(1))
    repo = F.substr(before, F.length(host) + 2)
    tagged = marker == "_tags"
    error = (
        F.when(marker.isNull(), "no marker").when((host == "") | (repo == ""), "missing host or path")
        .otherwise(F.coalesce(host_path_tag_error(host, repo, F.when(tagged, leaf).otherwise("")), F.when(tagged & (leaf == ""), "empty tag"), F.when(~tagged & ~is_digest_hex(leaf), "digest hex")))
    )
    return F.struct(*[F.when(error.isNull(), c).alias(n) for n, c in (("host", host), ("repo", repo), ("marker", marker), ("leaf", leaf))], error.alias("error"))


def redact_url(url: Column) -> Column:
    """Without query, fragment and user information, which ends at the last ``@`` before the path."""
    return F.regexp_replace(F.regexp_replace(url, "(?s)[?#].*$", ""), "://[^/]*@", "://")


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://([^/?#]+)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, "^https?://[^/?#]+/([^?#]*)", 1)


def redact_header(header: Column) -> Column:
    """The name stays, without blanks around it; without a colon nothing does."""
    name = F.regexp_replace(F.split_part(header, F.lit(":"), F.lit(1)), r"^\s+|\s+$", "")
    return F.when(F.instr(header, ":") > 0, F.concat(name, F.lit(": [redacted]"))).otherwise("[redacted header]")


def split_header(header: Column) -> Column:
    """``struct<name, value>`` cut at the first colon, one blank behind it dropped; null without a colon."""
    at = F.instr(header, ":")
    value = F.regexp_replace(F.substr(header, at + 1), "^ ", "")
    return F.when(at > 0, F.struct(F.left(header, at - 1).alias("name"), value.alias("value")))


def has_authorization(headers: Column) -> Column:
    return F.exists(headers, lambda h: (F.instr(h, ":") > 0) & (F.lower(F.trim(F.split_part(h, F.lit(":"), F.lit(1)))) == "authorization"))


def redact_argv(argv: Column, flags: tuple[str, ...] = SECRET_FLAGS) -> Column:
    """Values of secret flags, given behind them or with ``=``, read ``<redacted>``. A value that is itself the name
    of a secret flag hides no further argument."""
    names = [F.lit(f) for f in flags]

    def step(acc, arg):
        name = F.substring_index(arg, "=", 1)
        shown = F.when(acc["hide"], F.lit("<redacted>")).when((F.instr(arg, "=") > 1) & name.isin(*names), F.concat(name, F.lit("=<redacted>"))).otherwise(arg)
        return F.struct(F.concat(acc["out"], F.array(shown)).alias("out"), (~acc["hide"] & F.coalesce(arg.isin(*names), F.lit(False))).alias("hide"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("hide"))
    return F.aggregate(argv, start, step, lambda acc: acc["out"])


def shell_quote(argv: Column) -> Column:
    """Each argument in single quotes, one line."""
    return F.array_join(F.transform(argv, lambda a: F.concat(F.lit("'"), F.replace(a, F.lit("'"), F.lit("'\\''")), F.lit("'"))), " ")


def tail(content: Column, most: int) -> Column:
    """The last ``most`` bytes, as binary; all of them for zero or less."""
    raw = content.cast("binary")
    return raw if most <= 0 else F.substring(raw, F.greatest(F.octet_length(raw) - most + 1, F.lit(1)), F.lit(most))


def redact_config(config: Column, secret: str = "auth") -> Column:
    """A configuration struct with a secret that isn't empty read as ``[REDACTED]``."""
    return config.withField(secret, F.when(F.coalesce(config[secret], F.lit("")) != "", "[REDACTED]").otherwise(config[secret]))


def parse_local_spec(spec: Column) -> Column:
    """``struct<transport, path, error>``: containers-storage, docker-daemon, docker (each with or without a colon
    behind) and ``oci:<path>``."""
    name = F.regexp_extract(spec, "^(containers-storage|docker-daemon|docker):?$", 1)
    plain = name != ""
    path = F.when(F.startswith(spec, F.lit("oci:")), F.substr(spec, F.lit(5)))
    error = F.when(plain | (path != ""), F.lit(None)).when(path == "", "oci needs a path").otherwise("unknown transport")
    return F.struct(F.when(plain, name).when(path.isNotNull(), "oci").alias("transport"), path.alias("path"), error.alias("error"))


def enumerable_error(transport: Column) -> Column:
    """Null unless a local transport can't be enumerated or loaded into; it may still be a source."""
    return F.when(transport == "docker", "docker can't be enumerated")


def _unescape(text: Column) -> Column:
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def parse_remote_spec(spec: Column) -> Column:
    """``struct<kind, host, port, user, transport, path, error>`` of ``oci:<path>``, ``file-server:<http url>`` or
    ``ssh://[user@]host[:port][/transport[:path]]``; ssh without a transport means containers-storage.

    Of user information only the name is returned. Fields are null where they don't apply or with an error.
    """
    oci, server, ssh = (F.startswith(spec, F.lit(x)) for x in ("oci:", "file-server:", "ssh://"))
    url = F.substr(spec, F.lit(13))
    # user information ends at the last @ of the authority, a host may stand in brackets
    pattern = r"^[A-Za-z]+://(?:([^/?#]*)@)?(\[[^\]/?#]*\]|[^\[\]:/@?#]*)(?::([0-9]*))?(?:/([^?#]*))?(?:[?#].*)?$"
    get = lambda c, n: F.regexp_extract(c, pattern, n)
    formed = lambda c: c.rlike(pattern) & ~c.rlike(r"[\x00-\x20\x7f]")
    host = F.regexp_replace(get(spec, 2), r"^\[|\]$", "")
    port = F.nullif(get(spec, 3), F.lit(""))
    nested = _unescape(get(spec, 4))
    name = F.when(nested == "", "containers-storage").otherwise(F.split_part(nested, F.lit(":"), F.lit(1)))
    arg = F.when(F.instr(nested, ":") > 0, F.substr(nested, F.instr(nested, ":") + 1)).otherwise("")
    error = (
        F.when(F.coalesce(spec, F.lit("")) == "", "empty spec")
        .when(oci, F.when(spec == "oci:", "oci needs a path"))
        .when(server, F.when(~F.lower(url).rlike("^https?:"), "file server needs an http or https address").when(F.lower(url).rlike("^https?://") & ~formed(url), "bad address"))
        .when(ssh, F.when(~formed(spec) | nested.isNull(), "bad ssh address").when(host == "", "no host").when(port.isNotNull() & port.try_cast("bigint").isNull(), "bad port")
              .when(~name.isin("containers-storage", "docker-daemon", "oci"), "unsupported transport").when((name == "oci") & (arg == ""), "oci needs a path")
              .when((name != "oci") & (arg != ""), "transport takes no argument"))
        .otherwise("unknown remote")
    )
    kind = F.when(oci, "local-dir").when(server, "file-server").when(ssh, "ssh")
    ok = error.isNull()
    user = F.nullif(_unescape(F.split_part(get(spec, 1), F.lit(":"), F.lit(1))), F.lit(""))
    path = F.when(oci, F.substr(spec, F.lit(5))).when(server, url).when(ssh & (name == "oci"), arg)
    fields = (("kind", kind), ("host", F.when(ssh, host)), ("port", F.when(ssh, port.try_cast("bigint"))), ("user", F.when(ssh, user)), ("transport", F.when(ssh, name)), ("path", path))
    return F.struct(*[F.when(ok, c).alias(n) for n, c in fields], error.alias("error"))
