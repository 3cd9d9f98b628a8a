"""Registered queries of the scalar functions and reports, over texts made of the test tables, hostile ones included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyport.functions import commands, text
from tallyport.operators import transfer
from tallyport.sources import store

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(key: str, forms: list) -> Column:
    """The form whose turn it is, by the key."""
    n = F.col(key) % len(forms)
    return F.coalesce(*[F.when(n == i, F.lit(f) if isinstance(f, str) else f) for i, f in enumerate(forms)])


_REST = "regexp_extract(url, '^https?://(.*)$', 1)"


@query(f"""
with u as (select page_id, r, string_split(string_split(r, '?')[1], '#')[1] as base from (select page_id, {_REST} as r from pages)),
  a as (select page_id, r, base, string_split(base, '/')[1] as auth from u)
select page_id, case page_id % 5 when 4 then string_split(string_split(r, '?')[1], '#')[1]
  else 'https://' || case page_id % 5 when 0 then auth else string_split(auth, '@')[-1] end || substr(base, length(auth) + 1) end as u from a""")
def redact_hostile_url(spark, d):
    rest = F.regexp_extract("url", "^https?://(.*)$", 1)
    forms = [F.concat(F.lit("https://"), rest), F.concat(F.lit("https://u:p@"), rest), F.concat(F.lit("https://u:p@ss@"), rest), F.concat(F.lit("https://u@"), rest, F.lit("?token=a@b#c")), F.concat(rest, F.lit("#x"))]
    return _t(spark, d, "pages").select("page_id", text.redact_url(_turns("page_id", forms)).alias("u"))


@query("""
select p_partkey, case p_partkey % 8 when 0 then p_size::bigint * 1073741824 when 5 then p_size::bigint when 6 then p_size::bigint * 1000 end as bytes from part""")
def hostile_sizes(spark, d):
    n = F.col("p_size").cast("string")
    forms = [F.concat(F.lit("+"), n, F.lit("GiB")), F.concat(F.lit("99999999999"), n, F.lit("GiB")), F.concat(F.lit(" "), n, F.lit("MiB")), F.concat(n, F.lit(" MiB")), F.concat(F.lit("-"), n, F.lit("K")), F.concat(n, F.lit("B")), F.concat(n, F.lit("KB")), F.concat(n, F.lit(".5M"))]
    return _t(spark, d, "part").select("p_partkey", text.parse_size(_turns("p_partkey", forms)).alias("bytes"))


@query("""
with c as (select c_custkey as k, c_custkey % 14 as t, lower(c_mktsegment) as s, cast(c_custkey as varchar) as n from customer)
select k, case when t in (0, 1, 2, 3, 4) then 'ssh' when t in (5, 6) then 'file-server' when t = 7 then 'local-dir' end as kind, case when t = 4 then '::1' when t < 4 then s end as host,
  case when t in (2, 4) then k end as port, case when t in (2, 4) then 'u' end as "user", case when t in (0, 1) then 'containers-storage' when t in (2, 4) then 'oci' when t = 3 then 'docker-daemon' end as transport,
  case t when 2 then '/srv/' || n when 4 then 'a b' when 5 then 'https://' || s || '/b' when 6 then 'HTTP://u:p@' || s || ':90/b' when 7 then '/x/' || n end as path,
  case t when 8 then 'oci needs a path' when 9 then 'file server needs an http or https address' when 10 then 'no host' when 11 then 'unsupported transport' when 12 then 'transport takes no argument' when 13 then 'unknown remote' end as error from c""")
def remote_specs(spark, d):
    n, s = F.col("c_custkey").cast("string"), F.lower("c_mktsegment")
    j = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    forms = [j("ssh://", s), j("ssh://", s, "/containers-storage:"), j("ssh://u@", s, ":", n, "/oci:/srv/", n), j("ssh://", s, "/docker-daemon"), j("ssh://u:pw@x@[::1]:", n, "/oci:a%20b"), j("file-server:https://", s, "/b"), j("file-server:HTTP://u:p@", s, ":90/b"), j("oci:/x/", n), j("ssh://", s, "/oci:"), j("file-server:ftp://", s), "ssh:///x", j("ssh://", s, "/docker:"), j("ssh://", s, "/docker-daemon:", n), j("docker-daemon:", n)]
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), text.parse_remote_spec(_turns("c_custkey", forms)).alias("x"))
    return rows.select("k", "x.*")


@query("""
select c_custkey as k, case c_custkey % 7 when 0 then 'containers-storage' when 1 then 'docker-daemon' when 2 then 'docker' when 3 then 'oci' when 4 then 'oci' end as transport, case c_custkey % 7 when 3 then '/s/' || cast(c_custkey as varchar) when 4 then '' end as path,
  case c_custkey % 7 when 4 then 'oci needs a path' when 5 then 'unknown transport' when 6 then 'unknown transport' end as error, case c_custkey % 7 when 2 then 'docker can''t be enumerated' end as pull_error from customer""")
def local_specs(spark, d):
    forms = ["containers-storage", "docker-daemon:", "docker:", F.concat(F.lit("oci:/s/"), F.col("c_custkey").cast("string")), "oci:", "docker::", F.lower("c_mktsegment")]
    rows = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), text.parse_local_spec(_turns("c_custkey", forms)).alias("x"))
    return rows.select("k", "x.*", text.enumerable_error(F.col("x.transport")).alias("pull_error"))


_ENDS = "e as (select p_partkey as k, ['containers-storage', 'oci', 'docker', 'docker-archive', 'dir', 'docker-daemon', 'ftp', 'oci'][p_partkey % 8 + 1] as t, case when p_partkey % 16 = 0 then '' else 'h/' || lower(replace(p_brand, '#', '')) end as a, case when p_partkey % 8 = 7 or p_partkey % 3 = 0 then '' else 'v' || cast(p_size as varchar) end as b, p_size from part)"
_REF = "case when a = '' then null when t in ('oci') and b = '' then null when t = 'ftp' then null when t = 'docker' then 'docker://' || a when t in ('oci', 'docker-archive') and b <> '' then t || ':' || a || ':' || b else t || ':' || a end"


def _ends(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    t = _turns("p_partkey", ["containers-storage", "oci", "docker", "docker-archive", "dir", "docker-daemon", "ftp", "oci"])
    a = F.when(k % 16 == 0, "").otherwise(F.concat(F.lit("h/"), F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("")))))
    b = F.when((k % 8 == 7) | (k % 3 == 0), "").otherwise(F.concat(F.lit("v"), F.col("p_size").cast("string")))
    return _t(spark, d, "part").select(k.alias("k"), F.struct(t.alias("transport"), a.alias("arg1"), b.alias("arg2")).alias("e"), "p_size")


@query(f"with {_ENDS} select k, {_REF} as ref, case when a = '' then 'empty ref' when t = 'oci' and b = '' then 'empty tag' when t = 'ftp' then 'unknown transport' end as error from e")
def transport_refs(spark, d):
    return _ends(spark, d).select("k", commands.transport_ref(F.col("e.transport"), F.col("e.arg1"), F.col("e.arg2")).alias("x")).select("k", "x.*")


@query(f"""
with {_ENDS}, r as (select *, {_REF} as ref, 'oci:/d:v' as dst from e)
select k, case when ref is not null then 'copy' || case when p_size % 2 = 0 then ' --dest-compress-format zstd' || case when p_size % 3 = 0 then ' --dest-force-compress-format' else '' end else '' end
  || case when p_size % 5 <> 0 then ' --dest-compress-level ' || cast(p_size % 5 as varchar) else '' end || ' --dest-shared-blob-dir /s ' || ref || ' ' || dst end as push_args,
  case when ref is not null and (t = 'oci') then 'copy --src-shared-blob-dir /s ' || ref || ' docker-daemon:x' end as pull_args,
  case when a = '' then 'empty ref' when t = 'oci' and b = '' then 'empty tag' when t = 'ftp' then 'unknown transport' when t <> 'oci' then 'a shared pool needs an oci side' end as pull_error,
  case when ref is not null then 'inspect --raw ' || ref end as inspect_args from r""")
def copy_arguments(spark, d):
    end = lambda *x: F.struct(*[F.lit(v).alias(n) for n, v in zip(("transport", "arg1", "arg2"), x)])
    fmt, level, force = F.when(F.col("p_size") % 2 == 0, "zstd").otherwise(""), F.col("p_size") % 5, F.col("p_size") % 3 == 0
    push = commands.copy_args(F.col("e"), end("oci", "/d", "v"), F.lit("/s"), fmt, level, force)
    pull = commands.copy_args(F.col("e"), end("docker-daemon", "x", ""), F.lit("/s"), F.lit(""), F.lit(0), F.lit(False))
    line = lambda x: F.array_join(x, " ")
    inspect = commands.inspect_args(F.col("e"), F.lit(True), F.lit(""))
    return _ends(spark, d).select("k", line(push["args"]).alias("push_args"), line(pull["args"]).alias("pull_args"), pull["error"].alias("pull_error"), line(inspect["args"]).alias("inspect_args"))


@query("""
select c_custkey as k, case when t = 'oci' then 'oci:/o:' || i else t || ':' || i end as local_ref, t || ':' || i as dump_src, 'oci:/t:' || i as dump_dst
from (select c_custkey, 'h/' || lower(c_mktsegment) || ':v' || cast(c_custkey as varchar) as i, case when c_custkey % 3 = 0 then 'oci' else 'docker-daemon' end as t from customer)""")
def dump_arguments(spark, d):
    image = F.concat(F.lit("h/"), F.lower("c_mktsegment"), F.lit(":v"), F.col("c_custkey").cast("string"))
    t = F.when(F.col("c_custkey") % 3 == 0, "oci").otherwise("docker-daemon")
    own, dump = commands.local_ref(t, F.lit("/o"), image), commands.dump_refs(t, image, F.lit("/t"), F.lit("/s"))
    as_text = lambda x: F.array_join(F.filter(F.array(x["transport"], x["arg1"], x["arg2"]), lambda v: v != ""), ":")
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), as_text(own).alias("local_ref"), as_text(dump["src"]).alias("dump_src"), as_text(dump["dst"]).alias("dump_dst"))


@query("""
select c_custkey as k, case c_custkey % 6 when 0 then 'x --creds <redacted> y' when 1 then '--password=<redacted> ' || c_name when 2 then '--authfile <redacted> ' || c_name when 3 then '=' || c_name || ' --credsx ' || c_name
  when 4 then '--src-creds=<redacted> --dest-creds <redacted>' else '--creds <redacted> ' || c_name end as line,
  '''it''\\''''s'' ''' || c_name || '''' as quoted from customer""")
def argument_redaction(spark, d):
    name = F.col("c_name")
    a = lambda *x: F.array(*[F.lit(v) if isinstance(v, str) else v for v in x])
    forms = [a("x", "--creds", name, "y"), a(F.concat(F.lit("--password="), name), name), a("--authfile", name, name), a(F.concat(F.lit("="), name), "--credsx", name), a("--src-creds=a=b", "--dest-creds", name), a("--creds", "--password-stdin", name)]
    argv = F.coalesce(*[F.when(F.col("c_custkey") % 6 == i, f) for i, f in enumerate(forms)])
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.array_join(text.redact_argv(argv), " ").alias("line"), text.shell_quote(a("it's", name)).alias("quoted"))


@query("""
select c_custkey as k, case c_custkey % 4 when 3 then '[redacted header]' when 2 then 'X-Auth: [redacted]' else 'Authorization: [redacted]' end as shown, c_custkey % 4 in (0, 1) as authorized,
  case c_custkey % 4 when 0 then 'Authorization' when 1 then '  Authorization ' when 2 then 'X-Auth' end as name, case c_custkey % 4 when 0 then 'Bearer ' || c_name when 1 then ' a:b' when 2 then c_name end as value from customer""")
def headers(spark, d):
    forms = [F.concat(F.lit("Authorization: Bearer "), "c_name"), "  Authorization :  a:b", F.concat(F.lit("X-Auth:"), "c_name"), F.col("c_name")]
    h = _turns("c_custkey", forms)
    h2 = F.when(F.col("c_custkey") % 4 == 0, F.lower(h)).otherwise(h)
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), text.redact_header(h).alias("shown"), text.has_authorization(F.array(F.lit("A: b"), h2)).alias("authorized"), text.split_header(h).alias("x")).select("k", "shown", "authorized", "x.name", "x.value")


@query("""
with s as (select s_suppkey as k, case when s_suppkey % 5 = 0 then s_name else '' end as n, case when s_suppkey % 3 = 0 then '' else 'u' || cast(s_nationkey as varchar) end as u, 'h' || cast(s_suppkey as varchar) as h, case s_suppkey % 4 when 0 then 22 when 1 then 0 else 2000 + s_suppkey end as p, case when s_suppkey % 7 = 0 then '/c' else '' end as c from supplier),
  t as (select *, case when u = '' then h else u || '@' || h end as login, p not in (0, 22) as own from s)
select k, case when n <> '' then n when own then login || ':' || cast(p as varchar) else login end as target,
  case when c <> '' then '-F /c ' else '' end || case when n <> '' then n when own then '-p ' || cast(p as varchar) || ' ' || login else login end as args,
  case when c <> '' then '-F /c ' else '' end || case when n <> '' then n when own then '-p ' || cast(p as varchar) || ' ' || login else login end || ' -n -o BatchMode=yes -o ServerAliveInterval=15 -o ServerAliveCountMax=3' as command from t""")
def ssh_targets(spark, d):
    k = F.col("s_suppkey")
    name, user = F.when(k % 5 == 0, F.col("s_name")).otherwise(""), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("u"), F.col("s_nationkey").cast("string")))
    host, port, config = F.concat(F.lit("h"), k.cast("string")), F.when(k % 4 == 0, 22).when(k % 4 == 1, 0).otherwise(k + 2000), F.when(k % 7 == 0, "/c").otherwise("")
    line = lambda x: F.array_join(x, " ")
    return _t(spark, d, "supplier").select(k.alias("k"), commands.ssh_target(name, user, host, port).alias("target"), line(commands.ssh_args(name, user, host, port, config)).alias("args"), line(commands.ssh_command_args(name, user, host, port, config)).alias("command"))


@query("""
select event_id, case event_type when 'error' then 8 end as level, case when event_id % 3 = 0 then 'json' when event_id % 3 = 1 then 'text' end as format, upper(event_type) || '_LOG' as prefix, cast(user_id as varchar) as value from events""")
def log_settings(spark, d):
    fmt = _turns("event_id", ["JSON", "Text", "xml"])
    env = F.array(F.lit("A=0"), F.concat(F.lit("AB="), "event_type"), F.concat(F.lit("A="), F.col("user_id").cast("string")), F.lit("A"))
    return _t(spark, d, "events").select("event_id", commands.log_level(F.upper("event_type")).alias("level"), commands.log_format(fmt).alias("format"), commands.env_prefix(F.concat("event_type", F.lit("-log"))).alias("prefix"), commands.lookup_env(env, "A").alias("value"))


@query("""
with t as (select p_partkey as k, cast(p_size as varchar) as s, p_size from part)
select k, k % 6 not in (4, 5) as valid, k % 6 = 3 as devel, case k % 6 when 1 then 'a/b' else '' end as prefix,
  case k % 6 when 1 then 'a/b/v1.2.' || cast(p_size + 1 as varchar) || '-devel' when 4 then null when 5 then 'v1.2.' || cast(p_size + 1 as varchar) || '-devel' else 'v1.2.' || cast(p_size + 1 as varchar) || '-devel' end as next_dev,
  'package x' || chr(10) || 'const Version = "v' || s || '"' || chr(10) as source from t""")
def release_tags(spark, d):
    s = F.col("p_size").cast("string")
    forms = [F.concat(F.lit("v1.2."), s), F.concat(F.lit("a/b/v1.2."), s), F.concat(F.lit("v1.2."), s, F.lit("-rc.1")), F.concat(F.lit("v1.2."), s, F.lit("-devel")), F.concat(F.lit("v1."), s), F.concat(F.lit("1.2."), s)]
    tag = _turns("p_partkey", forms)
    source = commands.rewrite_version(F.lit('package x\nconst  Version  = "old"\n'), F.concat(F.lit("v"), s))
    rows = _t(spark, d, "part").select(F.col("p_partkey").alias("k"), tag.alias("tag"), source.alias("source"))
    return rows.select("k", commands.is_release_tag(F.col("tag")).alias("valid"), commands.is_devel(F.col("tag")).alias("devel"), commands.split_tag(F.col("tag"))["prefix"].alias("prefix"), commands.next_dev(F.col("tag")).alias("next_dev"), "source")


@query("""
select doc_id, 'p/q/images/h/' || source || '/_tags/t' || cast(doc_id as varchar) || '.json' as meta, 'images/h/a/_digests/' || sha256(text) || '.json' as digest_meta, 'share/sha256/' || sha256(text) as blob,
  case when doc_id % 2 = 0 then '/x/' || lang || '/app' when doc_id % 3 = 0 then null else '/home/' || lang || '/.local/share/app' end as base, case when doc_id % 2 = 1 and doc_id % 3 = 0 then 'no home' end as base_error from documents""")
def store_paths(spark, d):
    hex_ = F.sha2(F.col("text").cast("binary"), 256)
    base = text.base_dir(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("/x/"), "lang")), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("/home/"), "lang")), "app")
    meta = text.meta_name(F.lit("p/q//"), F.lit("h"), F.col("source"), F.concat(F.lit("t"), F.col("doc_id").cast("string")), F.lit(""))
    return _t(spark, d, "documents").select("doc_id", meta.alias("meta"), text.meta_name(F.lit(""), F.lit("h"), F.lit("a"), F.lit(""), hex_).alias("digest_meta"), text.blob_path(text.digest_of(F.col("text").cast("binary"))).alias("blob"), base["path"].alias("base"), base["error"].alias("base_error"))


@query("""
select doc_id, case doc_id % 4 when 0 then 'malformed digest' when 1 then 'digest mismatch' end as error, case when doc_id % 4 <> 0 then 'sha256' end as algo, case doc_id % 4 when 0 then null when 1 then repeat('0', 64) else sha256(text) end as hex from documents""")
def verified_blobs(spark, d):
    content = F.col("text").cast("binary")
    digest = _turns("doc_id", [F.concat(F.lit("sha256:"), F.upper(F.sha2(content, 256)), F.lit("0")), "sha256:" + "0" * 64, text.digest_of(content), text.digest_of(content)])
    x = text.split_digest(digest)
    return _t(spark, d, "documents").select("doc_id", text.digest_error(content, digest).alias("error"), x["algo"].alias("algo"), x["hex"].alias("hex"))


@query("select doc_id, lower(hex(array_slice(encode(text), greatest(octet_length(encode(text)) - 15, 1), octet_length(encode(text))))) as last from documents")
def tail_bytes(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.lower(F.hex(text.tail(F.col("text"), 16))).alias("last"))


@query("""
select doc_id, coalesce(case when quality = 1 then 'e' || cast(d.doc_id as varchar) end, case when lang = 'en' then '' end, 'containers-storage') as local, coalesce(case when quality = 1 then 0 end, case when lang = 'en' then 3 end, 20) as level,
  case when quality = 1 and toxic = 0 then '[REDACTED]' else '' end as auth, case when lang = 'en' then 'x' else 'a,b' end as headers
from documents d left join labels using (doc_id)""")
def config_layers(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "lang").join(_t(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    env = F.when(F.col("quality") == 1, F.concat(F.lit('{"local":"e'), F.col("doc_id").cast("string"), F.lit('","compression":{"level":0},"fileServer":{"auth":"'), F.when(F.col("toxic") == 0, "secret").otherwise(""), F.lit('"}}')))
    file = F.when(F.col("lang") == "en", '{"local":"","compression":{"level":3},"fileServer":{"headers":["x"]},"other":1}')
    default = F.lit('{"local":"containers-storage","compression":{"level":20},"fileServer":{"auth":"","headers":["a","b"]}}')
    rows = rows.select("doc_id", *[store.config_layer(c).alias(n) for n, c in (("env", env), ("file", file), ("base", default))])
    leaf = lambda path: transfer.overlay(*[F.col(f"{layer}.{path}") for layer in ("env", "file", "base")])
    server = text.redact_config(F.struct(leaf("fileServer.auth").alias("auth"), leaf("fileServer.headers").alias("headers")))
    return rows.select("doc_id", leaf("local").alias("local"), leaf("compression.level").alias("level"), server["auth"].alias("auth"), F.array_join(server["headers"], ",").alias("headers"))


def _reports(spark, d) -> DataFrame:
    rows = _t(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("h/i:"), F.col("o_orderkey").cast("string")).alias("ref"), (F.col("o_orderkey") % 5).alias("sent"), (F.col("o_orderkey") % 3).alias("reused"), (F.col("o_custkey") * 10).alias("bytes"), (F.col("o_orderstatus") == "O").alias("dry_run"))
    return rows.withColumn("error", F.when(F.col("pos") % 7 == 0, F.concat(F.lit("blob "), F.col("pos").cast("string"))))


@query("""
select o_orderkey as pos, case when o_orderkey % 7 = 0 then 'h/i:' || o_orderkey || ' ERROR: blob ' || o_orderkey else case when o_orderstatus = 'O' then 'DRY-RUN would: ' else '' end
  || 'h/i:' || o_orderkey || ' pulled (new: ' || o_orderkey % 5 || ', reused: ' || o_orderkey % 3 || ', bytes: ' || o_custkey * 10 || ')' end as line from orders""")
def report_lines(spark, d):
    return transfer.argument_order(transfer.report_lines(_reports(spark, d), "pulled")).select("pos", "line")


@query("select count(*) as failed from orders where o_orderkey % 7 = 0")
def failed_count(spark, d):
    return transfer.failed_count(_reports(spark, d))


@query("""
select img, k, cast(sum(size) over (partition by img order by k rows between unbounded preceding and current row) as bigint) as done from (select distinct l_orderkey as img, l_partkey as k, l_partkey % 97 + 1 as size from lineitem)""")
def running_bytes(spark, d):
    plan = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("img"), F.col("l_partkey").alias("k"), (F.col("l_partkey") % 97 + 1).alias("size")).distinct()
    return transfer.running_bytes(plan, "img", "k", "size").select("img", "k", "done")


@query("""
select c_custkey as k, case when n = 0 then 'no images' when t = '' then 'no transport' when b = '' then 'no store' when ro then 'peer is read-only' end as push_error,
  case when n = 0 then 'no images' when t = '' then 'no transport' when b = '' then 'no store' end as pull_error
from (select c_custkey, c_custkey % 4 as n, case when c_custkey % 5 = 0 then '' else 'oci' end as t, case when c_custkey % 6 = 0 then '' else '/b' end as b, c_custkey % 7 = 0 as ro from customer)""")
def request_checks(spark, d):
    k = F.col("c_custkey")
    images = F.array_repeat(F.lit("i"), (k % 4).cast("int"))
    args = images, F.when(k % 5 == 0, "").otherwise("oci"), F.when(k % 6 == 0, F.lit(None)).otherwise("/b"), k % 7 == 0
    return _t(spark, d, "customer").select(k.alias("k"), transfer.request_error("push", *args).alias("push_error"), transfer.request_error("pull", *args).alias("pull_error"))


@query("""
select o_orderkey as img, cast(coalesce(m, 100) as bigint) as chunk_size from (
  select o_orderkey, arg_max(l_quantity, (l_linenumber, l_partkey, l_suppkey, l_quantity)) as m from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey)""")
def chunk_sizes(spark, d):
    said = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("digest"), F.col("l_quantity").cast("bigint").alias("chunk_size"), F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("seq"))
    rows = transfer.chunk_size_of(_t(spark, d, "orders").select(F.col("o_orderkey").alias("digest")), said, 100)
    return rows.select(F.col("digest").alias("img"), "chunk_size")


@query("""
select c_custkey as k, case when c_custkey % 5 = 0 then 'complete' when c_custkey % 5 = 1 then 'wrong size' when c_custkey % 5 = 2 and c_nationkey > 0 then 'partial' else 'absent' end as status,
  case when c_custkey % 5 = 0 then 100 when c_custkey % 5 = 1 then 99 when c_custkey % 5 = 2 and c_nationkey > 0 then c_nationkey end as current_size from customer""")
def blob_states(spark, d):
    k = F.col("c_custkey") % 5
    x = transfer.blob_state(F.when(k == 0, 100).when(k == 1, 99), F.when(k == 2, F.col("c_nationkey")).when(k == 3, 100 + F.col("c_nationkey")), F.lit(100))
    return _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), x["status"].alias("status"), x["current_size"].alias("current_size"))
