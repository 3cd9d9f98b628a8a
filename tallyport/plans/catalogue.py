"""The registered queries: the library's operators over the test tables, which hold no image store.

An order stands for an image and ``l_partkey`` for a layer's digest; a document is a blob, a conversation's turns are
chunks, events are per-item outcomes and page addresses are endpoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyport.functions import documents, refs, text
from tallyport.operators import transfer
from tallyport.plans import images, oracle, stores, words  # stores adds its queries to those of images


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _str(c: str) -> Column:
    return F.col(c).cast("string")


def blob_inventory(spark, d):
    return _t(spark, d, "documents").select("doc_id", text.digest_of(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").cast("bigint").alias("size"))


def transfer_plan(spark, d):
    lines = _t(spark, d, "lineitem").select("l_returnflag", F.col("l_partkey").alias("k"))
    pinned = _t(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("k"))
    return transfer.transfer_set(lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'N'"), pinned, "k")


def push_report(spark, d):
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("img"), F.col("l_partkey").alias("k"), "l_returnflag")
    need = lines.where("l_returnflag <> 'N'").select("img", "k").distinct().withColumn("sz", (F.col("k") % 97 + 1).cast("bigint"))
    return transfer.image_report(need, lines.where("l_returnflag = 'N'").select("k"), "img", "k", "sz")


def redact_url(spark, d):
    return _t(spark, d, "pages").select("page_id", text.redact_url(F.col("url")).alias("u"))


def endpoint_parts(spark, d):
    return _t(spark, d, "pages").select("page_id", text.url_host(F.col("url")).alias("host"), text.url_path(F.col("url")).alias("path"))


def chunk_layout(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", text.digest_of(F.col("text").cast("binary")).alias("digest"), F.octet_length("text").cast("bigint").alias("sz"))
    rows = transfer.chunk_rows(docs, "sz", 1000)
    return rows.select("doc_id", "i", text.chunk_name(F.lit(""), F.col("digest"), F.col("i")).alias("name"), "len")


def resume_offset(spark, d):
    chunks = _t(spark, d, "conversations").select("conv_id", F.expr("turn + turn div 3").alias("i"), F.length("text").alias("len"))  # every third chunk leaves a gap
    return transfer.chunk_state(chunks, "conv_id", "i", "len")


def fail_fast_cut(spark, d):
    events = _t(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    return transfer.until_first_error(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id")


def json_field(spark, d):
    return _t(spark, d, "events").select("event_id", documents.count_at(F.col("props"), "$.k").alias("k"))


def pool_dedup(spark, d):
    return transfer.pool_copies(blob_inventory(spark, d), "doc_id").withColumnRenamed("first", "first_doc")


def first_occurrence(spark, d):
    events = _t(spark, d, "events").select("user_id", "event_type", "event_id")
    return transfer.first_occurrence(events, ["user_id", "event_type"], "event_id")


def plan_order(spark, d):
    plan = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("img"), _str("l_partkey").alias("k")).distinct()
    return transfer.plan_order(plan, "img", "k").select("img", "ordinal", "k")


def have_union(spark, d):
    closures = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("k"))
    return transfer.union_keys(closures, _t(spark, d, "part").select(F.col("p_size").cast("bigint")), _t(spark, d, "supplier").select("s_suppkey"))


def assume_override(spark, d):
    need = _t(spark, d, "lineitem").select(F.col("l_partkey").alias("k"))
    return transfer.transfer_set(need, transfer.have_set(need, assumed_keys=[1, 5, 9, 100], key="k"), key="k")


def dry_run_vs_real(spark, d):
    need = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("img"), F.col("l_partkey").alias("k"))
    return transfer.dry_and_real(need, "img", "k")


def dangling_audit(spark, d):
    closures = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("img"), F.col("l_partkey").alias("k"))
    return transfer.dangling(closures, _t(spark, d, "part").where("p_size < 40").select(F.col("p_partkey").alias("k")), "img", "k")


def accumulate_commit(spark, d):
    events = _t(spark, d, "events").select("user_id", "event_type", "event_id")
    kind = F.col("event_type")
    return transfer.both_halves(events, "user_id", kind == "click", kind == "purchase", "event_id")


def latest_meta(spark, d):
    return transfer.latest(_t(spark, d, "events"), "user_id", "value", F.struct("ts", "event_id"), "v")


def complete_blobs(spark, d):
    return transfer.complete_blobs(_t(spark, d, "conversations"), "conv_id", F.length("text") >= 20)


def config_overlay(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", "lang").join(_t(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return rows.select("doc_id", transfer.overlay(F.when(F.col("quality") == 1, "env"), F.when(F.col("lang") == "en", "file"), F.lit("default")).alias("layer"))


def ref_parse(spark, d):
    n = F.col("page_id")
    ends = {0: F.lit(""), 1: F.concat(F.lit(":v"), _str("page_id")), 2: F.lit(":.bad"), 3: F.lit("@sha256:" + "a" * 64), 4: F.lit("@deadbeef"), 5: F.lit("/_tags/x:1"), 6: F.lit("/../x"), 7: F.lit(":"), 8: F.lit(":Tag-1_2.3")}
    end = F.coalesce(*[F.when(n % 9 == k, v) for k, v in ends.items()])
    pages = _t(spark, d, "pages").select(n.alias("i"), F.concat(F.regexp_extract("url", "^https?://([^?#]*)", 1), end).alias("s"))
    k, name, size = F.col("p_partkey"), F.col("p_name"), _str("p_size")
    made = {0: F.replace(name, F.lit(" "), F.lit("-")), 1: F.concat(F.lit("DOCKER.IO/"), F.replace(name, F.lit(" "), F.lit("/"))), 2: F.concat(F.lit("LOCALHOST/"), _str("p_partkey")), 3: F.concat(F.lit("localhost:"), size), 4: F.lit("nginx:1.0@sha256:" + "b" * 64), 5: F.concat(F.lit("reg.io:5000/"), F.replace(name, F.lit(" "), F.lit("/")), F.lit(":"), size)}
    parts = _t(spark, d, "part").select((k + 1000000).alias("i"), F.coalesce(*[F.when(k % 6 == x, v) for x, v in made.items()]).alias("s"))
    parsed = refs.parse_refs(pages.unionByName(parts), "s", "r")
    return parsed.select("i", F.coalesce("r.canonical", F.lit("")).alias("canonical"), F.coalesce("r.error", F.lit("")).alias("error"))


def chunk_size_parse(spark, d):
    ends = F.array(*[F.lit(x) for x in ("GiB", "MiB", "KiB", "GB", "MB", "KB", "G", "M", "K", "B", "", "Gi")])
    rows = _t(spark, d, "part").select("p_partkey", F.concat(_str("p_size"), F.get(ends, (F.col("p_partkey") % 12).cast("int"))).alias("s"))
    return rows.withColumn("bytes", text.parse_size(F.col("s")))


def marker_path_parse(spark, d):
    dump = text.dump_dir(F.lit("reg.io"), F.concat(F.lower("c_mktsegment"), F.lit("/n"), _str("c_nationkey")), F.concat(F.lit("v"), _str("c_custkey")), F.lit(""))
    rows = _t(spark, d, "customer").select("c_custkey", text.parse_dump_dir(dump).alias("x"))
    return rows.select("c_custkey", "x.host", "x.repo", "x.leaf")


def size_lookup(spark, d):
    lines = _t(spark, d, "lineitem").where("l_quantity > 10")
    order = F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    sizes = transfer.latest(lines.withColumn("sz", F.col("l_quantity").cast("bigint") - 10), "l_partkey", "sz", order, "sz")
    rows = _t(spark, d, "part").select("p_partkey").join(sizes, F.col("p_partkey") == F.col("l_partkey"), "left")
    return rows.select("p_partkey", F.coalesce("sz", F.lit(0)).cast("bigint").alias("sz"))


def skip_bad_items(spark, d):
    body = F.when(F.col("event_id") % 7 == 0, "{bad").otherwise(F.col("props"))
    return _t(spark, d, "events").select("event_id", documents.count_at(body, "$.k").alias("k")).where("k is not null")


def summary_line(spark, d):
    per = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("sent"), F.sum("l_quantity").cast("bigint").alias("bytes"))
    rows = per.withColumns({"ref": _str("l_orderkey"), "reused": F.lit(0), "dry_run": F.lit(False), "error": F.lit(None).cast("string")})
    return transfer.report_lines(rows).select("l_orderkey", "line")


QUERIES = images.QUERIES | words.QUERIES | {
    f.__name__: f
    for f in (
        blob_inventory, transfer_plan, push_report, redact_url, endpoint_parts, chunk_layout, resume_offset, fail_fast_cut, json_field,
        pool_dedup, first_occurrence, plan_order, have_union, assume_override, dry_run_vs_real, dangling_audit, accumulate_commit, latest_meta,
        complete_blobs, config_overlay, ref_parse, chunk_size_parse, marker_path_parse, size_lookup, skip_bad_items, summary_line,
    )
}
SQL = oracle.SQL | images.SQL | words.SQL
