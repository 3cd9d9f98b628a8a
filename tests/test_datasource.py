import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull
from pyspark.sql.types import StructType

from tallyport.operators import manifests
from tallyport.sources import datasource, store
from tallyport.streaming import commit

from test_moving import image, put, sha


def read(spark, root, part, schema=None, **options):
    datasource.register(spark)
    source = spark.read.format("tallyport").option("part", part).options(**options)
    return (source.schema(schema) if schema else source).load(str(root))


def test_parts_as_the_readers_give_them(spark, tmp_path):
    image(tmp_path, "h/a/_tags/t", [b"one", b"two"])
    image(tmp_path, "h/b/_digests/" + "d" * 64, [b"two"])
    (tmp_path / "share/sha256" / ("a" * 64 + ".part")).write_bytes(b"x")
    same = lambda a, b: sorted(map(repr, map(tuple, a.collect()))) == sorted(map(repr, map(tuple, b.collect())))
    pool, dumps = read(spark, tmp_path, "pool"), read(spark, tmp_path, "dumps", tasks="2")
    assert same(pool, store.read_pool(spark, str(tmp_path))) and same(dumps, store.read_dumps(spark, str(tmp_path)))
    assert {r.error for r in manifests.read_manifests(dumps, pool).collect()} == {None}
    assert read(spark, tmp_path / "none", "pool").count() == 0 and read(spark, tmp_path / "none", "dumps").count() == 0


def test_filters_and_columns_are_pushed(spark, tmp_path):
    put(tmp_path, b"one", b"two", b"three")
    names = read(spark, tmp_path, "pool", "digest string, length bigint")
    assert names.columns == ["digest", "length"] and names.count() == 3
    asked = names.where(F.col("digest").isin(sha(b"two"), sha(b"none"), "sha256:../../x"))
    assert [tuple(r) for r in asked.collect()] == [(sha(b"two"), 3)]
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "- Filter" not in plan and ") Filter" not in plan and "BatchScan tallyport[digest" in plan  # the source took the filter
    assert names.where(F.col("digest") == sha(b"one")).where(F.col("length") > 5).count() == 0
    reader = datasource.StoreReader({"path": str(tmp_path)}, StructType.fromDDL(datasource.SCHEMAS["pool"]))
    kept = list(reader.pushFilters([In(("digest",), (sha(b"one"), sha(b"two"))), IsNotNull(("digest",)), EqualTo(("digest",), sha(b"two")), EqualTo(("length",), 3)]))
    assert len(kept) == 2 and [p.value for p in reader.partitions()] == [(sha(b"two"),)]
    image(tmp_path, "h/a/_tags/t", [b"one"])
    image(tmp_path, "h/a/_tags/u", [b"one"])
    one = read(spark, tmp_path, "dumps").where("ref = 'h/a/_tags/u'")
    assert [r.ref for r in one.collect()] == ["h/a/_tags/u"] and read(spark, tmp_path, "dumps").where("ref in ('h/../h/a/_tags/u', 'h/a/_tags/v')").count() == 0
    with pytest.raises(Exception):
        read(spark, tmp_path, "pool", "digest string, nothing string").count()


def test_arrivals_stream_into_commits(spark, tmp_path):
    datasource.register(spark)
    root, out = tmp_path / "s", []
    _, tags = image(root, "h/a/_tags/t", [b"one"])
    store.write_pointer(str(root), "h/b/_tags/t", "index.json", b"{}")
    old = time.time() - 60
    for d, _, names in os.walk(root):
        for n in names:
            os.utime(os.path.join(d, n), (old, old))

    def run():
        rows = spark.readStream.format("tallyport").option("part", "arrivals").load(str(root)).withColumn("body", F.col("body").cast("string"))
        query = commit.start_commits(rows, lambda df: out.extend(r.ref for r in df.collect()), str(tmp_path / "c"), available_now=False)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        got, out[:] = sorted(out), []
        return got

    assert run() == ["h/a/_tags/t"]
    store.write_pointer(str(root), "h/b/_tags/t", "oci-layout", b"{}")
    os.utime(root / "h/b/_tags/t/oci-layout", (old + 30, old + 30))
    assert run() == ["h/b/_tags/t"] and run() == []
