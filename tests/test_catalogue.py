import os

import duckdb
import pytest

from tallyport.plans import catalogue

SF = "/root/testdata/sf0.001"
#: Queries that are run at the next size too, where several images share a manifest.
LARGER = ("image_view", "inspect_image", "image_manifests", "meta_commit", "transfer_actions", "strict_manifests", "chunk_conflicts")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name, sf", [(n, SF) for n in sorted(catalogue.QUERIES)] + [(n, "/root/testdata/sf0.01") for n in LARGER])
def test_query_matches_sql(spark, name, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = catalogue.QUERIES[name](spark, sf).toArrow()
    want = con.sql(catalogue.SQL[name])
    assert sorted(got.column_names) == sorted(want.columns)
    rows = sorted(map(repr, zip(*(got[c].to_pylist() for c in want.columns))))
    assert rows == sorted(map(repr, want.fetchall()))
