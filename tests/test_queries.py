"""Queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHOSEN = "win01 win04 win07 win08 agg02 agg04 agg08 agg11 agg23 flt03 flt14 joi08 set02 scl01 scl05 scl15 scl27 snk07 opt05 cnd02 cnd04 shp05 ipa09 gra01 gra23 lif06 str04 src05 cgr01 snk03 flw01 flw11 cdg01 b301 udx05 audit_all joi07_ids flw04 flw07 flw08 opt02 opt03 opt04_backward gra29 shp04 shp06 shp08 dfi05 gra22 opt08 pts07 src13 str05 gra06 lif04 ipa02 b706 udx03".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bool):
        return int(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")
@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, oracle, name):
    frame = entry.queries()[name](spark, SF)
    got = frame.collect()
    found = oracle.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    want = [tuple(plain(v) for v in r) for r in found.fetchall()]
    assert sorted((tuple(plain(r[n]) for n in names) for r in got), key=repr) == sorted(want, key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
