import duckdb
import pytest

import __spark_entry__ as entry
from quiltrel import catalogue

D = "/root/testdata/sf0.001"


# the ticks of one plan of each discipline; test_nodes.py holds the others
@pytest.mark.parametrize("name", [n for n in catalogue.ORACLES if not n.startswith("stream") or n == "stream_anti_join_ticks"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("nation", "region", "customer", "supplier", "orders", "lineitem", "part", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    df = entry.queries()[name](spark, D)
    want = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    text = lambda rs: sorted(tuple(map(str, r)) for r in rs)
    expected = want.fetchall()
    assert text(df.select(*(f"`{c}`" for c in cols)).collect()) == text(expected)


def test_absence_is_witnessed_by_the_whole_right_side(spark):
    rows = catalogue.QUERIES["why_absence_witness"](spark, D).collect()
    nation = duckdb.sql(f"SELECT n_nationkey, n_regionkey FROM read_parquet('{D}/nation.parquet') WHERE n_regionkey >= 2").fetchall()
    assert {(r.n_nationkey, r.n_regionkey) for r in rows} == set(nation)
    marks = [set(r.w.split("|")) for r in rows]
    assert all(len(m) == 2 for m in marks) and len(set.intersection(*marks)) == 1


def test_address_of_a_table_is_stable(spark):
    a, b = (catalogue.QUERIES["relation_address"](spark, D).first().address for _ in range(2))
    assert a == b and a.startswith("sha256:")
