"""Closures of all roots keep every account and predecessor, beyond the 3,000 and 64 that bound one request."""

import random

import pytest

import __spark_entry__ as entry
from loomlake.operators import graph as G

from .test_records import walk

CUSTOMERS = 3601


def wide_tables(folder):
    """Customer 0 endorses and follows over 3,000 others; 90 accounts that customer 1 reaches lead to customer 3000."""
    import duckdb

    orders = {6 * k: 0 for k in range(1, 3801)}  # customer of an order; subjects of keys that differ by less than 6 * 3601 differ
    inverse31, inverse17 = pow(31, -1, CUSTOMERS), pow(17, -1, CUSTOMERS)
    keys = iter(range(1, 1 << 30))

    def add(customer, residue):
        """An order of `customer` with a new key that is `residue` modulo the customers and counts in both tables."""
        for k in keys:
            o = residue + CUSTOMERS * k
            if o % 6 == 0 and o % 17 and o % 19 and o % 23 and o % 31 and o not in orders:
                orders[o] = customer
                return

    for a in range(100, 190):
        add(1, (a - 7) * inverse31 % CUSTOMERS)
        add(1, (a - 1) * inverse17 % CUSTOMERS)
        add(a, (3000 - 7) * inverse31 % CUSTOMERS)
        add(a, (3000 - a) * inverse17 % CUSTOMERS)
    orders |= {k: 200 + k for k in range(1, 6)}  # each badge definition is there
    db = duckdb.connect()
    db.execute("create table orders (o_orderkey bigint, o_custkey bigint)")
    db.executemany("insert into orders values (?, ?)", list(orders.items()))
    db.execute(f"create table customer as select k as c_custkey, 'name' || k as c_name from range({CUSTOMERS}) t(k)")
    for table in ("orders", "customer"):
        db.execute(f"copy {table} to '{folder}/{table}.parquet' (format parquet)")
    return db


@pytest.mark.parametrize("name", ["closure_all_roots", "closure_every_root", "closure_follows", "closure_profiles"])
def test_every_account_and_predecessor(spark, tmp_path, name):
    pytest.importorskip("duckdb")
    db = wide_tables(tmp_path)
    got = entry.queries()[name](spark, str(tmp_path))
    want = db.execute(entry.oracle_sql()[name])
    assert [c[0] for c in want.description] == got.columns
    want = want.fetchall()
    accounts = {}
    for r in want:
        accounts[r[0]] = accounts.get(r[0], 0) + 1
    at = got.columns.index("n_via" if "n_via" in got.columns else "via")
    assert max(accounts.values()) > G.MOST_ACCOUNTS and max(r[at] if isinstance(r[at], int) else r[at].count(",") + 1 for r in want) > G.MOST_VIA
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("piece", [1 << 20, 12])
@pytest.mark.parametrize("degree", [1, 2, 3])
def test_whole_closure_equals_walk(spark, monkeypatch, piece, degree):
    """Also with issuers dealt over pieces, by their edges and by the roots that meet them."""
    monkeypatch.setattr(G, "PIECE", piece)
    rnd = random.Random(5)
    edges = sorted({(f"n{rnd.randrange(40):02d}", f"n{rnd.randrange(40):02d}") for _ in range(90)} | {("n39", f"leaf{k:02d}") for k in range(70)} | {(f"n{k:02d}", "n38") for k in range(30)} | {("n38", "n39"), ("n00", "")})
    roots = [f"n{k:02d}" for k in range(40)] + ["nobody", "n00"]
    found = G.whole_closure(spark.createDataFrame([*edges, *edges], "issuer string, subject string"), spark.createDataFrame([(r,) for r in roots], "did string"), degree).collect()
    by = {}
    for r in found:
        by.setdefault(r["root"], []).append((r["did"], r["degree"], tuple(r["via"])))
    want = {r: walk(edges, r, degree, 1 << 20, 1 << 20)[0] for r in roots}
    assert {r: sorted(x) for r, x in by.items()} == {r: x for r, x in want.items() if x}


def test_an_issuer_of_many_rows_is_split(spark, tmp_path, monkeypatch):
    """Of a hub no key of the join holds much more than a piece, whichever side is long; the rows are those of a plain join."""
    monkeypatch.setattr(G, "PIECE", 200)
    frontier = [(f"r{k}", "wide") for k in range(3)] + [(f"r{k}", "met") for k in range(900)] + [("r1", "low")]
    edges = [("wide", f"s{k}") for k in range(1000)] + [("met", f"s{k}") for k in range(2)] + [("low", "s1"), ("unmet", "s2")]
    rows = G.ring_edges(spark.createDataFrame(frontier, "root string, issuer string"), spark.createDataFrame(edges, "issuer string, subject string"), str(tmp_path / "w"))
    assert sorted(map(tuple, rows.collect())) == sorted((r, i, s) for r, i in frontier for j, s in edges if i == j)
    wide = {r["issuer"]: (r["by_edge"], r["pieces"]) for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    assert wide == {"wide": (True, 15), "met": (False, 9)}
