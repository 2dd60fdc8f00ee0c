"""Queries against their SQL on small tables of odd content."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry


def both(spark, folder, name, **tables):
    """The rows of the query and of its SQL over the tables, in one order of columns."""
    con = duckdb.connect()
    for table, df in tables.items():
        path = f"{folder}/{table}.parquet"
        con.register("df", df)
        con.execute(f"COPY df TO '{path}' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    got = entry.queries()[name](spark, str(folder))
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    same = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    return same(got.select(*names).collect()), same(want.fetchall())


def lineitems():
    """Prices of three years: quiet ones, and ones that double and halve now and then."""
    days = pd.bdate_range("1998-01-01", "2000-12-29")
    i = np.arange(len(days))
    jumpy = np.where(i % 17 < 3, 2.0, 1.0)
    price = {"quiet": 100 + np.sin(i), "jumpy": (100 + np.cos(i)) * jumpy}
    return pd.concat([pd.DataFrame({"l_returnflag": k, "l_shipdate": days.astype("datetime64[us]"), "l_extendedprice": v.round(2), "l_quantity": 1.0}) for k, v in price.items()])


@pytest.mark.parametrize("name", ["pattern_evidence", "gate_without_interval"])
def test_rules_where_one_series_has_no_shock(spark, tmp_path, name):
    got, want = both(spark, tmp_path, name, lineitem=lineitems())
    assert got == want and {r[0] for r in got} == {"quiet", "jumpy"}
    if name == "pattern_evidence":
        assert all(r[-1] is None for r in got if r[0] == "quiet") and all(r[-1] is not None for r in got if r[0] == "jumpy")
    else:
        assert all("train_lift" in r[2] for r in got if r[0] == "quiet")


def test_named_characters_without_a_semicolon_and_wide_blanks(spark, tmp_path):
    body = ["Cut &amp;&amp</h1><p>a &lt;b&gt; &quot;c&quot", "x &am</h1><p>&amp;amp; &copy 2024 &middot&copy;", "one\u2028two\x85\u00a0three\u3000</h1><p>\u2003", "&amp;quot; &ampquot;"]
    pages = pd.DataFrame({"page_id": range(len(body)), "html": [f"<html><body><article><h1>{b}</p></article></body></html>" for b in body]})
    got, want = both(spark, tmp_path, "page_text", pages=pages)
    assert got == want
